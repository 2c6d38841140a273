"""Each operator against brute force, an exact round trip, or known cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gabble.llm import (
    bpe, label_model, packing, repetition, secrets, simhash, token_rollup, toxicity, weighted_minhash, winnow,
)
from gabble.session import scratch_dir
from tests.llm import data

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def run(spark, name):  # on the smallest tables
    return entry.queries()[name](spark, FOLDER)


# 1 token counts


def test_rollup_matches_a_recount_without_copies(spark, texts, docs):
    tokens = data.reference_encoding()
    want, seen = Counter(), set()
    about = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    for i in sorted(texts):
        if texts[i] not in seen:
            seen.add(texts[i])
            want[about[i], "docs"] += 1
            want[about[i], "tokens"] += len(tokens.encode_ordinary(texts[i]))
    got = Counter()
    for r in run(spark, "op1_token_rollup").collect():
        assert r.tokenizer_version == "byte_bpe_50k"
        got[(r.source, r.lang), "docs"] = r.n_docs
        got[(r.source, r.lang), "tokens"] = r.n_tokens
    assert +got == +want


def test_commits_are_idempotent_and_broken_ones_are_redone(spark):
    folder = scratch_dir(spark, "rollup")
    rollup = token_rollup.Rollup(spark, folder)
    assert rollup.totals().collect() == [] and rollup.batches() == []
    rows = spark.createDataFrame([("s", "en", "v1", 1, 10), ("s", "en", "v1", 1, 5), (None, "en", "v1", 1, 7)], token_rollup.CHANGE)
    # What a broken run leaves: files without a marker.
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/batch=a")
    assert rollup.batches() == []
    assert rollup.commit("a", rows) and not rollup.commit("a", rows)
    revised = spark.createDataFrame([("s", "en", "v1", -1, 10), ("s", "en", "v2", 1, 12)], token_rollup.CHANGE)
    assert rollup.commit("b", revised)
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == sorted(
        [("s", "en", "v1", 1, 5), ("s", "en", "v2", 1, 12), (None, "en", "v1", 1, 7)], key=str)
    assert rollup.batches() == ["a", "b"]
    rollup.commit("c", spark.createDataFrame([("t", "fr", "v1", -1, 3)], token_rollup.CHANGE))
    assert ("t", "fr", "v1", -1, -3) in map(tuple, rollup.totals().collect())


# 2 secrets


def test_secrets_are_found_and_numbers_are_not(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {(i, m.group(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-fA-F]{40})"', t)}
    found = entry.queries()["op2_secret_scan"](spark, folder).collect()
    got = {(r.doc_id, texts[r.doc_id][r.start:r.end]) for r in found if r.is_secret}
    assert want and got == want
    assert {r.doc_id for r in found if not r.is_secret}
    assert all(r.value_sha256 == hashlib.sha256(texts[r.doc_id][r.start:r.end].encode()).hexdigest() for r in found)


def test_forest_learns_from_labelled_findings(spark):
    rng = random.Random(5)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(120)]
    texts = [(i, f'api_key = "{h}" end') for i, h in enumerate(hexes[:60])]
    texts += [(60 + i, f"commit sha {h} end") for i, h in enumerate(hexes[60:])]
    labels = spark.createDataFrame(
        [(h, 'api_key = "', '" end', "src", 1) for h in hexes[:30]] + [(h, "commit sha ", " end", "src", 0) for h in hexes[60:90]],
        "value string, before string, after string, path string, label int")
    got = {r.doc_id: r.is_secret for r in secrets.scan(data.frame(spark, texts), labels=labels).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 120))
    redacted = {r.doc_id: r.text for r in secrets.redact(data.frame(spark, texts), labels=labels).collect()}
    assert redacted[0] == 'api_key = "[SECRET]" end' and redacted[60] == texts[60][1]
    one_class = secrets.scan(data.frame(spark, texts), labels=labels.where("label = 0"))
    assert not any(r.is_secret for r in one_class.collect())


@pytest.mark.parametrize("text, value", [
    ("my_token = 'abc123def456'", "abc123def456"), ("aws_secret_key: Zx9/+kk1234567==", "Zx9/+kk1234567=="),
    ("API-KEY=q1w2e3r4t5", "q1w2e3r4t5"), ("see commit 0123456789abcdef0123", "0123456789abcdef0123")])
def test_candidates(text, value):
    assert [v for _, _, v, _, _ in secrets.find(text)] == [value]


# 3 byte-level BPE


def test_codec_equals_the_library(spark, texts):
    tokens = data.reference_encoding()
    cases = texts | {10_000 + i: t or "" for i, (_, t) in enumerate(data.TEXTS)}
    rng = random.Random(2)
    signs = " \n\t\r\x0b\x1c\x85\xa0　aabcé字½12'stre,.!$😀́"
    cases |= {20_000 + i: "".join(rng.choice(signs) for _ in range(rng.randrange(80))) for i in range(400)}
    frame = spark.createDataFrame(list(cases.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.digests(frame, data.RANKS, public_tokenizers.PATTERN).collect()}
    assert got.keys() == cases.keys()
    for i, text in cases.items():
        ids = tokens.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_then_decode_is_the_text(spark):
    encoded = bpe.encode(data.edge(spark), data.RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, data.RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t in data.TEXTS)


# 4 and 7 weak labels


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(1)
    truth = rng.random(6000) < 0.3
    accuracy = [0.95, 0.8, 0.7, 0.9]
    votes = np.stack([np.where(rng.random(6000) < a, truth, ~truth) * 2 - 1 for a in accuracy], 1)
    votes = np.column_stack([votes, votes[:, 2], votes[:, 2]])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = label_model.fit(patterns, counts, 0.3)
    assert np.abs(model.accuracies[:4] - accuracy).max() < 0.06
    assert model.correlations[2, 4] > 0.9 and model.shares[2] < 0.45 < model.shares[0]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95
    assert label_model.fit(np.zeros((0, 3)), np.zeros(0)).prior == 0.5


def test_quality_scores_follow_the_hidden_labels(spark):
    folder = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    rows = entry.queries()["op4_quality_classifier"](spark, folder).join(marks, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    scores = entry.queries()["op7_toxicity"](spark, folder)
    assert scores.count() == 10_000
    held = scores.where("held_out").join(marks, "doc_id").collect()
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    area = np.mean(np.array(toxic)[:, None] > np.array(clean)[None, :])
    assert area > 0.9 and np.mean(np.array(clean) >= 0.5) < 0.02 and np.mean(np.array(toxic) >= 0.5) > 0.7


def test_held_out_labels_are_not_learned(spark):
    import zlib

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, f"{'vile trash' if i % 2 else 'plain talk'} about thing{i}") for i in range(400)]
    marks = spark.createDataFrame([(i, (i % 2) if i not in held else 1 - i % 2) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(data.frame(spark, rows), marks).collect()}
    assert [i for i in got if got[i].held_out] and {i for i in got if got[i].held_out} == set(held)
    assert all(got[i].predicted == i % 2 for i in got)


# 5 SimHash


def brute_fingerprint(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(parts[i:i + 4]) for i in range(len(parts) - 3)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 4 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    got = {r.doc_id: r for r in run(spark, "op5_simhash_dedup").collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert all(len(r.fingerprint) == 16 for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("wide, block", [(False, 2048), (True, 2048), (False, 16), (True, 7)])
def test_links_reach_what_all_pairs_reach(spark, wide, block):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for b in base[:6]:
        for _ in range(40):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 8)):
                x ^= 1 << bit
            values.add(x)
    want = brute_components({v: v for v in values})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), wide, block)
    roots = {r.fp: r.root for r in simhash.components(edges).collect()}
    groups, brute = {}, {}
    for v, s in zip(values, signed):
        groups.setdefault(roots.get(s, s), set()).add(v)
        brute.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i - 1) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 50)]
    roots = {r.fp: r.root for r in simhash.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert roots == {i: 0 for i in range(1, 40)} | {100 + i: 100 for i in range(1, 50)}


# 6 repetition


def brute_repetition(parts):
    windows = Counter(tuple(parts[i:i + 5]) for i in range(len(parts) - 4))
    covered = {j for i in range(len(parts) - 4) if windows[tuple(parts[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(covered)


def test_quality_rules_equal_brute_force(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op6_quality_rules").collect()}
    for i, text in texts.items():
        parts = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        repeats = brute_repetition(parts)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(parts), sum(map(len, parts)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats)
        assert r.base_failed == (len(parts) < 10 or 100 * repeats > 20 * len(parts))
        assert not (r.base_failed and r.kept)


def test_longest_repeats_equal_brute_force():
    rng = random.Random(4)
    for case in range(80):
        lists = [[b"abcd"[rng.randrange(1 + case % 4):][:1] for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 6))]
        covered, longest = repetition.repeated_words(lists, 5)
        for parts, c, top in zip(lists, covered, longest):
            n, best = len(parts), 0
            for i in range(n):
                for j in range(i + 1, n):
                    k = 0
                    while j + k < n and parts[i + k] == parts[j + k]:
                        k += 1
                    best = max(best, k)
            assert (c, top) == (brute_repetition(parts), best)


def test_a_long_repeat_fails_a_long_text():
    plain = [f"w{i}" for i in range(2_000)]
    for size, kept in ((50, True), (51, False)):
        text = " ".join(plain + plain[100:100 + size])
        verdict = next(repetition.judge([text], repetition.Limits()))
        assert (verdict["base_failed"][0], verdict["kept"][0]) == (False, kept)


# 8 line dedup


def brute_lines(texts, least):
    """Lines to delete, by the definition: every run of lines with enough words against every earlier one."""
    runs, out = {}, {}
    for key in sorted(texts):
        parts = [tuple(line.encode().split()) for line in texts[key].split("\n")]
        gone = set()
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                if sum(map(len, parts[a:b])) >= least and parts[a] and parts[b - 1]:
                    content = tuple(p for p in parts[a:b] if p)
                    if runs.setdefault(content, (key, a)) < (key, a):
                        gone |= set(range(a, b))
        out[key] = gone
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    lines = ["one two three", "four five", "six seven eight nine ten eleven", "", "x", "a b c d", "repeat me", "  one  two three "]
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for i in range(60)}
    rows = data.frame(spark, texts.items()).repartition(4)
    want = brute_lines(texts, 5)
    spans = winnow.repeated_spans(rows, min_words=5).collect()
    got = {r.doc_id: {i for s in r.spans for i in range(s["first"], s["last"] + 1)} for r in spans}
    assert got == {i: g for i, g in want.items() if g}
    cleaned = {r.doc_id: r.text for r in winnow.clean(rows, min_words=5).collect()}
    for i, text in texts.items():
        parts = text.split("\n")
        assert cleaned[i] == "\n".join(p for k, p in enumerate(parts) if k not in want[i])
    report = {r.doc_id: r for r in winnow.report(rows, min_words=5).collect()}
    assert all(report[i].n_deleted == len(want[i]) for i in texts)
    assert all(report[i].kept_sha256 == hashlib.sha256(cleaned[i].encode()).hexdigest() for i in texts)


def test_line_dedup_on_the_table(spark, texts):
    want = brute_lines(texts, winnow.MIN_WORDS) if sum(map(len, texts.values())) < 2_000_000 else {}
    got = {r.doc_id: r.n_deleted for r in run(spark, "op8_line_dedup").collect()}
    assert got == {i: len(g) for i, g in want.items()}


# 9 packing


def test_boundaries_are_optimal():
    rng = random.Random(6)
    for _ in range(40):
        lengths = rng.sample(range(1, 40), rng.randrange(1, 8))
        counts = [rng.randrange(1, 9) for _ in lengths]
        buckets = rng.randrange(1, 5)

        def padding(tops):
            return sum(c * (min(t for t in tops if t >= n) - n) for n, c in zip(lengths, counts))

        def best(rest, left):
            if left == 0:
                return math.inf
            return min([padding([*rest, max(lengths)])] + [best([*rest, t], left - 1) for t in lengths if t not in rest and left > 1])

        tops = packing.boundaries(lengths, counts, buckets)
        assert tops == sorted(set(tops)) and len(tops) <= buckets and padding(tops) == best([], buckets)
    assert packing.boundaries([], []) == []


def test_packing_keeps_every_token_in_budget(spark, texts):
    import regex

    rows = run(spark, "op9_packing").collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
        assert r.padding == r.bucket_len - r.n_tokens >= 0
    assert total == Counter({i: len(regex.findall(r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+", t)) for i, t in texts.items()})
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket_len, r.batch), []).append(r.slot)
    for (length, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * length <= packing.TOKEN_BUDGET
    for length in {b for b, _ in batches}:
        own = sorted((r for r in rows if r.bucket_len == length), key=lambda r: (r.batch, r.slot))
        assert [(r.doc_id, r.piece) for r in own] == sorted((r.doc_id, r.piece) for r in own)


# 10 consistent weighted sampling


def test_weighted_fingerprints_estimate_the_generalised_jaccard(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op10_weighted_fingerprints").collect()}
    order, off = sorted(texts, reverse=True), []
    for n, i in enumerate(order):
        text, following = texts[i], texts[order[(n + 1) % len(order)]]
        cut = len(text) // 3
        changed = text[:len(text) - cut] + following[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for other, near in ((changed, got[i].near_edited), (following, got[i].near_next)):
            a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (text, other))
            keys = a.keys() | b.keys()
            want = sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0
            off.append(near - want)
    samples = weighted_minhash.SAMPLES
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.6 / math.sqrt(samples)
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_followers_across_parts_and_null_ids(spark):
    ids = [3, 255, 256, 257, 2000, 10**12, -5]
    rows = data.frame(spark, [(i, f"t{i}") for i in ids] + [(None, "tn")]).repartition(5)
    got = {r.text: r.next_text for r in weighted_minhash.with_next(rows).where("not visits").collect()}
    order = [f"t{i}" for i in sorted(ids, reverse=True)] + ["tn"]
    assert got == dict(zip(order, order[1:] + order[:1]))
    alone = weighted_minhash.with_next(data.frame(spark, [(7, "x")])).where("not visits").collect()
    assert [(r.text, r.next_text) for r in alone] == [("x", "x")]


def test_native_plan(spark, docs):
    from tests.helpers import plan

    text = plan(weighted_minhash.compare(docs))
    assert "Python" not in text and "Arrow" not in text


def test_pipeline_query(spark, texts):
    rows = run(spark, "pipeline").collect()
    assert {r.doc_id for r in rows} <= set(texts) and len({r.doc_id for r in rows}) > 100


def test_hashes_agree_with_the_engine(spark):
    row = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()
    assert row[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)
