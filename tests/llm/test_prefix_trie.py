"""The prefix trie against a dictionary of prefixes, built turn by turn."""

import hashlib
import random
import zlib

import pytest

from gabble.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, path long, block int, depth string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, "d") for r in rows], SCHEMA).repartition(5)


def by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, tie, text))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for conv, turns in own.items():
        head = zlib.crc32(str(conv).encode()) % 6
        whole[conv] = tuple(own.get(100 * int(conv / 100), [])[:head] + turns[head:])
    nodes, children = {}, {}
    for conv, turns in whole.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(turns[:depth], []).append(conv)
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        saved[node] = sum(saved[c] for c in below) + ((len(nodes[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if whole[c] == node)
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children.get(node, [])),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(turns):
    return sorted([tuple(r) for r in prefix_trie.report(turns).collect()], key=str)


def some(seed, lengths, ids):
    draw = random.Random(seed)
    rows = [(None, 0, "user", "of no conversation")]
    for conv in draw.sample(ids, 90):
        for turn in range(draw.choice(lengths)):
            text = draw.choice(["a", "b", "é😀", None, "", "x" * 5000]) if draw.random() < .2 else f"same {turn % 3}"
            rows.append((conv, draw.choice([turn, turn, None, 3]), draw.choice(["user", "assistant", None]) if draw.random() < .1 else "user", text))
    return rows


@pytest.mark.parametrize("lengths", [[1, 2, 3, 5], [1, 7, 8, 9, 16, 17, 40, 70]])
def test_trie_equals_one_by_hand(spark, lengths):
    rows = some(len(lengths), lengths, range(-120, 300))
    assert found(frame(spark, rows)) == by_hand(rows)


def test_copies_and_a_long_conversation(spark):
    """Many equal conversations, repeated rows, and one conversation with a third of all rows."""
    rows = [(c, t, "user", "hello") for c in range(1000, 1300) for t in range(2)]
    rows += rows[:4] + [(1301, t, "user", str(t // 3)) for t in range(300)]
    assert found(frame(spark, rows)) == by_hand(rows)


def test_pieces_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, 0, "user", "hello") for c in range(100, 200)]
    assert found(frame(spark, rows)) == by_hand(rows)


def test_turnless_conversations_end_in_the_root(spark):
    rows = [(c, 0, "user", "hi") for c in (1, 2, 3, 4, 5)]  # their family's first conversation is absent
    assert found(frame(spark, rows)) == by_hand(rows)


def test_empty_table(spark):
    assert found(frame(spark, [])) == []


def test_own_height(spark):
    """Any block height gives the same trie."""
    rows = some(5, [1, 4, 9, 30], range(0, 300))
    convs, sequences = prefix_trie.branched(frame(spark, rows))
    of = {h: sorted(map(str, prefix_trie.trie(convs, sequences, h).collect())) for h in (1, 3, 64)}
    assert of[1] == of[3] == of[64]
