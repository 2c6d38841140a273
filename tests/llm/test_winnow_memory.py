"""What a bucket of windows takes in memory while it is settled, and the helpers that keep it small."""

import tracemalloc

import numpy as np

from gabble.llm import winnow


def test_a_bucket_is_sorted_in_parts():
    rng = np.random.default_rng(8)
    n = 1_000_000
    grams, windows = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
    grams[n // 2:n // 2 + 5000], windows[n // 2:n // 2 + 5000] = grams[:5000], windows[:5000]
    tracemalloc.start()
    turn, sizes = winnow._repeated(grams, windows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.start()
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    winnow._groups(grams, windows)
    whole = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < whole / 1.5
    assert sizes.tolist() == [2] * 5000
    assert sorted(turn.tolist()) == [*range(5000), *range(n // 2, n // 2 + 5000)]
    assert (grams[turn[::2]] == grams[turn[1::2]]).all()


def test_repeated_rows_are_those_equal_in_all_arrays():
    rng = np.random.default_rng(9)
    for size in (0, 1, 2, 50, 400):
        a, b = (rng.integers(0, 12, size).astype(np.uint64) for _ in range(2))
        pairs = list(zip(a.tolist(), b.tolist()))
        turn, sizes = winnow._repeated(a, b)
        groups = np.split(turn, np.cumsum(sizes)[:-1]) if len(sizes) else []
        assert all(len({pairs[i] for i in g}) == 1 for g in groups)
        assert sorted(turn.tolist()) == [i for i, p in enumerate(pairs) if pairs.count(p) > 1]


def test_least_is_the_smallest_of_each_run():
    rng = np.random.default_rng(10)
    for width in range(1, 20):
        values = rng.integers(0, 50, 60).astype(np.uint64)
        assert winnow._least(values, width).tolist() == [min(values[k:k + width]) for k in range(60 - width + 1)]
        assert not len(winnow._least(values[:width - 1], width))


def test_elected_places_are_the_leftmost_smallest():
    """Each window's place by brute force, in texts of few words, where one hash stands at several places of a window."""
    rng = np.random.default_rng(11)
    for trial in range(300):
        least = int(rng.integers(1, 14))
        size = min(winnow.GRAM, least)
        texts = [" ".join(map(str, rng.integers(0, 1 + trial % 4, rng.integers(0, 30)))).encode() for _ in range(5)]
        grams = [winnow._runs(winnow.hashed(np.frombuffer(t + b"\n", np.uint8))[0], size, 0x9E3779B97F4A7C15).tolist() for t in texts]
        windows, places = [], []
        for i, g in enumerate(grams):
            last = -1
            for at in range(len(texts[i].split()) - least + 1):
                own = g[at:at + least - size + 1]
                place = at + own.index(min(own))
                windows.append((i, min(own), at))
                places += [(i, min(own))] if place != last else []
                last = place
        of, found, at, _ = winnow.elected(texts, least)
        assert list(zip(of.tolist(), found.tolist(), at.tolist())) == windows
        of, found = winnow.elected(texts, least, places=True)
        assert list(zip(of.tolist(), found.tolist())) == places
