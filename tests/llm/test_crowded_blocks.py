"""Crowded zones are compared in tables of bounded size."""

import tracemalloc

import numpy as np

from turnwise.llm import neardup


def some_sets(n: int, own: int) -> list[np.ndarray]:
    r = np.random.default_rng(3)
    return [np.unique(np.concatenate([np.arange(20, dtype=np.uint64), r.integers(100, 160, own, dtype=np.uint64)])) for _ in range(n)]


def brute(sets, label, left, right) -> set[tuple[int, int]]:
    out = set()
    for i in left:
        for j in right:
            both = len(np.intersect1d(sets[i], sets[j]))
            if label[i] != label[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                out.add((int(i), int(j)))
    return out


def test_tiles_give_all_pairs(monkeypatch):
    monkeypatch.setattr(neardup, "_TILE", 7)
    sets, label = some_sets(40, 4), np.arange(40) % 33
    left, right, all_ = np.arange(0, 18), np.arange(18, 40), np.arange(40)
    want = brute(sets, label, left, right)
    assert want and set(neardup.linked_pairs(sets, label, left, right, 4, 5)) == want
    pairs = brute(sets, label, all_, all_)
    assert {tuple(sorted(p)) for p in neardup.linked_pairs(sets, label, all_, all_, 4, 5)} == {tuple(sorted(p)) for p in pairs}


def test_memory_follows_the_tile():
    sets = some_sets(3000, 12)
    all_ = np.arange(len(sets))
    tracemalloc.start()
    for _ in neardup.linked_pairs(sets, all_, all_, all_, 4, 5):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000  # the counts of all pairs at once take over 250 MB

