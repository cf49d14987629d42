"""Alignment from rows of bits gives what the table gives, and does not fill it."""

import random

import numpy as np
import pandas as pd

from turnwise.operators import alignment as A


def test_bits_give_the_rows_and_items_of_the_table(monkeypatch):
    r = random.Random(3)
    for _ in range(150):
        x, y = ([r.choice("abcdE") for _ in range(r.randint(1, 70))] for _ in range(2))
        s = A.Sames(x, y, "exact")
        for back, order in ((False, range(len(x))), (True, range(len(x) - 1, -1, -1))):
            assert np.array_equal(A._costs(s, order, 0, len(y), back), A._table(s, order, 0, len(y), back))
        items = A.align(x, y, "nocase")
        with monkeypatch.context() as m:  # the same words through the table
            rows = [np.array([a.lower() == b.lower() for b in y], bool) for a in x]
            m.setattr(A, "Sames", lambda p, q, mode: _Fuzzy(rows, len(y)))
            assert A.align(x, y, "nocase") == items


class _Fuzzy:
    def __init__(self, rows, n):
        self.fuzzy, self.ref = rows, np.arange(n)

    def row(self, i, c, d):
        return self.fuzzy[i][self.ref[c:d]]


def test_equal_words_fill_no_table(monkeypatch):
    def none(*_, **__):
        raise AssertionError("a table was filled")

    monkeypatch.setattr(A, "_table", none)
    x, y = ["a", "b", "c"] * 200, ["b", "c", "d"] * 200
    assert sum(t == "match" for t, *_ in A.align(x, y)) == A.lcs(x, y)


def test_versions_are_compared_without_a_frame_for_each_row(monkeypatch):
    rows = [(k, "s" if k else None, f"w{k}", float(k) if k % 3 else float("nan"), k + 1.0) for k in range(6)]
    before = pd.DataFrame(rows, columns=["utt", "speaker", "words", "start_ms", "end_ms"])
    after = before.assign(speaker=[None, "s", "t", "s", "s", "s"], end_ms=[1.0, 2.0, 3.0, 4.0, 9.0, 6.0])
    monkeypatch.setattr(pd.DataFrame, "iloc", None)
    assert [d[0] for d in A.diff_file(before, after)] == ["unchanged", "unchanged", "speaker_changed", "unchanged", "timing_only", "unchanged"]
