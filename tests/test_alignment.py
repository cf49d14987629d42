import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.functions import sequences
from turnwise.operators import alignment as A
from turnwise.operators import joins, segmentation, timing


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(row[j], prev[j + 1])
    return row[-1]


WORDS = st.lists(st.sampled_from("abcde"), max_size=14)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_alignment_is_a_least_cost_one(a, b):
    items = A.align(a, b)
    n = sum(t == "match" for t, *_ in items)
    assert n == lcs(a, b)
    assert [p for _, _, p, _ in items if p is not None] == list(range(len(a)))
    assert [r for _, _, _, r in items if r is not None] == list(range(len(b)))


def test_long_lists_divide():
    r = random.Random(1)
    a, b = [r.choice("abcdef") for _ in range(150)], [r.choice("abcdef") for _ in range(140)]
    assert sum(t == "match" for t, *_ in A.align(a, b)) == lcs(a, b)


def test_golden_order():
    items = A.align("i need cookie".split(), "i want cookie".split())
    assert [t for t, *_ in items] == ["match", "extra_reference", "extra_payload", "match"]


def test_modes():
    assert sum(t == "match" for t, *_ in A.align(["The", "É"], ["the", "é"], "nocase")) == 1
    assert A.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert A.jaro_winkler("", "a") == 0.0
    assert A.jaro_winkler("thhatind", "thantion.") == pytest.approx(0.8, abs=1e-4)  # three letters out of place are one transposition
    assert A.matcher("fuzzy:0.9")("HELLO", "hello") and not A.matcher("fuzzy:0.9")("HELLO", "help")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9))
def test_longest_increasing(values):
    best = 0
    for mask in range(1 << len(values)):
        pick = [v for i, v in enumerate(values) if mask >> i & 1]
        if all(x <= y for x, y in zip(pick, pick[1:], strict=False)):
            best = max(best, len(pick))
    found = timing.longest_increasing(values)
    assert len(found) == best and all(values[i] <= values[j] for i, j in zip(found, found[1:], strict=False))


def test_benchmark_errors_pair_up():
    def rate(h, r):
        return A.benchmark_errors([(t, k) for t, k, _, _ in A.align(h.split(), r.split())])[:3]

    assert rate("i need cookie", "i want cookie") == (1, 0, 0)
    assert rate("a b c", "a c") == (0, 1, 0)
    assert rate("a c", "a b c") == (0, 0, 1)
    assert rate("", "a b") == (0, 0, 2)


def test_compare_places_gold_utterances():
    main = pd.DataFrame({"text": "the dog ran home now".split(), "utt": [0, 0, 0, 1, 1], "pos": [None] * 5})
    gold = pd.DataFrame({"text": "the dog ran home".split(), "utt": [5, 5, 5, 6], "pos": [None] * 4})
    rows = A.compare_file(main, gold)
    assert sum(r[-1] == "match" for r in rows) == 4
    assert [r for r in rows if r[-1] == "extra_payload"][0][5] == "now"
    assert A.compare_file(main[:0], gold)[0][-1] == "extra_reference"


def test_diff_kinds():
    def v(rows):
        return pd.DataFrame(rows, columns=["utt", "speaker", "words", "start_ms", "end_ms"])

    before = v([(0, "A", "x y", 1, 2), (1, "A", "z", None, None), (2, "B", "q", 5, 6)])
    after = v([(0, "A", "x y", 1, 2), (1, "A", "w", None, None), (2, "A", "q", 5, 6), (3, "C", "new", None, None)])
    assert [k for k, *_ in A.diff_file(before, after)] == ["unchanged", "words_changed", "speaker_changed", "inserted"]


def test_recovery_and_stitching():
    u = pd.DataFrame({"utt": [0, 1], "words": [["a", "b"], ["c"]]})
    t = pd.DataFrame({"text": ["a", "b", "c"], "start_ms": [0, 10, 20], "end_ms": [5, 15, 25]})
    assert A.recover_file(u, t) == [(0, 0, 15), (1, 20, 25)]
    assert A.unique_subsequence(["a"], ["a", "a"]) is None
    assert A.stitch(["hello", "you"], [("hel", 0, 1), ("lo", 1, 2), ("you", 3, 4)]) == [(0, 2), (3, 4)]


def test_speaker_assignment():
    assert joins.assign_speakers([("a", "x", 3), ("b", "y", 2)], ["a", "b"], ["x", "y"]) == ("established", {"a": "x", "b": "y"})
    assert joins.assign_speakers([("a", "x", 1), ("a", "y", 1)], ["a"], ["x", "y"])[0] == "ambiguous"
    assert joins.assign_speakers([], ["a"], ["x"])[0] == "unavailable"


def test_trees():
    assert segmentation.clause_ranges("(S (NP (N a)) (VP (V b) (SBAR (S (N c)))))") == [(0, 2), (2, 2)]
    assert segmentation.clause_ranges("") == []


def test_time_warp():
    import numpy as np

    assert A.time_warp(np.array([[0.0, 9], [9, 0]])) == [(0, 0), (1, 1)]
    assert A.time_warp(np.array([[0.0, 0, 9], [9, 9, 0]])) == [(0, 0), (0, 1), (1, 2)]


def test_a_segment_is_used_once():
    """The later of two equal segments is taken; what lies before it is not sought again."""
    said = [(0, "yes please"), (1, "the dog ran"), (2, "yes please")]
    rows = pd.DataFrame([(w, u, None) for u, t in said for w in t.split()], columns=["text", "utt", "pos"])
    got = [(unit, mu, gu, t, status) for unit, _, _, mu, gu, t, _, status in A.compare_file(rows, rows)]
    assert got == [
        (0, 0, None, "yes", "extra_payload"), (0, 0, None, "please", "extra_payload"),
        (1, 1, None, "the", "extra_payload"), (1, 1, None, "dog", "extra_payload"), (1, 1, None, "ran", "extra_payload"),
        (2, 2, 0, "yes", "match"), (2, 2, 0, "please", "match"),
        (3, None, 1, "the", "extra_reference"), (3, None, 1, "dog", "extra_reference"), (3, None, 1, "ran", "extra_reference"),
        (4, None, 2, "yes", "extra_reference"), (4, None, 2, "please", "extra_reference"),
    ]
    twice = pd.DataFrame([(w, u, None) for u, t in [(0, "go on now"), (1, "stop it there")] for w in t.split()], columns=["text", "utt", "pos"])
    assert [r[-1] for r in A.compare_file(twice, twice)] == ["match"] * 6


def test_segments_prefer_matches_in_order_and_one_utterance():
    assert A.best_segment(["p", "q", "r"], ["r", "p", "q", "-", "p", "-", "q", "-", "r"], [0] * 9) == (4, 9)
    assert A.best_segment(["my", "cat", "sat"], ["my", "sun", "that", "cat", "sat", "down"], [0, 0, 1, 1, 1, 1]) == (3, 5)
    assert A.best_segment(["a"], ["b", "c"], [0, 0]) == (0, 0) == A.best_segment([], ["a"], [0])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcA"), min_size=1, max_size=5), st.lists(st.tuples(st.sampled_from("abcAx"), st.booleans()), min_size=1, max_size=12))
def test_best_segment_matches_a_search_of_all_windows(gold, steps):
    main, utts = [w for w, _ in steps], [sum(n for _, n in steps[: k + 1]) for k in range(len(steps))]
    best = None
    for i in range(len(main)):
        for j in range(i + max(1, len(gold) - 2), min(len(main), i + len(gold) + 2) + 1):
            major = max(dict.fromkeys(utts[i:j]), key=utts[i:j].count)
            s, e = i + utts[i:j].index(major), i + utts[i:j].index(major) + utts[i:j].count(major)
            overlap = sum(min(main[s:e].count(w), gold.count(w)) for w in set(gold))
            key = (overlap, lcs([w.lower() for w in main[s:e]], [w.lower() for w in gold]), -(e - s - overlap), e)
            best = max(best, (key, (s, e))) if best else (key, (s, e))
    assert A.best_segment(gold, main, utts) == (best[1] if best and best[0][0] else (0, 0))


def test_benchmark_names_and_runs():
    def errors(text):
        kinds = {"m": ("match", "w"), "p": ("extra_payload", "h"), "r": ("extra_reference", "g"), "n": ("extra_reference", "firstname")}
        sub, dele, ins, diff = A.benchmark_errors([kinds[c] for c in text])
        return sub, dele, ins, "".join(d[0] for d in diff)

    assert errors("rrpp") == (1, 1, 1, "++--")  # only neighbours pair up
    assert errors("rmp") == (0, 1, 1, "+ -")
    assert errors("pn") == (0, 1, 0, "+")  # the word before is counted, not shown
    assert errors("nmp") == (0, 0, 0, "+ ")  # the next one is neither
    assert errors("nnpp") == (0, 1, 0, "++-")
    assert errors("npnp") == (0, 0, 0, "++")
    assert errors("") == (0, 0, 0, "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abA"), max_size=10), st.sampled_from([1, 2]))
def test_repeated_stretches(words, least):
    low = [w.lower() for w in words]
    want = [any(low[s : s + n] == low[s + n : s + 2 * n] for n in range(least, len(low)) for s in range(max(0, i - n + 1), i + 1) if s + 2 * n <= len(low)) for i in range(len(low))]
    assert sequences.repeated(words, least).tolist() == want
