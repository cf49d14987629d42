"""Fuzzy alignment judges only the words that can be alike, and finds all of them."""

import random

from turnwise.operators import alignment


def some(rng, n):
    return ["".join(rng.choices("abcdéß", k=rng.randint(0, 9))) for _ in range(n)]


def test_no_similar_word_is_left_out():
    rng = random.Random(1)
    words, others = some(rng, 150), some(rng, 120)
    for least in (0.0, 0.3, 0.7, 0.85, 0.95, 1.0):
        found = alignment._hopeful(words, others, least)
        for w, places in zip(words, found, strict=True):
            assert {j for j, o in enumerate(others) if alignment.jaro_winkler(w, o) >= least} <= set(places.tolist())


def test_rows_of_fuzzy_words_are_those_of_the_matcher():
    rng = random.Random(2)
    payload, reference = [w.title() for w in some(rng, 60)], some(rng, 70)
    same = alignment.matcher("fuzzy:0.85")
    sames = alignment.Sames(payload, reference, "fuzzy:0.85")
    for i, w in enumerate(payload):
        assert sames.row(i, 0, len(reference)).tolist() == [same(w, y) for y in reference]


def test_few_words_are_compared_letter_by_letter(monkeypatch):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=rng.randint(2, 10))) for _ in range(120)]
    calls, plain = [0], alignment.jaro_winkler

    def counted(a, b):
        calls[0] += 1
        return plain(a, b)

    monkeypatch.setattr(alignment, "jaro_winkler", counted)
    alignment.Sames(words, words[::-1], "fuzzy:0.85")
    assert calls[0] < 120 * 120 / 10  # all pairs before
