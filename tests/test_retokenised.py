"""Utterances cut inside arrays, against a plain loop; no word is sorted or shuffled for it."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnwise.functions import lexicon as L
from turnwise.operators import segmentation

MARKS = [*L.ENDING_PUNCT, *L.RTL_PUNCT]


def plain(words):
    parts = []
    for w in words:
        w = w.replace("¿", " ").replace("¡", " ").replace("。", ".")
        if w in MARKS:
            parts.append(L.RTL_PUNCT.get(w, w))
        elif w and w[-1] in MARKS:
            parts += [x for x in (w[:-1], L.RTL_PUNCT.get(w[-1], w[-1])) if x]
        else:
            parts.append(w)
    out, own = [], []
    for p in parts:
        own.append(p)
        if p in L.ENDING_PUNCT:
            out.append(own)
            own = []
    while own and own[-1] in L.MOR_PUNCT:
        own.pop()
    return out + ([[*own, "."]] if own else [])


def turns():
    rng = random.Random(4)
    pool = ["a", "b.", "c?", ".", "!", ",", "‡", "„", "x,", "¿d", "e。", "..", "", *L.RTL_PUNCT, *[f"w{m}" for m in L.RTL_PUNCT]]
    return [rng.choices(pool, k=rng.randint(0, 25)) for _ in range(300)] + [[], [","], [",", "."], ["a", ",", ","], ["."]]


def test_both_forms_are_the_loop(spark):
    rows = spark.createDataFrame(list(enumerate(turns())), "i int, w array<string>").repartition(3)
    got = {r.i: r.said for r in segmentation.retokenised(rows, "w", "said").collect()}
    assert got == {i: plain(t) for i, t in enumerate(turns())}
    each = rows.select("i", F.posexplode("w").alias("p", "t")).orderBy(F.rand(1))
    words = {}
    for r in segmentation.retokenise(each, ["i"], "p", "t").collect():
        words.setdefault(r.i, {}).setdefault(r.utt, {})[r.pos] = r.t
    assert {i: [[u[k][j] for j in range(len(u[k]))] for k in range(len(u))] for i, u in words.items()} == {i: p for i, t in enumerate(turns()) if (p := plain(t))}


def test_a_null_array_has_no_utterances(spark):
    rows = spark.createDataFrame([(1, None), (2, ["a"])], "i int, w array<string>")
    assert {r.i: r.said for r in segmentation.retokenised(rows, "w", "said").collect()} == {1: None, 2: [["a", "."]]}


def test_words_are_not_sorted_by_windows(spark, sf):
    plans = {q: entry.queries()[q](spark, sf)._jdf.queryExecution().executedPlan().toString() for q in ("e23_retokenise", "k07_transcribe")}
    assert "Exchange" not in plans["e23_retokenise"] and "Window" not in plans["k07_transcribe"] and plans["k07_transcribe"].count("Exchange") == 1
