"""Two runs compared by hand-written plans."""

import hashlib

from turnwise.operators import runs

PLAN = "pair long, left string, right string, held_out string"
TIMED = "path string, speaker string, utt long, pos int, text string, start_ms long, end_ms long"


def found(df):
    return {r.pair: r for r in df.collect()}


def test_manifest_reasons(spark):
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    left = [("a", digest("x"), "x"), ("b", digest("x"), "y"), ("c", digest("z"), "z"), ("d", digest("1"), "1"), ("d", digest("1"), "1"), ("e", digest(""), None), ("n", None, "n")]
    right = [("a", digest("x").upper(), "x"), ("b", digest("y"), "y"), ("c", digest("zz"), "zz"), ("d", digest("1"), "1"), ("e", digest(""), "")]
    plan = [(1, "a", "a", None), (1, "a", "a", None), (2, "b", "b", None), (3, "c", "c", "test"), (4, "d", "d", None), (5, "q", "a", None), (6, "a", None, None), (7, "e", "e", None), (8, "n", "a", None)]
    a, b = (spark.createDataFrame(x, "path string, sha256 string, content string") for x in (left, right))
    df = runs.by_manifest(spark.createDataFrame(plan, PLAN), a, b)
    got = {k: (r.outcome, r.reason, r.same, r.held_out) for k, r in found(df).items()}
    bad = lambda why: ("unpairable", why, None, None)
    assert got == {1: ("compared", None, True, None), 2: bad("digest_left"), 3: ("compared", None, False, "test"), 4: bad("repeated_left"), 5: bad("missing_left"), 6: bad("missing_right"), 7: ("compared", None, True, None), 8: bad("digest_left")}
    assert tuple(runs.totals(df, []).first()) == (8, 3, 5, 1)


def timed(spark, rows):
    return spark.createDataFrame(rows, TIMED)


def test_alignment_by_pair(spark):
    one = [("a", "A", 0, 0, "Hi", 0, 10), ("a", "A", 0, 1, "you", 20, 30), ("a", "A", 1, 0, "there", 15, 40), ("a", "B", 2, 0, "what", None, None), ("a", "B", 2, 1, "now", 5, 9), ("b", "A", 0, 0, "x", 0, 1)]
    two = [("a", "P", 0, 0, "hi", 3, 10), ("a", "P", 0, 1, "you", 25, 30), ("a", "P", 1, 0, "there", 115, 140), ("a", "Q", 2, 0, "what", 1, 2), ("a", "Q", 2, 1, "now", 5, 9), ("b", "P", 0, 0, "y", 0, 1)]
    plan = spark.createDataFrame([(1, "a", "a", None), (2, "b", "b", None), (3, "a", "zz", None), (4, "a", "a", None), (5, "a", "a", None)], PLAN)
    maps = spark.createDataFrame([(2, "A", "P"), (4, "A", "P"), (4, "C", "Q"), (5, "A", "Q"), (5, "B", "P")], "pair long, l string, r string")
    got = found(runs.by_alignment(plan, timed(spark, one), timed(spark, two), maps))
    assert {k: r.reason for k, r in got.items()} == {1: None, 2: "token_identity", 3: "missing_right", 4: "invalid_speaker_map", 5: "token_identity"}
    r = got[1]
    assert (r.tokens, r.start_delta_n, r.start_delta_min, r.start_delta_median, r.start_delta_p95, r.start_delta_max, r.end_delta_max) == (5, 4, 0, 3, 100, 100, 100)
    assert (r.left_violations, r.right_violations) == (1, 0) and got[2].tokens is None
    none = runs.by_alignment(plan.limit(0), timed(spark, one), timed(spark, two))
    assert none.count() == 0


def test_transcription_finds_speakers(spark):
    one = [("a", s, 0, i, t, None, None) for s, text in (("A", "the cat sat down"), ("B", "no it ran off")) for i, t in enumerate(text.split())] + [("b", s, 0, i, t, None, None) for i, (s, t) in enumerate((("A", "x"), ("B", "x")))]
    two = [("a", s, 0, i, t, None, None) for s, text in (("P", "No it RAN"), ("Q", "the cat sat there")) for i, t in enumerate(text.split())] + [("b", s, 0, i, t, None, None) for i, (s, t) in enumerate((("P", "x"), ("Q", "x")))]
    plan = spark.createDataFrame([(1, "a", "a", "why"), (2, "b", "b", None)], PLAN)
    df = runs.by_transcription(plan, timed(spark, one), timed(spark, two), ["THE"])
    got = found(df)
    assert (got[1].overlap, round(got[1].agreement, 6), got[1].left_tokens) == (5, round(10 / 13, 6), 8) and got[2].reason == "speakers_ambiguous"
    assert tuple(runs.totals(df, ["overlap"]).first()) == (2, 1, 1, 1, 0)


def test_morphology_by_axis(spark):
    cols = "path string, speaker string, utt long, pos int, text string, upos string, lemma string, feats string, chunks int, head int, deprel string"
    one = spark.createDataFrame([("a", "A", 0, 0, "go", "VERB", "go", "x|y", 1, 0, "root"), ("a", "A", 0, 1, "on", "ADP", "on", None, 1, 1, None), ("a", "A", 0, 2, "z", "X", "z", "", 1, 1, "dep")], cols)
    two = spark.createDataFrame([("a", "A", 0, 0, "go", "VERB", "goes", "y|x|x", 1, 0, "root"), ("a", "A", 0, 1, "on", "ADV", "on", "", 2, 1, None), ("a", "A", 1, 0, "new", "X", "new", "", 1, 0, "root")], cols)
    r = found(runs.by_morphology(spark.createDataFrame([(1, "a", "a", None)], PLAN), one, two))[1]
    assert (r.tokens, r.differing, r.lemma_differs, r.upos_differs, r.feats_differs, r.chunks_differs, r.deprel_differs, r.missing_left, r.missing_right) == (4, 4, 1, 1, 0, 1, 0, 1, 1)
