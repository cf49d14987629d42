"""Joins, gates, word lists and reports on small tables."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from turnwise.functions import words as W
from turnwise.operators import evaluation, jobs, joins, lexicons, morphology, timing


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()) if columns else map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(40))
def test_speakers_are_assigned_like_all_permutations(seed):
    r = random.Random(seed)
    left, right = [f"a{i}" for i in range(r.randint(0, 5))], [f"b{i}" for i in range(r.randint(0, 5))]
    score = {(a, b): r.choice([0, 0, 1, 2, 3, 7]) for a in left for b in right}
    small, large, turned = (left, right, False) if len(left) <= len(right) else (right, left, True)
    best, maps = 0, set()
    for chosen in permutations(large, len(small)):
        own = frozenset(p for p in ((b, a) if turned else (a, b) for a, b in zip(small, chosen)) if score[p])
        total = sum(score[p] for p in own)
        if total > best:
            best, maps = total, {own}
        elif total == best:
            maps.add(own)
    want = ("unavailable", {}) if not best else ("ambiguous", {}) if len(maps) > 1 else ("established", dict(next(iter(maps))))
    assert joins.assign_speakers([(a, b, n) for (a, b), n in score.items()], left, right) == want


def test_many_speakers_have_an_answer():
    names = [f"s{i}" for i in range(40)]
    pairs = [(a, f"t{a[1:]}", 5) for a in names] + [(a, "t0", 1) for a in names]
    outcome, found = joins.assign_speakers(pairs, names, [f"t{i}" for i in range(40)])
    assert outcome == "established" and found == {a: f"t{a[1:]}" for a in names}


def test_speaker_map_given_by_hand(spark):
    left = spark.createDataFrame([(1, "A", "x"), (1, "B", "y")], "file long, speaker string, token string")
    right = spark.createDataFrame([(1, "P", "x"), (1, "Q", "z")], "file long, speaker string, token string")
    rules = spark.createDataFrame([(1, "A", "P"), (1, "A", "Q"), (1, "C", "Q")], "file long, l string, r string")
    said, wrong = joins.apply_speaker_map(left, right, rules)
    assert rows(said) == [(1, "A=P", "left", "x"), (1, "A=P", "right", "x"), (1, "A=Q", "left", "x"), (1, "A=Q", "right", "z"), (1, "C=Q", "right", "z")]
    assert rows(wrong) == [(1, "left", "A", "twice"), (1, "left", "C", "unknown"), (1, "right", "Q", "twice")]


def test_artifacts_of_two_runs(spark):
    make = lambda *r: spark.createDataFrame(r, "path string, content string")
    out = joins.artifact_pairs(make(("a", ""), ("b", ""), ("c", ""), ("d", ""), ("e", "")), make(("a", "1"), ("b", "1"), ("c", "1"), ("x", "9")), make(("a", "1"), ("b", "2"), ("d", "1")))
    assert rows(out, "path", "outcome") == [("a", "equal"), ("b", "different"), ("c", "missing_right"), ("d", "missing_left"), ("e", "missing_both")]
    maps = spark.createDataFrame([(1, "A", "P", 3), (1, "A", "P", 3), (1, "A", "Q", 5), (1, "B", "P", 3)], "file long, l string, r string, overlap long")
    assert rows(joins.candidate_maps(maps, ["file"]), "l", "r", "rank") == [("A", "P", 2), ("A", "Q", 1), ("B", "P", 3)]


def test_sets_of_positions(spark):
    one = spark.range(1).select(F.expr("array(array(1,2,3), array(2,3), array(4), array(1,2,3), array(3,4))").alias("r"))
    assert one.select(joins.without_subsets(F.col("r"))).first()[0] == [[1, 2, 3], [3, 4]]
    assert one.select(joins.range_subtraction(F.expr("array(5,1,3)"), F.expr("array(3,9)"))).first()[0] == [1, 5]
    heads = spark.createDataFrame([("wer", 2), ("file", 1), ("wer", 0), ("pos", 3)], "h string, o int")
    assert joins.header_union(heads, "h", "o") == ["wer", "file", "pos"]


def test_speakers_of_segments_that_have_ended(spark):
    utts = spark.createDataFrame([(1, 0, "u", 5), (1, 1, "u", 10), (1, 2, "u", None), (2, 0, "v", 9)], "file long, utt long, speaker string, end_ms long")
    segs = spark.createDataFrame([(1, 0, 5, "A"), (1, 1, 9, "B"), (1, 2, 7, "C")], "file long, seq long, end_ms long, speaker string")
    assert rows(joins.reassign_speakers(utts, segs), "file", "utt", "speaker_new") == [(1, 0, "A"), (1, 1, "C"), (1, 2, "u"), (2, 0, "v")]
    early = segs.where("seq > 0")
    assert rows(joins.reassign_speakers(utts.where("utt = 0 AND file = 1"), early), "speaker_new") == [("B",)]


def test_gates_and_labels(spark):
    u = spark.createDataFrame([(0, []), (1, ["n|a~v|b", "pro|i"]), (2, None)], "utt long, words array<string>")
    out = morphology.gate(u, {"some": F.size("words") > 0}, {"few": F.size("words") < 2})
    assert [(r.gate, r.broken) for r in out.orderBy("utt").collect()] == [("reject", ["some"]), ("warn", ["few"]), ("reject", ["some", "few"])]
    assert u.where("utt = 1").select(morphology.pos_labels(F.col("words"))).first()[0] == ["N", "V", "PRO"]
    t = spark.createDataFrame([(1, "observed"), (1, "clamped"), (2, "derived")], "file long, origin string")
    assert rows(timing.origin_tally(t)) == [(1, 1, 0, 0, 1, 2, True), (2, 0, 1, 0, 0, 1, False)]
    assert jobs.rejections(spark.createDataFrame([("late",), (None,), ("late",)], "reason string"), "reason").collect()[0].n == 2


def test_word_lists_agree_with_the_rules(spark, tmp_path, monkeypatch):
    said = ["Airplane", "NASA", "nasa", "Mary", "mary's", "mm-hmm", "gonna", "um", "hello", None, " ok ", "a_b", "Airplane"]
    (tmp_path / "compounds.txt").write_text("# two parts\nair plane\n\nair plane\n")
    (tmp_path / "names.txt").write_text("Mary\nGonna\n")
    (tmp_path / "abbreviations.txt").write_text("NASA\n")
    lists = lexicons.read(spark, str(tmp_path / "compounds.txt"), "compound").union(lexicons.read(spark, str(tmp_path / "names.txt"), "name")).union(lexicons.read(spark, str(tmp_path / "abbreviations.txt"), "abbreviation"))
    assert lists.count() == 4
    df = spark.createDataFrame([(i, w) for i, w in enumerate(said)], "i int, text string")
    want = {r.i: r.c for r in df.select("i", W.conform(F.col("text"), compounds=[("air", "plane")], names=["mary", "gonna"], abbreviations=["NASA"]).alias("c")).collect()}
    for most in (200_000, -1):
        monkeypatch.setattr(lexicons, "_BROADCAST_ROWS", most)
        got = {r.i: r.conformed for r in lexicons.conformed(df, lists).collect()}
        assert got == want and len(got) == len(said)
    assert got[0] == ["air", "plane"] and got[1] == list("NASA") and got[3] == ["name"]
    assert lexicons.builtin(spark).count() > 10


def test_large_word_list(spark):
    names = spark.range(50_000).select(F.lit("name").alias("kind"), F.array(F.concat(F.lit("nm"), F.col("id").cast("string"))).alias("parts"))
    df = spark.createDataFrame([("NM49999",), ("nm50000",)], "text string")
    assert rows(lexicons.conformed(df, lexicons.keyed(names)), "text", "conformed") == [("NM49999", ["name"]), ("nm50000", ["nm50000"])]


def test_evaluation_reports(spark, tmp_path):
    w = spark.createDataFrame([(1, "eng,spa", "la", "spa", "det", "spliced", []), (1, "eng,spa", "casa", "spa", "propn", "spliced", ["propn_for_function_word"]), (2, "eng,fra", "le", "fra", None, "missing_mor", ["missing_mor"])],
                              "file long, pair string, text string, lang string, pos string, status string, flags array<string>")
    evaluation.write_reports(w, str(tmp_path / "r"), ["spliced"], ["propn_for_function_word"])
    read = lambda n: spark.read.option("header", True).csv(str(tmp_path / "r" / n))
    assert read("per-word").count() == 3 and {r.text for r in read("flagged").collect()} == {"casa", "le"}
    assert {r.pair: r.clean for r in read("per-pair").collect()} == {"eng,spa": "1", "eng,fra": "0"}
    text = evaluation.summary(evaluation.per_pair(w, ["spliced"], []), "T").first().markdown
    assert text.startswith("# T\n\n| pair |") and text.endswith("Words: 3, clean: 1") and text.index("eng,fra") < text.index("eng,spa")


def test_numbers_of_other_languages():
    from turnwise.functions.numbers import expand

    want = {
        "deu": {1: "eins", 10: "zehn", 21: "einundzwanzig", 34: "vierunddreißig", 70: "siebzig", 200: "zweihundert"},
        "fra": {1: "un", 5: "cinq", 21: "vingt-et-un", 71: "soixante-et-onze", 80: "quatre-vingts", 81: "quatre-vingt-un", 91: "quatre-vingt-onze", 77: "soixante-dix-sept"},
        "spa": {1: "uno", 5: "cinco", 13: "trece", 22: "veintidós", 25: "veinticinco", 31: "treinta y uno", 1000: "mil"},
        "por": {21: "vinte e um"}, "nld": {22: "tweeëntwintig", 25: "vijfentwintig"}, "ita": {21: "ventuno", 28: "ventotto", 33: "trentatré", 45: "quarantacinque"},
    }
    assert {lang: {n: expand(str(n), lang) for n in some} for lang, some in want.items()} == want
    assert expand("13th", "spa") == "13th" and expand("21-22", "fra") == "vingt-et-un vingt-deux" and expand("5", "xxx") == "5"
    assert expand("$12", "spa") == "doce dollars"


def test_language_rules(spark):
    from turnwise.functions import languages as X

    df = spark.createDataFrame([("Go", "WENT", "Moi", "Chevaux"), ("walk", "walked", "l'", "table"), (None, "x", "leur", "travail"), ("go", None, "le'", "travaux")], "l string, f string, p string, n string")
    got = df.select(X.irregular(F.col("l"), F.col("f")), X.french_case(F.col("p")), X.heard_plural(F.col("n"), ["cheval", "travail"])).collect()
    assert [tuple(r) for r in got] == [(True, "Nom", True), (False, "", False), (False, "Acc", True), (False, "Acc", True)]


def test_recovery_by_strategy(spark):
    from turnwise.plans import strategies as X

    utts = spark.createDataFrame([(1, 0, ["a", "b"], False), (1, 1, ["c"], False), (2, 0, ["a"], False), (2, 1, ["b"], True)], "file long, utt long, words array<string>, has_overlap boolean")
    tokens = spark.createDataFrame([(f, i, w, 10 * i, 10 * i + 5) for f in (1, 2) for i, w in enumerate("abc")], "file long, seq long, text string, start_ms long, end_ms long")
    auto = rows(X.recover(utts, tokens), "file", "utt", "start_ms", "end_ms")
    assert auto[:2] == [(1, 0, 0, 15), (1, 1, 20, 25)] and len(auto) == 4
    assert rows(X.recover(utts, tokens, "global").where("file = 1"), "file", "utt", "start_ms", "end_ms") == auto[:2]
    with pytest.raises(KeyError):
        X.recover(utts, tokens, "other")


def test_caches(spark, tmp_path):
    from turnwise.plans import strategies as X

    items = spark.createDataFrame([("a", "v1"), ("b", "v1")], "key string, engine_version string")
    keys = ["key", "engine_version"]
    table = X.TableCache(spark, str(tmp_path / "cache"), keys)
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.withColumn("data", F.concat("key", F.lit("!")))

    for cache in (table, table, X.TieredCache(X.NoCache(), table), X.NoCache()):
        assert rows(X.through_cache(items, keys, cache, compute, 1), "key", "data") == [("a", "a!"), ("b", "b!")]
    assert calls == [2, 0, 0, 2]
    assert X.choose_engine("morphology", None, "eng") == "rules"
    with pytest.raises(KeyError):
        X.choose_engine("morphology", "none", "eng")


def test_overrides_and_multiwords(spark):
    from turnwise.plans import strategies as X

    df = spark.createDataFrame([(["New", "york", "city", "is", "in", "spite", "of"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(X.merge_multiwords(F.col("w"), [["new", "york"], ["New", "York", "City"], ["in", "spite", "of"]])).collect()]
    assert got == [["New_york_city", "is", "in_spite_of"], []]
    assert df.select(X.override_items(F.col("w"), [(lambda x: x == "is", lambda x: F.lit("be")), (lambda x: F.length(x) == 2, F.upper)])).first()[0] == ["New", "york", "city", "be", "IN", "spite", "OF"]


def test_a_batch_replaces_itself(spark, tmp_path):
    from turnwise.streaming import events

    sink = events.upsert_sink(str(tmp_path / "s"))
    make = lambda *r: spark.createDataFrame(r, "key string, v int")
    sink(make(("a", 1), ("b", 1)), 0)
    sink(make(("a", 9)), 1)
    sink(make(("a", 2)), 1)
    assert rows(events.upserted(spark, str(tmp_path / "s"), ["key"])) == [("a", 2), ("b", 1)]
