"""Phrases against a plain search of every place."""

import random

from pyspark.sql import functions as F

from turnwise.functions import cantonese
from turnwise.operators import lexicons, phrases
from turnwise.plans import commands


def _plain(words, table):
    out, at = [], 0
    while at < len(words or []):
        best = max((n for n in range(1, len(words) - at + 1) if tuple(words[at : at + n]) in table), default=0)
        if best:
            out.append((at, at + best, table[tuple(words[at : at + best])]))
        at += best or 1
    return out


def _case(n_phrases, seed):
    rng = random.Random(seed)
    table = {tuple(rng.choices("abcdef", k=rng.randint(1, 5))): [f"v{i}"] for i in range(n_phrases)}
    texts = [rng.choices("abcdefg", k=rng.randint(0, 40)) for _ in range(300)] + [None, [], ["a", None, "b"], ["a"] * 500]
    return table, texts + texts[:5]


def test_both_ways_find_what_a_plain_search_finds(spark, monkeypatch):
    table, texts = _case(120, 3)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, words array<string>").repartition(3)
    listed = spark.createDataFrame([(list(k), v) for k, v in table.items()] + [([], ["no"]), (["a", None], ["no"])], "phrase array<string>, value array<string>")
    want = {i: _plain(t, table) for i, t in enumerate(texts)}
    for most, shard in ((200_000, 100_000), (10, 25)):
        monkeypatch.setattr(phrases, "_BROADCAST_ROWS", most)
        monkeypatch.setattr(phrases, "_SHARD_ROWS", shard)
        out = phrases.find(rows, listed).collect()
        assert {r.i: [(m.start, m.end, m.value) for m in r.matches] for r in out} == want and len(out) == len(texts)


def test_a_long_list_takes_one_pass(spark):
    listed = spark.range(100_000).select(F.array(F.concat(F.lit("w"), F.col("id")), F.concat(F.lit("x"), F.col("id"))).alias("phrase"), F.array(F.concat(F.lit("p"), F.col("id"))).alias("value"))
    texts = spark.range(200).select("id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: F.array(F.concat(F.lit("w"), F.col("id") * 500 + k), F.concat(F.lit("x"), F.col("id") * 500 + k + (k % 2))))).alias("words"))
    out = phrases.find(texts, listed).select("id", F.size("matches").alias("n"), F.col("matches")[0]["value"][0].alias("first")).collect()
    assert all(r.n == 25 and r.first == f"p{r.id * 500}" for r in out)


def test_replacing_and_multiwords(spark):
    lists = spark.createDataFrame([("multiword", "", ["New", "York"]), ("multiword", "", ["new", "york", "City"]), ("multiword", "", ["single"])], "kind string, key string, parts array<string>")
    df = spark.createDataFrame([(1, ["I", "love", "New", "York", "city", "new", "york"]), (2, []), (3, None)], "i int, words array<string>")
    assert {r.i: r.words for r in phrases.merge_multiwords(df, lists).collect()} == {1: ["I", "love", "New_York_city", "new_york"], 2: [], 3: None}


def test_rewriting_text_is_the_rule_of_the_small_tables(spark):
    rows = spark.createDataFrame([("他们说这个话沒有他",), ("",), (None,), ("abc 他們",)], "text string")
    tables = [spark.createDataFrame(list(t.items()), "source string, target string") for t in (cantonese.WORDS, cantonese.SCRIPT)]
    out = phrases.rewrite_text(rows, tables[0], script=tables[1]).collect()
    want = rows.select(cantonese.normalise(F.col("text"))).collect()
    assert sorted(str(r[0]) for r in out) == sorted(str(r[0]) for r in want)


def test_comparison_scores_with_a_users_lists(spark):
    lists = lexicons.keyed(spark.createDataFrame([("compound", ["Foo", "bar"]), ("name", ["Zelda"]), ("multiword", ["in", "spite", "of"])], "kind string, parts array<string>"))
    main = spark.createDataFrame([(7, 0, ["foobar", "met", "zelda", "in", "spite", "of", "rain"])], "file long, utt long, words array<string>")
    gold = spark.createDataFrame([(7, 0, ["foo", "bar", "met", "name", "in_spite_of", "rain"])], "file long, utt long, words array<string>")
    with_lists = commands.compare(main, gold, lexicon=lists).first()
    assert (with_lists.matches, with_lists.wer) == (8, 0.0)
    assert commands.compare(main, gold).first().wer > 0
    asr = spark.createDataFrame([(7, i, w) for i, w in enumerate(["In", "spite", "of", "rain", "."])], "file long, seq long, text string")
    assert [r.text for r in commands.transcribe(asr, lexicon=lists).orderBy("pos").collect()] == ["In_spite_of", "rain"]
