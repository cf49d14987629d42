"""A long phrase list does not multiply the texts."""

from pyspark.sql import functions as F

from turnwise.operators import phrases


def shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_shuffle_does_not_follow_the_shards(spark, monkeypatch):
    word = lambda k: F.concat(F.lit("w"), F.sha2(k.cast("string"), 256))
    texts = spark.range(150).select("id", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: word((F.col("id") * 31 + k * 7) % 4000)).alias("words"))
    listed = spark.range(4000).select(F.array(word(F.col("id")), word((F.col("id") + 7) % 4000)).alias("phrase"), F.array(F.col("id").cast("string")).alias("value"))
    monkeypatch.setattr(phrases, "_BROADCAST_ROWS", 10)
    cost, found = [], []
    for rows in (4000, 100):
        monkeypatch.setattr(phrases, "_SHARD_ROWS", rows)
        before = shuffled(spark)
        found.append(sorted((r.id, [m.value[0] for m in r.matches]) for r in phrases.find(texts, listed).collect()))
        cost.append(shuffled(spark) - before)
    assert found[0] == found[1] and any(m for _, m in found[0])
    assert cost[1] < 2 * cost[0]  # each text went to every shard before


def test_texts_and_places_of_one_name_are_told_apart(spark, monkeypatch):
    """Names are hashes: with all of them equal the matches are the same."""
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c", "a"]), (3, None), (4, ["a", None, "b"]), (5, ["a", "b", "c"])], "i int, words array<string>")
    listed = spark.createDataFrame([(["a", "b"], ["1"]), (["b", "c"], ["2"]), (["b"], ["3"])], "phrase array<string>, value array<string>")
    monkeypatch.setattr(phrases, "_BROADCAST_ROWS", 1)
    monkeypatch.setattr(phrases.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    out = {r.i: [(m.start, m.end, m.value[0]) for m in r.matches] for r in phrases.find(rows, listed).collect()}
    assert out == {1: [(0, 2, "1")], 2: [(0, 2, "2")], 3: [], 4: [(2, 3, "3")], 5: [(0, 2, "1")]}
