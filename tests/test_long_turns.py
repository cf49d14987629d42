"""Rules over the words of a turn take time in proportion to them, and means are printed as their values are."""

import time

from pyspark.sql import functions as F

from turnwise.functions import sequences
from turnwise.functions import words as W
from turnwise.operators import joins, metrics

N = 20_000


def _within(seconds, df):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < seconds
    return rows


def test_timings_of_a_long_turn(spark):
    u = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(N)), lambda i: i.cast("string")).alias("words"))
    times = F.transform("words", lambda _, i: F.struct((i * 10).cast("long").alias("start_ms"), (i * 10 + 9).cast("long").alias("end_ms")))
    got = _within(40, u.select(F.explode(joins.indexed_timings(F.col("words"), times, F.lit(7), F.lit(10_000_000))).alias("t")).select("t.*"))
    assert [tuple(r) for r in got] == [(str(i + 1), i * 10 + 7, i * 10 + 16) for i in range(N)]


def test_timings_may_be_fewer_more_or_missing(spark):
    t = "array<struct<start_ms:bigint,end_ms:bigint>>"
    df = spark.createDataFrame([(1, ["a", "b"], [(0, 5)]), (2, ["a"], [(0, 5), (5, 9)]), (3, ["a"], None), (4, [], [(0, 5)]), (5, ["a"], [None])], f"k int, w array<string>, t {t}")
    got = {r.k: None if r.x is None else [tuple(y) for y in r.x] for r in df.select("k", joins.indexed_timings(F.col("w"), F.col("t"), F.lit(0), F.lit(100)).alias("x")).collect()}
    assert got == {1: [("a", 0, 5), ("b", None, None)], 2: [("a", 0, 5)], 3: [("a", None, None)], 4: [], 5: [("a", None, None)]}


def test_abbreviations_of_a_long_turn(spark):
    df = spark.range(1).select(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(N // 4)), lambda i: F.array(F.lit("u"), F.lit("S"), F.lit("A"), F.lit("x_")))).alias("w"))
    (row,) = _within(40, df.select(sequences.merge_abbreviations(F.col("w"), ["USA", "SA"]).alias("m")))
    assert row.m == ["uSA", "x_"] * (N // 4)
    some = spark.createDataFrame([(["S", None, "A", "S", "A"],), ([],), (None,)], "w array<string>").select(sequences.merge_abbreviations(F.col("w"), ["USA", "SA"]).alias("m"))
    assert [r.m for r in some.collect()] == [["S", None, "A", "SA"], [], None]


def test_times_of_a_long_text(spark):
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(N)), lambda i: F.repeat(F.lit("é"), i % 3 + 1)), " ").alias("t"))
    got = _within(40, df.select(F.explode(W.split_timed(F.col("t"), F.lit(5), F.lit(5 + 3 * N))).alias("p")).select("p.*"))
    sizes = [(i % 3) + 1 for i in range(1, N + 1)]
    total, at = sum(sizes), 0
    for r, n in zip(got, sizes, strict=True):
        assert (r.text, r.start_ms, r.end_ms) == ("é" * n, 5 + 3 * N * at // total, 5 + 3 * N * (at + n) // total)
        at += n
    assert spark.sql("SELECT CAST(NULL AS string) AS t UNION ALL SELECT ' '").select(W.split_timed(F.col("t"), F.lit(0), F.lit(9)).alias("x")).collect() == [(None,), ([],)]


def test_means_are_printed_as_their_values_are(spark):
    rows = [(1, 0.00025), (2, 0.00035), (3, 45.63525), (4, 7.0), (5, None)]
    wide = spark.createDataFrame(rows, "file int, mean double")
    got = {r.file: r.value for r in metrics.long_metrics(wide, "file", ["mean"]).collect()}
    assert got == {k: None if x is None else (f"{x:.4f}".rstrip("0") + "0" if f"{x:.4f}".rstrip("0").endswith(".") else f"{x:.4f}".rstrip("0")) for k, x in rows}
    assert got[3] == "45.6352"


def test_metrics_match_their_sql_at_a_larger_size(spark):
    from tests.oracle import differs
    from turnwise.queries import ORACLE_SQL, QUERIES

    assert differs(spark, QUERIES["a13_metrics_long"], ORACLE_SQL["a13_metrics_long"], "/root/testdata/sf0.1") is None


def test_means_of_events_without_a_number_or_of_one_number(spark, tmp_path):
    from tests.oracle import differs
    from turnwise.queries import ORACLE_SQL, QUERIES

    rows = [(None, 1, 1.0), (None, 1, 2.5), (7, 2, 1.0), (7, 2, 4.0), (7, 2, 0.5), (None, 3, 5.0), (1, 3, 6.0), (2, None, 3.0), (3, 4, None), (None, 5, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", F.expr("timestamp'2024-01-01'")).coalesce(1).write.parquet(str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("*.parquet")
    (tmp_path / "events.parquet").write_bytes(part.read_bytes())
    assert differs(spark, QUERIES["a13_metrics_long"], ORACLE_SQL["a13_metrics_long"], str(tmp_path)) is None


def test_bags_of_long_turns(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(N)), lambda i: F.concat(F.lit("W"), i.cast("string"))).alias("a"), F.transform(F.sequence(F.lit(11), F.lit(N + 5)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("b"))
    (row,) = _within(40, df.select(sequences.bag_difference(F.col("a"), F.col("b")).alias("d"), sequences.bag_overlap(F.col("a"), F.col("b")).alias("o")))
    assert (row.d, row.o) == (15, 0)
    some = spark.createDataFrame([(["a", "A", "b", None], ["a", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [tuple(r) for r in some.select(sequences.bag_difference(F.col("a"), F.col("b")), sequences.bag_overlap(F.col("a"), F.col("b"))).collect()] == [(3, 1), (0, 0)]
