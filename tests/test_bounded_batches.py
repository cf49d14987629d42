"""Python holds a bounded number of values, however many rows an Arrow batch has."""

import pyarrow as pa
from pyspark.sql import functions as F

from turnwise.functions.lazy import pieces, row_udf


def test_pieces_are_bounded_and_whole():
    a = pa.array([["x"] * 99, [], None, ["y"] * 5000] * 50, pa.list_(pa.string()))
    b = pa.array([[{"w": ["z"] * 10}]] * 200, pa.list_(pa.struct([("w", pa.list_(pa.string()))])))
    parts = list(pieces((a, b), 4000))
    assert sum(len(p[0]) for p in parts) == 200 and len(parts) > 40
    assert pa.concat_arrays([p[0] for p in parts]).equals(a) and pa.concat_arrays([p[1] for p in parts]).equals(b)
    assert max(sum(len(x or ()) for x in p[0].to_pylist()) for p in parts if len(p[0]) > 1) < 4000


def test_row_functions_keep_rows_and_nulls(spark):
    df = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.array_repeat(F.col("id"), 50)).alias("w"))
    total = row_udf("struct<n:int,sum:bigint>")(lambda w: None if w is None else (len(w), sum(w)))
    for r in df.select("id", total("w").alias("t")).collect():
        assert r.t == (None if r.id % 7 == 0 else (50, 50 * r.id))


def test_each_distinct_word_is_judged_once(spark):
    from turnwise.sources import grammar

    said = spark.createDataFrame([("ok",), ("b[",), ("b[",)], "word string")
    bad = grammar.bad_words(said)
    assert [(r.word, r.n) for r in bad.collect()] == [("b[", 2)]
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan[plan.index("Aggregate [") :].split("\n", 1)[1]  # nothing is judged below the grouping


def test_counts_without_items(spark):
    from turnwise.operators import alignment

    rows = [(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["a"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").withColumns({"s": F.array_join("a", ""), "t": F.array_join("b", "")})
    got = df.select(alignment.aligned_counts()("a", "b").alias("n"), alignment.counts(alignment.aligned()("a", "b")).alias("i"), alignment.aligned_counts()("s", "t").alias("c")).collect()
    assert [r.n for r in got] == [(2, 1, 2), (0, 0, 1), None]
    assert got[0].i == got[0].n == got[0].c and got[1].i == got[1].n == got[1].c


def test_stitched_column(spark):
    from turnwise.operators import alignment

    df = spark.createDataFrame([(["ab", "c"], [("a", 0, 1), ("b", 1, 2), ("x", 2, 3)]), (None, [])], "w array<string>, t array<struct<text:string,start_ms:bigint,end_ms:bigint>>")
    assert [r.s for r in df.select(alignment.stitched("w", "t").alias("s")).collect()] == [[(0, 2), None], None]


def test_engines_get_bounded_batches(spark):
    from turnwise.plans import engines

    def sizes(batches):
        for b in batches:
            yield b[["file"]].assign(n=len(b))

    engines.register("sizes", "test", sizes, "file long, n int")
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("file"), F.array_repeat(F.struct(F.lit(1).alias("utt"), F.array_repeat(F.lit("w"), 100).alias("words")), 2).alias("sentences"))
    got = engines.infer(docs, "sizes", "test").agg(F.count("*").alias("rows"), F.max("n").alias("most")).first()
    assert got.rows == 4000 and got.most < 200


def test_small_groups_do_not_start_pandas_each(spark):
    from turnwise.operators import timing

    w = spark.createDataFrame([(1, 1, 0, 0, 10), (1, 1, 1, 10, 200), (1, 2, 0, 5, 6)], "file long, utt long, pos long, start_ms long, end_ms long")
    out = timing.rebalance_short_words(w)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0, 0, 40), (1, 1, 1, 40, 200), (1, 2, 0, 5, 6)]
    lines = spark.createDataFrame([(1, "a", 1, 0, 1), (1, "a", 2, 9, 10), (1, "a", 3, 5, 6), (1, "a", 4, 7, 8), (1, "b", 5, 1, 2)], "file long, speaker string, line long, start_ms long, end_ms long")
    gone = timing.out_of_order(lines)
    assert [tuple(r) for r in gone.collect()] == [(1, "a", 2)]
    assert all("InPandas" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (out, gone))
