"""Parsing deals lines out in shares of bounded size, and moves nothing else."""

from pyspark.sql import functions as F

from turnwise.sources import grammar


def lines(spark, n):
    text = F.concat(F.lit("<a b> [//] c [: d e] "), F.repeat(F.lit("w <x y> [/] "), (F.col("id") % 7).cast("int")), F.lit("."))
    return spark.range(n).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.col("id").cast("int").alias("line_no"), F.lit("utterance").alias("kind"), text.alias("text"), F.lit("A").alias("label"))


def test_shares_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(grammar, "_SHARE", 2000)
    most = []
    for n in (500, 4000):
        said = grammar._dealt(lines(spark, n)).groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("c"))
        most.append(said.agg(F.max("c")).first()[0])
    assert max(most) < 3 * 2000


def test_only_lines_are_shuffled(spark):
    plan = grammar.parse(lines(spark, 50))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and all("REPARTITION_BY_NUM" in x and "pos#" not in x for x in moved)


def test_repeated_and_nested_replacements(spark):
    rows = [(1, "<a [: x] b> [: y z] c [: p] [: q] <> [: r] d [/] ."), (2, None), (3, "[: lost] (.) <e f> [: g] [?]")]
    df = spark.createDataFrame([("f", n, "utterance", t, "A") for n, t in rows], "file string, line_no int, kind string, text string, label string")
    out = {r.line_no: r for r in grammar.parse(df).collect()}
    said = lambda n: [(w.word, w.retraced, w.uncertain, w.replaced, w.replacement) for w in out[n].words]
    assert [w[0] for w in said(1)] == ["a", "b", "c", "d"] and [w[3] for w in said(1)] == [True, True, True, False]
    assert said(1)[0][4] == ["x"] and said(1)[2][4] == ["q"] and said(1)[3][1] is True
    assert out[2].words is None and out[2].codes is None and out[2].errors == []
    assert said(3) == [("e", False, True, True, ["g"]), ("f", False, True, True, None)] and out[3].errors == ["nothing before"]
