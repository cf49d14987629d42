"""Range rules on a long utterance: numbers are looked up, not carried along with every word."""

from pyspark.sql import functions as F

from turnwise.operators import cascades


def parse(spark, n):
    """A chain of ``n`` words; words 2 and 3, 7 and 8, ... are parts of one."""
    items = spark.range(1, n + 1).select(
        F.lit(1).cast("long").alias("file"), F.lit(1).cast("long").alias("utt"), "id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("l").alias("lemma"), F.lit("X").alias("upos"),
        F.lit(None).cast("string").alias("feats"), (F.col("id") - 1).alias("head"), F.lit("dep").alias("deprel"), F.lit("x").alias("lang"), (F.col("id") * 2).alias("more"),
    )
    ranges = items.where("id % 5 = 2").select("file", "utt", F.col("id").alias("first"), (F.col("id") + 1).alias("last"), F.concat(F.lit("r"), F.col("id")).alias("text"))
    rules = ranges.select(F.lit("x").alias("lang"), "text", F.lit("one").alias("kind"), F.lit("ONE").alias("new_upos"), F.lit(None).cast("string").alias("new_lemma"), F.lit(None).cast("string").alias("new_feats"))
    return cascades.regrouped(items, ranges, rules)


def test_heads_follow_the_new_numbers(spark):
    n = 4000
    out = {r.id: r for r in parse(spark, n).collect()}
    assert len(out) == n - n // 5 and set(out) == set(range(1, len(out) + 1))
    assert all(r.head == k - 1 for k, r in out.items())  # a chain stays one
    assert [(out[k].text, out[k].upos, out[k].more) for k in (1, 2, 3)] == [("w1", "X", 2), ("r2", "ONE", 4), ("w4", "X", 8)]


def test_no_window_gathers_an_utterance(spark):
    plan = parse(spark, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("collect_list" in x and "Window" in x for x in plan.splitlines())
