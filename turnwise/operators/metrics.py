"""Error rates, agreement and distributions as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions.lazy import row_udf


def tally(compared: DataFrame, *keys: str) -> DataFrame:
    """matches, insertions, deletions of compared tokens by ``keys``; punctuation is not counted."""
    rows = compared.where(F.coalesce(F.upper("pos") != "PUNCT", F.lit(True)))
    return rows.groupBy(*keys).agg(F.count_if(F.col("status") == "match").alias("matches"), F.count_if(F.col("status") == "extra_payload").alias("insertions"), F.count_if(F.col("status") == "extra_reference").alias("deletions"))


def with_rates(counts: DataFrame) -> DataFrame:
    """wer and accuracy; without gold words the rate is 0, and accuracy stays in [0, 1]."""
    gold = F.col("matches") + F.col("deletions")
    wer = F.when(gold > 0, (F.col("insertions") + F.col("deletions")) / gold).otherwise(F.lit(0.0))
    return counts.withColumn("total_gold_words", gold).withColumn("wer", wer).withColumn("accuracy", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("wer"))))


def bag_errors(compared: DataFrame) -> DataFrame:
    """file, bag_errors: words that one side of a unit has more of, case folded, whatever their order."""
    rows = compared.where(F.col("status") != "match").where(F.coalesce(F.upper("pos") != "PUNCT", F.lit(True)))
    sign = F.when(F.col("status") == "extra_payload", 1).otherwise(-1)
    each = rows.groupBy("file", "unit", F.lower("text").alias("w")).agg(F.sum(sign).alias("d"))
    return each.groupBy("file").agg(F.sum(F.abs("d")).alias("bag_errors"))


def agreement(left: DataFrame, right: DataFrame, key: str, token: str) -> DataFrame:
    """By key: words of both sides, multiset overlap of case-folded tokens, and the rate (null for an empty left side)."""
    count = lambda df, n: df.groupBy(key, F.lower(token).alias("w")).agg(F.count("*").alias(n))
    both = count(left, "l").join(count(right, "r"), [key, "w"], "full_outer")
    sums = both.groupBy(key).agg(F.sum(F.coalesce("l", F.lit(0))).alias("left_words"), F.sum(F.coalesce("r", F.lit(0))).alias("right_words"), F.sum(F.least(F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("overlap"))
    return sums.withColumn("rate", F.try_divide("overlap", F.when(F.col("left_words") > 0, F.col("left_words"))))


def nearest_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, p50, p95, max by nearest rank (``ceil(n * p / 100)``)."""
    pick = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").cast(df.schema[value].dataType)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("min"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max(value).alias("max"))


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value by key; of equally frequent ones the one seen first."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return each.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def detected_languages(df: DataFrame, key: str, lang: str, order: str, least: int = L.DETECT_UTTERANCES) -> DataFrame:
    """By key: the primary language, then others with at least ``least`` utterances, most frequent first (ties: seen first)."""
    each = df.where(F.col(lang).isNotNull()).groupBy(key, lang).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    kept = each.withColumn("r", rank).where((F.col("r") == 1) | (F.col("n") >= least))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", lang))), lambda x: x[lang]).alias("languages"))


def top_string(df: DataFrame, keys: list[str], value: str, k: int = 5) -> DataFrame:
    """'x:300, noun:262': the ``k`` most frequent values with their counts (ties in order of the value)."""
    each = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    kept = each.withColumn("r", rank).where(F.col("r") <= k)
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", F.col(value), F.col("n").cast("string")).alias("s")))), lambda x: x["s"]), ", ").alias("top"))


def boundary_quality(df: DataFrame, pred: str, label: str, *keys: str) -> DataFrame:
    """accuracy, precision, recall, f1 of boundary marks; label -100 is left out, empty denominators give 0."""
    rows = df.where(F.col(label) != -100)
    hit = lambda p, y: F.count_if((F.col(pred) == p) & (F.col(label) == y))
    c = rows.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.withColumns({"accuracy": rate(tp + tn, tp + fp + fn + tn), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn)})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def pitch_verdict(df: DataFrame, keys: list[str], hz: str) -> DataFrame:
    """voiced frames, median pitch, share of child pitch, and the verdict."""
    v = df.where(F.col(hz) > 0).groupBy(*keys).agg(F.count("*").alias("frames"), F.median(hz).alias("median_hz"), F.avg((F.col(hz) > L.CHILD_HZ).cast("double")).alias("child_share"))
    return v.withColumn("verdict", F.when(F.col("frames") < L.VOICED_FRAMES, "unknown").when(F.col("child_share") >= L.CHILD_SHARE, "child").when(F.col("child_share") <= L.ADULT_SHARE, "adult").otherwise("mixed"))


def voice_quality(cpps: Column, hnr: Column, shimmer: Column, shimmer_db: Column, slope: Column, tilt: Column) -> Column:
    """Acoustic voice quality index, a linear formula over six features."""
    return (F.lit(4.152) - 0.177 * cpps - 0.006 * hnr - 0.037 * shimmer + 0.941 * shimmer_db + 0.01 * slope + 0.093 * tilt) * 2.8902


def long_metrics(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, metric, value): rates with four decimals, counts whole; zeros at the end go but one."""
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = wide.select(key, F.expr(f"stack({len(columns)}, {parts}) as (metric, x)"))
    return long.select(key, "metric", metric_text(four_decimals("x")).alias("value"))


@row_udf("string")
def four_decimals(x: float | None) -> str | None:
    """The exact value of a double rounded to four decimals, as printf does (Java rounds its shortest digits half up)."""
    return None if x is None else f"{x:.4f}"


def metric_text(fixed: Column) -> Column:
    """'0.5000' as '0.5', '1.0000' as '1.0'."""
    cut = F.regexp_replace(fixed, "0+$", "")
    return F.when(cut.endswith("."), F.concat(cut, F.lit("0"))).otherwise(cut)


def wide_metrics(long: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row for each key, a column for each metric, in the given order."""
    return long.groupBy(key).pivot("metric", metrics).agg(F.first("value"))


def per_pair_rollup(words: DataFrame, key: str, statuses: list[str], flags: list[str]) -> DataFrame:
    """files, totals, statuses and flags of tagged words, and their rates (0 when empty)."""
    aggs = [F.count_distinct("file").alias("files"), F.count("*").alias("total")]
    aggs += [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    aggs += [F.count_if(F.array_contains("flags", f)).alias(f"flag_{f}") for f in flags]
    aggs += [F.count_if((F.col("status") == "spliced") & (F.size("flags") == 0)).alias("clean")]
    out = words.groupBy(key).agg(*aggs)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns({"splice_rate": rate("spliced", "total"), "clean_rate": rate("clean", "spliced")})


def distribution_lines(rows: list, title: str) -> str:
    """A small table of aggregates as markdown (rows are already reduced)."""
    if not rows:
        return f"# {title}\n\nno rows\n"
    names = list(rows[0].asDict())
    body = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)] + ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows]
    return f"# {title}\n\n" + "\n".join(body) + "\n"


def standardise(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Columns of a matrix in long form: mean 0, population deviation 1 (0 where constant)."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(F.lit(0.0)))


def median_filter(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = 3) -> DataFrame:
    half = width // 2
    near = F.array_sort(F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)))
    middle = lambda a, up: F.get(a, F.floor((F.size(a) - up) / 2).cast("int"))
    return df.withColumn(out, (middle(near, 1) + middle(near, 0)) / 2)


def count_flags(df: DataFrame, key: str, flag_columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.count_if(F.col(c)).alias(c) for c in flag_columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_speakers(segments: DataFrame) -> DataFrame:
    """file, speakers: how many speakers the segments of a file have."""
    return segments.groupBy("file").agg(F.count_distinct("speaker").alias("speakers"))


def language_batches(rows: DataFrame, lang: str, text: str) -> DataFrame:
    """Size of the batch that goes to the engine of each language: rows and characters."""
    return rows.groupBy(lang).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
