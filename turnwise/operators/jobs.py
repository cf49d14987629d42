"""Job, attempt, cache and review bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; a null key is a key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Append-only store, read as its latest rows."""
    return latest(old.unionByName(new), keys, version)


def delete(store: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(gone.select(*keys).distinct(), keys, "left_anti")


def next_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    return attempts.groupBy(*keys).agg((F.coalesce(F.max("attempt_number"), F.lit(0)) + 1).alias("next_attempt"))


def job_status(files: DataFrame, job: str = "job_id") -> DataFrame:
    """cancelled, failed or completed from file outcomes, with the counts behind it."""
    c = files.groupBy(job).agg(F.count("*").alias("files"), *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "error", "cancelled", "pending")])
    return c.withColumn("job_status", F.when(F.col("pending") > 0, "running").when(F.col("cancelled") > 0, "cancelled").when(F.col("error") > 0, "failed").otherwise("completed"))


def cache_statistics(cache: DataFrame) -> DataFrame:
    """Entries in all, by task, and by task and engine version, in one pass."""
    cache.createOrReplaceTempView("_cache_entries")
    return cache.groupingSets([[], ["task"], ["task", "engine_version"]], "task", "engine_version").agg(F.count("*").alias("entries"), F.grouping_id().alias("level"))


def expired(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of epoch seconds older than ``days`` before a fixed ``now``."""
    return df.where(F.col(at) < now - days * 86400)


def backoff(n: Column, first: float = L.RETRY_FIRST_S, factor: float = L.RETRY_FACTOR, cap: float = L.RETRY_CAP_S) -> Column:
    """Seconds to wait before retry ``n`` (1, 2, ...)."""
    return F.least(F.lit(cap), F.lit(first) * F.pow(F.lit(factor), n - 1))


def retry_plan(attempts: DataFrame, most: int = L.RETRY_ATTEMPTS) -> DataFrame:
    """Failed attempts: another one with its earliest time, or given up."""
    again = F.col("attempt_number") < most
    return attempts.where("outcome = 'failed'").withColumns({"disposition": F.when(again, "retry").otherwise("give_up"), "next_eligible_at": F.when(again, F.col("finished_at") + backoff(F.col("attempt_number")))})


def ready_queue(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("submitted_at", "job_id")


def review_summary(lines: DataFrame, tier: str = "tier") -> tuple[DataFrame, DataFrame]:
    """(counts by outcome, the queue of lines to look at)."""
    return lines.groupBy(tier).agg(F.count("*").alias("n")), lines.where(F.col(tier).isin("review", "hold")).orderBy("file", "line")


def leases(claims: DataFrame, now: Column) -> DataFrame:
    """Who holds each job: the last claim or renewal, if it has not run out or been released."""
    last = latest(claims, ["job_id"], "at", "seq")
    return last.withColumn("state", F.when(F.col("action") == "release", "free").when(F.col("at") + F.col("ttl_s") < now, "expired").otherwise("held"))


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart, running work waits again and its files are pending."""
    return jobs.withColumn("status", F.when(F.col("status").isin("running", "claimed"), "queued").otherwise(F.col("status")))


def run_time_average(runs: DataFrame) -> DataFrame:
    return runs.groupBy("name").agg(F.avg("elapsed_s").alias("mean_s"), F.count("*").alias("runs"))


def counters(files: DataFrame) -> DataFrame:
    """One row of operational counters over the files of all jobs."""
    n = lambda s: F.count_if(F.col("status") == s)
    return files.agg(F.count("*").alias("files"), F.count_distinct("job_id").alias("jobs"), n("done").alias("done"), n("error").alias("failed"))


def newest_first(jobs: DataFrame, at: str, key: str, n: int | None = None) -> DataFrame:
    """Jobs from the newest on (ties: the smaller key); the first ``n`` if given, without a full sort."""
    ordered = jobs.orderBy(F.desc(at), key)
    return ordered if n is None else ordered.limit(n)


def attempts_in_order(attempts: DataFrame, keys: list[str], started: str, number: str) -> DataFrame:
    """Adds ``n``, the place of an attempt among those of its unit, by start and number."""
    return attempts.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(started, number)).cast("long"))


def latest_one(df: DataFrame, *order: str) -> DataFrame:
    """The one row that comes last."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(1)


def rejections(rows: DataFrame, reason: str) -> DataFrame:
    """reason, n: dropped and rejected timings by reason; rows without one are kept timings."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
