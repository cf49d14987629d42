"""Job events as streams: windows, sessions, idempotent batches and incremental work (state and leases: ``stateful``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import jobs


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Parquet files as they come, with the schema of those that are there; ``ts`` as an instant."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and kind; late rows beyond the watermark are dropped (an addition, not parity)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_sink(path: str):
    """For ``foreachBatch``: each batch is a folder of its number, so that a batch that is sent again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of each key over all batches."""
    return jobs.latest(spark.read.parquet(path), keys, "batch").drop("batch")


def changed_only(before: DataFrame, after: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Rows of ``after`` whose content is new or different: what has to be processed again."""
    same = before.select(*keys, F.sha2(F.to_json(F.struct(*content)), 256).alias("_h"))
    return after.withColumn("_h", F.sha2(F.to_json(F.struct(*content)), 256)).join(same, [*keys, "_h"], "left_anti").drop("_h")
