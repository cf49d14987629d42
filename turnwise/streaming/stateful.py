"""Job status and leases as stateful streams with timers, stored in files.

``transformWithStateInPandas`` keeps one state for each job in RocksDB; a timer in event time ends a lease that nobody
renews, and idle jobs leave the state by its time to live. Results go to files by ``store``: each micro-batch is a
folder of its number, so that a batch which is sent again after a crash replaces itself, and a
stream that is started again with the same checkpoint goes on where it was. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from turnwise.operators import jobs

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def store(stream: DataFrame, path: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Runs a stream into ``path``/table, with its checkpoint beside it.

    ``once``: over what there is, and ends then. Otherwise the query is returned as it runs; so must
    streams with a time to live be run, which always have something to wait for.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put)
        q = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
        if once:
            q.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return q


def stored(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """What ``store`` has written: all rows, or the last row of each key."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/table")
    return (jobs.latest(rows, keys, "batch") if keys else rows).drop("batch")


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    some = list(batches)
    return pd.concat(some).sort_values(["ts", "seq"], kind="stable") if some else None


class LeaseBook(StatefulProcessor):
    """Who holds a job: claim, renew, release, complete; a lease ends ``ttl_ms`` after its last claim or renewal."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "worker string, until long, n long")

    def _set(self, worker: str | None, until: int, n: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.lease.update((worker or "", until, n))
        if worker:
            self.handle.registerTimer(until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        worker, until, n = self.lease.get() if self.lease.exists() else ("", 0, 0)
        out, ordered = [], _in_order(rows)
        for ts, action, who in zip(ordered["ts"], ordered["action"], ordered["worker"], strict=True):
            at = int(pd.Timestamp(ts).value // 1_000_000)
            if worker and until < at:
                out.append((until, worker, "expired"))
                worker = ""
            if action == "claim":
                outcome = "granted" if not worker else "renewed" if worker == who else "refused"
            else:
                outcome = {"renew": "renewed", "release": "released", "complete": "completed"}.get(action, "unknown") if worker == who else "refused"
            if outcome in ("granted", "renewed"):
                worker, until = who, at + self.ttl_ms
            elif outcome in ("released", "completed"):
                worker = ""
            n += outcome == "granted"
            out.append((at, who, outcome))
        self._set(worker, until, n)
        yield pd.DataFrame([(key[0], *row) for row in out], columns=["job_id", "at_ms", "worker", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        worker, until, n = self.lease.get() if self.lease.exists() else ("", 0, 0)
        if worker and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.lease.update(("", until, n))
            yield pd.DataFrame([(key[0], until, worker, "expired")], columns=["job_id", "at_ms", "worker", "outcome"])

    def close(self) -> None:
        pass


LEASES = "job_id long, at_ms long, worker string, outcome string"


def leases(events: DataFrame, ttl_ms: int, late: str = "1 minute") -> DataFrame:
    """job_id, at_ms, worker, outcome (granted, renewed, refused, released, completed, expired) of a stream job_id, ts, seq, action, worker.

    Rows of a micro-batch are taken in order of ts and seq. A lease that nobody renews is ended by a timer once the watermark (``late``
    behind the latest event) has passed its end.
    """
    rows = events.select("job_id", "ts", "seq", "action", "worker").withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(LeaseBook(ttl_ms), LEASES, "Append", "EventTime")


class JobBook(StatefulProcessor):
    """Status of a job and its number of updates; ``complete`` and ``deleted`` close it, idle ones leave by their time to live."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.seen.get()[0] if self.seen.exists() else 0
        ordered = _in_order(rows)
        n, last = n + len(ordered), ordered["kind"].iloc[-1]
        if last in ("complete", "deleted"):
            self.seen.clear()
        else:
            self.seen.update((n,))
        yield pd.DataFrame({"job_id": [key[0]], "status": [last], "updates": [n]})

    def close(self) -> None:
        pass


STATUS = "job_id long, status string, updates long"


def job_status(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """job_id, status, updates of a stream job_id, ts, seq, kind: a row for each job and micro-batch, the latest of which counts."""
    rows = events.select("job_id", "ts", "seq", "kind")
    return rows.groupBy("job_id").transformWithStateInPandas(JobBook(ttl_ms), STATUS, "Update", "None" if ttl_ms is None else "ProcessingTime")
