"""A cache of model results as a table of snapshots.

Layout under one folder that all executors reach::

    data/<name>/_p=<part>/*.parquet   entries, written once and never changed
    manifest/<version>.json           the names that are alive in a version

A version is put in place by creating its manifest file, which fails if another writer was there first; that
writer then takes the newer version as its base and tries again. So readers see whole versions only,
and of several writers none loses an entry. The file system must create a file at most once (local disks and HDFS do). Entries are
found by a digest of their keys, in which a null key is a value like any other; a lookup reads only the parts
(by digest) that its items fall into. The latest entry of a key counts. A writer that dies while it writes a manifest (some
bytes) leaves a file that is not read, but has to be removed before others can go on; they raise and say so.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import jobs

_PARTS = 64
_TRIES = 100


def digest(keys: list[str]) -> Column:
    """One value for all keys; null differs from every text."""
    return F.sha2(F.to_json(F.struct(*[F.struct(F.col(k).isNull().alias("n"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("v")).alias(f"k{i}") for i, k in enumerate(keys)])), 256)


class SnapshotCache:
    """Results (``data``) by ``keys``, kept for all runs that share ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions -----------------------------------------------------------------

    def version(self) -> tuple[int, list[str]]:
        """(number, live names) of the newest version; (0, []) before the first."""
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return 0, []
        numbers = [int(n[:-5]) for n in (s.getPath().getName() for s in self._fs.listStatus(folder)) if n.endswith(".json") and n[:-5].isdigit()]
        while numbers:  # the newest file may still be in the making
            newest = max(numbers)
            rows = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{newest}.json").collect()
            if rows and rows[0].value.rstrip().endswith("]}"):
                return newest, json.loads(rows[0].value)["live"]
            numbers.remove(newest)
        return 0, []

    def _commit(self, change: Callable[[list[str]], list[str]]) -> None:
        for attempt in range(_TRIES):
            time.sleep(min(attempt, 20) * 0.05)
            number, live = self.version()
            number += 1
            try:
                out = self._fs.create(self._path(f"{self.path}/manifest/{number}.json"), False)
            except Exception as taken:  # noqa: BLE001 - py4j wraps FileAlreadyExistsException
                if "exist" not in str(taken).lower():
                    raise
                continue  # someone else's version: look again
            out.write(bytearray((json.dumps({"live": change(live)}) + "\n").encode()))
            out.close()
            return
        raise RuntimeError(f"no version could be put in place; is the newest file of {self.path}/manifest incomplete?")

    # --- entries ------------------------------------------------------------------

    def _read(self, names: list[str]) -> DataFrame | None:
        if not names:
            return None
        schema = "_k string, created_at long, data string, _p int"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{n}" for n in names]).drop("name")

    def _write(self, entries: DataFrame) -> str:
        """Entries (_k, created_at, data) as one folder; each part is one file or a few."""
        name = f"name={uuid.uuid4().hex}"
        placed = entries.withColumn("_p", F.pmod(F.xxhash64("_k"), F.lit(_PARTS)).cast("int"))
        placed.repartition("_p").write.partitionBy("_p").parquet(f"{self.path}/data/{name}")
        return name

    def entries(self, parts: list[int] | None = None) -> DataFrame:
        """_k, data: the latest entry of each key, of the given parts only."""
        found = self._read(self.version()[1])
        if found is None:
            return self.spark.createDataFrame([], "_k string, data string")
        if parts is not None:
            found = found.where(F.col("_p").isin(parts))
        return jobs.latest(found, ["_k"], "created_at", "data").select("_k", "data")

    def lookup(self, items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """(items with ``data``, items without an entry)."""
        marked = items.withColumn("_k", digest(keys))
        parts = [r._p for r in marked.select(F.pmod(F.xxhash64("_k"), F.lit(_PARTS)).cast("int").alias("_p")).distinct().collect()]  # 64 at most
        known = self.entries(parts)
        return marked.join(known, "_k").drop("_k"), marked.join(known.select("_k"), "_k", "left_anti").drop("_k")

    def store(self, rows: DataFrame) -> None:
        """Adds rows (keys, created_at, data) as a new version."""
        name = self._write(rows.select(digest(self.keys).alias("_k"), F.col("created_at").cast("long").alias("created_at"), F.col("data").cast("string").alias("data")))
        self._commit(lambda live: [*live, name])

    def compact(self) -> None:
        """One folder with the latest entries in place of those that are alive now; entries stored meanwhile stay."""
        _, live = self.version()
        if len(live) > 1:
            latest = jobs.latest(self._read(live), ["_k"], "created_at", "data").select("_k", "created_at", "data")
            name, gone = self._write(latest), set(live)
            # of two compactions at once only the first may drop the folders
            self._commit(lambda now: [name, *[n for n in now if n not in gone]] if gone <= set(now) else now)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes data that none of the last ``keep`` versions names, and older manifests (call it when no reader uses them)."""
        number, _ = self.version()
        kept: set[str] = set()
        for v in range(max(1, number - keep + 1), number + 1):
            kept |= set(json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{v}.json").first().value)["live"])
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.path}/data")) if s.getPath().getName() not in kept] if number else []
        for p in gone:
            self._fs.delete(p, True)
        for v in range(1, number - keep + 1):
            self._fs.delete(self._path(f"{self.path}/manifest/{v}.json"), False)
        return [p.getName() for p in gone]


def cached(items: DataFrame, keys: list[str], tiers: list[SnapshotCache], compute: Callable[[DataFrame], DataFrame], now: int) -> DataFrame:
    """``items`` with ``data``: from the first tier that has it, else computed.

    What a far tier has is put into the nearer ones; what none has is computed once for each distinct key,
    written to the farthest tier and read from there, so that the model runs once however many tiers there are and
    however often the result is read.
    """
    wanted, nearer = items.dropDuplicates(keys), []
    for tier in tiers:
        hits, wanted = tier.lookup(wanted, keys)
        for near in nearer:
            near.store(hits.withColumn("created_at", F.lit(now)))
        nearer.append(tier)
    if not wanted.isEmpty():
        last = tiers[-1]
        last.store(compute(wanted).withColumn("created_at", F.lit(now)))
        for near in tiers[:-1]:
            near.store(last.lookup(wanted, keys)[0].withColumn("created_at", F.lit(now)))
    return tiers[0].lookup(items, keys)[0]
