"""Choices a user makes by name: how times are recovered, where results are kept, which engine answers, what is overridden.

Each kind is a small table of functions over DataFrames; ``register_*`` adds to it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import alignment, jobs, joins, timing
from turnwise.plans.cache import SnapshotCache, cached
from turnwise.plans.engines import engines
from turnwise.session import kept

# --- timing recovery ------------------------------------------------------------------

Recovery = Callable[[DataFrame, DataFrame], DataFrame]
_RECOVERY: dict[str, Recovery] = {"global": alignment.recover_timing, "two_pass": alignment.recover_overlapping}


def register_recovery(name: str, strategy: Recovery) -> None:
    _RECOVERY[name] = strategy


def recover(utts: DataFrame, tokens: DataFrame, strategy: str = "auto") -> DataFrame:
    """Spans of (file, utt, words, has_overlap); ``auto`` chooses for each file by its overlap marks."""
    if strategy != "auto":
        if strategy not in _RECOVERY:
            raise KeyError(f"no strategy {strategy}; known: {sorted(_RECOVERY)}")
        return _RECOVERY[strategy](utts, tokens)
    chosen = timing.recovery_strategy(utts)
    of = lambda df, name: df.join(chosen.where(F.col("strategy") == name).select("file"), "file", "left_semi")
    return _RECOVERY["global"](of(utts, "global"), of(tokens, "global")).unionByName(_RECOVERY["two_pass"](of(utts, "two_pass"), of(tokens, "two_pass")))


# --- caches ---------------------------------------------------------------------------


class Cache(Protocol):
    def lookup(self, items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """(items with ``data``, items without an entry)."""

    def store(self, rows: DataFrame) -> None: ...


class NoCache:
    """Nothing is kept."""

    def lookup(self, items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        return items.withColumn("data", F.lit(None).cast("string")).where("false"), items

    def store(self, rows: DataFrame) -> None:
        return None


class TableCache:
    """Entries (keys, created_at, data) appended to a Parquet folder that all executors reach; the latest one counts."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys
        self.schema = ", ".join(f"`{k}` string" for k in keys) + ", created_at long, data string"

    def entries(self) -> DataFrame:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        return jobs.latest(self.spark.read.schema(self.schema).parquet(self.path), self.keys, "created_at", "data") if there else self.spark.createDataFrame([], self.schema)

    def lookup(self, items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        return joins.cache_split(items, self.entries().select(*keys, "data"), keys)

    def store(self, rows: DataFrame) -> None:
        rows.select(*self.keys, F.col("created_at").cast("long").alias("created_at"), "data").write.mode("append").parquet(self.path)


class TieredCache:
    """One cache before another: what the first does not have is sought in the second."""

    def __init__(self, near: Cache, far: Cache) -> None:
        self.near, self.far = near, far

    def lookup(self, items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        hits, misses = self.near.lookup(items, keys)
        more, left = self.far.lookup(misses, keys)
        return hits.unionByName(more), left

    def store(self, rows: DataFrame) -> None:
        self.near.store(rows)
        self.far.store(rows)


def through_cache(items: DataFrame, keys: list[str], cache: Cache, compute: Callable[[DataFrame], DataFrame], now: int) -> DataFrame:
    """(items with ``data``): cached where there is an entry; the rest is computed and stored.

    With a ``SnapshotCache`` results are written once and read from the cache. Other caches have no
    place for that: the new results are checkpointed, so that the model does not run again for each reader.
    """
    if isinstance(cache, SnapshotCache):
        return cached(items, keys, [cache], compute, now)
    hits, misses = cache.lookup(items, keys)
    new = kept(compute(misses), "computed")
    cache.store(new.withColumn("created_at", F.lit(now)))
    return hits.select(*items.columns, "data").unionByName(new.select(*items.columns, "data"))


# --- engines --------------------------------------------------------------------------


def choose_engine(task: str, wanted: str | None, lang: str, by_language: dict[str, str] | None = None, default: str = "rules") -> str:
    """The engine of a task: the one asked for, else the language's own, else the default; unknown names raise."""
    name = wanted or (by_language or {}).get(lang, default)
    if (task, name) not in engines(task):
        raise KeyError(f"no engine {name} for {task}; known: {[n for _, n in engines(task)]}")
    return name


# --- sentence overrides ------------------------------------------------------------------


def override_items(items: Column, rules: list[tuple[Callable[[Column], Column], Callable[[Column], Column]]]) -> Column:
    """Items of a sentence, each through the first rule (condition, replacement) that applies to it."""

    def one(x: Column) -> Column:
        out = None
        for applies, value in rules:
            out = F.when(applies(x), value(x)) if out is None else out.when(applies(x), value(x))
        return x if out is None else out.otherwise(x)

    return F.transform(items, one)


def merge_multiwords(words: Column, phrases: list[list[str]]) -> Column:
    """A user's multiword entries as one word with ``_``, longest first, from the left (case does not matter).

    ``phrases`` are part of the expression: for a few hundred entries; larger lists are tables (``operators.lexicons``).
    """
    longest = sorted({tuple(w.lower() for w in p) for p in phrases if len(p) > 1}, key=lambda p: (-len(p), p))
    low = F.transform(words, F.lower)

    def size_at(i: Column) -> Column:
        out = F.lit(1)
        for p in reversed(longest):
            out = F.when(F.slice(low, i + 1, len(p)) == F.array(*map(F.lit, p)), len(p)).otherwise(out)
        return out

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.array_join(F.slice(words, x["i"] + 1, x["n"]), "_")
        taken = F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip"))
        return F.when(acc["skip"] > 0, taken).otherwise(F.struct(F.concat(acc["out"], F.array(joined)).alias("out"), (x["n"] - 1).alias("skip")))

    return F.aggregate(F.transform(words, lambda w, i: F.struct(i.alias("i"), size_at(i).alias("n"))), start, step)["out"]
