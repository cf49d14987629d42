"""Streams that stop and go on, leases by timers, and the snapshot cache."""

import datetime
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnwise.plans import cache, strategies
from turnwise.streaming import stateful

T0 = datetime.datetime(2024, 1, 1)
EVENTS = "job_id long, ts timestamp, seq long, action string, worker string, kind string"


def _write(spark, folder, n, rows):
    spark.createDataFrame([(j, T0 + datetime.timedelta(seconds=s), q, a, w, k) for j, s, q, a, w, k in rows], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))


def _stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _plain(rows, ttl):
    """Lease by lease in order of time."""
    out, held = [], {}
    for j, s, _, action, who, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        worker, until = held.get(j, (None, 0))
        at = s * 1000
        if worker and until < at:
            out.append((j, until, worker, "expired"))
            worker = None
        if action == "claim" and worker in (None, who) or action == "renew" and worker == who:
            out.append((j, at, who, "granted" if worker is None else "renewed"))
            worker, until = who, at + ttl
        elif action in ("release", "complete") and worker == who:
            out.append((j, at, who, action + "d" if action[-1] == "e" else action))
            worker = None
        else:
            out.append((j, at, who, "refused"))
        held[j] = (worker, until)
    newest = max(r[1] for r in rows) * 1000
    out += [(j, until, worker, "expired") for j, (worker, until) in held.items() if worker and until <= newest - 60_000]
    return Counter(out)


def test_leases_stop_and_go_on(spark, tmp_path):
    first = [(1, 0, 1, "claim", "a", "x"), (1, 5, 2, "claim", "b", "x"), (1, 8, 3, "renew", "a", "x"), (2, 1, 4, "claim", "a", "x"), (2, 2, 5, "release", "a", "x"), (2, 3, 6, "claim", "b", "x"), (3, 4, 7, "renew", "z", "x")]
    second = [(1, 30, 8, "claim", "b", "x"), (1, 31, 9, "complete", "b", "x"), (2, 5, 10, "complete", "b", "x"), (4, 40, 11, "claim", "c", "x")]
    third = [(5, 500, 12, "claim", "d", "x"), (1, 501, 13, "claim", "a", "x")]
    path, base = str(tmp_path / "out"), int(T0.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    for n, rows in enumerate((first, second, third)):  # each run is a new start on the same checkpoint
        _write(spark, tmp_path / "in", n, rows)
        stateful.store(stateful.leases(_stream(spark, tmp_path / "in"), 10_000), path)
    found = Counter((r.job_id, r.at_ms - base, r.worker, r.outcome) for r in stateful.stored(spark, path, stateful.LEASES).collect())
    assert found == _plain(first + second + third, 10_000)
    before = stateful.stored(spark, path, stateful.LEASES).count()
    stateful.store(stateful.leases(_stream(spark, tmp_path / "in"), 10_000), path)  # nothing new
    assert stateful.stored(spark, path, stateful.LEASES).count() == before


def test_a_batch_that_is_sent_again_replaces_itself(spark, tmp_path):
    _write(spark, tmp_path / "in", 0, [(1, 0, 1, "", "", "snapshot"), (2, 0, 2, "", "", "job_update")])
    path = str(tmp_path / "out")
    stateful.store(stateful.job_status(_stream(spark, tmp_path / "in")), path, "update")
    commits = tmp_path / "out" / "checkpoint" / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (last, commits / f".{last.name}.crc"):  # as if the driver had died between writing and committing
        if p.exists():
            p.unlink()
    _write(spark, tmp_path / "in", 1, [(1, 9, 3, "", "", "complete"), (3, 9, 4, "", "", "snapshot")])
    stateful.store(stateful.job_status(_stream(spark, tmp_path / "in")), path, "update")
    out = {r.job_id: (r.status, r.updates) for r in stateful.stored(spark, path, stateful.STATUS, ["job_id"]).collect()}
    assert out == {1: ("complete", 2), 2: ("job_update", 1), 3: ("snapshot", 1)}


def test_idle_jobs_can_be_forgotten(spark, tmp_path):
    path, status = str(tmp_path / "out"), lambda: stateful.job_status(_stream(spark, tmp_path / "in"), ttl_ms=1)
    _write(spark, tmp_path / "in", 0, [(1, 0, 1, "", "", "snapshot")])
    q = stateful.store(status(), path, "update", once=False)
    said = lambda: {(r.status, r.updates) for r in stateful.stored(spark, path, stateful.STATUS).collect()} if (tmp_path / "out" / "table").exists() else set()
    try:
        for wanted in ("snapshot", "job_update"):
            for _ in range(30):
                time.sleep(1)
                if wanted in {s for s, _ in said()}:
                    break
            if wanted == "snapshot":
                _write(spark, tmp_path / "in", 1, [(1, 1, 2, "", "", "job_update")])
    finally:
        q.stop()
    assert {("snapshot", 1), ("job_update", 1)} <= said()  # the first update was forgotten


@pytest.fixture
def model(spark):
    """A model that counts the items it sees, inside its tasks."""
    calls = spark.sparkContext.accumulator(0)

    def compute(items):
        def run(frames):
            for f in frames:
                calls.add(len(f))
                yield f.assign(data=["!" if k is None else k + "!" for k in f["key"]])

        return items.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields) + ", data string")

    return calls, compute


def test_the_model_runs_once_for_each_miss(spark, tmp_path, model):
    calls, compute = model
    keys = ["key", "version"]
    items = spark.createDataFrame([(f"k{i % 10}", "1") for i in range(30)] + [(None, "1"), ("", "1"), (None, "1")], "key string, version string").repartition(4)
    near, far = (cache.SnapshotCache(spark, str(tmp_path / n), keys) for n in ("near", "far"))
    said = lambda df: Counter((r.key, r.data) for r in df.collect())
    want = Counter({**{(f"k{i}", f"k{i}!"): 3 for i in range(10)}, (None, "!"): 2, ("", "!"): 1})
    out = cache.cached(items, keys, [near, far], compute, 1)
    assert said(out) == want and said(out) == want and calls.value == 12
    assert said(cache.cached(items, keys, [near, far], compute, 2)) == want and calls.value == 12
    fresh = cache.SnapshotCache(spark, str(tmp_path / "other"), keys)
    assert said(cache.cached(items, keys, [fresh, far], compute, 3)) == want and calls.value == 12
    assert fresh.entries().count() == 12  # hits of the far tier are put into the near one
    assert said(strategies.through_cache(items.withColumn("version", F.lit("2")), keys, far, compute, 4)) == want and calls.value == 24
    other = strategies.TableCache(spark, str(tmp_path / "table"), ["key", "version"])
    some = items.where("key IS NOT NULL").dropDuplicates()
    assert strategies.through_cache(some, keys, other, compute, 1).count() == 11 and calls.value == 35
    assert strategies.through_cache(some, keys, other, compute, 1).count() == 11 and calls.value == 35


def test_writers_at_once_lose_nothing(spark, tmp_path):
    keys, failed = ["key"], []

    def write(i):
        try:
            own = cache.SnapshotCache(spark, str(tmp_path / "c"), keys)
            own.store(spark.createDataFrame([(f"w{i}", i, f"d{i}"), ("shared", i, f"s{i}")], "key string, created_at long, data string"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    c = cache.SnapshotCache(spark, str(tmp_path / "c"), keys)
    assert not failed and c.version()[0] == 5 and len(c.version()[1]) == 5
    found = lambda: sorted(r.data for r in c.lookup(spark.createDataFrame([(f"w{i}",) for i in range(5)] + [("shared",), ("none",)], "key string"), keys)[0].collect())
    want = ["d0", "d1", "d2", "d3", "d4", "s4"]
    assert found() == want
    c.compact()
    assert len(c.version()[1]) == 1 and found() == want
    assert len(c.vacuum(keep=1)) == 5 and found() == want


def test_a_half_written_version_is_not_seen(spark, tmp_path):
    c = cache.SnapshotCache(spark, str(tmp_path / "c"), ["key"])
    assert c.version() == (0, []) and c.entries().count() == 0 and c.vacuum() == []
    c.store(spark.createDataFrame([("a", 1, "x")], "key string, created_at long, data string"))
    (tmp_path / "c" / "manifest" / "2.json").write_text('{"live": [')
    assert c.version()[0] == 1 and c.entries().count() == 1
