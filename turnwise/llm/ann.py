"""Approximate nearest neighbours by cross-polytope hashing (operator 9).

A vector of length one is rotated by three rounds of random signs and a fast
Hadamard transform; its hash is the nearest signed axis. A table joins such a
hash with one of a second rotation, so that it has (2d)^2 buckets. All rows are
indexed: their buckets in all tables are written once, beside the vector.

A query probes in each table the buckets whose axes lose least against its own
(multiprobe), as many as promise ``share(n)`` candidates of n rows in all tables, counted
once for each table that finds them: about half of the rows of a small table, of a
larger one an ever smaller part. The buckets decide at every size.

Rows and probes meet by a shuffle join on (table, cell): a cell is a first axis, or
for large tables a first axis and a part of the second axes, so that cells have about
``_CELL`` rows whatever the size of the table; a cell that has more is dealt in
salted parts. A task ranks the rows of the probed buckets of its cell by their exact
Euclidean distance in double precision, summed in the order of the components, and
returns the ``k`` best for each query, so that what grows with the data is the
number of cells. There is no cap on buckets or candidates, and nothing passes
through the driver. A query with fewer than ``k`` found probes every bucket of one
table, which is every row.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of other lengths are
never compared; rows that share an id count as one, at their least distance;
ties go to the smaller id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import cut
from turnwise.session import table

#: About how many rows a cell has.
_CELL = 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), normalised."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=64)
def signs(width: int, tables: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng((seed, width)).choice(np.array([-1.0, 1.0]), (tables, 2, 3, width))


def rotated(unit: np.ndarray, s: np.ndarray) -> np.ndarray:
    for k in range(3):
        unit = hadamard(unit * s[k])
    return unit


def _padded(x: np.ndarray) -> np.ndarray:
    """Unit vectors, filled up with zeros to a power of two of at least 8."""
    width = 1 << max(3, (x.shape[1] - 1).bit_length())
    unit = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
    return np.pad(unit, ((0, 0), (0, width - x.shape[1])))


def axes(unit: np.ndarray, table_: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all signed axes of both rotations of a table."""
    s = signs(unit.shape[1], tables)[table_]
    a, b = rotated(unit, s[0]), rotated(unit, s[1])
    return np.concatenate([a, -a], axis=1), np.concatenate([b, -b], axis=1)


def buckets(x: np.ndarray, tables: int) -> np.ndarray:
    """The bucket (first axis, second axis) of each row in each table."""
    unit = _padded(x)
    out = np.empty((len(x), tables, 2), np.uint16)
    for t in range(tables):
        for k, score in enumerate(axes(unit, t, tables)):
            out[:, t, k] = score.argmax(axis=1)
    return out


def probed(x: np.ndarray, tables: int, probes: int) -> list[np.ndarray]:
    """For each table, the ``probes`` buckets (first * 2d + second) with the least loss for each row."""
    unit = _padded(x)
    out = []
    for t in range(tables):
        a, b = axes(unit, t, tables)
        loss = ((a.max(axis=1, keepdims=True) - a) ** 2)[:, :, None] + ((b.max(axis=1, keepdims=True) - b) ** 2)[:, None, :]
        loss = loss.reshape(len(x), -1)
        p = min(probes, loss.shape[1])
        out.append(np.argpartition(loss, p - 1, axis=1)[:, :p])
    return out


def share(n: int) -> int:
    """How many candidates, repeats between tables included, are worth looking at of ``n`` rows for each query."""
    return max(1, int(min(0.8 * n, 120 * n**0.42)))


def groups(n: int, width: int) -> int:
    """Parts of the second axes, so that a cell has about ``_CELL`` rows."""
    return min(2 * width, max(1, -(-n // (2 * width * _CELL))))


def _width(dim: int) -> int:
    return 1 << max(3, (dim - 1).bit_length())


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs; the sum runs over the components in order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


def index(rows: DataFrame, *, vec_id: str, embedding: str, tables: int) -> DataFrame:
    """vec_id, dim, x (doubles), codes: every usable row with its buckets."""
    good = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    source = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).where("vec_id IS NOT NULL").where(good)

    def run(batches):
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("x")
            flat, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            ends = np.cumsum(n)
            for dim in np.unique(n):
                own = np.flatnonzero(n == dim)
                x = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                codes = buckets(x, tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array(np.full(len(own), dim, np.int64)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    ["vec_id", "dim", "x", "codes"],
                )

    return source.mapInArrow(run, "vec_id long, dim long, x binary, codes binary")


def postings(indexed: DataFrame, sizes: dict[int, int], tables: int) -> DataFrame:
    """dim, table, cell, vec_id, x, seconds (the second axis, one): every row in every table."""

    def run(batches):
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()):
                part = batch.filter(pc.equal(batch.column("dim"), int(dim)))
                g = groups(sizes[int(dim)], _width(int(dim)))
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint16).reshape(len(part), -1, 2).astype(np.int64)
                for t in range(tables):
                    yield _side(part, np.arange(len(part)), np.full(len(part), t), codes[:, t, 0] * g + codes[:, t, 1] % g, codes[:, t, 1].astype("<u2").tobytes(), np.full(len(part), 2))

    return indexed.select("vec_id", "dim", "x", "codes").mapInArrow(run, _SIDE)


_SIDE = "dim long, t int, cell long, vec_id long, x binary, seconds binary"


def _side(part: pa.RecordBatch, rows: np.ndarray, t: np.ndarray, cell: np.ndarray, raw: bytes, sizes: np.ndarray) -> pa.RecordBatch:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    seconds = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
    own = part.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([own.column("dim"), pa.array(t.astype(np.int32)), pa.array(cell.astype(np.int64)), own.column("vec_id"), own.column("x"), seconds], ["dim", "t", "cell", "vec_id", "x", "seconds"])


def probes(asked: DataFrame, sizes: dict[int, int], tables: int, every: bool, least: int | None = None) -> DataFrame:
    """dim, table, cell, vec_id, x, seconds (the second axes to look at): the probes of every query, a row for each cell.

    ``every``: all buckets of the first table.
    """

    def run(batches):
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()):
                whole = batch.filter(pc.equal(batch.column("dim"), int(dim)))
                n, width = sizes[int(dim)], _width(int(dim))
                g, axes_ = groups(n, width), 2 * width
                for lo in range(0, len(whole), 64):
                    part = whole.slice(lo, 64)
                    x = np.frombuffer(b"".join(part.column("x").to_pylist())).reshape(len(part), -1)
                    want = least or share(n)
                    # all buckets of one table hold every row
                    found = [np.tile(np.arange(axes_ * axes_), (len(part), 1))] if every else probed(x, tables, -(-want * axes_ * axes_ // (n * tables)))
                    for t, own in enumerate(found):
                        row = np.repeat(np.arange(len(part)), own.shape[1])
                        first, second = np.divmod(own.ravel(), axes_)
                        cell = first * g + second % g
                        order = np.lexsort((second, cell, row))
                        row, cell, second = row[order], cell[order], second[order]
                        begin = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]))))
                        yield _side(part, row[begin], np.full(len(begin), t), cell[begin], second.astype("<u2").tobytes(), 2 * np.diff(np.append(begin, len(row))))

    return asked.mapInArrow(run, _SIDE)


_FOUND = "query_id long, vec_id long, score double"


def _ranked(cell: pa.Table, k: int) -> pa.Table:
    """The k best rows of a cell for each of its queries."""
    asks = cell.column("ask").to_numpy()
    ids = cell.column("vec_id").to_numpy()
    x = np.frombuffer(b"".join(cell.column("x").to_pylist())).reshape(len(ids), -1)
    seconds = cell.column("seconds").to_pylist()
    rows, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
    own = np.frombuffer(b"".join(seconds[i] for i in rows), "<u2").astype(np.int64)
    order = np.argsort(own, kind="stable")
    rows, own = rows[order], own[order]
    out: list[tuple[np.ndarray, ...]] = []
    for q in queries:
        want = np.frombuffer(seconds[q], "<u2").astype(np.int64)
        a, b = np.searchsorted(own, want, side="left"), np.searchsorted(own, want, side="right")
        n = b - a
        at = rows[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at = at[ids[at] != ids[q]]
        d = distances(np.broadcast_to(x[q], (len(at), x.shape[1])), x[at])
        if len(at) > k:
            near = d <= np.partition(d, k - 1)[k - 1]
            at, d = at[near], d[near]
        best = np.lexsort((ids[at], d))[:k]
        out.append((np.full(len(best), ids[q]), ids[at[best]], d[best]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: str, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, tables: int = 16, least: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row that meets the SQL condition ``queries``.

    ``least``: how many rows a query should rank, ``share`` of the rows if not given.
    """
    indexed = cut(index(rows, vec_id=vec_id, embedding=embedding, tables=tables), "index")
    sizes = {r.dim: r.n for r in indexed.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each vector length
    asked = indexed.where(queries).select("vec_id", "dim", "x").distinct()
    key = ["dim", "t", "cell", "part"]

    def met(queries_: DataFrame, every: bool) -> DataFrame:
        own = postings(indexed, sizes, tables)
        own = own.where("t = 0") if every else own
        own, ask = own.withColumn("part", F.lit(0)), probes(queries_, sizes, tables, every, least).withColumn("part", F.lit(0))
        hot = cut(own.groupBy("dim", "t", "cell").count().where(F.col("count") > 2 * _CELL).withColumn("parts", F.ceil(F.col("count") / _CELL).cast("int")).drop("count"), "hot")
        if not hot.isEmpty():
            parts = F.coalesce("parts", F.lit(1))
            own = own.join(hot, ["dim", "t", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), parts).cast("int"))
            ask = ask.join(hot, ["dim", "t", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        both = own.select(*key, F.lit(False).alias("ask"), "vec_id", "x", "seconds").union(ask.select(*key, F.lit(True).alias("ask"), "vec_id", "x", "seconds"))
        return both.groupBy(*key).applyInArrow(lambda cell: _ranked(cell, k), _FOUND)

    first = cut(_best(met(asked, False), k), "nearest")
    few = cut(asked.join(first.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= k), "vec_id", "left_anti"), "few")
    if not few.isEmpty():
        first = _best(first.select("query_id", "vec_id", "score").union(met(few, True)), k)
    return first.select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: ids divisible by 100 against all rows, ten nearest."""
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM d) WHERE rank <= 10
"""
