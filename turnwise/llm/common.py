"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python works on slices of an Arrow batch of about this many text bytes, so
#: that the numpy arrays (8 or more bytes for each text byte) stay small.
SLICE_BYTES = 2_000_000
_WRITTEN: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; an own one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not found:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="turnwise-")  # one machine only
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """``df`` computed once and read back from a table in the shared folder.

    The table stays for the life of the application, since later stages may
    read it again when an executor is lost; ``sweep`` removes all of them.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, what: str) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/turnwise-{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that ``cut`` has written, once their results are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (columns of callers never clash)."""
    have = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in have:
        k += 1
        name = f"{base}_{k}"
    return name


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in row ranges of about ``limit`` text bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    _, off = utf8(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def crc_mod(id_col: str, n: int):
    """crc32 of an id written as text, modulo ``n`` (null id: 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % F.lit(n), F.lit(0))
