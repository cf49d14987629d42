"""Recordings as a data source: ranges of bytes of WAV files, read as rows of samples.

``read`` lists files and sizes only. A partition is some ranges of about ``range_bytes``
(small files share one); its task finds the sample data by walking the RIFF chunks of the
file and reads the rows that begin in its ranges, one row at a time, so that a task holds
one row of samples however long the recording is. Row ``i`` of a file holds the samples
from ``i * chunk_ms`` on, wherever ranges end.

Defined results: files without samples give no rows; a data chunk that promises more than
the file holds ends with its last whole frame; a file that is no PCM WAV of 8, 16, 24 or 32
bits stops the query with its path in the message.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from turnwise.sources.audio import quiet_cuts

SCHEMA = "path string, chunk bigint, rate int, first bigint, samples array<float>"
_ARROW = pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("rate", pa.int32()), ("first", pa.int64()), ("samples", pa.list_(pa.float32()))])


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file lie."""

    rate: int
    channels: int
    width: int
    start: int
    frames: int

    @property
    def frame(self) -> int:
        return self.channels * self.width


def layout(file, size: int, path: str = "") -> Layout:
    """Reads chunk headers until the sample data; ``file`` can seek."""
    file.seek(0)
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError(f"no WAV file: {path}")
    at, form = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            # 0xFFFE says that the true code begins a field further on
            code = struct.unpack("<H", file.read(10)[8:])[0] if code == 0xFFFE and length >= 26 else code
            form = (code, channels, rate, bits)
        elif name == b"data":
            if form is None or form[0] != 1 or form[3] not in (8, 16, 24, 32) or not form[1] or not form[2]:
                raise ValueError(f"not PCM of 8, 16, 24 or 32 bits: {path}")
            _, channels, rate, bits = form
            return Layout(rate, channels, bits // 8, at + 8, min(length, size - at - 8) // (channels * bits // 8))
        at += 8 + length + length % 2
    raise ValueError(f"no sample data: {path}")


def mono(raw: bytes, channels: int, width: int) -> np.ndarray:
    """Samples from -1 to 1, the mean of all channels."""
    if width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = np.zeros((len(parts), 4), np.uint8)
        x[:, 1:] = parts
        x = x.reshape(-1).view("<i4").astype(np.float32) / np.float32(1 << 31)
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
        x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1)


def rows_of(file, own: Layout, lo: int, hi: int, chunk_ms: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row number, first sample, samples) of the rows whose first byte lies in ``lo`` to ``hi`` (excluded)."""
    each = max(1, own.rate * chunk_ms // 1000)
    step = each * own.frame
    row = max(0, -(-(lo - own.start) // step))
    while row * each < own.frames and own.start + row * step < hi:
        file.seek(own.start + row * step)
        yield row, row * each, mono(file.read(min(each, own.frames - row * each) * own.frame), own.channels, own.width)
        row += 1


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]) -> None:
        super().__init__(None)
        self.ranges = ranges


def packed(files: list[tuple[str, int]], most: int) -> list[list[tuple[str, int, int, int]]]:
    """(path, size, from, to) of all bytes of all files, in lists of about ``most`` bytes."""
    out: list[list[tuple[str, int, int, int]]] = []
    room = 0
    for path, size in sorted(files):
        for lo in range(0, size, most):
            hi = min(size, lo + most)
            if hi - lo > room:
                out.append([])
                room = most
            out[-1].append((path, size, lo, hi))
            room -= hi - lo
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.most = int(options.get("range_bytes", 64 << 20))
        self.chunk_ms = int(options.get("chunk_ms", 10_000))
        self.suffix = options.get("suffix", ".wav").lower()
        if self.most < 1 or self.chunk_ms < 1:
            raise ValueError("range_bytes and chunk_ms must be positive")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.suffix)]
        return [_Ranges(r) for r in packed(files, self.most)] or [_Ranges([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for path, size, lo, hi in partition.ranges:
            with system.open_input_file(path) as file:
                own = layout(file, size, path)
                for row, first, x in rows_of(file, own, lo, hi, self.chunk_ms):
                    one = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([row]), pa.array([own.rate], pa.int32()), pa.array([first]), one], schema=_ARROW)


class Recordings(DataSource):
    """``spark.read.format("recordings")`` with options range_bytes, chunk_ms and suffix."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, root: str, *, chunk_ms: int = 10_000, range_bytes: int = 64 << 20) -> DataFrame:
    """path, chunk, rate, first (sample), samples: all recordings below ``root`` (a path or URI that all executors reach)."""
    spark.dataSource.register(Recordings)
    uri = root if "://" in root else f"file://{root}"
    return spark.read.format("recordings").option("chunk_ms", chunk_ms).option("range_bytes", range_bytes).load(uri)


def lengths(rows: DataFrame) -> DataFrame:
    """path, rate, n_samples, duration_ms."""
    by = rows.groupBy("path", "rate").agg(F.sum(F.size("samples")).cast("long").alias("n_samples"))
    return by.withColumn("duration_ms", F.round(F.col("n_samples") * 1000 / F.col("rate")).cast("long"))


def parts(rows: DataFrame, wanted: DataFrame, chunk_ms: int = 10_000) -> DataFrame:
    """``wanted`` (path, begin_ms, end_ms) with the samples from begin to end (excluded), as far as there are any.

    Rows meet by path and row number, so that only the rows of a part are sent to it; equal parts give equal
    rows. ``chunk_ms`` is that of ``rows``. A part outside its recording, or of no length, has no samples.
    """
    own = rows.groupBy("path").agg(F.max("rate").alias("rate"))
    asked = wanted.groupBy("path", "begin_ms", "end_ms").agg(F.count("*").cast("int").alias("copies")).join(own, "path", "left")
    place = lambda ms: F.floor(F.greatest(F.col(ms), F.lit(0)) * F.col("rate") / 1000).cast("long")
    each = F.greatest(F.lit(1), F.floor(F.col("rate") * F.lit(chunk_ms) / 1000)).cast("long")
    asked = asked.withColumns({"_lo": place("begin_ms"), "_hi": place("end_ms"), "_each": each})
    spread = asked.where("_hi > _lo").withColumn("chunk", F.explode(F.sequence(F.expr("_lo div _each"), F.expr("(_hi - 1) div _each"))))
    met = spread.join(rows.select("path", "chunk", "first", "samples"), ["path", "chunk"])
    start = F.greatest(F.col("_lo") - F.col("first"), F.lit(0)).cast("int")
    end = F.least(F.col("_hi") - F.col("first"), F.size("samples").cast("long")).cast("int")
    piece = met.select("path", "begin_ms", "end_ms", "chunk", F.when(end > start, F.slice("samples", start + 1, end - start)).otherwise(F.array().cast("array<float>")).alias("s"))
    joined = piece.groupBy("path", "begin_ms", "end_ms").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "s"))), lambda x: x["s"])).alias("samples"))
    out = asked.select("path", "begin_ms", "end_ms", "rate", "copies").join(joined, ["path", "begin_ms", "end_ms"], "left")
    out = out.withColumn("samples", F.coalesce("samples", F.array().cast("array<float>")))
    return out.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_c", "copies")


def quiet_parts(rows: DataFrame, most_s: float, search_s: float = 2.0, frame_s: float = 0.05) -> DataFrame:
    """path, part, first, end (samples): parts of up to ``most_s`` seconds, cut where it is quietest.

    A cut depends on the one before it, so that a file is read in order by one task, which holds
    one part and one row of it; files are dealt to all tasks.
    """

    def run(batches):
        path, rate, base, number, held = None, 0, 0, 0, np.zeros(0, np.float32)

        def cuts(last: bool):
            """Parts that no further sample can change; with ``last`` all of them."""
            nonlocal base, number, held
            found = []
            frame, most = max(1, int(frame_s * rate)), int(most_s * rate)
            while len(held) > most_s * rate and (last or len(held) >= most + frame):
                a, b = quiet_cuts(held[: most + frame], rate, most_s, search_s, frame_s)[0]
                found.append((path, number, base + a, base + b))
                base, number, held = base + b, number + 1, held[b:]
            if last and len(held):
                found.append((path, number, base, base + len(held)))
            return found

        def batch_of(found):
            cols = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:])], ["path", "part", "first", "end"])

        for batch in batches:
            lists = batch.column("samples")
            for i, (p, r) in enumerate(zip(batch.column("path").to_pylist(), batch.column("rate").to_pylist(), strict=True)):
                if p != path:
                    if path is not None and (found := cuts(True)):
                        yield batch_of(found)
                    path, rate, base, number, held = p, r, 0, 0, np.zeros(0, np.float32)
                held = np.concatenate([held, lists[i].values.to_numpy()])
                if found := cuts(False):
                    yield batch_of(found)
        if path is not None and (found := cuts(True)):
            yield batch_of(found)

    ordered = rows.select("path", "chunk", "rate", "samples").repartition("path").sortWithinPartitions("path", "chunk")
    return ordered.mapInArrow(run, "path string, part bigint, first bigint, end bigint")
