"""Recordings by byte ranges, against the whole file decoded at once."""

import io
import struct
import wave

import numpy as np
import pytest

from turnwise.sources import audio, recordings


def wav(x: np.ndarray, rate: int, channels: int, width: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    return out.getvalue()


def with_list(raw: bytes) -> bytes:
    """The same file with a chunk of odd length before the sample data."""
    at = raw.index(b"data")
    extra = b"LIST" + struct.pack("<I", 5) + b"abcde\0"
    return b"RIFF" + struct.pack("<I", len(raw) - 8 + len(extra)) + raw[8:at] + extra + raw[at:]


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(3)
    (tmp_path / "deep").mkdir()
    loud = np.abs(np.sin(np.arange(90_000) / 4_000)) * 12_000
    (tmp_path / "a.wav").write_bytes(with_list(wav((r.normal(size=90_000) * loud / 4).clip(-32768, 32767).astype("<i2"), 8_000, 2, 2)))
    (tmp_path / "deep" / "b.WAV").write_bytes(wav(r.integers(0, 256, 7_001).astype(np.uint8), 1_000, 1, 1))
    (tmp_path / "c.wav").write_bytes(wav(r.integers(-(2**31), 2**31, 999).astype("<i4"), 300, 3, 4))
    (tmp_path / "none.wav").write_bytes(wav(np.zeros(0, "<i2"), 8_000, 1, 2))
    (tmp_path / "notes.txt").write_text("no recording")
    return tmp_path


def whole(folder, name):
    return audio.samples((folder / name).read_bytes())


@pytest.mark.parametrize(("chunk_ms", "range_bytes"), [(250, 1_000), (1_000, 7_777), (10_000, 1 << 26)])
def test_rows_put_together_are_the_recording(spark, folder, chunk_ms, range_bytes):
    rows = recordings.read(spark, str(folder), chunk_ms=chunk_ms, range_bytes=range_bytes).orderBy("path", "chunk").collect()
    found = {}
    for row in rows:
        name = row.path[len(str(folder)) + 1 :]
        assert row.first == sum(map(len, found.setdefault(name, []))) and row.chunk == len(found[name])
        assert len(row.samples) <= row.rate * chunk_ms // 1000
        found[name].append(row.samples)
    assert set(found) == {"a.wav", "deep/b.WAV", "c.wav"}
    for name, pieces in found.items():
        assert np.array_equal(np.concatenate(pieces).astype(np.float32), whole(folder, name)[1])


def test_ranges_are_partitions_and_small_files_share_one(spark, folder):
    # 180,058 bytes are four ranges; the rest of the fourth has room for the small files
    assert recordings.read(spark, str(folder), range_bytes=50_000).rdd.getNumPartitions() == 4
    assert recordings.packed([("a", 10), ("b", 3), ("c", 3), ("d", 0)], 7) == [[("a", 10, 0, 7)], [("a", 10, 7, 10), ("b", 3, 0, 3)], [("c", 3, 0, 3)]]


def test_a_task_reads_one_row_at_a_time():
    """A recording of two gigabytes, made up as it is read."""

    class Long(io.RawIOBase):
        head = wav(np.zeros(0, "<i2"), 16_000, 1, 2)[:-4] + struct.pack("<I", 2_000_000_000)
        at = most = 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.most = max(self.most, n)
            out = self.head[self.at : self.at + n] if self.at < len(self.head) else bytes(n)
            self.at += n
            return out

    file = Long()
    own = recordings.layout(file, 2_000_000_044)
    assert own.frames == 1_000_000_000
    last = [(row, first, len(x)) for row, first, x in recordings.rows_of(file, own, 1_999_000_000, 2_000_000_044, 10_000)]
    assert last[-1][1] + last[-1][2] == own.frames and file.most == 320_000


def test_layouts(tmp_path):
    raw = wav(np.arange(12, dtype=np.uint8), 10, 1, 3)
    own = recordings.layout(io.BytesIO(raw), len(raw))
    assert (own.width, own.frames) == (3, 4)
    got = np.concatenate([x for _, _, x in recordings.rows_of(io.BytesIO(raw), own, 0, len(raw), 100)])
    want = [int.from_bytes(bytes(range(i, i + 3)), "little", signed=True) / (1 << 23) for i in range(0, 12, 3)]
    assert np.allclose(got, want)
    assert recordings.layout(io.BytesIO(raw[:-4]), len(raw) - 4).frames == 2  # cut short within a frame
    for bad in (b"", b"RIFF....WAVE", b"text" * 20, raw.replace(struct.pack("<H", 1) + struct.pack("<H", 1), struct.pack("<H", 3) + struct.pack("<H", 1), 1)):
        with pytest.raises(ValueError, match="name"):
            recordings.layout(io.BytesIO(bad), len(bad), "name")


def test_parts_and_lengths(spark, folder):
    rows = recordings.read(spark, str(folder), chunk_ms=400, range_bytes=5_000)
    n = {r.path.split("/")[-1]: (r.n_samples, r.duration_ms) for r in recordings.lengths(rows).collect()}
    assert n == {"a.wav": (45_000, 5_625), "b.WAV": (7_001, 7_001), "c.wav": (333, 1_110)}
    a = str(folder / "a.wav")
    wanted = [(a, 0, 400), (a, 399, 1_201), (a, 5_000, 9_000), (a, -50, 10), (a, 700, 700), (a, 9_000, 9_100), (a, 0, 400), ("nowhere", 0, 10)]
    got = recordings.parts(rows, spark.createDataFrame(wanted, "path string, begin_ms long, end_ms long"), 400).collect()
    assert len(got) == len(wanted)
    _, x = whole(folder, "a.wav")
    for g in got:
        want = x[max(0, g.begin_ms) * 8 : max(0, g.end_ms) * 8] if g.path == a else []
        assert np.array_equal(np.asarray(g.samples, np.float32), np.asarray(want, np.float32)), g[:3]


def test_quiet_parts_are_those_of_the_whole_recording(spark, folder):
    rows = recordings.read(spark, str(folder), chunk_ms=300, range_bytes=5_000)
    for most, search in ((1.0, 0.4), (0.7, 2.0), (30.0, 2.0)):
        found = {}
        for r in recordings.quiet_parts(rows, most, search).orderBy("path", "part").collect():
            found.setdefault(r.path[len(str(folder)) + 1 :], []).append((r.first, r.end))
        for name in ("a.wav", "deep/b.WAV", "c.wav"):
            rate, x = whole(folder, name)
            assert found[name] == audio.quiet_cuts(x, rate, most, search), (name, most)
