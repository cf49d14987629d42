"""Quality classifier: a byte-level convolutional network in numpy (operator 3).

A document is its UTF-8 bytes, cut into overlapping chunks of ``CHUNK`` bytes
that cover all of it. Learned byte embeddings, one layer of learned filters
(width 8, stride 4), a max over the positions of each chunk, then maximum, mean
and minimum over the chunks, a small hidden layer and one sigmoid.

The weights are fitted on the driver on a bounded sample of labelled rows
(``sample`` rows with texts of at most ``sample_bytes`` bytes, in the order of a
hash of their ids); scores are then made for every whole text, on the
executors, without any shuffle of text. Of a text of any length, 512 chunks are
expanded at a time; what stays is half a byte for each byte of it.

Defined results: null and empty texts get the score of a document without
bytes; several labels of one id count as their maximum; labels without a
document and null labels are not used; without any labelled row, or with one
class only, each score is the share of label 1 (0.5 without labels). Repeated rows
are scored one by one, equal texts get equal scores (ties stay ties); an empty
table stays empty; where the score's name is taken, it gets a number at its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import crc_mod, fresh, slices, utf8
from turnwise.session import table

CHUNK, WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 256, 8, 4, 8, 32, 16
_PAD = 256  # the embedding row of bytes after the end


def layout(off: np.ndarray) -> np.ndarray:
    """First chunk of each document, and the number of chunks."""
    return np.concatenate(([0], np.cumsum(np.maximum(1, -(-(np.diff(off) - WIDTH) // (CHUNK - WIDTH))))))


def expanded(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Byte ids of the chunks ``lo`` to ``hi`` of the documents, a row for each."""
    first = layout(off)
    each = np.arange(lo, min(hi, first[-1]))
    doc = np.searchsorted(first, each, side="right") - 1
    at = (off[doc] + (each - first[doc]) * (CHUNK - WIDTH))[:, None] + np.arange(CHUNK)
    inside = at < off[doc + 1][:, None]
    ids = np.full(at.shape, _PAD, np.int16)
    if len(data):
        ids[inside] = data[at[inside]]
    return ids


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk matrix of byte ids, first chunk of each document)."""
    first = layout(off)
    return expanded(data, off, 0, int(first[-1])), first[:-1]


class ByteNet:
    """The network, its gradient and Adam."""

    def __init__(self, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "emb": r.normal(0, 0.5, (257, EMBED)).astype(f),
            "conv": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "hid": r.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)).astype(f),
            "hb": np.zeros(HIDDEN, f),
            "out": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(f),
            "ob": np.zeros(1, f),
        }
        self.p["emb"][_PAD] = 0
        self.constant: float | None = None

    def pooled(self, ids: np.ndarray, where: bool = False):
        """Max of each filter over each chunk (and where it is)."""
        half = STRIDE * EMBED
        w = self.p["conv"]
        both = np.concatenate([w[:half], w[half:]], axis=1)
        blocks = self.p["emb"][ids].reshape(len(ids) * (CHUNK // STRIDE), half) @ both
        blocks = blocks.reshape(len(ids), CHUNK // STRIDE, 2 * FILTERS)
        conv = blocks[:, :-1, :FILTERS] + blocks[:, 1:, FILTERS:]
        if not where:
            return np.maximum(conv.max(axis=1) + self.p["bias"], 0), None
        at = conv.argmax(axis=1)
        top = np.take_along_axis(conv, at[:, None], axis=1)[:, 0]
        return np.maximum(top + self.p["bias"], 0), at

    def combine(self, m: np.ndarray, first: np.ndarray, n: np.ndarray):
        x = np.concatenate([np.maximum.reduceat(m, first), np.add.reduceat(m, first) / n[:, None], np.minimum.reduceat(m, first)], axis=1)
        h = np.tanh(x @ self.p["hid"] + self.p["hb"])
        z = h @ self.p["out"] + self.p["ob"][0]
        return x, h, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        first = layout(off)
        m = [self.pooled(expanded(data, off, i, i + 512))[0] for i in range(0, int(first[-1]), 512)]
        return self.combine(np.concatenate(m), first[:-1], np.diff(first))[2].astype(np.float64) if m else np.zeros(0)

    def gradient(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = np.diff(np.append(first, len(ids)))
        m, at = self.pooled(ids, where=True)
        x, h, p = self.combine(m, first, n)
        dz = ((p - y) / len(y)).astype(np.float32)
        dh = dz[:, None] * self.p["out"] * (1 - h * h)
        dx = dh @ self.p["hid"].T
        doc = np.repeat(np.arange(len(n)), n)
        hi, mean, lo = dx[:, :FILTERS], dx[:, FILTERS : 2 * FILTERS], dx[:, 2 * FILTERS :]
        x_hi, x_lo = x[:, :FILTERS], x[:, 2 * FILTERS :]
        dm = mean[doc] / n[doc][:, None] + hi[doc] * (m == x_hi[doc]) + lo[doc] * (m == x_lo[doc])
        dm = np.where(m > 0, dm, 0).astype(np.float32)
        win = ids[np.arange(len(ids))[:, None, None], at[:, :, None] * STRIDE + np.arange(WIDTH)]  # chunk, filter, byte
        e = self.p["emb"][win].reshape(len(ids), FILTERS, WIDTH * EMBED)
        demb = np.zeros_like(self.p["emb"])
        de = (dm[:, :, None] * self.p["conv"].T[None]).reshape(-1, EMBED)
        flat = win.reshape(-1)
        for c in range(EMBED):
            demb[:, c] = np.bincount(flat, weights=de[:, c], minlength=257)
        demb[_PAD] = 0
        return {
            "emb": demb, "conv": np.einsum("cf,cfe->ef", dm, e), "bias": dm.sum(0), "hid": x.T @ dh, "hb": dh.sum(0),
            "out": h.T @ dz, "ob": np.array([dz.sum()], np.float32),
        }

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int, batch: int = 32, rate: float = 4e-3, seed: int = 2) -> ByteNet:
        if len(texts) == 0 or len(set(y.tolist())) < 2:
            self.constant = float(np.mean(y)) if len(y) else 0.5
            return self
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        order: list[int] = []
        for t in range(1, steps + 1):
            while len(order) < batch:
                order += r.permutation(len(texts)).tolist()
            own, order = order[:batch], order[batch:]
            data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
            off = np.concatenate(([0], np.cumsum([len(texts[i]) for i in own])))
            g = self.gradient(*chunks(data, off), y[own])
            lr = rate * min(1.0, 1.2 - t / steps)
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                self.p[k] -= (lr * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7) + lr * 0.01 * self.p[k] * (k in ("conv", "hid"))).astype(np.float32)
            self.p["emb"][_PAD] = 0
        return self


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = 4_000, sample_bytes: int = 32_768, steps: int = 700) -> ByteNet:
    """Fits on at most ``sample`` labelled ids outside the held-out fifth, one text of each (of several the one with the least hash)."""
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).where(crc_mod(doc_id, 5) != 0)
        .groupBy(F.col(doc_id).alias("k")).agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(sample)
    )
    texts = docs.select(F.col(doc_id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.octet_length("t") <= sample_bytes)
    one = texts.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m"), F.max("y").alias("y"))
    found = one.select("k", "m.t", "y").toPandas().sort_values("k")  # one row an id: bounded by sample * sample_bytes
    return ByteNet().fit([t.encode() for t in found["t"]], (found["y"].to_numpy() > 0).astype(np.float32), steps)


def score(docs: DataFrame, net: ByteNet, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of good quality (``out``, or a free name like it)."""
    out = fresh(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        net = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, text, 500_000):
                found = net.score(*utf8(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, out])

    return docs.mapInArrow(run, f"{spec}, `{out}` double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: every document with its score and decision at 0.3."""
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
