"""Language identification: averaged hashed subword embeddings (operator 6).

Subwords are the byte n-grams (2 to 4 bytes, lower case) of a text, hashed to
``BUCKETS`` rows. A document is the average of the embeddings of its subwords;
a linear softmax gives the languages. Embeddings and softmax are trained by
stochastic gradient descent in numpy on the driver, on at most ``per_lang`` rows
of each language. A part of those rows is kept back to fit a temperature
(calibration) and the confidence under which a prediction counts as rejected.

Averaging is linear, so that for prediction embedding and softmax are folded
into one table of scores by bucket; every whole text is read once, in slices.

Defined results: a null text or one without a letter is ``und`` with score 0;
rows with a null language are predicted but not learned from; ties go to the
language first in alphabetical order; without learnable rows all are ``und``;
repeated rows are predicted one by one; of a text of any length ``_PART`` bytes are
looked up at a time; further columns are ignored, and an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import crc_mod, slices, utf8
from turnwise.session import table

BUCKETS, DIM, GRAMS = 1 << 17, 16, (2, 3, 4)
#: Bytes whose subwords are looked up at a time (some 60 bytes of memory each).
_PART = 1 << 18


def subwords(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte (n - 1 fewer)."""
    x = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for k in range(n):
        x = x * np.uint32(257) + data[k : len(data) - n + 1 + k]
    x = (x + np.uint32(n * 0x1F3D)) * np.uint32(0x9E3779B1)
    return (x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1)


class LanguageModel:
    """Scores by bucket and language, with temperature and rejection bound."""

    def __init__(self, langs: list[str]) -> None:
        self.langs, self.temperature, self.bound = langs, 1.0, 0.0
        self.table = np.zeros((BUCKETS, len(langs)), np.float32)
        self.bias = np.zeros(len(langs))

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        total = np.zeros((len(off) - 1, len(self.langs)))
        count = np.zeros(len(off) - 1)
        for lo in range(0, len(data), _PART):
            own = slice(max(0, int(np.searchsorted(off, lo, side="right")) - 1), int(np.searchsorted(off, lo + _PART)))  # documents that begin or go on here
            for n in GRAMS:
                idx = subwords(data[lo : lo + _PART + n - 1], n)
                cum = np.zeros((len(idx) + 1, len(self.langs)))
                np.cumsum(self.table[idx], axis=0, dtype=np.float64, out=cum[1:])
                a = np.clip(off[:-1][own] - lo, 0, len(idx))
                b = np.clip(off[1:][own] - n + 1 - lo, a, len(idx))
                total[own] += cum[b] - cum[a]
                count[own] += b - a
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.logits(data, off) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 4, rate: float = 0.6, seed: int = 3) -> LanguageModel:
        """Stochastic gradient descent, one document at a time."""
        r = np.random.default_rng(seed)
        emb = (r.random((BUCKETS, DIM), dtype=np.float32) - np.float32(0.5)) / DIM
        out = np.zeros((DIM, len(self.langs)), np.float32)
        each = []
        for t in texts:
            idx = np.concatenate([subwords(np.frombuffer(t, np.uint8), n) for n in GRAMS])
            u, c = np.unique(idx, return_counts=True)
            each.append((u, (c / max(1, c.sum())).astype(np.float32)))
        steps, t = max(1, epochs * len(each)), 0
        for _ in range(epochs):
            for i in r.permutation(len(each)):
                u, c = each[i]
                lr = np.float32(rate * (1 - t / steps))
                t += 1
                if not len(u):
                    continue
                e = emb[u]
                h = c @ e
                z = h @ out + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                g = out @ p.astype(np.float32)
                out -= lr * np.outer(h, p).astype(np.float32)
                self.bias -= lr * 0.02 * p
                emb[u] = e - (lr * len(u) ** 0.5) * c[:, None] * g
        self.table = emb @ out
        return self

    def calibrate(self, texts: list[bytes], y: np.ndarray, error: float = 0.01) -> LanguageModel:
        """Temperature by likelihood; the least confidence with an error share of at most ``error``."""
        if not len(texts):
            return self
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        z = self.logits(data, off)

        def loss(temp: float) -> float:
            q = z / temp
            q = q - q.max(axis=1, keepdims=True)
            return float(-(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(axis=1))).mean())

        self.temperature = min(np.geomspace(0.25, 8, 60), key=loss)
        best, conf = self.predict(data, off)
        order = np.argsort(-conf)
        wrong = np.cumsum(best[order] != y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(wrong <= error)
        self.bound = float(conf[order][good[-1]]) if len(good) else 1.0
        return self


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 800, most: int = 12_000, sample_bytes: int = 16_384) -> LanguageModel:
    """Fits on at most ``per_lang`` rows of each language (``most`` ids in all) outside the held-out quarter.

    Of rows that share an id one is learned from, that with the least hash of text and language.
    """
    rows = docs.select(F.col(doc_id).alias("k"), F.col(lang).alias("y"), F.octet_length(text).alias("n"))
    rows = rows.where(F.col("k").isNotNull() & F.col("y").isNotNull() & (F.col("n") <= sample_bytes)).where(crc_mod("k", 4) != 2)
    order = (F.xxhash64("k"), F.col("k"))
    # first in parts, so that no task gets all rows of a frequent language
    some = rows.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("y", "part").orderBy(*order))).where(F.col("r") <= per_lang)
    ids = some.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(*order))).where(F.col("r") <= per_lang).orderBy("r", "y").limit(most).select("k").distinct()
    found = docs.select(F.col(doc_id).alias("k"), F.lower(F.col(text)).alias("t"), F.col(lang).alias("y"), F.octet_length(text).alias("n")).join(F.broadcast(ids), "k")
    found = found.where(F.col("t").isNotNull() & F.col("y").isNotNull() & (F.col("n") <= sample_bytes))
    one = found.groupBy("k").agg(F.min(F.struct(F.xxhash64("t", "y").alias("h"), "t", "y")).alias("m")).select("k", "m.t", "m.y")
    found = one.toPandas().sort_values(["k", "y", "t"])  # one row an id: bounded by most * sample_bytes
    langs = sorted(found["y"].unique())
    model = LanguageModel(langs)
    if not langs:
        return model
    y = np.searchsorted(np.array(langs, object).astype(str), found["y"].to_numpy().astype(str))
    texts = [t.encode() for t in found["t"]]
    keep = np.arange(len(texts)) % 5 == 0
    model.fit([t for t, k in zip(texts, keep, strict=True) if not k], y[~keep])
    return model.calibrate([t for t, k in zip(texts, keep, strict=True) if k], y[keep])


def identify(docs: DataFrame, model: LanguageModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (calibrated confidence), rejected (score under the fitted bound)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"), F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("letters"))

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                letters = part.column("letters").to_numpy(zero_copy_only=False)
                if model.langs:
                    best, conf = model.predict(*utf8(part.column("text")))
                    names = [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                    conf = np.where(letters, conf, 0.0)
                else:
                    names, conf = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(conf, pa.float64()), pa.array(conf < model.bound)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows; ``rejected`` tells which predictions the calibrated bound would refuse."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
