"""Benchmark decontamination by a prefix-filtered set join (operator 10).

The benchmark side is a set of windows: every run of ``window`` consecutive
words of an item, or the whole item if it is shorter. A window is the list of its
shingles (``_SIZE`` words; a shorter window is one shingle), ordered by rarity in
the corpus. A window is contained in a document only if all its shingles are, so
that with a containment threshold of 1 its necessary prefix is its rarest one.

1. The windows are made and told apart by Spark; a benchmark of any size stays
   distributed.
2. Rarity is counted over all documents, in one pass that emits the counts of
   shingles that may be in the index. What may be is told by a Bloom filter, the
   only thing that is broadcast: at most ``_BITS`` bits (16 MB), whatever the size
   of the benchmark. It has no false negatives; what passes wrongly falls at the
   joins, which compare hashes.
3. A second pass emits for each document the places of prefix shingles with the
   words around them (up to ``window`` on each side).
4. These are joined with the windows on the prefix shingle. Candidates that would
   start before the first word of the document or end after its last one are cut
   by position and length; the rest are verified word by word.
5. Hits are gathered by document. Documents never move: no shuffle carries text.

Defined results: a null or empty text has no words and no hit; an item without
words has no window; rows are told apart by id (null included) and text, every
row is reported once, and equal rows have equal results; items with the same
window are all reported, an item without an id is not named; further columns are
ignored. Nothing depends on the number of items or documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.llm.common import cut, fresh, slices, utf8
from turnwise.llm.shingles import LOWER, mix, words
from turnwise.session import table

_SIZE = 3
_BITS = 1 << 27
#: Words are runs of digits, small letters and non-ASCII bytes, after A-Z is lower-cased.
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Hashes are made for about this many bytes at a time, so that of a very long text only its words stay in memory.
_PART = 1 << 20


class Words:
    """The words of some texts: hash, first and last byte of each, and the first word of each text."""

    def __init__(self, texts: pa.Array) -> None:
        data, off = utf8(texts)
        self.low = LOWER[data]
        parts, at = [], 0
        while at < len(data):
            end = self._gap(at + _PART)
            inside = off[(off >= at) & (off <= end)] - at
            h, _, a, b = words(self.low[at:end], np.unique(np.concatenate(([0], inside, [end - at]))), _GAP)
            parts.append((h, a + at, b + at))
            at = end
        self.hash, self.start, self.end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def _gap(self, at: int) -> int:
        """The first place from ``at`` that is in no word."""
        while at < len(self.low):
            found = np.flatnonzero(_GAP[self.low[at : at + 65_536]])
            if len(found):
                return at + int(found[0])
            at += 65_536
        return len(self.low)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words of a text."""
        last = np.repeat(self.first[1:], self.count)
        at = np.flatnonzero(np.arange(len(self.hash)) + size <= last)
        gram = np.zeros(len(at), np.uint64)
        for k in range(size):
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + k]
        return at, mix(gram + np.uint64(size))

    def text(self, a: int, b: int) -> str:
        """Words ``a`` to ``b`` (excluded) with one space between."""
        raw = self.low[self.start[a] : self.end[b - 1]]
        return b" ".join(np.where(_GAP[raw], np.uint8(0x20), raw).tobytes().split()).decode("utf-8", "replace")


def windows(items: DataFrame, *, item_id: str, text: str, window: int) -> DataFrame:
    """item (string), n, words, grams (hashes in order) of every distinct window of each item."""
    source = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                item, n, said, grams = [], [], [], []
                for name, first, count in zip(part.column("item").to_pylist(), w.first[:-1].tolist(), w.count.tolist(), strict=True):
                    wide = min(window, count)
                    for a in range(first, first + count - wide + 1 if count else first):
                        item.append(name)
                        n.append(wide)
                        said.append(w.text(a, a + wide))
                size = {k: dict(zip(*(x.tolist() for x in w.shingles(k)), strict=True)) for k in range(1, _SIZE + 1)}
                for first, count in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
                    wide = min(window, count)
                    k = min(_SIZE, wide)
                    for a in range(first, first + count - wide + 1 if count else first):
                        grams.append([size[k][a + i] for i in range(wide - k + 1)])
                grams = pa.array(np.array([g for x in grams for g in x], np.uint64).view(np.int64)), np.cumsum([0, *map(len, grams)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.string()), pa.array(n, pa.int32()), pa.array(said, pa.string()), pa.ListArray.from_arrays(pa.array(grams[1], pa.int32()), grams[0])],
                    ["item", "n", "words", "grams"],
                )

    return source.mapInArrow(run, "item string, n int, words string, grams array<long>").distinct()


def bloom(hashes: DataFrame) -> np.ndarray:
    """A filter of the column ``g``: 64 bits for each hash, up to ``_BITS`` in all; three of them are set."""
    size = 1 << 16
    while size < min(_BITS, 64 * hashes.count()):
        size *= 2
    places = F.array(*[F.shiftrightunsigned("g", k).bitwiseAND(F.lit(size - 1)) for k in (0, 18, 36)])
    rows = hashes.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def passes(filter_: np.ndarray, g: np.ndarray) -> np.ndarray:
    ok = np.ones(len(g), bool)
    for k in (0, 18, 36):
        p = (g >> np.uint64(k)) & np.uint64(64 * len(filter_) - 1)
        ok &= (filter_[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def corpus_counts(source: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(g, c): how often each of the ``wanted`` shingles (g) occurs in all texts."""
    shared = source.sparkSession.sparkContext.broadcast(bloom(wanted))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                for size in sizes:
                    g = w.shingles(size)[1]
                    found, number = np.unique(g[passes(shared.value, g)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(number.astype(np.int64))], ["g", "c"])

    counted = source.select("text").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    return counted.join(wanted, "g", "left_semi")


_PLACE = T.ArrayType(T.StructType([T.StructField("g", T.LongType()), T.StructField("at", T.LongType()), T.StructField("before", T.IntegerType()), T.StructField("around", T.StringType())]))


def places(source: DataFrame, prefixes: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """doc_id, tk, n_words and the places of prefix shingles, for each document."""
    shared = source.sparkSession.sparkContext.broadcast(bloom(prefixes))
    kind = pa.list_(pa.struct([("g", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.string())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for size in sizes:
                    at, g = w.shingles(size)
                    ok = passes(shared.value, g)
                    at, g = at[ok], g[ok].view(np.int64)
                    row = np.searchsorted(w.first, at, side="right") - 1
                    for r, a, x in zip(row.tolist(), at.tolist(), g.tolist(), strict=True):
                        first, last = int(w.first[r]), int(w.first[r + 1])
                        begin, end = max(first, a - window + 1), min(last, a + window)
                        found[r].append({"g": x, "at": a - first, "before": a - begin, "around": w.text(begin, end)})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tk"), pa.array(w.count.astype(np.int64)), pa.array(found, kind)], ["doc_id", "tk", "n_words", "places"])

    schema = T.StructType([source.schema["doc_id"], T.StructField("tk", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("places", _PLACE)])
    return source.select("doc_id", "tk", "text").mapInArrow(run, schema)


def _hits(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tk, n_words) of each document; (doc_id, tk, start, n, item) of each window that occurs."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tk"))
    owned = cut(windows(items, item_id=item_id, text=item_text, window=window), "windows")
    each = owned.select("words", "n", "grams").distinct()
    sizes = sorted(r[0] for r in owned.select(F.least("n", F.lit(_SIZE))).distinct().collect())  # three at most
    spread = each.select("words", "n", F.posexplode("grams").alias("offset", "g"))
    counts = cut(corpus_counts(source, spread.select("g").distinct(), sizes), "rarity")
    # a shingle that no document holds makes its window impossible
    rare = spread.join(counts, "g", "left").groupBy("words", "n").agg(F.min(F.struct(F.coalesce("c", F.lit(0).cast("long")).alias("c"), "g", "offset")).alias("r")).where("r.c > 0")
    prefixed = cut(rare.select("words", "n", "r.g", "r.offset"), "prefixes")
    found = cut(places(source, prefixed.select("g").distinct(), sizes, window), "places")
    spots = found.select("doc_id", "tk", F.explode("places").alias("p")).select("doc_id", "tk", "p.*").distinct()
    inside = (F.col("before") >= F.col("offset")) & (F.size("list") >= F.col("before") - F.col("offset") + F.col("n"))
    met = spots.withColumn("list", F.split("around", " ")).join(prefixed, "g").where(inside)
    met = met.where(F.array_join(F.expr("slice(list, before - offset + 1, n)"), " ") == F.col("words"))
    hits = met.select("doc_id", "tk", (F.col("at") - F.col("offset")).alias("start"), "n", "words").join(owned.select("words", "item"), "words")
    return found.select("doc_id", "tk", "n_words"), hits.select("doc_id", "tk", "start", "n", "item")


def find_hits(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document: its id, n_words, maximal hit runs and item ids.

    ``starts``/``ends`` are word positions (end excluded), ascending and disjoint;
    ``items`` are ids of the items with an occurring window, cast to string.
    """
    each, hits = _hits(docs, items, **options)
    by = hits.groupBy(F.col("doc_id").alias("d"), F.col("tk").alias("k")).agg(F.collect_set(F.struct("start", "n")).alias("runs"), F.array_sort(F.collect_set("item")).alias("items"))
    hit = by.withColumn("p", F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))))))
    runs = hit.select(
        "d", "k", "items",
        F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1)).alias("starts"),
        F.transform(F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1)), lambda x: x + 1).alias("ends"),
    )
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return each.join(runs, each["doc_id"].eqNullSafe(runs["d"]) & (each["tk"] == runs["k"]), "left").select(
        "doc_id", "n_words", F.coalesce("starts", none("long")).alias("starts"), F.coalesce("ends", none("long")).alias("ends"), F.coalesce("items", none("string")).alias("items"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without any benchmark window; all their columns."""
    d, k = fresh(docs, "_d"), fresh(docs, "_k")
    hit = _hits(docs, items, doc_id=doc_id, text=text, **options)[1].select(F.col("doc_id").alias(d), F.col("tk").alias(k)).distinct()
    return docs.join(hit, docs[doc_id].eqNullSafe(hit[d]) & (F.xxhash64(docs[text]) == hit[k]), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest over all documents and benchmark items."""
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
SQL = f"""
WITH it AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM it WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
          FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)
"""


def sha_of(items: list[object]) -> str:
    """The digest of item ids, as the query makes it."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
