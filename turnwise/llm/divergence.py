"""Source divergence audit with a heavy-light split (operator 12).

How far the word frequencies of two sources of one language lie apart, and which words set
a source off from its language. With p of one source and q of the other (or of the
language), scaled to a billion and smoothed by one, a term adds f(p, q) = (p-q)*(p-q)/q, rounded down.

For two sources s and t the sum over all V kept terms is

    V f(0, 0) + sum over terms of s (f(p, 0) - f(0, 0)) + sum over terms of t (f(0, q) - f(0, 0))
      + sum over terms of both (f(p, q) - f(p, 0) - f(0, q) + f(0, 0)),

where 0 stands for the frequency of an absent term, which is the same for all terms of a group. The
first three parts come from counts of equal counts, in Spark. The last one is split: terms present in
at least half of a language's sources ("heavy") go through dense numpy tiles of terms by sources; the
others through pairs of their postings, which are never more than the pairs of sources.
Both partial sums are integers and are added exactly.

Steps: Python counts words of each task (bounded tables, flushed when full), Spark adds
them up by language, source and term, so that a frequent word is a row for each task and not
for each occurrence; a window over (language, term) finds the kept terms. Group tables are
joined without hints, so that Spark broadcasts them only by their measured size.

Bounds: the result has a row for each two sources of a language, so that the posting list of a term
(at most one entry a source) and a tile's sums are small beside it. Integers are exact while a
language has less than two billion kept terms and a group less than 9.2e9 occurrences of one term.

Defined results: null text, language or source counts as ''; a group without terms has all its pairs
(value 0 where the language keeps no term); repeated rows count as documents; further columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import cut, slices
from turnwise.session import table

#: A term's bytes: ASCII letters (lower-cased before) and everything beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
#: Entries of a task's tables before they are written out; bytes of a text read at once; terms of a tile; shares of a join by language.
_FLUSH, _BLOCK, _TILE, _SHARES = 300_000, 4_000_000, 2_048, 32
SCALE = 1_000_000_000


def _blocks(raw: bytes) -> Iterator[bytes]:
    """Pieces of a text, cut where no term is."""
    start = 0
    while start < len(raw):
        end = min(start + _BLOCK, len(raw))
        if end < len(raw):
            found = _GAP.search(raw, end)
            end = found.start() if found else len(raw)
        yield raw[start:end]
        start = end


def _count_words(batches):
    """Rows (lang, source, term, n, docs); a row without a term for each group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, docs) in counts.items():
            terms = [None, *n]
            for at in range(0, len(terms), 65_536):
                some = terms[at : at + 65_536]
                names = pa.array([t if t is None else t.decode() for t in some], pa.string())
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k), pa.array([source] * k), names, pa.array([n[t] if t else 0 for t in some], pa.int64()), pa.array([docs[t] if t else 0 for t in some], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        counts.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, source, text in zip(*[part.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for block in _blocks(text.encode().lower()):
                    words = _TERM.findall(block)
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(n) for n, _ in counts.values()) > _FLUSH:
                yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents); a row without a term for each group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = rows.mapInArrow(_count_words, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + terms))."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(20,0)") * (count + 1), total + terms).cast("long")


def surprise(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _joint(p, p0, q, q0) -> np.ndarray:
    return _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)


def _dense(size: np.ndarray, s: np.ndarray, p: np.ndarray, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over a tile of terms (``size`` postings each) for all pairs of its sources."""
    sources, column = np.unique(s, return_inverse=True)
    row = np.repeat(np.arange(len(size)), size)
    high, low = np.ones((len(size), len(sources)), np.int64), np.ones(len(sources), np.int64)
    has = np.zeros(high.shape, bool)
    high[row, column], has[row, column], low[column] = p, True, p0
    out = np.zeros((len(sources), len(sources)), np.int64)
    for i in range(len(sources)):
        of = has[:, i]
        each = _joint(high[of, i, None], low[i], high[of], low[None, :])
        out[i] = np.where(has[of], each, 0).sum(0)
    np.fill_diagonal(out, 0)
    a, b = np.nonzero(out)
    return sources[a], sources[b], out[a, b]


def _sparse(size: np.ndarray, s: np.ndarray, p: np.ndarray, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the pairs of each term's postings."""
    each = np.repeat(size, size)
    left = np.repeat(np.arange(len(s)), each)
    begin = np.repeat(np.cumsum(size) - size, size)
    right = np.repeat(begin, each) + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    left, right = left[left != right], right[left != right]
    value = _joint(p[left], p0[left], p[right], p0[right])
    wide = int(s.max()) + 1 if len(s) else 1
    keys, at = np.unique(s[left].astype(np.int64) * wide + s[right], return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, at, value)
    return keys // wide, keys % wide, out


def _corrections(batches):
    """Rows (lang, s, t, value) from rows (lang, heavy, posting)."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        heavy = batch.column("heavy").to_numpy(zero_copy_only=False)
        for lang in dict.fromkeys(langs.tolist()):
            for dense, step in ((True, _TILE), (False, _TILE)):
                rows = np.flatnonzero((langs == lang) & (heavy == dense))
                for at in range(0, len(rows), step):
                    posting = batch.column("posting").take(pa.array(rows[at : at + step]))
                    size = posting.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    s, p, p0 = (posting.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "p", "p0"))
                    a, b, value = (_dense if dense else _sparse)(size, s, p, p0)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.int64())], ["lang", "s", "t", "value"])


class Audit:
    """Tables of one corpus: ``kept`` (lang, s, term, n, total), ``groups`` (lang, source, s, n_all, p0, terms, n_lang, n_sources)."""

    def __init__(self, docs: DataFrame, *, min_docs: int = 3, **columns: str):
        counts = cut(term_counts(docs, **columns), "terms")
        of_term = Window.partitionBy("lang", "term")
        numbered = counts.where("term IS NULL").select("lang", "source", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long").alias("s"))
        known = counts.where("term IS NOT NULL").withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("total", F.sum("n").over(of_term)).where(F.col("in_docs") >= min_docs)
        self.kept = cut(known.join(numbered, ["lang", "source"]).select("lang", "s", "term", "n", "total"), "kept_terms")
        sums = self.kept.groupBy("lang", "s").agg(F.sum("n").alias("n_all"))
        langs = self.kept.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("n_lang"))
        each = numbered.join(sums, ["lang", "s"], "left").join(langs, "lang", "left").na.fill(0, ["n_all", "terms", "n_lang"])
        each = each.withColumn("p0", F.when(F.col("terms") > 0, scaled(F.lit(0), F.col("n_all"), F.col("terms"))))
        self.groups = cut(each.withColumn("n_sources", F.count("*").over(Window.partitionBy("lang"))), "groups")

    def _frequent(self) -> DataFrame:
        """lang, s, term, n, total, p, p0 and the group's figures."""
        return self.kept.join(self.groups, ["lang", "s"]).withColumn("p", scaled(F.col("n"), F.col("n_all"), F.col("terms")))

    def pairs(self) -> DataFrame:
        """lang, source, item (the other source), q, value."""
        g = self.groups
        other = g.select("lang", F.col("s").alias("t"), F.col("source").alias("item"), F.col("n_all").alias("other_all"), F.col("p0").alias("q"))
        shares = F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))).alias("share")
        other = other.select("*", shares)  # a hot language is spread over the shares
        met = lambda left: left.withColumn("share", (F.col("s") % _SHARES).cast("int")).join(other, ["lang", "share"]).where("s <> t").drop("share")
        # equal counts of a source are one row: f(p, 0) and f(0, p) against every other source
        alike = self.kept.groupBy("lang", "s", "n").agg(F.count("*").alias("alike")).join(g, ["lang", "s"]).withColumn("p", scaled(F.col("n"), F.col("n_all"), F.col("terms")))
        sided = met(alike.select("lang", "s", "p", "p0", "alike"))
        p, p0, q, alike_ = F.col("p"), F.col("p0"), F.col("q"), F.col("alike")
        forth = sided.select("lang", "s", "t", (alike_ * (surprise(p, q) - surprise(p0, q))).alias("value"))
        back = sided.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), (alike_ * (surprise(q, p) - surprise(q, p0))).alias("value"))
        posting = self._frequent().groupBy("lang", "term").agg(F.collect_list(F.struct("s", "p", "p0")).alias("posting"), F.first("n_sources").alias("n_sources"))
        both = posting.where(F.size("posting") > 1).select("lang", (2 * F.size("posting") >= F.col("n_sources")).alias("heavy"), "posting").mapInArrow(_corrections, "lang string, s long, t long, value long")
        added = forth.groupBy("lang", "s", "t").agg(F.sum("value").alias("value")).unionByName(back.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))).unionByName(both)
        added = added.groupBy("lang", "s", "t").agg(F.sum("value").alias("added"))
        base = met(g.select("lang", "s", "source", "p0", "terms")).join(added, ["lang", "s", "t"], "left")
        value = F.when(F.col("terms") > 0, F.col("terms") * surprise(p0, q) + F.coalesce("added", F.lit(0))).otherwise(0)
        return base.select("lang", "source", "item", "q", value.cast("long").alias("value"))

    def terms(self) -> DataFrame:
        """lang, source, item (term), p, q, value of kept terms that a source uses more than its language does."""
        rows = self._frequent().withColumn("q", scaled(F.col("total"), F.col("n_lang"), F.col("terms"))).where("p > q")
        return rows.select("lang", "source", F.col("term").alias("item"), "p", "q", surprise(F.col("p"), F.col("q")).alias("value"))

    def report(self, top: int = 200) -> DataFrame:
        """lang, source, part, item, value, rank: all other sources (``pair``), the ``top`` terms (``term``)."""
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        return ranked(self.pairs(), "pair").unionByName(ranked(self.terms(), "term").where(F.col("rank") <= top))


def audit(docs: DataFrame, top: int = 200, **columns: str) -> DataFrame:
    return Audit(docs, **columns).report(top)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows over all documents."""
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
e AS (SELECT lang, source, doc, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM e GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS terms, sum(total) AS n_lang FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(terms), 0) AS terms, coalesce(sum(n), 0) AS n_all FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
f AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (n_all + g.terms)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (total + 1)) // (n_lang + g.terms)::HUGEINT AS p_lang FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - p_lang) * (p - p_lang) // p_lang)::BIGINT FROM f WHERE n > 0 AND p > p_lang)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 200
"""
