"""Column functions on word lists: order-sensitive rules as higher-order functions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions.lazy import lazy_udf, row_udf
from turnwise.functions.words import fold_ascii

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by one row of the table at a time.

    With costs match 0, gap 1 and substitution 2, a minimum-cost alignment has
    this many matches, |a| minus it insertions and |b| minus it deletions. For
    long lists use ``operators.alignment``, which is linear in memory.
    """
    row = F.transform(F.sequence(F.lit(0), F.size(b)), lambda x: F.lit(0))

    def next_row(prev: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)),
            lambda c, j: F.concat(c, F.array(F.when(x == F.get(b, j - 1), F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.get(c, j - 1))))),
        )

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.get(F.aggregate(a, row, next_row), F.size(b)))


def bag_difference(a: Column, b: Column) -> Column:
    """Words that one side has more of, ASCII case folded (sum over both sides)."""
    return _difference(F.transform(a, fold_ascii), F.transform(b, fold_ascii))


def _difference(a: Column, b: Column) -> Column:
    """Sum over the words of how much more one side has: one pass over both sides in order; nulls are no words."""
    side = lambda xs, sign: F.transform(F.filter(xs, lambda w: w.isNotNull()), lambda w: F.struct(w.alias("w"), F.lit(sign).alias("d")))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("d"), F.lit(0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        more = F.struct(x["w"].alias("w"), (acc["d"] + x["d"]).alias("d"), acc["sum"].alias("sum"))
        return F.when(acc["w"].eqNullSafe(x["w"]), more).otherwise(F.struct(x["w"].alias("w"), x["d"].alias("d"), (acc["sum"] + F.abs(acc["d"])).alias("sum")))

    return F.aggregate(F.sort_array(F.concat(side(a, 1), side(b, -1))), start, step, lambda acc: acc["sum"] + F.abs(acc["d"]))


def bag_overlap(a: Column, b: Column) -> Column:
    """Words that both sides have, with multiplicity."""
    words = lambda xs: F.size(F.filter(xs, lambda w: w.isNotNull()))
    return ((words(a) + words(b) - _difference(a, b)) / 2).cast("int")


def merge_compounds(words: Column, compounds: list[tuple[str, str]] | None = None) -> Column:
    """Neighbours that form a compound, joined greedily from the left."""
    pairs = F.array(*[F.lit(f"{a} {b}") for a, b in (L.COMPOUNDS if compounds is None else compounds)])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("closed"))

    def step(acc: Column, w: Column) -> Column:
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        joins = (F.size(acc["out"]) > 0) & ~acc["closed"] & F.array_contains(pairs, F.concat_ws(" ", last, w))
        joined = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat(last, w)))
        return F.struct(F.when(joins, joined).otherwise(F.concat(acc["out"], F.array(w))).alias("out"), joins.alias("closed"))

    return F.aggregate(words, start, step)["out"]


def join_single_letters(words: Column) -> Column:
    """Runs of single letters as one word."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))

    def step(acc: Column, w: Column) -> Column:
        single = w.rlike(r"^[A-Za-z]$")
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat(last, w)))
        return F.struct(F.when(single & acc["open"], grown).otherwise(F.concat(acc["out"], F.array(w))).alias("out"), single.alias("open"))

    return F.aggregate(words, start, step)["out"]


def merge_abbreviations(words: Column, abbreviations: list[str] | None = None) -> Column:
    """Known abbreviations out of runs of single letters, longest match first."""
    known = {a.upper() for a in (L.ABBREVIATIONS if abbreviations is None else abbreviations)}
    longest = max(map(len, known), default=1)

    @row_udf("array<string>")
    def merged(words: list[str] | None) -> list[str] | None:
        if words is None:
            return None
        letter = [w is not None and len(w) == 1 and unicodedata.category(w)[0] == "L" for w in words]
        out, i = [], 0
        while i < len(words):
            run = next((n for n in range(min(longest, len(words) - i)) if not letter[i + n]), min(longest, len(words) - i))
            n = next((n for n in range(run, 1, -1) if "".join(words[i : i + n]).upper() in known), 1)
            out.append("".join(words[i : i + n]) if n > 1 else words[i])
            i += n
        return out

    return merged(words)


def repeated(words: list[str], least: int = 1) -> np.ndarray:
    """Which words lie in a stretch of ``least`` or more words that is repeated at once.

    A stretch of n words is repeated where n words in a row equal the word n
    places on: for each n these are the runs of n or more.
    """
    low = np.array([w.translate(_ASCII) for w in words], object)
    marks = np.zeros(len(low), bool)
    for n in range(max(least, 1), len(low) // 2 + 1):
        same = np.flatnonzero(low[:-n] == low[n:])
        if len(same) >= n:
            begin = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1] + 1)))
            count = np.diff(np.append(begin, len(same)))
            marks[same[np.repeat(count >= n, count)]] = True
    return marks


@lazy_udf("array<boolean>")
def _retraces(words: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([None if ws is None else [bool(m) and not w.startswith("&-") for m, w in zip(repeated(list(ws), k), ws, strict=True)] for ws, k in zip(words, least, strict=True)])


def retraces(words: Column, least: int = 1) -> Column:
    """array<boolean>: words that open a repeated stretch (the repetition follows at once).

    ``words`` are content words. Fillers take part in the comparison but are not
    marked. Arrow-batched; quadratic in the words of a turn.
    """
    return _retraces(words, F.lit(least))


def group_ids(flags: Column) -> Column:
    """Running count of true flags before each element (boundary actions to group ids)."""
    return F.transform(flags, lambda f, i: F.size(F.filter(F.slice(flags, F.lit(1), i), lambda x: x)))


def chunks(words: Column, size: int = L.MAX_TURN_WORDS) -> Column:
    """Lists of at most ``size`` words."""
    n = F.greatest(F.ceil(F.size(words) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(words, k * size + 1, F.lit(size)))


def feature_set(feats: Column) -> Column:
    return F.array_sort(F.array_distinct(feats))


def relations_valid(heads: Column) -> Column:
    """One root, and all heads inside the sentence."""
    return (F.size(F.filter(heads, lambda h: h == 0)) == 1) & F.forall(heads, lambda h: (h >= 0) & (h <= F.size(heads)))


def length_mapping(n_words: Column, n_tokens: Column) -> Column:
    """Proportional fallback: the word index of each token."""
    return F.when(n_tokens > 0, F.transform(F.sequence(F.lit(0), F.greatest(n_tokens - 1, F.lit(0))), lambda t: F.least(F.floor(t * n_words / n_tokens).cast("int"), n_words - 1))).otherwise(F.array().cast("array<int>"))
