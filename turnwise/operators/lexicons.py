"""Word lists as tables: compounds, names, abbreviations, a user's multiword dictionary.

Lists of any size are joined to the distinct words of a corpus, so that a list
never becomes part of an expression; the result is joined back on the word.
A list of at most ``_BROADCAST_ROWS`` rows is broadcast, a longer one is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import words as W

_BROADCAST_ROWS = 200_000
KINDS = ("compound", "abbreviation", "name")


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(kind, key, parts) from a text file: a word, or a compound written in two parts, on each line.

    Empty lines and lines that begin with ``#`` do not count; repeated lines count once.
    """
    line = F.trim("value")
    parts = F.split(line, r"[\s,|]+")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.lit(kind).alias("kind"), parts.alias("parts"))
    return keyed(rows)


def keyed(rows: DataFrame) -> DataFrame:
    """Adds ``key``, what a word is compared with: abbreviations as they are written, all else in lower case."""
    joined = F.array_join("parts", "")
    return rows.select("kind", F.when(F.col("kind") == "abbreviation", joined).otherwise(F.lower(joined)).alias("key"), "parts").dropDuplicates(["kind", "key"])


def builtin(spark: SparkSession) -> DataFrame:
    """The lists of the package in the same form."""
    rows = [("compound", list(p)) for p in L.COMPOUNDS] + [("abbreviation", [a]) for a in L.ABBREVIATIONS] + [("name", [n]) for n in L.NAMES]
    return keyed(spark.createDataFrame(rows, "kind string, parts array<string>"))


def conformed(words: DataFrame, lexicon: DataFrame, text: str = "text", out: str = "conformed") -> DataFrame:
    """``words`` with the array of words each one is scored as, by the rules of ``functions.words.conform``.

    The lists stand where the rules have them: compounds, then abbreviations, then
    the fixed rules, and names only where no rule but the last ones would apply.
    """
    distinct = words.select(F.col(text).alias("_w")).distinct()
    small = lexicon.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS
    side = lambda k: (F.broadcast if small else (lambda x: x))(lexicon.where(F.col("kind") == k).select(F.col("key").alias(f"_{k}"), F.col("parts").alias(f"_{k}_parts")))
    raw, low = F.trim("_w"), F.lower(F.trim("_w"))
    met = distinct.join(side("compound"), low == F.col("_compound"), "left").join(side("abbreviation"), raw == F.col("_abbreviation"), "left").join(side("name"), low == F.col("_name"), "left")
    rules = W.conform(F.col("_w"), compounds=[], names=[], abbreviations=[])
    # a name list comes after the rules that change a word and before those that spell it
    early = F.coalesce(low.rlike(CHANGED) | low.isin([*L.FILLERS, *L.CONFORM_WORDS]), F.lit(False))
    value: Column = (
        F.when(F.col("_compound").isNotNull(), F.transform("_compound_parts", F.lower)).when(F.col("_abbreviation").isNotNull(), F.filter(F.split(raw, ""), lambda c: c != ""))
        .when(F.col("_name").isNotNull() & ~early, F.array(F.lit("name"))).otherwise(rules)
    )
    found = met.select("_w", value.alias(out))
    return words.join(found, words[text].eqNullSafe(found["_w"]), "left").drop("_w")


#: Marks of contractions and dashes, which come before names.
CHANGED = "|".join(["-", *[m for m, _ in L.CONTRACTIONS]])
