"""Reports of a code-switch evaluation: tables for each word, flagged words and language pairs, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators import metrics

WORD_COLUMNS = ("file", "pair", "text", "lang", "pos", "status", "flags")


def per_word(words: DataFrame) -> DataFrame:
    """The columns of the word report; flags are joined by ``;``."""
    return words.select(*WORD_COLUMNS[:-1], F.array_join("flags", ";").alias("flags"))


def flagged(words: DataFrame) -> DataFrame:
    """Only words with a flag."""
    return per_word(words.where(F.size("flags") > 0))


def per_pair(words: DataFrame, statuses: list[str], flags: list[str]) -> DataFrame:
    return metrics.per_pair_rollup(words, "pair", statuses, flags)


def summary(pairs: DataFrame, title: str) -> DataFrame:
    """One row, ``markdown``: a table of the pairs in order of their names, and totals (pairs are few)."""
    names = pairs.columns
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]), F.lit(" |"))
    lines = pairs.agg(F.array_sort(F.collect_list(F.struct(F.col("pair").alias("p"), cells.alias("l")))).alias("rows"), F.sum("total").alias("words"), F.sum("clean").alias("clean"))
    head = F.array(F.lit(f"# {title}"), F.lit(""), F.lit("| " + " | ".join(names) + " |"), F.lit("|" + "---|" * len(names)))
    foot = F.array(F.lit(""), F.concat(F.lit("Words: "), F.coalesce("words", F.lit(0)).cast("string"), F.lit(", clean: "), F.coalesce("clean", F.lit(0)).cast("string")))
    return lines.select(F.array_join(F.concat(head, F.transform("rows", lambda r: r["l"]), foot), "\n").alias("markdown"))


def write_reports(words: DataFrame, folder: str, statuses: list[str], flags: list[str], title: str = "Evaluation") -> None:
    """per-word, flagged and per-pair tables as CSV, and the summary as text, below ``folder``."""
    pairs = per_pair(words, statuses, flags)
    for name, table in (("per-word", per_word(words)), ("flagged", flagged(words)), ("per-pair", pairs)):
        table.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    summary(pairs, title).write.mode("overwrite").text(f"{folder}/summary")
