"""Alignment after an edit: only the groups that the edit touches go to the engine again.

Tables:

* utterances before and after: file, utt, speaker, words (one string), start_ms, end_ms, n_chars, utt = 0, 1, ...;
* word times: file, utt, pos, start_ms, end_ms.

A word time of the version before is stable where its utterance was not changed in its words (unchanged, other
speaker or other times by ``alignment.diff``) and all words of the utterance have a time. A group of the version after
is kept when all its utterances are stable; with ``same_window`` also only if the version before had a group over the same stretch
of sound with just those utterances, so that the result equals that of a full run of an engine that looks at
the whole stretch. All other groups are sent: a change spreads to the group it lies in, and through the window,
which reaches toward the next utterance, to the group in front of it.

Diffs and packing gather a file; stable times, groups kept and what is sent are joins on (file, utt).

Defined results: without a version before everything is sent; an utterance without words or without times of
its own belongs to no group and gets no word times; a file that is gone gives nothing; repeated word times of
one place count once (the earliest). Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators import alignment, timing

KEPT = ("unchanged", "speaker_changed", "timing_only")


def pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, utt, old): utterances of ``after`` with that of ``before`` they came from, words unchanged.

    Utterances are counted from 0 in each file, whatever numbers they carry.
    """
    cols = ["file", "utt", "speaker", F.coalesce("words", F.lit("")).alias("words"), "start_ms", "end_ms"]
    same = alignment.diff(before.select(*cols), after.select(*cols)).where(F.col("kind").isin(*KEPT)).select("file", "before_idx", "after_idx")
    at = Window.partitionBy("file").orderBy("utt")
    old = before.select("file", F.col("utt").alias("old"), (F.row_number().over(at) - 1).cast("long").alias("before_idx"))
    new = after.select("file", "utt", (F.row_number().over(at) - 1).cast("long").alias("after_idx"))
    return same.join(old, ["file", "before_idx"]).join(new, ["file", "after_idx"]).select("file", "utt", "old")


def stable_times(matched: DataFrame, before: DataFrame, times: DataFrame) -> DataFrame:
    """(file, utt, old, pos, start_ms, end_ms): times of the version before under the utterances of the version after."""
    n = before.select("file", F.col("utt").alias("old"), F.size(F.filter(F.split(F.coalesce("words", F.lit("")), " "), lambda w: w != "")).alias("_n"))
    one = times.where("start_ms IS NOT NULL AND end_ms IS NOT NULL").groupBy("file", F.col("utt").alias("old"), "pos").agg(F.min(F.struct("start_ms", "end_ms")).alias("_t"))
    known = one.join(n, ["file", "old"]).where("pos >= 0 AND pos < _n").withColumn("_k", F.count("*").over(Window.partitionBy("file", "old"))).where("_k = _n")
    return matched.join(known, ["file", "old"]).select("file", "utt", "old", "pos", "_t.start_ms", "_t.end_ms")


def _members(utts: DataFrame, max_ms: int, duration: int) -> DataFrame:
    rows = utts.where(F.trim(F.coalesce("words", F.lit(""))) != "").select("file", F.col("utt").alias("line"), "start_ms", "end_ms", "n_chars")
    groups = timing.group_for_alignment(rows, max_ms, duration)
    return groups.select("file", "grp", "start_ms", "end_ms", F.posexplode("lines").alias("place", "utt"), F.size("lines").alias("size"))


def plan(before: DataFrame, after: DataFrame, times: DataFrame, max_ms: int, duration: int, same_window: bool = False) -> tuple[DataFrame, DataFrame]:
    """(groups, stable): the groups of ``after`` as (file, grp, start_ms, end_ms, utt, place, size, kept), and the stable times."""
    matched = pairs(before, after)
    stable = stable_times(matched, before, times)
    whole = stable.select("file", "utt", "old").distinct()
    here = _members(after, max_ms, duration).join(whole, ["file", "utt"], "left")
    if same_window:
        there = _members(before, max_ms, duration).select("file", F.col("utt").alias("old"), F.struct("start_ms", "end_ms", "place", "size").alias("_there"))
        here = here.join(there, ["file", "old"], "left")
        good = F.col("_there").eqNullSafe(F.struct("start_ms", "end_ms", "place", "size")) & F.col("old").isNotNull()
    else:
        good = F.col("old").isNotNull()
    kept = F.min(F.coalesce(good, F.lit(False))).over(Window.partitionBy("file", "grp"))
    return here.select("file", "grp", "start_ms", "end_ms", "utt", "place", "size", kept.alias("kept")), stable


def realign(before: DataFrame, after: DataFrame, times: DataFrame, engine: Callable[[DataFrame], DataFrame], max_ms: int, duration: int, same_window: bool = False) -> DataFrame:
    """Word times of ``after``: (file, utt, pos, start_ms, end_ms, source), ``source`` being ``kept`` or ``engine``.

    ``engine`` turns (file, grp, start_ms, end_ms, words: array of (utt, pos, text)) into (file, utt, pos, start_ms,
    end_ms); it sees the groups that are not kept and no others.
    """
    groups, stable = plan(before, after, times, max_ms, duration, same_window)
    words = after.select("file", "utt", F.posexplode(F.filter(F.split(F.coalesce("words", F.lit("")), " "), lambda w: w != "")).alias("pos", "text"))
    sent = groups.where("NOT kept").select("file", "grp", "start_ms", "end_ms", "utt", "place").join(words, ["file", "utt"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "pos", "utt", "text"))), lambda w: F.struct(w["utt"].alias("utt"), w["pos"].alias("pos"), w["text"].alias("text")))
    asked = sent.groupBy("file", "grp", "start_ms", "end_ms").agg(ordered.alias("words"))
    new = engine(asked).select("file", "utt", "pos", "start_ms", "end_ms", F.lit("engine").alias("source"))
    old = stable.join(groups.where("kept").select("file", "utt"), ["file", "utt"], "left_semi").select("file", "utt", "pos", "start_ms", "end_ms", F.lit("kept").alias("source"))
    return old.union(new)


def even_engine(asked: DataFrame) -> DataFrame:
    """Words share their group's stretch in equal parts: the plainest engine, for tests and dry runs."""
    span, n = F.col("end_ms") - F.col("start_ms"), F.size("words")
    one = asked.select("file", "start_ms", span.alias("span"), n.alias("n"), F.posexplode("words").alias("k", "w"))
    edge = lambda k: (F.col("start_ms") + F.floor(F.col("span") * k / F.col("n"))).cast("long")
    return one.select("file", "w.utt", "w.pos", edge(F.col("k")).alias("a"), edge(F.col("k") + 1).alias("b")).select("file", "utt", "pos", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))
