"""Utterance times: order, overlaps, gaps, estimates and grouping.

Tables have (file, line, speaker, start_ms, end_ms[, n_words]); ``line`` orders a
file, null times mean untimed. Rules that look at neighbours are windows over
file (and speaker); the few with running state are grouped by file or speaker.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions.lazy import row_udf


def _file():
    return Window.partitionBy("file").orderBy("line")


def _speaker():
    return Window.partitionBy("file", "speaker").orderBy("line")


def timed(df: DataFrame) -> DataFrame:
    return df.where("start_ms IS NOT NULL AND end_ms IS NOT NULL")


def non_monotonic(df: DataFrame) -> DataFrame:
    """Adds ``stripped``: the start lies before that of an earlier row that is kept (a running maximum)."""
    before = F.max("start_ms").over(_file().rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("stripped", F.coalesce(F.col("start_ms") < before, F.lit(False)))


def enforce_monotonicity(df: DataFrame) -> DataFrame:
    """Times after both passes, with ``decision``: timing_stripped, end_clamped, zero_duration or null.

    Second pass: among the rows the first one left, an end is cut at the next
    start; without a duration left, the time goes.
    """
    one = non_monotonic(df)
    kept = F.when(~F.col("stripped"), F.col("start_ms"))
    following = F.first(kept, ignorenulls=True).over(_file().rowsBetween(1, Window.unboundedFollowing))
    two = one.withColumns({"_s": kept, "_n": following})
    late = F.col("_s").isNotNull() & F.coalesce(F.col("end_ms") > F.col("_n"), F.lit(False))
    zero = late & (F.col("_n") <= F.col("_s"))
    return two.withColumns(
        {
            "decision": F.when(F.col("stripped"), "timing_stripped").when(zero, "zero_duration").when(late, "end_clamped"),
            "_e": F.when(F.col("stripped") | zero, None).when(late, F.col("_n")).otherwise(F.col("end_ms")),
            "_b": F.when(~F.col("stripped") & ~zero, F.col("start_ms")),
        }
    ).withColumns({"start_ms": F.col("_b"), "end_ms": F.col("_e")}).drop("_s", "_n", "_e", "_b", "stripped")


def same_speaker_overlaps(df: DataFrame, tolerance: int = L.SAME_SPEAKER_OVERLAP_MS) -> DataFrame:
    """Timed rows with ``stripped``: the speaker's next row starts more than ``tolerance`` before this one ends."""
    return timed(df).withColumn("stripped", F.coalesce(F.col("end_ms") > F.lead("start_ms").over(_speaker()) + tolerance, F.lit(False)))


def gap_fills(df: DataFrame, most: int = L.FILL_GAP_MS) -> DataFrame:
    """Timed rows that start 1 to ``most`` ms after the same speaker's last end, with their ``new_start``."""
    before = F.lag("end_ms").over(_speaker())
    return timed(df).withColumn("new_start", before).where((F.col("start_ms") > F.col("new_start")) & (F.col("start_ms") - F.col("new_start") <= most))


def boundary_averages(df: DataFrame, most: int = L.AVERAGE_OVERLAP_MS) -> DataFrame:
    """Timed rows that overlap the row before by up to ``most`` ms, with the ``midpoint`` (whole ms)."""
    before = timed(df).withColumns({"prev_line": F.lag("line").over(_file()), "prev_end": F.lag("end_ms").over(_file())})
    overlap = F.col("prev_end") - F.col("start_ms")
    return before.where((overlap > 0) & (overlap <= most)).withColumn("midpoint", F.col("start_ms") + F.floor(overlap / 2).cast("long"))


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of the longest non-decreasing subsequence (patience sorting)."""
    from bisect import bisect_right

    tails, ends, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_right(ends, v)
        back.append(tails[k - 1] if k else None)
        tails[k : k + 1], ends[k : k + 1] = [i], [v]
    out, i = [], tails[-1] if tails else None
    while i is not None:
        out.append(i)
        i = back[i]
    return out[::-1]


def out_of_order(df: DataFrame) -> DataFrame:
    """file, speaker, line of timed rows outside the speaker's longest non-decreasing run of starts."""

    rows = timed(df).groupBy("file", "speaker").agg(F.sort_array(F.collect_list(F.struct("line", "start_ms"))).alias("rows"))
    return rows.select(F.col("file").cast("long").alias("file"), "speaker", F.explode(_outside(F.transform("rows", lambda x: x["line"].cast("long")), F.transform("rows", lambda x: x["start_ms"]))).alias("line"))


@row_udf("array<bigint>")
def _outside(lines: list[int], values: list[int]) -> list[int]:
    keep = set(longest_increasing(values))
    return [line for i, line in enumerate(lines) if i not in keep]


def repair(df: DataFrame) -> DataFrame:
    """Gap fills, then averages, then removals, all found on the times as they were."""
    fills = gap_fills(df).select("file", "line", F.col("new_start"))
    avg = boundary_averages(df)
    later = avg.select("file", "line", F.col("midpoint").alias("mid_start"))
    earlier = avg.select("file", F.col("prev_line").alias("line"), F.col("midpoint").alias("mid_end"))
    gone = out_of_order(df).select("file", "line", F.lit(True).alias("gone"))
    out = df
    for other in (fills, later, earlier, gone):
        out = out.join(other, ["file", "line"], "left")
    return out.withColumns(
        {
            "start_ms": F.when(F.col("gone").isNull(), F.coalesce("mid_start", "new_start", "start_ms")),
            "end_ms": F.when(F.col("gone").isNull(), F.coalesce("mid_end", "end_ms")),
            "repair": F.array_compact(F.array(F.when(F.col("new_start").isNotNull(), "gap_filled"), F.when(F.col("mid_start").isNotNull() | F.col("mid_end").isNotNull(), "boundary_averaged"), F.when(F.col("gone"), "lis_removal"))),
        }
    ).drop("new_start", "mid_start", "mid_end", "gone")


def _runs(df: DataFrame, duration: int) -> DataFrame:
    """Rows with the anchors around them: last end before, first start after, and a run id of untimed rows."""
    is_timed = F.col("start_ms").isNotNull()
    return df.withColumns(
        {
            "gap_start": F.coalesce(F.last("end_ms", ignorenulls=True).over(_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "gap_end": F.coalesce(F.first("start_ms", ignorenulls=True).over(_file().rowsBetween(1, Window.unboundedFollowing)), F.lit(duration)),
            "run": F.sum(is_timed.cast("int")).over(_file().rowsBetween(Window.unboundedPreceding, 0)),
        }
    )


def speech_rate(words: Column, span_ms: Column) -> Column:
    """no_words, no_audio, impossible (more than the human ceiling) or plausible."""
    return F.when(words == 0, "no_words").when(span_ms <= 0, "no_audio").when(words / (span_ms / 1000.0) > L.HUMAN_WPS, "impossible").otherwise("plausible")


def estimate_untimed(df: DataFrame, duration: int, buffer: int = L.ESTIMATE_BUFFER_MS) -> DataFrame:
    """Untimed rows placed between their timed neighbours in proportion to words.

    Adds est_start, est_end (null: cannot be placed) and ``placement``.
    """
    runs = _runs(df, duration)
    own = Window.partitionBy("file", "run").orderBy("line")
    all_ = Window.partitionBy("file", "run")
    untimed = F.col("start_ms").isNull()
    n = F.when(untimed, F.col("n_words")).otherwise(0)
    rows = runs.withColumns({"_all": F.sum(n).over(all_), "_before": F.sum(n).over(own.rowsBetween(Window.unboundedPreceding, 0)) - n, "_gap": F.greatest(F.col("gap_end") - F.col("gap_start"), F.lit(0))})
    share = lambda k: F.col("gap_start") + F.floor(k / F.col("_all") * F.col("_gap")).cast("long")
    a = F.least(F.greatest(share(F.col("_before")) - buffer, F.lit(0)), F.lit(duration))
    b = F.least(share(F.col("_before") + F.col("n_words")) + buffer, F.lit(duration))
    fits = speech_rate(F.col("_all"), F.col("_gap") + 2 * buffer).isin("plausible", "no_words")
    kind = F.when(~untimed, "timed").when(F.col("_all") == 0, "empty").when(~fits | (b <= a), "unplaceable").otherwise("estimated")
    return rows.withColumn("placement", kind).withColumns(
        {
            "est_start": F.when(~untimed, F.col("start_ms")).when(F.col("placement") == "empty", F.col("gap_start")).when(F.col("placement") == "estimated", a),
            "est_end": F.when(~untimed, F.col("end_ms")).when(F.col("placement") == "empty", F.col("gap_start")).when(F.col("placement") == "estimated", b),
        }
    ).drop("_all", "_before", "_gap", "run", "gap_start", "gap_end")


def untimed_windows(df: DataFrame, duration: int, padding: int) -> DataFrame:
    """file, start_ms, end_ms: padded stretches without times, merged where they touch, empty ones dropped."""
    runs = _runs(df, duration).where("start_ms IS NULL").groupBy("file", "run").agg(F.min("gap_start").alias("a"), F.max("gap_end").alias("b"))
    padded = runs.select("file", F.greatest(F.col("a") - padding, F.lit(0)).alias("s"), F.least(F.col("b") + padding, F.lit(duration)).alias("e"))
    order = Window.partitionBy("file").orderBy("s", "e")
    furthest = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = padded.withColumn("g", F.coalesce((F.col("s") > furthest).cast("int"), F.lit(1)))
    grouped = marked.withColumn("g", F.sum("g").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("file", "g").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms")).where("end_ms > start_ms").drop("g")


def trailing_extension(end: Column, following: Column, most: int = L.TRAILING_GAP_MS) -> Column:
    """An end moved into half of the gap that follows, by up to ``most`` ms."""
    return F.when(following <= end, end).otherwise(end + F.least(F.floor((following - end) / 2).cast("long"), F.lit(most)))


def group_for_alignment(df: DataFrame, max_ms: int, duration: int, max_chars: int = L.GROUP_CHARS) -> DataFrame:
    """file, group, start_ms, end_ms, lines: utterances packed in order until time or characters run out.

    Packing starts anew at each break, a running state, so that a file is one task's work. Needs n_chars.
    """
    from pyspark.sql import types as T

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, cur = [], None
        for line, s, e, chars in rows.sort_values("line")[["line", "start_ms", "end_ms", "n_chars"]].itertuples(index=False):
            over = cur is not None and (e <= cur[0] or e - cur[0] > max_ms or cur[3] + chars > max_chars)
            if over:
                gap = s - cur[1]
                out.append((cur[0], cur[1] + min(gap // 2, L.TRAILING_GAP_MS) if gap > 0 else cur[1], cur[2]))
                cur = None
            if cur is None:
                cur = [s, e, [], 0]
            cur[1] = e
            cur[2].append(int(line))
            cur[3] += chars
        if cur is not None:
            gap = duration - cur[1]
            out.append((cur[0], cur[1] + min(gap // 2, L.TRAILING_GAP_MS) if gap > 0 else cur[1], cur[2]))
        res = pd.DataFrame(out, columns=["start_ms", "end_ms", "lines"])
        res.insert(0, "grp", range(len(res)))
        res.insert(0, "file", rows["file"].iloc[0])
        return res

    schema = T._parse_datatype_string("file long, grp int, start_ms long, end_ms long, lines array<long>")
    return timed(df).select("file", "line", "start_ms", "end_ms", "n_chars").groupBy("file").applyInPandas(run, schema)


def rescue_narrow(df: DataFrame) -> DataFrame:
    """Timed rows with too little time for their words; ``new_end`` reaches toward the next start."""
    t = timed(df).withColumn("next_start", F.lead("start_ms").over(_file()))
    narrow = (F.col("n_words") > 0) & (F.col("end_ms") - F.col("start_ms") < F.col("n_words") * L.RESCUE_TRIGGER_MS)
    want = F.col("start_ms") + F.col("n_words") * L.RESCUE_TARGET_MS
    room = F.coalesce(F.col("next_start") - L.RESCUE_SAFETY_MS, want)
    new = F.least(want, room)
    return t.withColumn("new_end", F.when(narrow & (new > F.col("end_ms")), new).otherwise(F.col("end_ms")))


def expand_edge_fillers(df: DataFrame) -> DataFrame:
    """Spans whose first or last word is a filler grow by half the gap, 1.5 s at most (needs lead_filler, trail_filler)."""
    first = F.row_number().over(_file()) == 1
    before = F.when(first, F.lit(0)).otherwise(F.lag("end_ms").over(_file()))
    after = F.lead("start_ms").over(_file())
    grow = lambda gap: F.least(F.floor(gap / 2).cast("long"), F.lit(L.FILLER_EXPANSION_MS))
    s, e = F.col("start_ms"), F.col("end_ms")
    return df.withColumns(
        {
            "new_start": F.when(F.col("lead_filler") & (s > before), s - grow(s - before)).otherwise(s),
            "new_end": F.when(F.col("trail_filler") & (after > e), e + grow(after - e)).otherwise(e),
        }
    )


def heal_word_gaps(words: DataFrame, most: int = L.HEAL_GAP_MS, last_ms: int = L.LAST_WORD_MS) -> DataFrame:
    """Words of an utterance last until the next word starts if the gap is short; the last gets ``last_ms``; inverted spans go.

    ``words``: file, utt, pos, start_ms, end_ms (end may be null).
    """
    order = Window.partitionBy("file", "utt").orderBy("pos")
    following = F.first("start_ms", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    end = F.coalesce("end_ms", F.col("start_ms"))
    healed = F.when(following.isNull(), F.coalesce("end_ms", F.col("start_ms") + last_ms)).when((following - end <= most), following).otherwise(end)
    out = words.withColumn("_e", F.when(F.col("start_ms").isNotNull(), healed))
    good = F.col("_e") > F.col("start_ms")
    return out.withColumns({"start_ms": F.when(good, F.col("start_ms")), "end_ms": F.when(good, F.col("_e"))}).drop("_e")


def rebalance_short_words(words: DataFrame, least: int = 40) -> DataFrame:
    """Words shorter than ``least`` ms take time from the longer word that follows, or else precedes (in order, with the times as changed)."""

    rows = timed(words).groupBy("file", "utt").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("pos", "start_ms", "end_ms")]))).alias("w"))
    return rows.select(*[F.col(c).cast("long").alias(c) for c in ("file", "utt")], F.explode(_rebalanced("w", F.lit(least))).alias("w")).select("file", "utt", "w.*")


@row_udf("array<struct<pos:bigint,start_ms:bigint,end_ms:bigint>>")
def _rebalanced(words: list[dict], least: int) -> list[tuple[int, int, int]]:
    s, e = [w["start_ms"] for w in words], [w["end_ms"] for w in words]
    for i in range(len(words)):
        short = least - (e[i] - s[i])
        if short <= 0:
            continue
        if i + 1 < len(words) and e[i + 1] - s[i + 1] - short >= least and s[i + 1] == e[i]:
            e[i], s[i + 1] = e[i] + short, s[i + 1] + short
        elif i and e[i - 1] - s[i - 1] - short >= least and e[i - 1] == s[i]:
            s[i], e[i - 1] = s[i] - short, e[i - 1] - short
    return [(w["pos"], a, b) for w, a, b in zip(words, s, e, strict=True)]


def utterance_spans(words: DataFrame) -> DataFrame:
    return words.groupBy("file", "utt").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def floor_pass(df: DataFrame) -> DataFrame:
    """Spans pushed behind the last end that was committed in their file; spans left empty lose their time.

    A span that is not inverted is committed unless its end lies under the floor, so
    that the floor is the running maximum of such ends.
    """
    before = _file().rowsBetween(Window.unboundedPreceding, -1)
    floor = F.greatest(F.coalesce(F.max(F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms"))).over(before), F.lit(0)), F.lit(0))
    start = F.greatest("start_ms", floor)
    t = timed(df).select("file", "line", start.alias("_s"), F.col("end_ms").alias("_e"))
    good = F.col("_e") > F.col("_s")
    return t.select("file", "line", F.when(good, F.col("_s")).alias("start_ms"), F.when(good, F.col("_e")).alias("end_ms"))


def order_violations(df: DataFrame) -> DataFrame:
    """file, violations: neighbours of one speaker whose start goes back."""
    t = timed(df).withColumns({"ps": F.lag("speaker").over(_file()), "pt": F.lag("start_ms").over(_file())})
    return t.groupBy("file").agg(F.count_if((F.col("ps") == F.col("speaker")) & (F.col("start_ms") < F.col("pt"))).alias("violations"))


def contained(at: Column, duration: Column) -> Column:
    """struct<clamped, overshoot> of an instant in a recording."""
    return F.struct(F.least(F.greatest(at, F.lit(0)), duration).alias("clamped"), F.greatest(at - duration, F.lit(0)).alias("overshoot"))


def timed_counts(rows: DataFrame) -> DataFrame:
    """file, timed, untimed utterances."""
    return rows.groupBy("file").agg(F.count_if(F.col("start_ms").isNotNull()).alias("timed"), F.count_if(F.col("start_ms").isNull()).alias("untimed"))


ORIGINS = ("observed", "derived", "assumed", "clamped")


def origin_tally(rows: DataFrame, origin: str = "origin") -> DataFrame:
    """file, a count for each origin of a time, their total, and whether someone should look (assumed or clamped)."""
    n = rows.groupBy("file").agg(*[F.count_if(F.col(origin) == k).alias(k) for k in ORIGINS])
    return n.withColumns({"total": sum((F.col(k) for k in ORIGINS[1:]), F.col(ORIGINS[0])), "needs_review": (F.col("assumed") + F.col("clamped")) > 0})


def recovery_strategy(rows: DataFrame, has_overlap: str = "has_overlap") -> DataFrame:
    """file, strategy: two passes where an utterance is marked as overlapping, one over the whole file elsewhere."""
    return rows.groupBy("file").agg(F.when(F.bool_or(F.coalesce(has_overlap, F.lit(False))), "two_pass").otherwise("global").alias("strategy"))
