"""Timing rules over spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.operators import jobs, metrics, timing
from turnwise.queries.base import DURATION, SPANS, query, spans
from turnwise.session import table

_PLAIN = ("file", "line", "speaker", "start_ms", "end_ms", "n_words", "n_chars")


def plain(spark, d):
    return spans(spark, d).select(*_PLAIN)


@query("b27_timed_counts", f"WITH {SPANS} SELECT file, count(start_ms) AS timed, count(*) - count(start_ms) AS untimed FROM sp GROUP BY 1")
def b27(spark, d):
    return timing.timed_counts(plain(spark, d))


@query("b28_speech_rate", f"WITH {SPANS} SELECT CASE WHEN n_words = 0 THEN 'no_words' WHEN end_ms - start_ms <= 0 THEN 'no_audio' WHEN n_words / ((end_ms - start_ms) / 1000.0) > 15 THEN 'impossible' ELSE 'plausible' END AS rate, count(*) AS n FROM t GROUP BY 1")
def b28(spark, d):
    return timing.timed(plain(spark, d)).groupBy(timing.speech_rate(F.col("n_words"), F.col("end_ms") - F.col("start_ms")).alias("rate")).agg(F.count("*").alias("n"))


@query("b29_containment", f"WITH {SPANS} SELECT file, line, least(greatest(start_ms, 0), 100000) AS clamped, greatest(start_ms - 100000, 0) AS overshoot FROM t")
def b29(spark, d):
    t = timing.timed(plain(spark, d)).withColumn("c", timing.contained(F.col("start_ms"), F.lit(100_000).cast("long")))
    return t.select("file", "line", "c.clamped", F.col("c.overshoot").cast("long").alias("overshoot"))


_E01 = f"{SPANS}, m AS (SELECT *, coalesce(start_ms < max(start_ms) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stripped FROM sp)"


@query("e01_non_monotonic", f"WITH {_E01} SELECT file, line, stripped FROM m")
def e01(spark, d):
    return timing.non_monotonic(plain(spark, d)).select("file", "line", "stripped")


_E02 = f"""{_E01}, k AS (SELECT *, CASE WHEN NOT stripped THEN start_ms END AS s FROM m),
n AS (SELECT *, first_value(s IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM k),
r AS (SELECT *, s IS NOT NULL AND coalesce(end_ms > nx, false) AS late FROM n),
mono AS (SELECT file, line, speaker, n_words, n_chars, CASE WHEN stripped THEN 'timing_stripped' WHEN late AND nx <= s THEN 'zero_duration' WHEN late THEN 'end_clamped' END AS decision,
 CASE WHEN NOT stripped AND NOT (late AND nx <= s) THEN start_ms END AS start_ms, CASE WHEN stripped OR (late AND nx <= s) THEN NULL WHEN late THEN nx ELSE end_ms END AS end_ms FROM r)"""


@query("e02_monotonic_ends", f"WITH {_E02} SELECT file, line, decision, start_ms, end_ms FROM mono")
def e02(spark, d):
    return timing.enforce_monotonicity(plain(spark, d)).select("file", "line", "decision", "start_ms", "end_ms")


@query("e03_same_speaker_overlaps", f"WITH {SPANS} SELECT file, line, coalesce(end_ms > lead(start_ms) OVER (PARTITION BY file, speaker ORDER BY line) + 500, false) AS stripped FROM t")
def e03(spark, d):
    return timing.same_speaker_overlaps(plain(spark, d)).select("file", "line", "stripped")


_FILLS = "fills AS (SELECT * FROM (SELECT file, line, start_ms, lag(end_ms) OVER (PARTITION BY file, speaker ORDER BY line) AS new_start FROM t) WHERE start_ms > new_start AND start_ms - new_start <= 1000)"
_AVG = "av AS (SELECT *, start_ms + (prev_end - start_ms) // 2 AS midpoint FROM (SELECT file, line, start_ms, lag(line) OVER (PARTITION BY file ORDER BY line) AS prev_line, lag(end_ms) OVER (PARTITION BY file ORDER BY line) AS prev_end FROM t) WHERE prev_end - start_ms BETWEEN 1 AND 500)"


@query("e04_gap_fills", f"WITH {SPANS}, {_FILLS} SELECT file, line, new_start FROM fills")
def e04(spark, d):
    return timing.gap_fills(plain(spark, d)).select("file", "line", "new_start")


@query("e05_boundary_averages", f"WITH {SPANS}, {_AVG} SELECT file, prev_line, line, midpoint FROM av")
def e05(spark, d):
    return timing.boundary_averages(plain(spark, d)).select("file", "prev_line", "line", "midpoint")


@query("e06_out_of_order")
def e06(spark, d):
    """Rows outside each speaker's longest non-decreasing run; held against a quadratic version in tests."""
    return timing.out_of_order(plain(spark, d))


@query("d17_repair_statistics", f"WITH {SPANS}, {_FILLS}, {_AVG} SELECT (SELECT count(*) FROM fills) AS gaps_filled, (SELECT count(*) FROM av) AS boundary_averaged, (SELECT count(*) FROM t) AS total")
def d17(spark, d):
    p = plain(spark, d)
    rows = metrics.union_all([timing.gap_fills(p).select(F.lit("f").alias("k")), timing.boundary_averages(p).select(F.lit("a").alias("k")), timing.timed(p).select(F.lit("t").alias("k"))])
    return rows.agg(F.count_if(F.col("k") == "f").alias("gaps_filled"), F.count_if(F.col("k") == "a").alias("boundary_averaged"), F.count_if(F.col("k") == "t").alias("total"))


@query("e03_e06_repair")
def repair(spark, d):
    return timing.repair(plain(spark, d)).select("file", "line", "start_ms", "end_ms", F.array_join("repair", "+").alias("repair"))


_RUNS = f"""{SPANS}, r AS (SELECT *, coalesce(last_value(end_ms IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gs,
 coalesce(first_value(start_ms IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), {DURATION}) AS ge,
 sum((start_ms IS NOT NULL)::INT) OVER (PARTITION BY file ORDER BY line) AS run FROM sp)"""


@query("e07_estimates", f"""WITH {_RUNS}, u AS (SELECT *, CASE WHEN start_ms IS NULL THEN n_words ELSE 0 END AS n, greatest(ge - gs, 0) AS gap FROM r),
a AS (SELECT *, sum(n) OVER (PARTITION BY file, run) AS alln, sum(n) OVER (PARTITION BY file, run ORDER BY line) - n AS bef FROM u),
b AS (SELECT *, least(greatest(gs + floor(bef / nullif(alln, 0) * gap)::BIGINT - 2000, 0), {DURATION}) AS s, least(gs + floor((bef + n_words) / nullif(alln, 0) * gap)::BIGINT + 2000, {DURATION}) AS e FROM a),
p AS (SELECT *, CASE WHEN start_ms IS NOT NULL THEN 'timed' WHEN alln = 0 THEN 'empty' WHEN alln / ((gap + 4000) / 1000.0) > 15 OR e <= s THEN 'unplaceable' ELSE 'estimated' END AS placement FROM b)
SELECT file, line, placement, CASE placement WHEN 'timed' THEN start_ms WHEN 'empty' THEN gs WHEN 'estimated' THEN s END AS est_start, CASE placement WHEN 'timed' THEN end_ms WHEN 'empty' THEN gs WHEN 'estimated' THEN e END AS est_end FROM p""")  # fmt: skip
def e07(spark, d):
    return timing.estimate_untimed(plain(spark, d), DURATION).select("file", "line", "placement", "est_start", "est_end")


@query("e08_untimed_windows", f"""WITH {_RUNS}, w AS (SELECT file, greatest(min(gs) - 300, 0) AS s, least(max(ge) + 300, {DURATION}) AS e FROM r WHERE start_ms IS NULL GROUP BY file, run),
f AS (SELECT *, coalesce((s > max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS g FROM w),
g AS (SELECT *, sum(g) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM f)
SELECT file, min(s) AS start_ms, max(e) AS end_ms FROM g GROUP BY file, i HAVING max(e) > min(s)""")  # fmt: skip
def e08(spark, d):
    return timing.untimed_windows(plain(spark, d), DURATION, 300)


@query("e09_alignment_groups", f"""WITH RECURSIVE {SPANS}, n AS (SELECT file, line, start_ms AS s, end_ms AS e, n_chars AS c, row_number() OVER (PARTITION BY file ORDER BY line) AS k FROM t),
r AS (SELECT file, k, line, 0 AS grp, s AS a, e AS z, c AS chars FROM n WHERE k = 1
 UNION ALL SELECT n.file, n.k, n.line, CASE WHEN x THEN grp + 1 ELSE grp END, CASE WHEN x THEN n.s ELSE a END, n.e, CASE WHEN x THEN n.c ELSE chars + n.c END
  FROM (SELECT r.*, n.e <= r.a OR n.e - r.a > {L.GROUP_MS_NARROW} OR r.chars + n.c > {L.GROUP_CHARS} AS x FROM r JOIN n ON n.file = r.file AND n.k = r.k + 1) r JOIN n ON n.file = r.file AND n.k = r.k + 1),
g AS (SELECT file, grp, min(a) AS a, max_by(z, k) AS z, max(k) AS k, string_agg(line::VARCHAR, ',' ORDER BY k) AS lines FROM r GROUP BY 1, 2),
o AS (SELECT g.*, coalesce(n.s, {DURATION}) - g.z AS gap FROM g LEFT JOIN n ON n.file = g.file AND n.k = g.k + 1)
SELECT file, grp::INT AS grp, a AS start_ms, z + CASE WHEN gap > 0 THEN least(gap // 2, {L.TRAILING_GAP_MS}) ELSE 0 END AS end_ms, lines FROM o""")  # fmt: skip
def e09(spark, d):
    groups = timing.group_for_alignment(plain(spark, d), L.GROUP_MS_NARROW, DURATION)
    return groups.withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query("e10_trailing_extension", f"WITH {SPANS}, n AS (SELECT file, line, end_ms, lead(start_ms) OVER (PARTITION BY file ORDER BY line) AS nx FROM t) SELECT file, line, CASE WHEN nx <= end_ms THEN end_ms ELSE end_ms + least((nx - end_ms) // 2, 1500) END AS extended FROM n WHERE nx IS NOT NULL")
def e10(spark, d):
    from pyspark.sql import Window

    t = timing.timed(plain(spark, d)).withColumn("nx", F.lead("start_ms").over(Window.partitionBy("file").orderBy("line"))).where("nx IS NOT NULL")
    return t.select("file", "line", timing.trailing_extension(F.col("end_ms"), F.col("nx")).cast("long").alias("extended"))


@query("e11_rescue_narrow", f"""WITH {SPANS}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY file ORDER BY line) AS nx FROM t), w AS (SELECT *, start_ms + n_words * 350 AS want FROM n),
x AS (SELECT *, least(want, coalesce(nx - 200, want)) AS new FROM w) SELECT file, line, CASE WHEN n_words > 0 AND end_ms - start_ms < n_words * 250 AND new > end_ms THEN new ELSE end_ms END AS new_end FROM x""")  # fmt: skip
def e11(spark, d):
    return timing.rescue_narrow(plain(spark, d)).select("file", "line", "new_end")


@query("e12_edge_fillers", f"""WITH {SPANS}, n AS (SELECT *, CASE WHEN row_number() OVER o = 1 THEN 0 ELSE lag(end_ms) OVER o END AS pe, lead(start_ms) OVER o AS ns FROM sp WINDOW o AS (PARTITION BY file ORDER BY line))
SELECT file, line, CASE WHEN lead_filler AND start_ms > pe THEN start_ms - least((start_ms - pe) // 2, 1500) ELSE start_ms END AS new_start, CASE WHEN trail_filler AND ns > end_ms THEN end_ms + least((ns - end_ms) // 2, 1500) ELSE end_ms END AS new_end FROM n""")  # fmt: skip
def e12(spark, d):
    return timing.expand_edge_fillers(spans(spark, d)).select("file", "line", "new_start", "new_end")


def word_times(spark, d):
    """Words with times: utterance = ten lines of a file."""
    return spans(spark, d).select("file", F.expr("line div 10").alias("utt"), F.col("line").alias("pos"), "start_ms", F.when(F.col("line") % 3 != 0, F.col("end_ms")).alias("end_ms"))


@query("e13_heal_gaps", f"""WITH {SPANS}, w AS (SELECT file, line // 10 AS utt, line AS pos, start_ms, CASE WHEN line % 3 <> 0 THEN end_ms END AS end_ms FROM sp),
n AS (SELECT *, first_value(start_ms IGNORE NULLS) OVER (PARTITION BY file, utt ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM w),
h AS (SELECT *, CASE WHEN start_ms IS NULL THEN NULL WHEN nx IS NULL THEN coalesce(end_ms, start_ms + 500) WHEN nx - coalesce(end_ms, start_ms) <= 1000 THEN nx ELSE coalesce(end_ms, start_ms) END AS e FROM n)
SELECT file, utt, pos, CASE WHEN e > start_ms THEN start_ms END AS start_ms, CASE WHEN e > start_ms THEN e END AS end_ms FROM h""")  # fmt: skip
def e13(spark, d):
    return timing.heal_word_gaps(word_times(spark, d))


@query("e14_rebalance_short")
def e14(spark, d):
    return timing.rebalance_short_words(timing.heal_word_gaps(word_times(spark, d)))


@query("e15_utterance_spans", f"WITH {SPANS} SELECT file, line // 10 AS utt, min(start_ms) AS start_ms, max(CASE WHEN line % 3 <> 0 THEN end_ms END) AS end_ms FROM sp GROUP BY 1, 2")
def e15(spark, d):
    return timing.utterance_spans(word_times(spark, d))


@query("e16_floor_pass", f"""WITH RECURSIVE {SPANS}, n AS (SELECT file, line, start_ms, end_ms, row_number() OVER (PARTITION BY file ORDER BY line) AS k FROM t),
r AS (SELECT file, line, k, greatest(start_ms, 0) AS s, end_ms AS e, CASE WHEN end_ms > greatest(start_ms, 0) THEN end_ms ELSE 0 END AS f FROM n WHERE k = 1
 UNION ALL SELECT n.file, n.line, n.k, greatest(n.start_ms, r.f), n.end_ms, CASE WHEN n.end_ms > greatest(n.start_ms, r.f) THEN n.end_ms ELSE r.f END FROM r JOIN n ON n.file = r.file AND n.k = r.k + 1)
SELECT file, line, CASE WHEN e > s THEN s END AS start_ms, CASE WHEN e > s THEN e END AS end_ms FROM r""")  # fmt: skip
def e16(spark, d):
    return timing.floor_pass(plain(spark, d))


@query("e28_order_violations", f"WITH {SPANS}, n AS (SELECT *, lag(speaker) OVER o AS ps, lag(start_ms) OVER o AS pt FROM t WINDOW o AS (PARTITION BY file ORDER BY line)) SELECT file, count(*) FILTER (ps = speaker AND start_ms < pt) AS violations FROM n GROUP BY 1")
def e28(spark, d):
    return timing.order_violations(plain(spark, d))


@query("e30_backoff", "SELECT DISTINCT event_id % 9 + 1 AS n, least(60.0, power(2.0, event_id % 9))::DOUBLE AS seconds FROM events")
def e30(spark, d):
    n = table(spark, d, "events").select((F.col("event_id") % 9 + 1).alias("n")).distinct()
    return n.select("n", jobs.backoff(F.col("n")).alias("seconds"))


@query("c24_previous_span", f"WITH {SPANS} SELECT file, line, last_value(start_ms IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM sp")
def c24(spark, d):
    from turnwise.operators.joins import previous_bullet

    return plain(spark, d).select("file", "line", previous_bullet(None, "start_ms").alias("previous"))


@query("c25_strategy_by_file", "SELECT user_id AS file, CASE WHEN bool_or(event_type = 'error') THEN 'two_pass' ELSE 'global' END AS strategy FROM events GROUP BY 1")
def c25(spark, d):
    return timing.recovery_strategy(table(spark, d, "events").select(F.col("user_id").alias("file"), (F.col("event_type") == "error").alias("has_overlap")))


@query("d12_distribution", f"WITH {SPANS} SELECT speaker, count(*) AS n, min(end_ms - start_ms) AS min, quantile_disc(end_ms - start_ms, 0.5) AS p50, quantile_disc(end_ms - start_ms, 0.95) AS p95, max(end_ms - start_ms) AS max FROM t GROUP BY 1")
def d12(spark, d):
    return metrics.nearest_rank(timing.timed(plain(spark, d)).withColumn("ms", F.col("end_ms") - F.col("start_ms")), ["speaker"], "ms")


@query("d18_origin_tally", f"WITH {SPANS} SELECT file, count(*) FILTER (start_ms IS NOT NULL AND line % 2 = 0) AS observed, count(*) FILTER (start_ms IS NOT NULL AND line % 2 = 1) AS derived, count(*) FILTER (start_ms IS NULL) AS assumed FROM sp GROUP BY 1")
def d18(spark, d):
    o = F.when(F.col("start_ms").isNull(), "assumed").when(F.col("line") % 2 == 0, "observed").otherwise("derived")
    return timing.origin_tally(plain(spark, d).withColumn("origin", o)).select("file", "observed", "derived", "assumed")


@query("d22_boundary_quality", """WITH b AS (SELECT user_id, (event_id % 3 = 0)::INT AS p, CASE WHEN event_id % 10 = 9 THEN -100 ELSE (event_id % 2 = 0)::INT END AS y FROM events),
c AS (SELECT user_id, count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 1 AND y = 0) AS fp, count(*) FILTER (p = 0 AND y = 1) AS fn, count(*) FILTER (p = 0 AND y = 0) AS tn FROM b WHERE y <> -100 GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END AS a, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM c)
SELECT user_id, tp, fp, fn, tn, round(a, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM r""")  # fmt: skip
def d22(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 3 == 0).cast("int").alias("p"), F.when(F.col("event_id") % 10 == 9, -100).otherwise((F.col("event_id") % 2 == 0).cast("int")).alias("y"))
    return metrics.boundary_quality(e, "p", "y", "user_id").select("user_id", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("d23_pitch_verdict", """WITH v AS (SELECT user_id, count(*) AS frames, median(value * 10) AS median_hz, avg((value * 10 > 250)::INT) AS share FROM events WHERE value > 0 GROUP BY 1)
SELECT user_id, frames, round(median_hz, 4) AS median_hz, CASE WHEN frames < 8 THEN 'unknown' WHEN share >= 0.5 THEN 'child' WHEN share <= 0.2 THEN 'adult' ELSE 'mixed' END AS verdict FROM v""")  # fmt: skip
def d23(spark, d):
    v = metrics.pitch_verdict(table(spark, d, "events").select("user_id", (F.col("value") * 10).alias("hz")), ["user_id"], "hz")
    return v.select("user_id", "frames", F.round("median_hz", 4).alias("median_hz"), "verdict")


@query("d24_voice_quality", "SELECT event_id, round((4.152 - 0.177 * value - 0.006 * value - 0.037 * value + 0.941 * value + 0.01 * value + 0.093 * value) * 2.8902, 4) AS avqi FROM events")
def d24(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(metrics.voice_quality(v, v, v, v, v, v), 4).alias("avqi"))


@query("d32_standardise", "WITH s AS (SELECT user_id, event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id)) SELECT event_id, round(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END, 5) AS z FROM s")
def d32(spark, d):
    return metrics.standardise(table(spark, d, "events"), ["user_id"], "value", "z").select("event_id", F.round("z", 5).alias("z"))


@query("d32_median_filter", "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS m FROM events")
def d32b(spark, d):
    return metrics.median_filter(table(spark, d, "events"), ["user_id"], "event_id", "value", "m", 5).select("event_id", F.round("m", 5).alias("m"))
