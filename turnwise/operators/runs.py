"""Comparison of two runs by a plan, in four modes; a pair that cannot be compared never stops the others.

Tables:

* plan: pair (any id), left, right (paths of the artifacts), held_out (its reason, null: the pair counts in totals);
* artifacts of a run: path, sha256 (as its manifest declares), content;
* tokens of a run: path, speaker, utt, pos, text, and start_ms, end_ms (alignment) or upos, lemma, feats, chunks, head, deprel, xpos (morphology);
* speaker map: pair, l, r (optional).

Every mode gives one row for each pair of the plan: pair, outcome (``compared`` or ``unpairable``), reason (null if
compared), held_out, and its figures, which are null for unpairable pairs.

Speakers of the left run are matched to those of the right one by a map, in pairs that have entries there,
else by the words they share: pairs for which that is ``speakers_ambiguous`` or ``speakers_unavailable`` are
unpairable, and so are pairs whose map names a speaker who is not there, or one twice (``invalid_speaker_map``).

A plan names paths, and each path of a plan is joined by hash; the texts of artifacts are read once for
their digest and never shuffled. Work on tokens is a join on (pair, position). Defined results: a pair that
the plan repeats counts once; artifacts that a run lists twice are ``repeated`` and unpairable; a null path is missing;
null texts are empty tokens; an empty plan gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators import joins

AXES = ["text", "upos", "lemma", "feats", "chunks", "head", "deprel"]


def _planned(plan: DataFrame) -> DataFrame:
    return plan.select("pair", "left", "right", "held_out").groupBy("pair").agg(F.min(F.struct("left", "right", "held_out")).alias("p")).select("pair", "p.*")


def _outcome(reason: Column) -> list[Column]:
    return [F.when(reason.isNull(), "compared").otherwise("unpairable").alias("outcome"), reason.alias("reason")]


def by_manifest(plan: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pair, outcome, reason, held_out, same: whether both artifacts are what their manifests say, and equal.

    Reasons: missing, repeated or digest, and the side: ``missing_left``; the first of them, left before right.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        seen = df.select(F.col("path").alias(name), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("real"), F.lower("sha256").alias("said"))
        return seen.groupBy(name).agg(F.count("*").alias(f"{name}_n"), F.min(F.coalesce(F.col("real") == F.col("said"), F.lit(False))).alias(f"{name}_ok"), F.min("real").alias(f"{name}_hash"))

    both = _planned(plan).join(side(left, "left"), "left", "left").join(side(right, "right"), "right", "left")
    tests = [(f"{what}_{s}", test(s)) for what, test in [("missing", lambda s: F.col(f"{s}_n").isNull()), ("repeated", lambda s: F.col(f"{s}_n") > 1), ("digest", lambda s: ~F.col(f"{s}_ok"))] for s in ("left", "right")]
    reason = F.coalesce(*[F.when(test, name) for name, test in tests])
    return both.select("pair", *_outcome(reason), "held_out", F.when(reason.isNull(), F.col("left_hash") == F.col("right_hash")).alias("same"))


def _sides(plan: DataFrame, left: DataFrame, right: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan with the reason why a pair has no tokens on a side, and the tokens of both sides by pair."""
    p = _planned(plan)
    take = lambda df, s: p.select("pair", F.col(s).alias("path")).join(df.select("path", "speaker", "utt", "pos", F.coalesce("text", F.lit("")).alias("text"), *columns), "path").drop("path")
    a, b = take(left, "left"), take(right, "right")
    have = p.join(a.groupBy("pair").agg(F.count("*").alias("left_tokens")), "pair", "left").join(b.groupBy("pair").agg(F.count("*").alias("right_tokens")), "pair", "left")
    return have.withColumn("_why", F.when(F.col("left_tokens").isNull(), "missing_left").when(F.col("right_tokens").isNull(), "missing_right")), a, b


def _words(tokens: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    word = F.lower("text")
    return tokens.select(F.col("pair").alias("file"), "speaker", word.alias("token")).where(~F.col("token").isin([x.lower() for x in exclusions or []]) & (F.col("token") != ""))


def _speaker_maps(wa: DataFrame, wb: DataFrame, mapping: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(file, l, r) for all pairs whose speakers are known, and (pair, _bad) for the others."""
    free_a, free_b = wa, wb
    if mapping is not None:
        given = mapping.select(F.col("pair").alias("file"), "l", "r").distinct()
        _, wrong = joins.apply_speaker_map(wa, wb, given)
        named = given.select("file").distinct()
        free_a, free_b = wa.join(named, "file", "left_anti"), wb.join(named, "file", "left_anti")
    found = joins.speaker_correspondence(free_a, free_b)
    maps = found.where("l IS NOT NULL").select("file", "l", "r")
    solved = found.groupBy("file").agg(F.min("outcome").alias("_o"))
    why = solved.where("_o <> 'established'").select(F.col("file").alias("pair"), F.concat(F.lit("speakers_"), "_o").alias("_bad"))
    if mapping is not None:
        maps, why = maps.union(given), why.union(wrong.select(F.col("file").alias("pair")).distinct().withColumn("_bad", F.lit("invalid_speaker_map")))
    return maps, why


def _renamed(a: DataFrame, b: DataFrame, mapping: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Tokens of the left side under the speakers of the right side, and why that cannot be done."""
    maps, why = _speaker_maps(_words(a), _words(b), mapping)
    one = maps.groupBy(F.col("file").alias("pair"), F.col("l").alias("speaker")).agg(F.min("r").alias("_r"))
    return a.join(one, ["pair", "speaker"], "left").withColumn("speaker", F.coalesce("_r", "speaker")).drop("_r"), why


def by_transcription(plan: DataFrame, left: DataFrame, right: DataFrame, exclusions: list[str] | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """pair, outcome, reason, held_out, left_tokens, right_tokens, overlap, agreement (2 overlap / tokens of mapped speakers).

    Words are compared in lower case and without those of ``exclusions``.
    """
    have, a, b = _sides(plan, left, right, [])
    wa, wb = _words(a, exclusions), _words(b, exclusions)
    maps, why = _speaker_maps(wa, wb, mapping)
    said, _ = joins.apply_speaker_map(wa, wb, maps)
    bags = said.groupBy("file", "pair", "token").agg(F.count_if(F.col("side") == "left").alias("x"), F.count_if(F.col("side") == "right").alias("y"))
    sums = bags.groupBy(F.col("file").alias("pair")).agg(F.sum(F.least("x", "y")).alias("overlap"), F.sum(F.col("x") + F.col("y")).alias("_all"))
    out = have.join(why, "pair", "left").join(sums, "pair", "left")
    reason = F.coalesce("_why", "_bad")
    fine = lambda c: F.when(reason.isNull(), c)
    overlap, total = F.coalesce("overlap", F.lit(0)), F.coalesce("_all", F.lit(0))
    return out.select("pair", *_outcome(reason), "held_out", fine(F.col("left_tokens")).alias("left_tokens"), fine(F.col("right_tokens")).alias("right_tokens"), fine(overlap).alias("overlap"), fine(F.when(total > 0, 2 * overlap / total).otherwise(F.lit(0.0))).alias("agreement"))


def _order_violations(tokens: DataFrame, name: str) -> DataFrame:
    w = Window.partitionBy("pair").orderBy("utt", "pos")
    both = F.lag(F.struct("speaker", "start_ms", "end_ms")).over(w)
    timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & both["start_ms"].isNotNull() & both["end_ms"].isNotNull()
    back = timed & (both["speaker"] == F.col("speaker")) & ((F.col("start_ms") < both["start_ms"]) | (F.col("end_ms") < both["end_ms"]))
    return tokens.select("pair", F.coalesce(back, F.lit(False)).alias("back")).groupBy("pair").agg(F.count_if("back").alias(name))


def _nearest_rank(deltas: DataFrame, value: str) -> DataFrame:
    """count, min, median, p95 and max by nearest rank of ``value`` for each pair."""
    known = deltas.where(F.col(value).isNotNull())
    rank, n = F.row_number().over(Window.partitionBy("pair").orderBy(value)), F.count("*").over(Window.partitionBy("pair"))
    ranked = known.select("pair", F.col(value).alias("v"), rank.alias("k"), n.alias("n"))
    at = lambda p: F.max(F.when(F.col("k") == F.ceil(F.col("n") * p / F.lit(100)), F.col("v")))
    return ranked.groupBy("pair").agg(F.count("*").alias(f"{value}_n"), F.min("v").alias(f"{value}_min"), at(50).alias(f"{value}_median"), at(95).alias(f"{value}_p95"), F.max("v").alias(f"{value}_max"))


def by_alignment(plan: DataFrame, left: DataFrame, right: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """pair, outcome, reason, held_out, tokens, start/end delta distributions (nearest rank), order violations of both sides.

    Tokens are paired in order of (utt, pos); all of a pair must agree in speaker and text, in any case (``token_identity``).
    """
    have, a, b = _sides(plan, left, right, ["start_ms", "end_ms"])
    a, why = _renamed(a, b, mapping)
    number = lambda df, s: df.select("pair", F.row_number().over(Window.partitionBy("pair").orderBy("utt", "pos", "text", "start_ms", "end_ms")).alias("k"), F.struct("speaker", F.lower("text").alias("text")).alias(f"{s}_id"), F.col("start_ms").alias(f"{s}_start"), F.col("end_ms").alias(f"{s}_end"))
    met = number(a, "l").join(number(b, "r"), ["pair", "k"], "full_outer")
    whole = F.col("l_start").isNotNull() & F.col("l_end").isNotNull() & F.col("r_start").isNotNull() & F.col("r_end").isNotNull()
    deltas = met.select("pair", (F.col("l_id").eqNullSafe(F.col("r_id"))).alias("same"), F.when(whole, F.abs(F.col("l_start") - F.col("r_start"))).alias("start_delta"), F.when(whole, F.abs(F.col("l_end") - F.col("r_end"))).alias("end_delta"))
    gate = deltas.groupBy("pair").agg(F.min("same").alias("_same"))
    out = have.join(gate, "pair", "left").join(why, "pair", "left")
    for part in (_nearest_rank(deltas, "start_delta"), _nearest_rank(deltas, "end_delta"), _order_violations(a, "left_violations"), _order_violations(b, "right_violations")):
        out = out.join(part, "pair", "left")
    reason = F.coalesce("_why", "_bad", F.when(~F.col("_same"), "token_identity"))
    counts = ["start_delta_n", "end_delta_n", "left_violations", "right_violations"]
    values = [f"{v}_{k}" for v in ("start_delta", "end_delta") for k in ("min", "median", "p95", "max")]
    fine = lambda c: F.when(reason.isNull(), c)
    return out.select("pair", *_outcome(reason), "held_out", fine(F.col("left_tokens")).alias("tokens"), *[fine(F.coalesce(c, F.lit(0))).alias(c) for c in counts], *[fine(F.col(c)).alias(c) for c in values])


def by_morphology(plan: DataFrame, left: DataFrame, right: DataFrame, axes: list[str] | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """pair, outcome, reason, held_out, tokens (of both sides together by position), differing, one for each axis, missing_left, missing_right.

    Tokens are paired by (speaker, utt, pos); features are sets, so that their order does not count.
    """
    axes = AXES if axes is None else axes
    have, a, b = _sides(plan, left, right, [x for x in axes if x != "text"])
    a, why = _renamed(a, b, mapping)
    plain = lambda df: df.withColumn("feats", F.array_join(F.array_sort(F.array_distinct(F.split(F.coalesce("feats", F.lit("")), r"\|"))), "|")) if "feats" in axes else df
    rows = joins.compare_positions(plain(a), plain(b), ["pair", "speaker", "utt", "pos"], axes)
    has = lambda x: F.count_if(F.array_contains("differences", x)).alias(x if x.startswith("missing") else f"{x}_differs")
    sums = rows.groupBy("pair").agg(F.count("*").alias("tokens"), F.count_if(F.size("differences") > 0).alias("differing"), *[has(x) for x in [*axes, "missing_left", "missing_right"]])
    out = have.join(sums, "pair", "left").join(why, "pair", "left")
    names, reason = [c for c in sums.columns if c != "pair"], F.coalesce("_why", "_bad")
    return out.select("pair", *_outcome(reason), "held_out", *[F.when(reason.isNull(), F.col(c)).alias(c) for c in names])


def totals(found: DataFrame, sums: list[str]) -> DataFrame:
    """One row: pairs, compared, unpairable, held_out, and the sums of ``sums`` over compared pairs that are not held out."""
    counts = (F.col("outcome") == "compared") & F.col("held_out").isNull()
    return found.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("outcome") == "compared").alias("compared"), F.count_if(F.col("outcome") != "compared").alias("unpairable"), F.count("held_out").alias("held_out"),
        *[F.coalesce(F.sum(F.when(counts, F.col(c))), F.lit(0)).alias(c) for c in sums],
    )
