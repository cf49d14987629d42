"""Joins and correspondences between transcripts, words, tokens and segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L


def gold_path(path: Column) -> Column:
    """x.cha -> x.gold.cha"""
    return F.regexp_replace(path, r"\.cha$", ".gold.cha")


def is_gold(path: Column) -> Column:
    return path.endswith(".gold.cha")


def companion_pairs(files: DataFrame, path: str = "path") -> DataFrame:
    """main, gold (the derived path), has_gold; gold files are not mains."""
    mains = files.where(~is_gold(F.col(path))).select(F.col(path).alias("main"), gold_path(F.col(path)).alias("gold"))
    there = files.select(F.col(path).alias("gold")).distinct().withColumn("has_gold", F.lit(True))
    return mains.join(there, "gold", "left").select("main", "gold", F.coalesce("has_gold", F.lit(False)).alias("has_gold"))


def media_pairs(transcripts: DataFrame, media: DataFrame, extensions: list[str]) -> DataFrame:
    """stem and the medium with the first extension of the list (null: none)."""
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    found = media.withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", "")).withColumn("r", rank).where("r > 0")
    best = found.groupBy("stem").agg(F.min_by("path", F.struct("r", "path")).alias("media"))
    return transcripts.select("stem").join(best, "stem", "left")


def token_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, l, r, overlap: multiset overlap of the tokens of each pair of speakers of a file.

    Tables: (file, speaker, token). Joined on the token, after counting.
    """
    count = lambda df, s, n: df.groupBy("file", F.col("speaker").alias(s), "token").agg(F.count("*").alias(n))
    both = count(left, "l", "n").join(count(right, "r", "m"), ["file", "token"])
    return both.groupBy("file", "l", "r").agg(F.sum(F.least("n", "m")).alias("overlap"))


def largest_total(score: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """(total, pairs above 0) of a best one-to-one choice from a table with no more rows than columns.

    Rows are placed one after the other along cheapest augmenting paths (with prices on rows and columns).
    """
    n, m = len(score), len(score[0]) if score else 0
    row_price, col_price, taken = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for new in range(1, n + 1):
        taken[0], at = new, 0
        slack, came, seen = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while taken[at]:
            seen[at], row, step, to = True, taken[at], float("inf"), 0
            for j in range(1, m + 1):
                if not seen[j]:
                    gap = -score[row - 1][j - 1] - row_price[row] - col_price[j]
                    if gap < slack[j]:
                        slack[j], came[j] = gap, at
                    if slack[j] < step:
                        step, to = slack[j], j
            for j in range(m + 1):
                if seen[j]:
                    row_price[taken[j]] += step
                    col_price[j] -= step
                else:
                    slack[j] -= step
            at = to
        while at:
            taken[at], at = taken[came[at]], came[at]
    pairs = [(taken[j] - 1, j - 1) for j in range(1, m + 1) if taken[j] and score[taken[j] - 1][j - 1] > 0]
    return sum(score[i][j] for i, j in pairs), pairs


def assign_speakers(pairs: list[tuple[str, str, int]], left: list[str], right: list[str]) -> tuple[str, dict[str, str]]:
    """(established | ambiguous | unavailable, map) with the largest total overlap, one to one.

    Ambiguous: another map has the same total, which shows when a pair of the first one is forbidden.
    """
    given = {(a, b): n for a, b, n in pairs if n > 0}
    turned = len(left) > len(right)
    rows, cols = (right, left) if turned else (left, right)

    def solve(without=None):
        table = [[0 if (k := (c, r) if turned else (r, c)) == without else given.get(k, 0) for c in cols] for r in rows]
        total, found = largest_total(table)
        return total, {(cols[j], rows[i]) if turned else (rows[i], cols[j]) for i, j in found}

    if not given or not rows:
        return "unavailable", {}
    best, chosen = solve()
    if not best:
        return "unavailable", {}
    if any(solve(without=p)[0] == best for p in chosen):
        return "ambiguous", {}
    return "established", dict(chosen)


def speaker_correspondence(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, outcome, l, r (null unless established). A file has a handful of speakers, so that a group is small."""
    names = left.groupBy("file").agg(F.array_sort(F.collect_set("speaker")).alias("ls")).join(right.groupBy("file").agg(F.array_sort(F.collect_set("speaker")).alias("rs")), "file", "full_outer")
    sums = token_overlaps(left, right).groupBy("file").agg(F.collect_list(F.struct("l", "r", "overlap")).alias("o"))

    @F.pandas_udf("struct<outcome:string,pairs:array<struct<l:string,r:string>>>")
    def solve(o: pd.Series, ls: pd.Series, rs: pd.Series) -> pd.DataFrame:
        rows = []
        for x, a, b in zip(o, ls, rs, strict=True):
            outcome, found = assign_speakers([(p["l"], p["r"], p["overlap"]) for p in (x if x is not None else [])], list(a if a is not None else []), list(b if b is not None else []))
            rows.append((outcome, [{"l": k, "r": v} for k, v in sorted(found.items())]))
        return pd.DataFrame(rows, columns=["outcome", "pairs"])

    solved = names.join(sums, "file", "left").withColumn("s", solve("o", "ls", "rs"))
    return solved.select("file", F.col("s.outcome").alias("outcome"), F.explode_outer("s.pairs").alias("p")).select("file", "outcome", "p.l", "p.r")


def unknown_speakers(mapping: DataFrame, present: DataFrame) -> DataFrame:
    """Mapped speakers that a file does not have."""
    return mapping.join(present, ["file", "speaker"], "left_anti")


def apply_speaker_map(left: DataFrame, right: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens of both sides under their pair, what is wrong with the map) for a map given by hand.

    Tables (file, speaker, token); ``mapping``: file, l, r. The first table has file,
    pair, side, token; the second file, side, speaker, problem: ``unknown`` speakers
    and such that are mapped ``twice``. Speakers without an entry take no part.
    """
    rules = mapping.select("file", "l", "r").distinct()
    sides = {"left": (left, "l"), "right": (right, "r")}
    said = [df.join(rules.withColumnRenamed(c, "speaker").withColumn("pair", F.concat_ws("=", *["speaker" if x == c else x for x in ("l", "r")])), ["file", "speaker"]).select("file", "pair", F.lit(side).alias("side"), "token") for side, (df, c) in sides.items()]
    wrong = []
    for side, (df, c) in sides.items():
        own = rules.select("file", F.col(c).alias("speaker"))
        wrong.append(own.distinct().join(df.select("file", "speaker").distinct(), ["file", "speaker"], "left_anti").select("file", F.lit(side).alias("side"), "speaker", F.lit("unknown").alias("problem")))
        wrong.append(own.groupBy("file", "speaker").count().where("count > 1").select("file", F.lit(side).alias("side"), "speaker", F.lit("twice").alias("problem")))
    return said[0].unionByName(said[1]), wrong[0].unionByName(wrong[1]).unionByName(wrong[2]).unionByName(wrong[3])


def candidate_maps(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate maps, each once and in order: ``rank`` by overlap (most first), then names."""
    one = pairs.select(*keys, "l", "r", "overlap").distinct()
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("overlap"), "l", "r")))


def artifact_pairs(expected: DataFrame, left: DataFrame, right: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, outcome, left, right: the artifacts of two runs by relative path.

    Outcome: ``equal``, ``different``, or what is missing; one failed pair never stops the others.
    """
    a = left.select(key, F.col(content).alias("left"), F.lit(True).alias("_l"))
    b = right.select(key, F.col(content).alias("right"), F.lit(True).alias("_r"))
    both = expected.select(key).distinct().join(a, key, "left").join(b, key, "left")
    outcome = F.when(F.col("_l").isNull() & F.col("_r").isNull(), "missing_both").when(F.col("_l").isNull(), "missing_left").when(F.col("_r").isNull(), "missing_right").when(F.col("left").eqNullSafe(F.col("right")), "equal").otherwise("different")
    return both.select(key, outcome.alias("outcome"), "left", "right")


def speaker_words(words: DataFrame, exclusions: list[str]) -> DataFrame:
    """file, speaker, kept, excluded: words of each speaker, and how many of them are excluded (as written or in lower case)."""
    out = F.col("w").isin(exclusions) | F.lower("w").isin(exclusions)
    return words.groupBy("file", "speaker").agg(F.count_if(~out).alias("kept"), F.count_if(out).alias("excluded"))


def positioned(tokens: DataFrame, keys: list[str], position: str, sequence: str, text: str) -> DataFrame:
    """keys, tokens: in order of their (fractional) position, then as they were emitted."""
    each = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(sequence).alias("s"), F.col(text).alias("t"))))
    return tokens.groupBy(*keys).agg(F.transform(each, lambda x: x["t"]).alias("tokens"))


def unit_union(main: DataFrame, gold: DataFrame) -> DataFrame:
    """Units of main utterances and, after them, of gold utterances that found no place: ``side`` tells which."""
    return main.withColumn("side", F.lit("main")).unionByName(gold.withColumn("side", F.lit("gold")), allowMissingColumns=True)


def header_union(rows: DataFrame, key: str, order: str) -> list[str]:
    """The distinct header keys of all rows in the order in which they are first seen (a table's columns, so few)."""
    first = rows.groupBy(key).agg(F.min(order).alias("o")).orderBy("o", key)
    return [r[key] for r in first.collect()]


def without_subsets(ranges: Column) -> Column:
    """Sets of positions without those that lie inside another one (of equal ones the first stays)."""
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    numbered = F.transform(ranges, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    kept = F.filter(numbered, lambda x: ~F.exists(numbered, lambda y: (x["i"] != y["i"]) & inside(x["r"], y["r"]) & (~inside(y["r"], x["r"]) | (y["i"] < x["i"]))))
    return F.transform(kept, lambda x: x["r"])


def range_subtraction(positions: Column, taken: Column) -> Column:
    """Positions that no other range has taken, in order."""
    return F.array_sort(F.array_except(positions, taken))


def difference_axes(rows: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """keys, axes: the distinct axes on which a group differs, in order."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(axis)).alias("axes"))


def compare_positions(left: DataFrame, right: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Full outer join by position; ``differences`` names the axes that differ (a missing side: 'missing_left'/'missing_right')."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in axes], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in axes], F.lit(True).alias("_r"))
    both = a.join(b, keys, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), c) for c in axes]))
    return both.withColumn("differences", F.when(F.col("_l").isNull(), F.array(F.lit("missing_left"))).when(F.col("_r").isNull(), F.array(F.lit("missing_right"))).otherwise(differ)).drop("_l", "_r")


def compare_timings(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Words paired by position; deltas of start and end for groups whose word lists agree (``comparable``)."""
    w = Window.partitionBy(*keys).orderBy(order)
    number = lambda df, p: df.withColumn("n", F.row_number().over(w)).select(*keys, "n", *[F.col(c).alias(p + c) for c in ("text", "start_ms", "end_ms")])
    both = number(left, "l_").join(number(right, "r_"), [*keys, "n"], "full_outer")
    agree = F.min(F.coalesce(F.col("l_text") == F.col("r_text"), F.lit(False))).over(Window.partitionBy(*keys))
    return both.withColumn("comparable", agree).withColumns({"start_delta": F.when(F.col("comparable"), F.abs(F.col("l_start_ms") - F.col("r_start_ms"))), "end_delta": F.when(F.col("comparable"), F.abs(F.col("l_end_ms") - F.col("r_end_ms")))})


def reassign_speakers(utts: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds ``speaker_new``: the last segment in list order that ends by the utterance's end, else the first segment.

    Segments: (file, seq, end_ms, speaker). Both sides lie in one order of ends, in
    which a running maximum over (seq, speaker) is what has ended so far.
    """
    first = segments.groupBy("file").agg(F.min_by("speaker", "seq").alias("_first"))
    ends = segments.select("file", F.col("end_ms").alias("_e"), F.lit(0).alias("_k"), F.struct(F.col("seq").alias("s"), F.col("speaker").alias("who")).alias("_seg"), F.lit(None).cast(utts.schema["utt"].dataType).alias("utt"))
    asks = utts.select("file", F.col("end_ms").alias("_e"), F.lit(1).alias("_k"), F.lit(None).cast(ends.schema["_seg"].dataType).alias("_seg"), "utt")
    order = Window.partitionBy("file").orderBy("_e", "_k").rowsBetween(Window.unboundedPreceding, 0)
    met = ends.union(asks).where("_e IS NOT NULL").withColumn("_last", F.max("_seg").over(order)["who"]).where("_k = 1").select("file", "utt", "_last")
    last = met.groupBy("file", "utt").agg(F.max("_last").alias("_last"))
    return utts.join(last, ["file", "utt"], "left").join(first, "file", "left").withColumn("speaker_new", F.when(F.col("end_ms").isNotNull(), F.coalesce("_last", "_first", "speaker")).otherwise(F.col("speaker"))).drop("_last", "_first")


def speakers_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, speakers: in order of appearance."""
    first = rows.groupBy(key, "speaker").agg(F.min(order).alias("f"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "speaker"))), lambda x: x["speaker"]).alias("speakers"))


def character_spans(words: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Adds from_char, to_char of each word in the words written together."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return words.withColumn("to_char", F.sum(F.length(text)).over(w)).withColumn("from_char", F.col("to_char") - F.length(text))


def tokens_to_words(words: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, token) that share characters; tables: keys, pos, text, equal when written together.

    Where a word or a token begins, the last of each that has begun meet; empty ones share nothing.
    """
    w = character_spans(words, keys, "pos", "text").where("to_char > from_char").select(*keys, F.col("from_char").alias("at"), F.col("pos").alias("word"), F.lit(None).cast(tokens.schema["pos"].dataType).alias("token"))
    t = character_spans(tokens, keys, "pos", "text").where("to_char > from_char").select(*keys, F.col("from_char").alias("at"), F.lit(None).cast(words.schema["pos"].dataType).alias("word"), F.col("pos").alias("token"))
    begun = w.unionByName(t).groupBy(*keys, "at").agg(F.max("word").alias("word"), F.max("token").alias("token"))
    order = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    met = begun.select(*keys, F.last("word", ignorenulls=True).over(order).alias("word"), F.last("token", ignorenulls=True).over(order).alias("token"))
    return met.where("word IS NOT NULL AND token IS NOT NULL")


def indexed_timings(words: Column, timings: Column, window_start: Column, window_end: Column) -> Column:
    """Timings put onto words by index, moved to the file and dropped outside the window."""
    def one(w: Column, t: Column) -> Column:
        s, e = t["start_ms"] + window_start, t["end_ms"] + window_start
        good = (e > s) & (s >= window_start) & (e <= window_end)
        return F.struct(w.alias("text"), F.when(good, s).alias("start_ms"), F.when(good, e).alias("end_ms"))

    # side by side: by index the list of timings would be built anew for each word
    return F.slice(F.zip_with(words, F.coalesce(timings, F.array()), one), F.lit(1), F.size(words))


def upsert_tiers(tiers: DataFrame, new: DataFrame) -> DataFrame:
    """New tiers take the place of old ones with the same file, utterance and label."""
    return tiers.join(new, ["file", "utt", "label"], "left_anti").unionByName(new)


def drop_tiers(tiers: DataFrame, labels: list[str]) -> DataFrame:
    return tiers.where(~F.col("label").isin(labels))


def copy_tiers(tiers: DataFrame, deltas: DataFrame, labels: list[str]) -> DataFrame:
    """Tiers of unchanged utterances under their new index."""
    same = deltas.where("kind = 'unchanged'").select("file", F.col("before_idx").alias("utt"), "after_idx")
    return tiers.where(F.col("label").isin(labels)).join(same, ["file", "utt"]).select("file", F.col("after_idx").alias("utt"), "label", "content")


def scatter(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses back at their file and utterance (a missing one stays null)."""
    return items.join(responses, ["file", "utt"], "left")


def isolate_failures(results: DataFrame, key: str = "file", error: str = "error", samples: int = L.ERROR_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """(rows of files without an error, failed files with the count and the first errors by index)."""
    failed = results.where(F.col(error).isNotNull()).groupBy(key).agg(F.count("*").alias("n_errors"), F.slice(F.array_sort(F.collect_list(F.struct("utt", error))), 1, samples).alias("samples"))
    return results.join(failed, key, "left_anti"), failed


def cache_split(items: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items with their cached data, items to compute)."""
    return items.join(cache, keys), items.join(cache.select(*keys).distinct(), keys, "left_anti")


def conflicts(jobs: DataFrame, incoming: DataFrame, active: list[str]) -> DataFrame:
    """Submissions that touch a path of the same submitter's active job."""
    return incoming.join(jobs.where(F.col("status").isin(active)).select("submitter", "path", "job_id"), ["submitter", "path"])


def merge_decisions(records: DataFrame) -> DataFrame:
    """One tier for each line: records joined by '; ', marked for review if any of them is."""
    one = F.concat_ws(" ", F.col("strategy"), F.col("reason"))
    return records.groupBy("file", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("s")))), lambda x: x["s"]), "; ").alias("content"), F.bool_or("needs_review").alias("needs_review"))


def gold_projection(matches: DataFrame) -> DataFrame:
    """Gold utterances whose words all match, one to one and in one main utterance: file, gold_utt, main_utt.

    ``matches``: compared tokens. Utterances with any other token of the unit are left out.
    """
    per = matches.groupBy("file", "unit").agg(F.count_if(F.col("status") != "match").alias("bad"), F.count_distinct("main_utt").alias("mains"), F.count_distinct("gold_utt").alias("golds"), F.max("main_utt").alias("main_utt"), F.max("gold_utt").alias("gold_utt"))
    return per.where("bad = 0 AND mains = 1 AND golds = 1").select("file", "gold_utt", "main_utt")


def previous_bullet(df: DataFrame, value: str) -> Column:
    """The last value before a row that is not null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))


def unmatched(left: DataFrame, mapped: DataFrame) -> DataFrame:
    return left.distinct().exceptAll(mapped.distinct()) if left.columns == mapped.columns else left.join(mapped, left.columns, "left_anti").distinct()
