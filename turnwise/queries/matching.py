"""Alignment, comparison and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import sequences
from turnwise.functions import words as W
from turnwise.operators import alignment, joins, metrics
from turnwise.plans import commands
from turnwise.queries.base import SPANS, U, query, spans, spiced, utterances
from turnwise.queries.text import CONFORM
from turnwise.session import table

def pairs(spark, d):
    """Pairs of word lists for alignment: a turn and a worn copy of it."""
    gold = F.col("words")
    worn = F.filter(F.transform(gold, lambda w, i: F.when(i % 7 == 3, F.lit(None)).when(i % 5 == 1, "um").when(i % 6 == 2, F.translate(w, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(w)), lambda w: w.isNotNull())
    # aligning a turn costs far more than moving its words: all cores take part, however few files the table has
    spread = utterances(spark, d).where(F.size("words") > 0).repartition("file", "utt")
    return spread.select("file", "utt", "speaker", gold.alias("gold"), worn.alias("main"))


_PAIRS = f"""{U}, g AS (SELECT file, utt, speaker, words AS gold FROM u WHERE len(words) > 0),
p AS (SELECT *, list_filter(list_transform(gold, lambda x, i: CASE WHEN (i - 1) % 7 = 3 THEN NULL WHEN (i - 1) % 5 = 1 THEN 'um' WHEN (i - 1) % 6 = 2 THEN translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE x END), lambda x: x IS NOT NULL) AS main FROM g)"""
#: Longest common subsequence by a recursive table: one row of the table for each word.
_LCS_CTE = """lcs AS (SELECT file, utt, 0 AS i, list_transform(range(len(b) + 1), lambda z: 0) AS r, a, b FROM ab
 UNION ALL SELECT file, utt, i + 1, list_reduce(list_concat([[0]], list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN a[i + 1] = b[j] THEN r[j] + 1 ELSE -1 - r[j + 1] END])),
   lambda c, x: list_append(c, CASE WHEN x[1] >= 0 THEN x[1] ELSE greatest(-1 - x[1], c[-1]) END)), a, b FROM lcs WHERE i < len(a)),
l AS (SELECT file, utt, r[-1] AS matches, len(a) AS n, len(b) AS m FROM lcs WHERE i = len(a))"""


@query("c03_alignment_counts", f"WITH RECURSIVE {_PAIRS}, ab AS (SELECT file, utt, main AS a, gold AS b FROM p), {_LCS_CTE} SELECT file, utt, matches::BIGINT AS matches, (n - matches)::BIGINT AS extra_payload, (m - matches)::BIGINT AS extra_reference FROM l")
def c03(spark, d):
    """Aligned pairs by traceback; the counts must be those of the longest common subsequence."""
    return pairs(spark, d).select("file", "utt", alignment.aligned_counts("exact")("main", "gold").alias("c")).select("file", "utt", "c.*")


@query("c03_lcs_native", f"WITH RECURSIVE {_PAIRS}, ab AS (SELECT file, utt, list_transform(main, lambda x: lower(x)) AS a, list_transform(gold, lambda x: lower(x)) AS b FROM p), {_LCS_CTE} SELECT file, utt, matches::INT AS lcs FROM l")
def c03n(spark, d):
    low = lambda c: F.transform(c, F.lower)
    return pairs(spark, d).select("file", "utt", alignment.lcs_length(low("main"), low("gold")).alias("lcs"))


@query("c03_alignment_items")
def c03i(spark, d):
    return pairs(spark, d).select("file", "utt", F.posexplode(alignment.aligned("nocase")("main", "gold")).alias("seq", "i")).select("file", "utt", "seq", "i.*")


@query("c04_character_alignment")
def c04(spark, d):
    ch = lambda c: F.array_join(c, "")
    return pairs(spark, d).select("file", "utt", alignment.aligned_counts("exact")(ch("main"), ch("gold")).alias("c")).select("file", "utt", "c.*")


@query("c05_match_modes", f"""WITH {_PAIRS}, z AS (SELECT file, utt, unnest(list_zip(main, gold)) AS z FROM p), w AS (SELECT file, utt, z[1] AS a, z[2] AS b FROM z)
SELECT file, utt, a = b AS exact, translate(a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS nocase FROM w""")  # fmt: skip
def c05(spark, d):
    p = pairs(spark, d).select("file", "utt", F.explode(F.arrays_zip("main", "gold")).alias("z"))
    a, b = F.col("z.main"), F.col("z.gold")
    return p.select("file", "utt", (a == b).alias("exact"), (W.fold_ascii(a) == W.fold_ascii(b)).alias("nocase"))


@query("c05_similarity")
def c05s(spark, d):
    p = pairs(spark, d).select("file", "utt", F.explode(F.arrays_zip("main", "gold")).alias("z"))
    return p.select("file", "utt", "z.main", "z.gold", F.round(alignment.jaro_winkler_similarity(F.col("z.main"), F.col("z.gold")), 6).alias("similarity"))


def _gold_words(spark, d):
    return commands.compare_words(utterances(spark, d).where(F.size("words") > 0))


def _main_words(spark, d):
    worn = F.filter(F.transform("words", lambda w, i: F.when(i % 7 == 3, F.lit(None)).when(i % 6 == 2, "zz").otherwise(w)), lambda w: w.isNotNull())
    return commands.compare_words(utterances(spark, d).where(F.size("words") > 0).withColumn("words", worn))


@query("c07_compare_tokens")
def c07(spark, d):
    return alignment.compare(_main_words(spark, d), _gold_words(spark, d))


@query("k09_compare")
def k09(spark, d):
    """The whole comparison of worn transcripts with their originals."""
    main = utterances(spark, d).withColumn("words", F.transform("words", lambda w, i: F.when(i % 6 == 2, "zz").otherwise(w)))
    out = commands.compare(main, utterances(spark, d))
    return out.select("file", "matches", "insertions", "deletions", "total_gold_words", *[F.round(c, 4).alias(c) for c in ("wer", "accuracy", "cwer")])


_WER = f"""WITH RECURSIVE {_PAIRS},
cm AS (SELECT file, utt, flatten(list_transform(list_filter(main, lambda w: NOT (trim(w) IN ('.', '?', '!', ',', '‡', '„') OR lower(trim(w)) IN ('um', 'uhm', 'em', 'mhm', 'uhhm', 'eh', 'uh', 'hm'))), lambda w: {CONFORM})) AS a,
 flatten(list_transform(list_filter(gold, lambda w: NOT (trim(w) IN ('.', '?', '!', ',', '‡', '„') OR lower(trim(w)) IN ('um', 'uhm', 'em', 'mhm', 'uhhm', 'eh', 'uh', 'hm'))), lambda w: {CONFORM})) AS b, speaker FROM p),
ab AS (SELECT * FROM cm), {_LCS_CTE},
s AS (SELECT ab.speaker, sum(matches) AS matches, sum(n - matches) AS insertions, sum(m - matches) AS deletions FROM l JOIN ab USING (file, utt) GROUP BY 1)
SELECT speaker, matches::BIGINT AS matches, insertions::BIGINT AS insertions, deletions::BIGINT AS deletions, round(CASE WHEN matches + deletions > 0 THEN (insertions + deletions) / (matches + deletions) ELSE 0 END, 6) AS wer,
 round(greatest(0, least(1, 1 - CASE WHEN matches + deletions > 0 THEN (insertions + deletions) / (matches + deletions) ELSE 0 END)), 6) AS accuracy FROM s"""


@query("d01_d03_error_rates", _WER)
def wer(spark, d):
    """Word error rate by speaker, with utterances as units: content words, conformed, counted without a traceback."""
    content = lambda c: W.conform_all(F.filter(c, lambda w: ~W.is_punct_or_filler(w)))
    p = pairs(spark, d).select("speaker", content("main").alias("a"), content("gold").alias("b"))
    n = p.select("speaker", alignment.lcs_length(F.col("a"), F.col("b")).alias("k"), F.size("a").alias("n"), F.size("b").alias("m"))
    c = n.groupBy("speaker").agg(F.sum("k").alias("matches"), F.sum(F.col("n") - F.col("k")).alias("insertions"), F.sum(F.col("m") - F.col("k")).alias("deletions"))
    return metrics.with_rates(c).select("speaker", "matches", "insertions", "deletions", F.round("wer", 6).alias("wer"), F.round("accuracy", 6).alias("accuracy"))


@query("d02_bag_errors", f"""WITH {_PAIRS}, w AS (SELECT file, utt, lower(unnest(main)) AS w, 1 AS s FROM p UNION ALL SELECT file, utt, lower(unnest(gold)), -1 FROM p), c AS (SELECT file, utt, w, abs(sum(s)) AS k FROM w GROUP BY 1, 2, 3)
SELECT file, utt, sum(k)::INT AS bag FROM c GROUP BY 1, 2""")  # fmt: skip
def d02(spark, d):
    low = lambda c: F.transform(c, F.lower)
    return pairs(spark, d).select("file", "utt", sequences.bag_difference(low("main"), low("gold")).alias("bag"))


@query("d04_benchmark_rate")
def d04(spark, d):
    ready = lambda c, join: F.transform(W.conform_all(sequences.join_single_letters(F.transform(c, W.without_dashes)) if join else F.transform(c, W.without_dashes)), W.normalise_for_wer)
    p = pairs(spark, d).withColumn("r", alignment.benchmark_wer(ready("main", True), ready("gold", False), F.size("gold")))
    return p.select("file", "utt", F.round("r.wer", 6).alias("wer"), "r.total", "r.matches")


@query("d05_agreement", f"""WITH {_PAIRS}, w AS (SELECT file, lower(unnest(main)) AS w, 1 AS l, 0 AS r FROM p UNION ALL SELECT file, lower(unnest(gold)), 0, 1 FROM p), c AS (SELECT file, w, sum(l) AS l, sum(r) AS r FROM w GROUP BY 1, 2)
SELECT file, sum(l)::BIGINT AS left_words, sum(r)::BIGINT AS right_words, sum(least(l, r))::BIGINT AS overlap, round(sum(least(l, r)) / nullif(sum(l), 0), 6) AS rate FROM c GROUP BY 1""")  # fmt: skip
def d05(spark, d):
    p = pairs(spark, d)
    a = metrics.agreement(p.select("file", F.explode("main").alias("token")), p.select("file", F.explode("gold").alias("token")), "file", "token")
    return a.withColumn("rate", F.round("rate", 6))


@query("d06_bag_overlap", f"WITH {_PAIRS}, k AS (SELECT file, utt, main, gold, unnest(list_distinct(main)) AS k FROM p) SELECT file, utt, sum(least(len(list_filter(main, lambda x: x = k)), len(list_filter(gold, lambda x: x = k))))::INT AS overlap FROM k GROUP BY 1, 2")
def d06(spark, d):
    return pairs(spark, d).where(F.size("main") > 0).select("file", "utt", sequences.bag_overlap(F.col("main"), F.col("gold")).alias("overlap"))


@query("c01_companion_pairs", "WITH f AS (SELECT 'a/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.gold.cha' ELSE '.cha' END AS p FROM documents UNION ALL SELECT 'a/' || doc_id || '.gold.cha' FROM documents WHERE doc_id % 4 = 1) SELECT p AS main, replace(p, '.cha', '.gold.cha') AS gold, replace(p, '.cha', '.gold.cha') IN (SELECT p FROM f) AS has_gold FROM f WHERE p NOT LIKE '%.gold.cha'")
def c01(spark, d):
    i = table(spark, d, "documents").select(F.col("doc_id").alias("i"))
    name = lambda ext: F.concat(F.lit("a/"), F.col("i").cast("string"), ext)
    files = i.select(name(F.when(F.col("i") % 3 == 0, ".gold.cha").otherwise(".cha")).alias("path")).union(i.where("i % 4 = 1").select(name(F.lit(".gold.cha"))))
    return joins.companion_pairs(files)


@query("c02_media_pairs", "WITH s AS (SELECT doc_id, 'm/' || doc_id AS stem FROM documents) SELECT stem, CASE WHEN doc_id % 2 = 0 THEN stem || '.wav' WHEN doc_id % 3 = 0 THEN stem || '.mp3' END AS media FROM s")
def c02(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.concat(F.lit("m/"), F.col("doc_id").cast("string")).alias("stem"))
    media = s.where("doc_id % 2 = 0").select(F.concat("stem", F.lit(".wav")).alias("path")).union(s.where("doc_id % 3 = 0").select(F.concat("stem", F.lit(".mp3"))))
    return joins.media_pairs(s, media, ["wav", "mp3"])


@query("c09_token_overlaps", f"""WITH {U}, w AS (SELECT file, speaker, lower(unnest(words)) AS token FROM u), l AS (SELECT file, speaker AS l, token, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT file, speaker AS r, token, count(*) AS m FROM w GROUP BY ALL)
SELECT file, l, r, sum(least(n, m))::BIGINT AS overlap FROM l JOIN r USING (file, token) GROUP BY 1, 2, 3""")  # fmt: skip
def c09(spark, d):
    w = utterances(spark, d).select("file", "speaker", F.explode(F.transform("words", F.lower)).alias("token"))
    return joins.token_overlaps(w, w)


@query("c09_speaker_correspondence")
def c09s(spark, d):
    w = utterances(spark, d).select("file", "speaker", F.explode(F.transform("words", F.lower)).alias("token"))
    return joins.speaker_correspondence(w, w.withColumn("speaker", F.concat(F.lit("S-"), "speaker")))


@query("c12_positional_differences", f"""WITH {_PAIRS}, l AS (SELECT file, utt, unnest(main) AS w, unnest(range(len(main))) AS pos FROM p), r AS (SELECT file, utt, unnest(gold) AS w, unnest(range(len(gold))) AS pos FROM p)
SELECT CASE WHEN l.w IS NULL THEN 'missing_left' WHEN r.w IS NULL THEN 'missing_right' ELSE array_to_string(list_filter([CASE WHEN l.w <> r.w THEN 'text' END, CASE WHEN length(l.w) <> length(r.w) THEN 'size' END], lambda x: x IS NOT NULL), '+') END AS difference, count(*) AS n
FROM l FULL JOIN r ON l.file = r.file AND l.utt = r.utt AND l.pos = r.pos GROUP BY 1""")  # fmt: skip
def c12(spark, d):
    side = lambda c: pairs(spark, d).select("file", "utt", F.posexplode(c).alias("pos", "text")).withColumn("size", F.length("text"))
    return joins.compare_positions(side("main"), side("gold"), ["file", "utt", "pos"], ["text", "size"]).groupBy(F.array_join("differences", "+").alias("difference")).agg(F.count("*").alias("n"))


@query("c13_timing_deltas", f"""WITH {SPANS}, l AS (SELECT file, line // 10 AS utt, row_number() OVER (PARTITION BY file, line // 10 ORDER BY line) AS n, speaker, start_ms, end_ms FROM t),
b AS (SELECT l.file, l.utt, l.n, bool_and(l.speaker = CASE WHEN l.utt % 3 = 0 THEN 'x' ELSE l.speaker END) OVER (PARTITION BY l.file, l.utt) AS ok FROM l)
SELECT file, utt, n::INT AS n, CASE WHEN ok THEN 7 END::BIGINT AS start_delta, CASE WHEN ok THEN 3 END::BIGINT AS end_delta FROM b""")  # fmt: skip
def c13(spark, d):
    t = spans(spark, d).where("start_ms IS NOT NULL").select("file", F.expr("line div 10").alias("utt"), "line", F.col("speaker").alias("text"), "start_ms", "end_ms")
    right = t.withColumns({"text": F.when(F.col("utt") % 3 == 0, "x").otherwise(F.col("text")), "start_ms": F.col("start_ms") + 7, "end_ms": F.col("end_ms") - 3})
    return joins.compare_timings(t, right, ["file", "utt"], "line").select("file", "utt", "n", "start_delta", "end_delta")


@query("c14_reassign_speakers", f"""WITH {SPANS}, g AS (SELECT file, line AS seq, end_ms, speaker FROM t WHERE line % 4 = 0), f AS (SELECT file, min_by(speaker, seq) AS f FROM g GROUP BY 1),
m AS (SELECT t.file, t.line, max_by(g.speaker, g.seq) AS s FROM t JOIN g ON g.file = t.file AND g.end_ms <= t.end_ms GROUP BY 1, 2)
SELECT t.file, t.line AS utt, coalesce(m.s, f.f, t.speaker) AS speaker_new FROM t LEFT JOIN m ON m.file = t.file AND m.line = t.line LEFT JOIN f ON f.file = t.file""")  # fmt: skip
def c14(spark, d):
    t = spans(spark, d).where("start_ms IS NOT NULL").select("file", F.col("line").alias("utt"), "speaker", "end_ms")
    return joins.reassign_speakers(t, t.where("utt % 4 = 0").withColumnRenamed("utt", "seq")).select("file", "utt", "speaker_new")


@query("c15_tokens_to_words", f"""WITH {U}, p AS (SELECT file, utt, words AS ws FROM u WHERE len(words) > 0), w AS (SELECT file, utt, unnest(ws) AS x, unnest(range(len(ws))) AS pos FROM p), c AS (SELECT *, sum(length(x)) OVER (PARTITION BY file, utt ORDER BY pos) AS t FROM w),
k AS (SELECT file, utt, unnest(generate_series(0, (length(array_to_string(ws, '')) - 1) // 3)) AS token, length(array_to_string(ws, '')) AS n FROM p)
SELECT c.file, c.utt, c.pos::INT AS word, k.token::INT AS token FROM c JOIN k ON k.file = c.file AND k.utt = c.utt AND k.token * 3 < c.t AND least(k.token * 3 + 3, n) > c.t - length(c.x)""")  # fmt: skip
def c15(spark, d):
    u = utterances(spark, d).where(F.size("words") > 0).select("file", "utt", F.col("words").alias("ws"))
    w = u.select("file", "utt", F.posexplode("ws").alias("pos", "text"))
    whole = F.array_join("ws", "")
    thirds = F.transform(F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / 3).cast("int")), lambda k: F.substr(whole, k * 3 + 1, F.lit(3)))
    return joins.tokens_to_words(w, u.select("file", "utt", F.posexplode(thirds).alias("pos", "text")), ["file", "utt"])


@query("c16_length_mapping", f"WITH {U}, m AS (SELECT file, utt, len(words) AS n FROM u WHERE len(words) > 0) SELECT file, utt, array_to_string(list_transform(range(7), lambda t: least(t * n // 7, n - 1)), ',') AS mapping FROM m")
def c16(spark, d):
    return utterances(spark, d).where(F.size("words") > 0).select("file", "utt", F.array_join(F.transform(sequences.length_mapping(F.size("words"), F.lit(7)), lambda x: x.cast("string")), ",").alias("mapping"))


@query("c18_scatter", f"WITH {U} SELECT u.file, u.utt, r.r AS response FROM u LEFT JOIN (SELECT file, utt, 'ok' AS r FROM u WHERE utt % 2 = 0) r ON r.file = u.file AND r.utt = u.utt")
def c18(spark, d):
    u = utterances(spark, d).select("file", "utt")
    return joins.scatter(u, u.where("utt % 2 = 0").withColumn("response", F.lit("ok")))


_ERR = f"{U}, e AS (SELECT file, utt, CASE WHEN (file + utt) % 11 = 0 THEN 'bad' END AS error FROM u)"


@query("c19_failure_isolation", f"WITH {_ERR} SELECT file, utt FROM e WHERE file NOT IN (SELECT file FROM e WHERE error IS NOT NULL)")
def c19(spark, d):
    e = utterances(spark, d).select("file", "utt", F.when((F.col("file") + F.col("utt")) % 11 == 0, "bad").alias("error"))
    return joins.isolate_failures(e)[0].select("file", "utt")


@query("d28_error_samples", f"WITH {_ERR}, r AS (SELECT file, utt, row_number() OVER (PARTITION BY file ORDER BY utt) AS k FROM e WHERE error IS NOT NULL) SELECT file, count(*) AS n_errors, string_agg(utt::VARCHAR, ',' ORDER BY utt) FILTER (k <= 5) AS first_errors FROM r GROUP BY 1")
def d28(spark, d):
    e = utterances(spark, d).select("file", "utt", F.when((F.col("file") + F.col("utt")) % 11 == 0, "bad").alias("error"))
    return joins.isolate_failures(e)[1].select("file", "n_errors", F.array_join(F.transform("samples", lambda s: s["utt"].cast("string")), ",").alias("first_errors"))


@query("c20_cache_split", "SELECT d.doc_id, d.doc_id % 3 = 0 AS hit FROM documents d")
def c20(spark, d):
    items = table(spark, d, "documents").select("doc_id", F.lit("v1").alias("engine_version"))
    cache = items.where("doc_id % 3 = 0").withColumn("data", F.lit("x")).union(items.where("doc_id % 3 = 1").select("doc_id", F.lit("v0"), F.lit("old")))
    hits, misses = joins.cache_split(items, cache, ["doc_id", "engine_version"])
    return hits.select("doc_id", F.lit(True).alias("hit")).union(misses.select("doc_id", F.lit(False)))


@query("c21_conflicts", "SELECT o_orderkey AS job_id, o_custkey AS submitter FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 7 = 0")
def c21(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("submitter"), F.lit("p").alias("path"), F.col("o_orderstatus").alias("status"))
    return joins.conflicts(o, o.where("submitter % 7 = 0").select("submitter", "path").distinct(), ["O"]).select("job_id", "submitter")


def _tokens(u):
    each = u.select("file", "utt", F.posexplode("words").alias("pos", "text"))
    return each.select("file", (F.col("utt") * 1000 + F.col("pos")).alias("seq"), "text", ((F.col("utt") * 1000 + F.col("pos")) * 100).alias("start_ms"), ((F.col("utt") * 1000 + F.col("pos")) * 100 + 90).alias("end_ms"))


@query("c22_timing_recovery", f"WITH {U} SELECT file, utt, CASE WHEN len(words) > 0 THEN utt * 100000 END AS start_ms, CASE WHEN len(words) > 0 THEN (utt * 1000 + len(words) - 1) * 100 + 90 END AS end_ms FROM u")
def c22(spark, d):
    """Spans from tokens of the same words: each utterance from its first token to its last."""
    u = utterances(spark, d).select("file", "utt", "words")
    return alignment.recover_timing(u, _tokens(u))


@query("c23_overlap_recovery")
def c23(spark, d):
    u = utterances(spark, d).select("file", "utt", "words", (F.col("utt") % 4 == 1).alias("has_overlap"))
    return alignment.recover_overlapping(u, _tokens(u))


@query("c26_token_stitching")
def c26(spark, d):
    ws = F.col("words")
    pieces = F.flatten(F.transform(ws, lambda w, i: F.array(F.struct(F.substring(w, 1, 2).alias("text"), (i * 100).cast("long").alias("start_ms"), (i * 100 + 40).cast("long").alias("end_ms")), F.struct(F.substr(w, F.lit(3)).alias("text"), (i * 100 + 40).cast("long").alias("start_ms"), (i * 100 + 90).cast("long").alias("end_ms")))))
    return utterances(spark, d).select("file", "utt", F.posexplode(alignment.stitched(ws, pieces)).alias("pos", "s")).select("file", "utt", "pos", "s.start_ms", "s.end_ms")


@query("c27_indexed_timings", f"WITH {U}, e AS (SELECT file, utt, unnest(words) AS text, unnest(range(len(words))) AS i FROM u) SELECT file, utt, i::INT AS pos, text, CASE WHEN i <> 2 THEN utt * 100000 + i * 10 END AS start_ms, CASE WHEN i <> 2 THEN utt * 100000 + i * 10 + 9 END AS end_ms FROM e")
def c27(spark, d):
    ws, step = F.col("words"), 100_000
    times = F.transform(ws, lambda _, i: F.struct((i * 10).cast("long").alias("start_ms"), F.when(i == 2, i * 10).otherwise(i * 10 + 9).cast("long").alias("end_ms")))
    t = joins.indexed_timings(ws, times, F.col("utt") * step, F.col("utt") * step + step // 2)
    return utterances(spark, d).select("file", "utt", F.posexplode(t).alias("pos", "t")).select("file", "utt", "pos", "t.text", "t.start_ms", "t.end_ms")


def _versions(spark, d):
    before = utterances(spark, d).select("file", "utt", "speaker", F.concat(F.array_join("words", " "), F.lit("#"), F.col("utt").cast("string")).alias("words"), (F.col("utt") * 1000).alias("start_ms"), (F.col("utt") * 1000 + 900).alias("end_ms"))
    after = before.where("utt % 7 <> 6").withColumns({"words": F.when(F.col("utt") % 5 == 3, F.concat("words", F.lit("!"))).otherwise(F.col("words")), "start_ms": F.when(F.col("utt") % 4 == 2, F.col("start_ms") + 1).otherwise(F.col("start_ms")), "speaker": F.when(F.col("utt") == 1, "other").otherwise(F.col("speaker"))})
    return before, after


_DIFF = "CASE WHEN turn % 7 = 6 THEN 'deleted' WHEN turn % 5 = 3 THEN 'words_changed' WHEN turn = 1 THEN 'speaker_changed' WHEN turn % 4 = 2 THEN 'timing_only' ELSE 'unchanged' END"


@query("c28_transcript_diff", f"SELECT {_DIFF} AS kind, count(*) AS n FROM conversations GROUP BY 1")
def c28(spark, d):
    return alignment.diff(*_versions(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("d11_diff_summary", f"SELECT conv_id AS file, count(*) FILTER (k = 'unchanged') AS unchanged, count(*) FILTER (k IN ('words_changed', 'inserted')) AS reprocess, count(*) AS total FROM (SELECT conv_id, {_DIFF} AS k FROM conversations) GROUP BY 1")
def d11(spark, d):
    return alignment.diff(*_versions(spark, d)).groupBy("file").agg(F.count_if(F.col("kind") == "unchanged").alias("unchanged"), F.count_if(F.col("kind").isin("words_changed", "inserted")).alias("reprocess"), F.count("*").alias("total"))


@query("c29_copy_tiers", f"SELECT conv_id AS file, count(*) AS n FROM (SELECT conv_id, {_DIFF} AS k FROM conversations) WHERE k = 'unchanged' GROUP BY 1")
def c29(spark, d):
    before, after = _versions(spark, d)
    tiers = before.select("file", "utt", F.explode(F.array(F.lit("mor"), F.lit("wor"))).alias("label"), F.col("words").alias("content"))
    return joins.copy_tiers(tiers, alignment.diff(before, after), ["mor"]).groupBy("file").agg(F.count("*").alias("n"))


@query("b14_b15_tiers", f"WITH {U} SELECT file, utt, label, CASE WHEN utt % 2 = 0 AND label = 'xtra' THEN 'new' ELSE 'old' END AS content FROM u, (SELECT unnest(['xtra', 'wor']) AS label)")
def b15(spark, d):
    tiers = utterances(spark, d).select("file", "utt", F.explode(F.array(F.lit("xtra"), F.lit("mor"), F.lit("wor"))).alias("label"), F.lit("old").alias("content"))
    new = utterances(spark, d).where("utt % 2 = 0").select("file", "utt", F.lit("xtra").alias("label"), F.lit("new").alias("content"))
    return joins.upsert_tiers(joins.drop_tiers(tiers, ["mor"]), new)


@query("c31_decision_tiers", "SELECT user_id AS file, (event_id // 50) AS line, string_agg(event_type || ' at ' || event_id, '; ' ORDER BY event_id) AS content, bool_or(event_id % 9 = 0) AS needs_review FROM events GROUP BY 1, 2")
def c31(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), F.expr("event_id div 50").alias("line"), F.col("event_id").alias("seq"), F.col("event_type").alias("strategy"), F.concat(F.lit("at "), F.col("event_id").cast("string")).alias("reason"), (F.col("event_id") % 9 == 0).alias("needs_review"))
    return joins.merge_decisions(e)


@query("c33_gold_projection")
def c33(spark, d):
    """Each third turn is worn; the others can be projected where their words lie in one turn."""
    u = utterances(spark, d).where(F.size("words") > 0)
    main = commands.compare_words(u.where("utt % 3 <> 1")).union(_main_words(spark, d).where("utt % 3 = 1"))
    return joins.gold_projection(alignment.compare(main, commands.compare_words(u)))


@query("g01_unmapped_speakers", f"WITH {U} SELECT DISTINCT file, speaker FROM u EXCEPT SELECT file, speaker FROM u WHERE speaker = 'user'")
def g01(spark, d):
    u = utterances(spark, d).select("file", "speaker")
    return joins.unmatched(u, u.where("speaker = 'user'"))


@query("g08_speakers_in_order", f"WITH {U}, f AS (SELECT file, speaker, min(utt) AS f FROM u GROUP BY 1, 2) SELECT file, string_agg(speaker, ',' ORDER BY f) AS speakers FROM f GROUP BY 1")
def g08(spark, d):
    return joins.speakers_in_order(utterances(spark, d), "file", "utt").select("file", F.array_join("speakers", ",").alias("speakers"))


# --- commands ----------------------------------------------------------------------


def _english(spark, d):
    return utterances(spark, d).withColumn("lang", F.lit("eng"))


@query("k02_morphotag")
def k02(spark, d):
    return commands.morphotag(_english(spark, d))


@query("k03_utseg")
def k03(spark, d):
    return commands.utseg(_english(spark, d)).select("file", "utt", "part", F.array_join("words", " ").alias("text"))


@query("k04_translate")
def k04(spark, d):
    return commands.translate(_english(spark, d))


@query("k05_coref")
def k05(spark, d):
    return commands.coref(_english(spark, d))


@query("k06_align")
def k06(spark, d):
    u = _english(spark, d)
    return commands.align(u, _tokens(u.where("utt % 3 <> 1")), 10_000_000).select("file", "utt", "placement", "est_start", "est_end")


@query("k07_transcribe")
def k07(spark, d):
    return commands.transcribe(spiced(spark, d).select("file", F.posexplode("words").alias("p", "text"), "utt").select("file", (F.col("utt") * 10_000 + F.col("p")).alias("seq"), "text"))


@query("k10_benchmark")
def k10(spark, d):
    u = _english(spark, d)
    asr = u.select("file", F.posexplode("words").alias("p", "text"), "utt").select("file", (F.col("utt") * 10_000 + F.col("p")).alias("seq"), "text")
    return commands.benchmark(asr, u).select("file", "matches", "insertions", "deletions", F.round("wer", 4).alias("wer"))


@query("k11_diarize", "SELECT user_id AS file, 0::BIGINT AS inverted FROM events GROUP BY 1")
def k11(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("speaker"), F.col("event_id").alias("start_ms"), (F.col("event_id") + 1).alias("end_ms"))
    return commands.diarize(e).select("file", "inverted")


@query("k12_compare_runs")
def k12(spark, d):
    w = utterances(spark, d).select("file", "speaker", F.explode(F.transform("words", F.lower)).alias("token"))
    return commands.compare_runs(w, w.where("token <> 'the'")).select("k", "left_words", "right_words", "overlap", F.round("rate", 6).alias("rate"))


@query("k13_evaluate")
def k13(spark, d):
    from turnwise.queries.text import tagged

    t = tagged(spark, d).select("file", F.concat_ws(",", "lang", F.lit("spa")).alias("pair"), F.col("w").alias("text"), "lang", "mor", F.col("upos").alias("pos"), "feats")
    return commands.evaluate(t).select("pair", "files", "total", "spliced", "l2xxx", "missing_mor", "clean", F.round("splice_rate", 4).alias("splice_rate"), F.round("clean_rate", 4).alias("clean_rate"))

