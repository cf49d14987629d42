"""Two runs compared by a plan, in four modes: conversations, and a second run made of them.

The second run renames speakers, changes words, times and analyses at fixed positions and lacks some files;
the plan pairs each file with itself, maps its speakers, and holds some pairs out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import runs
from turnwise.queries.base import U, query, utterances
from turnwise.session import table


def parts(spark, d):
    """(plan, left tokens, right tokens, speaker map)."""
    w = utterances(spark, d).select(F.concat(F.lit("c/"), F.col("file").cast("string")).alias("path"), "file", "speaker", "utt", F.posexplode("words").alias("pos", "text"))
    at = F.col("utt") * 100_000 + F.col("pos") * 300
    left = w.withColumns({"start_ms": F.when(F.col("pos") % 5 != 1, at), "end_ms": F.when(F.col("pos") % 5 != 1, at + 250), "upos": F.when(F.length("text") % 2 == 0, "X").otherwise("Y"), "lemma": F.lower("text"), "feats": F.lit("b|a")})
    moved = (F.col("file") + F.col("utt") + F.col("pos")) % 40
    right = left.where("file % 6 <> 4 AND NOT (file % 3 = 1 AND pos = 7)").withColumns(
        {"start_ms": F.col("start_ms") + moved, "end_ms": F.col("end_ms") + 2 * moved, "upos": F.when(F.col("pos") % 11 == 3, "Z").otherwise(F.col("upos")), "feats": F.when(F.col("pos") % 13 == 0, "c").otherwise("a|b"), "speaker": F.concat(F.lit("S-"), "speaker")}
    )
    files = table(spark, d, "conversations").select(F.col("conv_id").alias("pair"), F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("left"), "role").distinct()
    plan = files.select("pair", "left", F.col("left").alias("right"), F.when(F.col("pair") % 5 == 0, "test").alias("held_out")).distinct()
    mapping = left.where("file % 6 <> 4").select(F.col("file").alias("pair"), F.col("speaker").alias("l"), F.concat(F.lit("S-"), "speaker").alias("r")).distinct()
    return plan, left, right, mapping


_SIDES = rf"""WITH {U}, w AS (SELECT file, speaker, utt, unnest(words) AS text, unnest(range(len(words))) AS pos FROM u),
l AS (SELECT *, CASE WHEN pos % 5 <> 1 THEN utt * 100000 + pos * 300 END AS s, CASE WHEN pos % 5 <> 1 THEN utt * 100000 + pos * 300 + 250 END AS e, CASE WHEN length(text) % 2 = 0 THEN 'X' ELSE 'Y' END AS upos FROM w),
r AS (SELECT * REPLACE (s + (file + utt + pos) % 40 AS s, e + 2 * ((file + utt + pos) % 40) AS e, CASE WHEN pos % 11 = 3 THEN 'Z' ELSE upos END AS upos) FROM l WHERE file % 6 <> 4 AND NOT (file % 3 = 1 AND pos = 7)),
p AS (SELECT DISTINCT conv_id AS pair, CASE WHEN conv_id % 5 = 0 THEN 'test' END AS held_out FROM conversations),
nl AS (SELECT file, count(*) AS nl FROM l GROUP BY 1), nr AS (SELECT file, count(*) AS nr FROM r GROUP BY 1),
q AS (SELECT pair, held_out, nl, nr, CASE WHEN nl IS NULL THEN 'missing_left' WHEN nr IS NULL THEN 'missing_right' END AS why FROM p LEFT JOIN nl ON nl.file = pair LEFT JOIN nr ON nr.file = pair)"""
_OUT = "CASE WHEN why IS NULL THEN 'compared' ELSE 'unpairable' END AS outcome, why AS reason"


@query("k12_manifest", r"""WITH p AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, CASE WHEN doc_id % 9 = 5 THEN sha256(coalesce(text, '') || '!') ELSE sha256(coalesce(text, '')) END AS h2 FROM documents),
w AS (SELECT doc_id AS pair, CASE WHEN doc_id % 7 = 3 THEN 'missing_right' WHEN doc_id % 11 = 6 THEN 'digest_left' END AS why, h = h2 AS same FROM p)
SELECT pair, CASE WHEN why IS NULL THEN 'compared' ELSE 'unpairable' END AS outcome, why AS reason, CASE WHEN why IS NULL THEN same END AS same FROM w""")
def manifest(spark, d):
    """Artifacts against the digests of their manifests and against each other."""
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    digest = F.sha2(F.col("content").cast("binary"), 256)
    left = t.select("path", "content", F.when(F.col("doc_id") % 11 == 6, "0").otherwise(F.upper(digest)).alias("sha256"))
    other = t.where("doc_id % 7 <> 3").withColumn("content", F.when(F.col("doc_id") % 9 == 5, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    plan = t.select(F.col("doc_id").alias("pair"), F.col("path").alias("left"), F.col("path").alias("right"), F.lit(None).cast("string").alias("held_out"))
    return runs.by_manifest(plan, left, other.select("path", "content", digest.alias("sha256"))).select("pair", "outcome", "reason", "same")


@query("k12_transcription", f"""{_SIDES},
a AS (SELECT file, speaker, lower(text) AS w, count(*) AS n FROM l GROUP BY 1, 2, 3), b AS (SELECT file, speaker, lower(text) AS w, count(*) AS n FROM r GROUP BY 1, 2, 3),
o AS (SELECT a.file, sum(least(a.n, b.n)) AS overlap FROM a JOIN b ON a.file = b.file AND a.speaker = b.speaker AND a.w = b.w WHERE a.w <> 'the' GROUP BY 1),
t AS (SELECT file, sum(n) AS n FROM (SELECT file, n, w FROM a UNION ALL SELECT file, n, w FROM b) WHERE w <> 'the' GROUP BY 1)
SELECT pair, {_OUT}, held_out, CASE WHEN why IS NULL THEN nl END AS left_tokens, CASE WHEN why IS NULL THEN nr END AS right_tokens, CASE WHEN why IS NULL THEN coalesce(overlap, 0) END::BIGINT AS overlap,
 round(CASE WHEN why IS NULL THEN CASE WHEN t.n > 0 THEN 2 * coalesce(overlap, 0) / t.n ELSE 0 END END, 6) AS agreement
FROM q LEFT JOIN o ON o.file = pair LEFT JOIN t ON t.file = pair""")  # fmt: skip
def transcription(spark, d):
    plan, left, right, mapping = parts(spark, d)
    return runs.by_transcription(plan, left, right, ["The"], mapping).withColumn("agreement", F.round("agreement", 6))


@query("k12_alignment", f"""{_SIDES},
g AS (SELECT pair, held_out, nl, coalesce(why, CASE WHEN nl <> nr THEN 'token_identity' END) AS why FROM q),
x AS (SELECT l.file, abs(l.s - r.s) AS ds, abs(l.e - r.e) AS de FROM l JOIN r ON l.file = r.file AND l.utt = r.utt AND l.pos = r.pos WHERE l.s IS NOT NULL),
z AS (SELECT file, count(*) AS n, min(ds) AS s0, quantile_disc(ds, 0.5) AS s50, quantile_disc(ds, 0.95) AS s95, max(ds) AS s100, min(de) AS e0, quantile_disc(de, 0.5) AS e50, quantile_disc(de, 0.95) AS e95, max(de) AS e100 FROM x GROUP BY 1)
SELECT pair, {_OUT}, held_out, CASE WHEN why IS NULL THEN nl END AS tokens, CASE WHEN why IS NULL THEN coalesce(n, 0) END AS start_delta_n, CASE WHEN why IS NULL THEN s0 END AS start_delta_min, CASE WHEN why IS NULL THEN s50 END AS start_delta_median,
 CASE WHEN why IS NULL THEN s95 END AS start_delta_p95, CASE WHEN why IS NULL THEN s100 END AS start_delta_max, CASE WHEN why IS NULL THEN coalesce(n, 0) END AS end_delta_n, CASE WHEN why IS NULL THEN e0 END AS end_delta_min,
 CASE WHEN why IS NULL THEN e50 END AS end_delta_median, CASE WHEN why IS NULL THEN e95 END AS end_delta_p95, CASE WHEN why IS NULL THEN e100 END AS end_delta_max
FROM g LEFT JOIN z ON z.file = pair""")  # fmt: skip
def alignment(spark, d):
    plan, left, right, mapping = parts(spark, d)
    return runs.by_alignment(plan, left, right, mapping).drop("left_violations", "right_violations")


@query("k12_morphology", f"""{_SIDES},
m AS (SELECT l.file, count(*) AS tokens, count(*) FILTER (r.file IS NULL) AS missing_right, count(*) FILTER (l.upos <> r.upos) AS upos_differs, count(*) FILTER (r.file IS NOT NULL AND l.pos % 13 = 0) AS feats_differs,
 count(*) FILTER (r.file IS NULL OR l.upos <> r.upos OR l.pos % 13 = 0) AS differing FROM l LEFT JOIN r ON l.file = r.file AND l.utt = r.utt AND l.pos = r.pos GROUP BY 1)
SELECT pair, {_OUT}, held_out, CASE WHEN why IS NULL THEN tokens END AS tokens, CASE WHEN why IS NULL THEN differing END AS differing, CASE WHEN why IS NULL THEN upos_differs END AS upos_differs,
 CASE WHEN why IS NULL THEN feats_differs END AS feats_differs, CASE WHEN why IS NULL THEN missing_right END AS missing_right
FROM q LEFT JOIN m ON m.file = pair""")  # fmt: skip
def morphology(spark, d):
    plan, left, right, mapping = parts(spark, d)
    return runs.by_morphology(plan, left, right, ["text", "upos", "lemma", "feats"], mapping).select("pair", "outcome", "reason", "held_out", "tokens", "differing", "upos_differs", "feats_differs", "missing_right")
