"""Word lists, speaker maps, artifact pairs, reports, language rules and named strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import languages
from turnwise.functions.numbers import expanded
from turnwise.operators import evaluation, joins, lexicons, morphology
from turnwise.plans import strategies
from turnwise.queries.base import SW, U, query, utterances
from turnwise.queries.matching import _tokens
from turnwise.queries.text import _TAG, CONFORM, qs, tagged, words
from turnwise.session import table


@query("c32_lexicon_conform", f"WITH {SW} SELECT file, utt, pos, array_to_string({CONFORM}, ' ') AS conformed FROM w")
def c32(spark, d):
    """As h01, with the word lists as tables."""
    out = lexicons.conformed(words(spark, d), lexicons.builtin(spark), "w", "c")
    return out.select("file", "utt", F.col("pos").cast("long").alias("pos"), F.array_join("c", " ").alias("conformed"))


@query("b04_pos_labels", f"WITH {_TAG} SELECT file, utt, string_agg(CASE WHEN mor LIKE 'L2|%' THEN 'L2' ELSE 'N' END, ' ' ORDER BY pos) AS labels FROM g WHERE mor IS NOT NULL AND w NOT LIKE '%~%' AND w NOT LIKE '%$%' GROUP BY 1, 2")
def b04(spark, d):
    t = tagged(spark, d).where("mor IS NOT NULL").where(~F.col("w").rlike("[~$]"))
    items = t.groupBy("file", "utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mor"))), lambda x: x["mor"]).alias("m"))
    return items.select("file", "utt", F.array_join(morphology.pos_labels(F.col("m")), " ").alias("labels"))


@query("c10_speaker_map", f"""WITH {U}, w AS (SELECT file, speaker, unnest(words) AS token FROM u), m AS (SELECT DISTINCT file, speaker FROM u WHERE speaker <> 'system'),
s AS (SELECT file, speaker || '=S-' || speaker AS pair, side FROM w JOIN m USING (file, speaker), (SELECT unnest(['left', 'right']) AS side))
SELECT file, pair, side, count(*) AS n FROM s GROUP BY 1, 2, 3""")  # fmt: skip
def c10(spark, d):
    left = utterances(spark, d).select("file", "speaker", F.explode("words").alias("token"))
    right = left.withColumn("speaker", F.concat(F.lit("S-"), "speaker"))
    rules = utterances(spark, d).where("speaker <> 'system'").select("file", F.col("speaker").alias("l"), F.concat(F.lit("S-"), "speaker").alias("r"))
    return joins.apply_speaker_map(left, right, rules)[0].groupBy("file", "pair", "side").agg(F.count("*").alias("n"))


@query("c10_map_problems", f"WITH {U} SELECT file, 'left' AS side, 'nobody' AS speaker, 'unknown' AS problem FROM u GROUP BY file UNION ALL SELECT file, 'right', 'user', 'twice' FROM u WHERE speaker = 'user' GROUP BY file UNION ALL SELECT file, 'right', 'user', 'unknown' FROM u GROUP BY file HAVING NOT bool_or(speaker = 'user')")
def c10b(spark, d):
    """A map that names someone who is not there, and one speaker twice."""
    u = utterances(spark, d)
    side = u.select("file", "speaker", F.lit("x").alias("token"))
    files = u.groupBy("file").agg(F.bool_or(F.col("speaker") == "user").alias("has"))
    first = F.array(F.struct(F.lit("nobody").alias("l"), F.lit("user").alias("r")))
    both = F.array_append(first, F.struct(F.lit("user").alias("l"), F.lit("user").alias("r")))
    rules = files.select("file", F.explode(F.when(F.col("has"), both).otherwise(first)).alias("m")).select("file", "m.l", "m.r")
    return joins.apply_speaker_map(side, side, rules)[1].select("file", "side", "speaker", "problem")


@query("c11_artifact_pairs", "SELECT 'a/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 = 0 THEN 'missing_both' WHEN doc_id % 5 = 0 THEN 'missing_left' WHEN doc_id % 7 = 0 THEN 'missing_right' WHEN doc_id % 3 = 0 AND lang IS DISTINCT FROM source THEN 'different' ELSE 'equal' END AS outcome FROM documents")
def c11(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("content"), "source")
    other = rows.where("doc_id % 7 <> 0").withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("content")))
    return joins.artifact_pairs(rows, rows.where("doc_id % 5 <> 0"), other).select("path", "outcome")


@query("f08_candidate_maps", f"""WITH {U}, w AS (SELECT file, speaker, lower(unnest(words)) AS token FROM u), l AS (SELECT file, speaker AS l, token, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT file, speaker AS r, token, count(*) AS m FROM w GROUP BY ALL),
o AS (SELECT file, l, r, sum(least(n, m)) AS overlap FROM l JOIN r USING (file, token) GROUP BY 1, 2, 3)
SELECT file, l, r, overlap::BIGINT AS overlap, (row_number() OVER (PARTITION BY file ORDER BY overlap DESC, l, r))::INT AS rank FROM o""")  # fmt: skip
def f08(spark, d):
    w = utterances(spark, d).select("file", "speaker", F.explode(F.transform("words", F.lower)).alias("token"))
    pairs = joins.token_overlaps(w, w)
    return joins.candidate_maps(pairs.union(pairs), ["file"]).select("file", "l", "r", "overlap", "rank")


@query("g04_ranges", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '1,2,3|4' WHEN 1 THEN '1,2,3' ELSE '1,2,3|3,4' END AS kept, CASE event_id % 3 WHEN 0 THEN '1,2,3' WHEN 1 THEN '1' ELSE '1,2' END AS free FROM events")
def g04(spark, d):
    """Ranges inside other ranges go, and positions that are taken."""
    i = F.col("event_id") % 3
    last = F.when(i == 0, F.array(F.lit(4))).when(i == 1, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(3), F.lit(4)))
    ranges = F.array(F.array(F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(2), F.lit(3)), last)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    kept = F.array_join(F.transform(joins.without_subsets(ranges), text), "|")
    return table(spark, d, "events").select("event_id", kept.alias("kept"), text(joins.range_subtraction(F.array(F.lit(3), F.lit(1), F.lit(2)), last)).alias("free"))


def _evaluated(spark, d):
    t = tagged(spark, d).select("file", F.concat("lang", F.lit(",spa")).alias("pair"), F.col("w").alias("text"), "lang", F.col("upos").alias("pos"), "feats", morphology.status(F.col("mor")).alias("status"))
    return t.withColumn("flags", morphology.flags(F.col("text"), F.col("lang"), F.col("pos"), F.col("feats"), F.col("status")))


@query("a18_flagged_words", f"""WITH {_TAG} SELECT file, lang || ',spa' AS pair, w AS text, status, CASE WHEN status <> 'spliced' THEN status ELSE array_to_string(list_filter([CASE WHEN f1 THEN 'propn_for_function_word' END, CASE WHEN f2 THEN 'feature_pos_mismatch' END], lambda x: x IS NOT NULL), ';') END AS flags
FROM fl WHERE status <> 'spliced' OR f1 OR f2""")  # fmt: skip
def a18(spark, d):
    return evaluation.flagged(_evaluated(spark, d)).select("file", "pair", "text", "status", "flags")


@query("a19_evaluation_summary", f"""WITH {_TAG}, p AS (SELECT lang || ',spa' AS pair, count(DISTINCT file) AS files, count(*) AS total, count(*) FILTER (status = 'spliced') AS spliced, count(*) FILTER (status = 'spliced' AND NOT f1 AND NOT f2) AS clean FROM fl GROUP BY 1)
SELECT '# Evaluation' || chr(10) || chr(10) || '| pair | files | total | spliced | clean |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg('| ' || pair || ' | ' || files || ' | ' || total || ' | ' || spliced || ' | ' || clean || ' |', chr(10) ORDER BY pair)
 || chr(10) || chr(10) || 'Words: ' || sum(total) || ', clean: ' || sum(clean) AS markdown FROM p""")  # fmt: skip
def a19(spark, d):
    pairs = evaluation.per_pair(_evaluated(spark, d), ["spliced"], []).select("pair", "files", "total", "spliced", "clean")
    return evaluation.summary(pairs, "Evaluation")


@query("h25_language_rules", f"""WITH {SW} SELECT file, utt, pos, CASE WHEN b IN ({qs(languages.FRENCH_NOMINATIVE)}) THEN 'Nom' WHEN b IN ({qs(languages.FRENCH_ACCUSATIVE)}) THEN 'Acc' ELSE '' END AS french, lower(w) IN ({qs(languages.ENGLISH_IRREGULAR["go"])}) AS irregular FROM (SELECT *, trim(trim(lower(w), '''')) AS b FROM w)""")
def h25(spark, d):
    return words(spark, d).select("file", "utt", F.col("pos").cast("long").alias("pos"), languages.french_case(F.col("w")).alias("french"), languages.irregular(F.lit("Go"), F.col("w")).alias("irregular"))


_TEN = {"deu": "null eins zwei drei vier fünf sechs sieben acht neun", "fra": "zéro un deux trois quatre cinq six sept huit neuf", "spa": "cero uno dos tres cuatro cinco seis siete ocho nueve"}


@query("h10_small_numbers", "SELECT event_id, " + ", ".join(f"string_split('{t}', ' ')[event_id % 10 + 1] AS {lang}" for lang, t in _TEN.items()) + " FROM events")
def h10(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 10).cast("string").alias("n"))
    return e.select("event_id", *[expanded(F.col("n"), F.lit(lang)).alias(lang) for lang in _TEN])


@query("j03_recovery_strategy", f"WITH {U} SELECT file, utt, CASE WHEN len(words) > 0 THEN utt * 100000 END AS start_ms, CASE WHEN len(words) > 0 THEN (utt * 1000 + len(words) - 1) * 100 + 90 END AS end_ms FROM u")
def j03(spark, d):
    """No utterance is marked as overlapping, so that every file takes the pass over the whole of it."""
    u = utterances(spark, d).select("file", "utt", "words", F.lit(False).alias("has_overlap"))
    return strategies.recover(u, _tokens(u))


@query("j05_item_overrides", f"WITH {U} SELECT file, utt, array_to_string(list_transform(words, lambda x: CASE WHEN lower(x) = 'the' THEN 'DET' WHEN lower(x) IN ('und', 'and') THEN '&' ELSE x END), ' ') AS items FROM u")
def j05(spark, d):
    rules = [(lambda x: F.lower(x) == "the", lambda x: F.lit("DET")), (lambda x: F.lower(x).isin("und", "and"), lambda x: F.lit("&"))]
    return utterances(spark, d).select("file", "utt", F.array_join(strategies.override_items(F.col("words"), rules), " ").alias("items"))
