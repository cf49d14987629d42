"""Rule cascades over the words of conversations, and incremental alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.operators import cascades, incremental
from turnwise.queries.base import DURATION, SPANS, U, query, spans, utterances

# Rules on the made-up words of the tables: (priority, text_is, text_has, upos, new_upos, new_lemma).
RULES = [(0, None, "tion", None, "NOUN", None), (1, None, "tion", "X", "PROPN", None), (2, "the", None, None, "DET", "the"), (3, None, "er", "X", "VERB", None), (4, None, "in", "Y", "ADP", "in"), (5, "is", None, None, "AUX", "be")]
_sq = lambda v: "NULL" if v is None else f"'{v}'"
_VALUES = ", ".join(f"('user', {p}, {_sq(a)}, {_sq(b)}, {_sq(u)}, {_sq(n)}, {_sq(m)})" for p, a, b, u, n, m in RULES)


def words(spark, d):
    """Words with the speaker as language and a class by their length."""
    w = utterances(spark, d).select("file", "utt", F.col("speaker").alias("lang"), F.posexplode("words").alias("pos", "text"))
    return w.withColumns({"lemma": F.lower("text"), "upos": F.when(F.length("text") % 2 == 0, "X").otherwise("Y"), "feats": F.lit(None).cast("string")})


@query("h25_rule_cascade", rf"""WITH {U}, w AS (SELECT file, utt, speaker AS lang, unnest(words) AS text, unnest(range(len(words))) AS pos FROM u),
i AS (SELECT *, lower(text) AS lemma, CASE WHEN length(text) % 2 = 0 THEN 'X' ELSE 'Y' END AS upos FROM w),
r(lang, priority, text_is, text_has, cls, new_upos, new_lemma) AS (VALUES {_VALUES}),
m AS (SELECT i.*, r.priority, r.new_upos, r.new_lemma, row_number() OVER (PARTITION BY file, utt, pos ORDER BY r.priority NULLS LAST) AS k
 FROM i LEFT JOIN r ON r.lang = i.lang AND (text_is IS NULL OR lower(text) = text_is) AND (text_has IS NULL OR contains(text, text_has)) AND (cls IS NULL OR cls = upos))
SELECT file, utt, pos, text, coalesce(new_upos, upos) AS upos, coalesce(new_lemma, lemma) AS lemma, priority AS rule FROM m WHERE k = 1""")
def h25_cascade(spark, d):
    """Rules as rows; of those that hold, the first decides."""
    rows = [("user", p, a, b, None, None, [u] if u else None, n, m, None) for p, a, b, u, n, m in RULES]
    return cascades.applied(words(spark, d), spark.createDataFrame(rows, cascades.RULE)).select("file", "utt", "pos", "text", "upos", "lemma", "rule")


@query("h25_range_rules", rf"""WITH {U}, w AS (SELECT file, utt, unnest(words) AS text, unnest(range(1, len(words) + 1)) AS id, len(words) AS n FROM u),
i AS (SELECT *, CASE WHEN id % 3 = 0 THEN id - 2 ELSE id - 1 END AS head FROM w),
r AS (SELECT a.file, a.utt, a.id AS first, a.id + 1 AS last, a.text || b.text AS text FROM w a JOIN w b ON b.file = a.file AND b.utt = a.utt AND b.id = a.id + 1 WHERE a.id % 5 = 2),
h AS (SELECT * FROM r WHERE length(text) % 3 = 0),
p AS (SELECT i.*, h.first, h.text AS whole, i.id = h.last AND h.last IS NOT NULL AS gone FROM i LEFT JOIN h ON h.file = i.file AND h.utt = i.utt AND i.id BETWEEN h.first AND h.last),
q AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY file, utt ORDER BY id) AS nid FROM p)
SELECT q.file, q.utt, q.nid::BIGINT AS id, coalesce(q.whole, q.text) AS text, CASE WHEN q.head = 0 THEN 0 ELSE t.nid END::BIGINT AS head, CASE WHEN q.whole IS NULL THEN 'X' ELSE 'ONE' END AS upos
FROM q LEFT JOIN q t ON t.file = q.file AND t.utt = q.utt AND t.id = q.head WHERE NOT q.gone""")
def h25_ranges(spark, d):
    """Words that were split are put together where a rule has them; heads are numbered anew."""
    w = words(spark, d).where(F.col("pos").isNotNull()).select("file", "utt", F.lit("x").alias("lang"), (F.col("pos") + 1).cast("long").alias("id"), "text", "lemma", F.lit("X").alias("upos"), "feats", F.lit("dep").alias("deprel"))
    items = w.withColumn("head", F.when(F.col("id") % 3 == 0, F.col("id") - 2).otherwise(F.col("id") - 1))
    two = w.where("id % 5 = 2").select("file", "utt", F.col("id").alias("first"), F.col("text").alias("a")).join(w.select("file", "utt", (F.col("id") - 1).alias("first"), F.col("text").alias("b")), ["file", "utt", "first"])
    ranges = two.select("file", "utt", "first", (F.col("first") + 1).alias("last"), F.concat("a", "b").alias("text"))
    rules = ranges.where(F.length("text") % 3 == 0).select(F.lit("x").alias("lang"), F.lower("text").alias("text")).distinct()
    rules = rules.select("lang", "text", F.lit("one").alias("kind"), F.lit("ONE").alias("new_upos"), F.lit(None).cast("string").alias("new_lemma"), F.lit(None).cast("string").alias("new_feats"))
    return cascades.regrouped(items, ranges, rules).select("file", "utt", "id", "text", "head", "upos")


@query("i07_incremental_groups", f"""WITH RECURSIVE {SPANS}, n AS (SELECT file, line, event_id, start_ms AS s, end_ms AS e, n_chars AS c, row_number() OVER (PARTITION BY file ORDER BY line) AS k FROM t),
r AS (SELECT file, k, line, event_id, 0 AS grp, s AS a, e AS z, c AS chars FROM n WHERE k = 1
 UNION ALL SELECT n.file, n.k, n.line, n.event_id, CASE WHEN x THEN grp + 1 ELSE grp END, CASE WHEN x THEN n.s ELSE a END, n.e, CASE WHEN x THEN n.c ELSE chars + n.c END
  FROM (SELECT r.*, n.e <= r.a OR n.e - r.a > {L.GROUP_MS_NARROW} OR r.chars + n.c > {L.GROUP_CHARS} AS x FROM r JOIN n ON n.file = r.file AND n.k = r.k + 1) r JOIN n ON n.file = r.file AND n.k = r.k + 1)
SELECT file, grp::INT AS grp, bool_and(event_id % 17 <> 0) AS kept, string_agg(line::VARCHAR, ',' ORDER BY k) AS lines FROM r GROUP BY 1, 2""")  # fmt: skip
def i07_groups(spark, d):
    """Each seventeenth event is edited: the groups that hold one go to the engine again, the others keep their times."""
    s = spans(spark, d)
    edited = F.col("event_id") % 17 == 0
    row = lambda words: s.select("file", F.col("line").alias("utt"), "speaker", words.alias("words"), "start_ms", "end_ms", "n_chars")
    before = row(F.concat(F.lit("e"), F.col("event_id").cast("string")))
    after = row(F.concat(F.when(edited, F.lit("x")).otherwise(F.lit("e")), F.col("event_id").cast("string")))
    times = s.select("file", F.col("line").alias("utt"), F.lit(0).alias("pos"), "start_ms", "end_ms")
    groups, _ = incremental.plan(before, after, times, L.GROUP_MS_NARROW, DURATION)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "utt"))), lambda x: x["utt"].cast("string")), ",")
    return groups.groupBy("file", "grp").agg(F.bool_and("kept").alias("kept"), lines.alias("lines"))
