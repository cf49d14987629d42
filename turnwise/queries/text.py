"""Text rules: projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import numbers, sequences
from turnwise.functions import words as W
from turnwise.operators import joins, morphology, segmentation
from turnwise.queries.base import SW, S, U, query, spiced, utterances
from turnwise.session import table
from turnwise.sources import payloads, transcripts


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qs(xs) -> str:
    return ", ".join(q(x) for x in xs)


def _map(d: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in d.items()) + " END"


def words(spark, d):
    return spiced(spark, d).select("file", "utt", "speaker", F.posexplode("words").alias("pos", "w"))


_PF = f"(trim(w) IN ({qs(L.TERMINATORS + L.SEPARATORS)}) OR lower(trim(w)) IN ({qs(L.FILLERS)}))"


@query("b01_flatten_words", f"WITH {SW} SELECT file, utt, pos, (row_number() OVER (PARTITION BY file, utt ORDER BY pos) - 1)::INT AS compact_pos, w FROM w WHERE NOT {_PF}")
def b01(spark, d):
    """Content words with their position as written and without the others."""
    content = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("w"))), lambda x: ~W.is_punct_or_filler(x["w"]))
    return spiced(spark, d).select("file", "utt", F.posexplode(content).alias("compact_pos", "x")).select("file", "utt", F.col("x.pos").cast("long").alias("pos"), "compact_pos", F.col("x.w").alias("w"))


@query("b02_punct_or_filler", f"WITH {SW} SELECT speaker, count(*) FILTER ({_PF}) AS marks, count(*) AS words FROM w GROUP BY 1")
def b02(spark, d):
    return words(spark, d).groupBy("speaker").agg(F.count_if(W.is_punct_or_filler(F.col("w"))).alias("marks"), F.count("*").alias("words"))


@query("b05_terminators", f"WITH {S} SELECT file, utt, CASE WHEN words[-1] IN ({qs(L.TERMINATORS)}) THEN words[-1] END AS terminator FROM s")
def b05(spark, d):
    last = F.try_element_at("words", F.lit(-1))
    return spiced(spark, d).select("file", "utt", F.when(last.isin(L.TERMINATORS), last).alias("terminator"))


@query("b06_excluded_words", f"WITH {SW} SELECT file, speaker, count(*) FILTER (lower(w) NOT IN ('um', 'ok', ',')) AS kept, count(*) FILTER (lower(w) IN ('um', 'ok', ',')) AS excluded FROM w GROUP BY 1, 2")
def b06(spark, d):
    return joins.speaker_words(words(spark, d), ["um", "ok", ","])


@query("b07_timed_words", """WITH a AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '<noise>' WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END AS w, value AS s, CASE WHEN event_id % 3 = 0 THEN value - 0.2 ELSE value + 0.3 END AS e FROM events)
SELECT event_id, w, CASE WHEN round(e * 1000) > round(s * 1000) THEN round(s * 1000)::BIGINT END AS start_ms, CASE WHEN round(e * 1000) > round(s * 1000) THEN round(e * 1000)::BIGINT END AS end_ms
FROM a WHERE trim(w) <> '' AND NOT (w LIKE '<%' AND w LIKE '%>')""")  # fmt: skip
def b07(spark, d):
    e = table(spark, d, "events")
    w = F.when(F.col("event_id") % 7 == 0, "<noise>").when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("event_type"))
    end = F.when(F.col("event_id") % 3 == 0, F.col("value") - 0.2).otherwise(F.col("value") + 0.3)
    rows = e.select("event_id", F.trim(w).alias("w"), W.timed_range(F.col("value"), end).alias("t")).where((F.col("w") != "") & ~(F.col("w").startswith("<") & F.col("w").endswith(">")))
    return rows.select("event_id", "w", "t.start_ms", "t.end_ms")


@query("b08_boundary_marks", f"WITH {SW} SELECT file, utt, pos, trim(trim(w, ',„‡،؛'), '\"“”„‘’«»') AS w FROM w WHERE trim(trim(w, ',„‡،؛'), '\"“”„‘’«»') <> ''")
def b08(spark, d):
    return words(spark, d).select("file", "utt", F.col("pos").cast("long").alias("pos"), W.strip_boundary(W.strip_boundary(F.col("w"), W.COMMAS), W.QUOTES).alias("w")).where("w <> ''")


_UD = "SELECT conv_id AS file, turn AS utt"


@query("b09_tagging_payload", f"""WITH {U} SELECT file, utt, 'eng' AS language,
 CASE WHEN file % 10 = 0 THEN 'ca_mode' WHEN len(words) = 0 THEN 'empty' WHEN utt % 4 = 3 THEN 'already_tagged' WHEN CASE WHEN utt % 5 = 2 THEN 'spa' ELSE 'eng' END <> 'eng' THEN 'other_language' END AS not_applicable FROM u""".replace("'eng' AS language", "CASE WHEN utt % 5 = 2 THEN 'spa' ELSE 'eng' END AS language"))  # fmt: skip
def b09(spark, d):
    u = utterances(spark, d).withColumns({"lang": F.when(F.col("utt") % 5 == 2, "spa"), "has_mor": F.col("utt") % 4 == 3, "mode": F.when(F.col("file") % 10 == 0, "CA")})
    declared = u.select("file").distinct().withColumn("languages", F.array(F.lit("eng"), F.lit("spa")))
    return morphology.tagging_payload(u, declared, "eng").select("file", "utt", "language", "not_applicable")


@query("b10_segmentation_payload", f"WITH {U} SELECT CASE WHEN len(words) = 0 THEN 'empty' WHEN len(words) = 1 THEN 'single_word' ELSE 'dispatch' END AS class, count(*) AS n, sum(len(words))::BIGINT AS words FROM u GROUP BY 1")
def b10(spark, d):
    return utterances(spark, d).groupBy(morphology.segmentation_class(F.col("words")).alias("class")).agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words"))


@query("b11_translation_payload", f"WITH {U} SELECT file, utt, array_to_string(words, ' ') AS text FROM u WHERE len(words) > 0")
def b11(spark, d):
    return morphology.translation_payload(utterances(spark, d))


@query("b12_coreference_payload", f"WITH {U} SELECT file, string_agg(array_to_string(words, ' '), '|' ORDER BY utt) AS sentences, count(*) AS n FROM u GROUP BY 1")
def b12(spark, d):
    g = morphology.coreference_payload(utterances(spark, d))
    return g.select("file", F.array_join(F.transform("sentences", lambda x: F.array_join(x["words"], " ")), "|").alias("sentences"), F.size("sentences").cast("long").alias("n"))


@query("b16_empty_translations", f"WITH {U} SELECT file, utt, CASE WHEN utt % 3 = 0 THEN '.' WHEN utt % 3 = 1 THEN '' ELSE 'x' END AS content FROM u WHERE trim(CASE WHEN utt % 3 = 0 THEN '.' WHEN utt % 3 = 1 THEN '' ELSE 'x' END) NOT IN ('', '.', '!', '?')")
def b16(spark, d):
    c = F.when(F.col("utt") % 3 == 0, ".").when(F.col("utt") % 3 == 1, "").otherwise("x")
    return utterances(spark, d).select("file", "utt", c.alias("content")).where(~W.is_empty_translation(F.col("content")))


_POS = "CASE WHEN upper(w[1]) = w[1] AND lower(w[1]) <> w[1] THEN 'PROPN' WHEN pos % 3 = 0 THEN 'NOUN' WHEN pos % 3 = 1 THEN 'VERB' ELSE 'DET' END"
_FEATS = "CASE WHEN pos % 4 = 0 THEN 'Tense=Past' WHEN pos % 4 = 1 THEN 'Gender=Fem' ELSE '_' END"
_MOR = "CASE WHEN pos % 9 = 4 THEN NULL WHEN pos % 9 = 5 THEN 'L2|xxx' ELSE 'n|' || w END"


def tagged(spark, d):
    head = F.substring("w", 1, 1)
    pos = F.when((F.upper(head) == head) & (F.lower(head) != head), "PROPN").when(F.col("pos") % 3 == 0, "NOUN").when(F.col("pos") % 3 == 1, "VERB").otherwise("DET")
    feats = F.when(F.col("pos") % 4 == 0, "Tense=Past").when(F.col("pos") % 4 == 1, "Gender=Fem").otherwise("_")
    mor = F.when(F.col("pos") % 9 == 4, F.lit(None)).when(F.col("pos") % 9 == 5, "L2|xxx").otherwise(F.concat(F.lit("n|"), "w"))
    lang = F.when(F.col("file") % 2 == 0, "eng").otherwise("fra")
    return words(spark, d).select("file", "utt", "pos", "w", pos.alias("upos"), feats.alias("feats"), mor.alias("mor"), lang.alias("lang"))


_TAG = f"""{SW}, g AS (SELECT file, utt, pos, w, {_POS} AS upos, {_FEATS} AS feats, {_MOR} AS mor, CASE WHEN file % 2 = 0 THEN 'eng' ELSE 'fra' END AS lang FROM w),
st AS (SELECT *, CASE WHEN mor IS NULL THEN 'missing_mor' WHEN mor LIKE 'L2|%' THEN 'l2xxx' ELSE 'spliced' END AS status FROM g),
fl AS (SELECT *, status = 'spliced' AND upos = 'PROPN' AND ((lang = 'eng' AND lower(w) IN ({qs(L.FUNCTION_WORDS["eng"])})) OR (lang = 'fra' AND lower(w) IN ({qs(L.FUNCTION_WORDS["fra"])}))) AS f1,
 status = 'spliced' AND ((upos = 'NOUN' AND feats LIKE 'Tense=%') OR (upos = 'VERB' AND feats LIKE 'Gender=%')) AS f2 FROM st)"""


@query("b18_tagging_flags", f"WITH {_TAG} SELECT lang, count(*) FILTER (f1) AS propn_for_function_word, count(*) FILTER (f2) AS feature_pos_mismatch FROM fl GROUP BY 1")
def b18(spark, d):
    t = tagged(spark, d)
    f = morphology.flags(F.col("w"), F.col("lang"), F.col("upos"), F.col("feats"), morphology.status(F.col("mor")))
    n = lambda x: F.count_if(F.array_contains("f", x)).alias(x)
    return t.withColumn("f", f).groupBy("lang").agg(n("propn_for_function_word"), n("feature_pos_mismatch"))


@query("b19_tagging_status", f"WITH {_TAG} SELECT status, count(*) AS n FROM st GROUP BY 1")
def b19(spark, d):
    return tagged(spark, d).groupBy(morphology.status(F.col("mor")).alias("status")).agg(F.count("*").alias("n"))


@query("b20_utterance_outcome", f"""WITH {_TAG}, c AS (SELECT file, utt, count(*) AS total, count(*) FILTER (status = 'spliced') AS s, count(*) FILTER (status = 'missing_mor') AS m FROM st GROUP BY 1, 2)
SELECT CASE WHEN total = 0 THEN 'no_foreign_words' WHEN s = total THEN 'all_spliced' WHEN m = total THEN 'none_tagged' ELSE 'partly_spliced' END AS outcome, count(*) AS n FROM c GROUP BY 1""")  # fmt: skip
def b20(spark, d):
    c = tagged(spark, d).withColumn("s", morphology.status(F.col("mor"))).groupBy("file", "utt").agg(F.count("*").alias("total"), F.count_if(F.col("s") == "spliced").alias("sp"), F.count_if(F.col("s") == "missing_mor").alias("mi"))
    return c.groupBy(morphology.utterance_outcome(F.col("total"), F.col("sp"), F.col("mi")).alias("outcome")).agg(F.count("*").alias("n"))


@query("b22_review_tier", """WITH v AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'unsure' WHEN 1 THEN 'conflict' ELSE 'fine' END AS c, CASE event_id % 4 WHEN 0 THEN 'child' WHEN 1 THEN 'adult' ELSE 'mixed' END AS p, CASE event_id % 5 WHEN 0 THEN 'child' WHEN 1 THEN 'adult' ELSE 'none' END AS e FROM events)
SELECT c AS category, CASE WHEN c = 'unsure' THEN CASE WHEN p = 'child' AND e = 'child' THEN 'trust' WHEN p = 'adult' AND e = 'adult' THEN 'demote' ELSE 'review' END WHEN c = 'conflict' THEN CASE WHEN p = 'child' AND e = 'child' THEN 'review' WHEN p = 'adult' AND e = 'adult' THEN 'demote' ELSE 'hold' END ELSE 'untouched' END AS tier, count(*) AS n FROM v GROUP BY 1, 2""")  # fmt: skip
def b22(spark, d):
    i = F.col("event_id")
    c = F.when(i % 3 == 0, "unsure").when(i % 3 == 1, "conflict").otherwise("fine")
    p = F.when(i % 4 == 0, "child").when(i % 4 == 1, "adult").otherwise("mixed")
    e = F.when(i % 5 == 0, "child").when(i % 5 == 1, "adult").otherwise("none")
    v = table(spark, d, "events").select(c.alias("category"), p.alias("p"), e.alias("e"))
    return v.groupBy("category", morphology.review_tier(F.col("category"), F.col("p"), F.col("e")).alias("tier")).agg(F.count("*").alias("n"))


@query("b24_lengths_valid", f"WITH {U} SELECT file, utt, len(words) <> len(words) - (utt % 2) AS bad_length, len(list_distinct(words)) AS distinct_words FROM u")
def b24(spark, d):
    answers = F.slice("words", F.lit(1), F.greatest(F.size("words") - F.col("utt").cast("int") % 2, F.lit(0)))
    answers = F.when((F.size("words") == 0) & (F.col("utt") % 2 != 0), F.array(F.lit("x"))).otherwise(answers)
    c = utterances(spark, d).select("file", "utt", morphology.response_check(F.col("words"), answers).alias("a"), morphology.response_check(F.col("words"), F.col("words")).alias("b"))
    return c.select("file", "utt", "a.bad_length", F.col("b.distinct").alias("distinct_words"))


@query("b26_relations_valid", f"""WITH {U}, h AS (SELECT file, utt, list_transform(words, lambda x, i: CASE WHEN i = 1 THEN 0 WHEN utt % 6 = 5 THEN 99999 ELSE i - 1 END) AS h FROM u)
SELECT file, utt, len(list_filter(h, lambda x: x = 0)) = 1 AND len(list_filter(h, lambda x: x < 0 OR x > len(h))) = 0 AS valid FROM h""")  # fmt: skip
def b26(spark, d):
    h = F.transform("words", lambda w, i: F.when(i == 0, 0).when(F.col("utt") % 6 == 5, 99999).otherwise(i))
    return utterances(spark, d).select("file", "utt", h.alias("h")).select("file", "utt", sequences.relations_valid(F.col("h")).alias("valid"))


@query("b30_runaway_text", "SELECT doc_id, n_chars / (1.0 + doc_id % 300) > 8 AS runaway FROM documents")
def b30(spark, d):
    return table(spark, d, "documents").select("doc_id", payloads.runaway(F.col("text"), 1.0 + F.col("doc_id") % 300).alias("runaway"))


@query("b31_deferred_positions", f"WITH {SW} SELECT file, utt, pos::INT AS pos, w AS text, 'spa' AS lang FROM w WHERE pos % 5 = 2 AND file % 2 = 0")
def b31(spark, d):
    ws = F.transform("words", lambda w, i: F.struct(w.alias("text"), F.when((i % 5 == 2) & (F.col("file") % 2 == 0), "spa").otherwise("eng").alias("lang")))
    return morphology.deferred_positions(spiced(spark, d).select("file", "utt", F.lit("eng").alias("lang"), ws.alias("words")))


@query("c34_secondary_spans", f"""WITH {SW}, f AS (SELECT file, utt, pos, w, CASE WHEN pos % 7 < 4 THEN 'spa' ELSE 'fra' END AS lang FROM w WHERE pos % 5 <> 2),
n AS (SELECT *, (coalesce(pos <> lag(pos) OVER o + 1 OR lang <> lag(lang) OVER o, true))::INT AS b FROM f WINDOW o AS (PARTITION BY file, utt ORDER BY pos)),
g AS (SELECT *, sum(b) OVER (PARTITION BY file, utt ORDER BY pos) AS span FROM n)
SELECT file, utt, span::BIGINT AS span, min(lang) AS lang, min(pos)::INT AS first, max(pos)::INT AS last, string_agg(w, ' ' ORDER BY pos) AS text FROM g GROUP BY 1, 2, 3""")  # fmt: skip
def c34(spark, d):
    f = words(spark, d).where("pos % 5 <> 2").select("file", "utt", "pos", F.col("w").alias("text"), F.when(F.col("pos") % 7 < 4, "spa").otherwise("fra").alias("lang"))
    return morphology.secondary_spans(f)


def _conform_sql() -> str:
    w, t = "lower(trim(w))", "trim(w)"
    arr = lambda xs: "[" + qs(xs) + "]"
    rules = [f"WHEN {w} = {q(a + b)} THEN {arr([a, b])}" for a, b in L.COMPOUNDS]
    rules.append(f"WHEN {t} IN ({qs(L.ABBREVIATIONS)}) THEN string_split({t}, '')")
    rules += [f"WHEN contains({w}, {q(m)}) THEN [split_part({w}, '''', 1), {q(x)}]" for m, x in L.CONTRACTIONS]
    rules += [f"WHEN {w} IN ({qs(L.FILLERS)}) THEN ['um']", f"WHEN contains({w}, '-') THEN list_transform(string_split({w}, '-'), lambda x: trim(x))"]
    rules += [f"WHEN {w} = {q(k)} THEN {arr(v)}" for k, v in L.CONFORM_WORDS.items()]
    rules.append(f"WHEN {w} IN ({qs(L.NAMES)}) THEN ['name']")
    rules += [f"WHEN {w} = {q(k)} THEN {arr(v)}" for k, v in L.CONFORM_LATE.items()]
    rules += [f"WHEN {w} IN ({qs(L.CONFORM_SPELLED)}) THEN string_split({w}, '')", f"WHEN contains({w}, '_') THEN string_split({w}, '_')"]
    return "CASE " + " ".join(rules) + f" ELSE [{w}] END"


CONFORM = _conform_sql()


@query("h01_conform", f"WITH {SW} SELECT file, utt, pos, array_to_string({CONFORM}, ' ') AS conformed FROM w")
def h01(spark, d):
    return words(spark, d).select("file", "utt", F.col("pos").cast("long").alias("pos"), F.array_join(W.conform(F.col("w")), " ").alias("conformed"))


@query("h02_conform_mapping", f"WITH {SW}, c AS (SELECT file, utt, pos, {CONFORM} AS c FROM w), e AS (SELECT file, utt, pos, unnest(c) AS text, unnest(range(len(c))) AS k FROM c) SELECT file, utt, (row_number() OVER (PARTITION BY file, utt ORDER BY pos, k) - 1)::INT AS seq, text, pos::INT AS source FROM e")
def h02(spark, d):
    return spiced(spark, d).select("file", "utt", F.posexplode(W.conform_mapped(F.col("words"))).alias("seq", "x")).select("file", "utt", "seq", "x.text", "x.source")


@query("h03_normalise", f"WITH {SW} SELECT file, utt, pos, replace(replace(lower('(' || w || ')'), '(', ''), ')', '') AS normal, replace(w, '-', '') AS dashless FROM w")
def h03(spark, d):
    return words(spark, d).select("file", "utt", F.col("pos").cast("long").alias("pos"), W.normalise_for_wer(F.concat(F.lit("("), "w", F.lit(")"))).alias("normal"), W.without_dashes(F.col("w")).alias("dashless"))


@query("h04_characters", f"WITH {S} SELECT file, utt, length(array_to_string(words, ''))::INT AS n, array_to_string(string_split(array_to_string(words, ''), ''), '.') AS head FROM s")
def h04(spark, d):
    return spiced(spark, d).select("file", "utt", F.size(W.characters(F.col("words"))).alias("n"), F.array_join(W.characters(F.col("words")), ".").alias("head"))


@query("h05_number_words")
def h05(spark, d):
    """Numbers as words; rows are checked by tests against the plain rules."""
    n = table(spark, d, "orders").select((F.col("o_orderkey") % 3000).cast("string").alias("n")).distinct()
    forms = n.select("n", F.explode(F.array("n", F.concat("n", F.lit("th")), F.concat("n", F.lit("s")), F.concat(F.lit("$"), "n"))).alias("word"))
    return forms.select("n", "word", numbers.expanded(F.col("word"), F.lit("eng")).alias("said"))


@query("h06_expansion_mode", r"""WITH n AS (SELECT DISTINCT o_orderkey % 3000 AS n FROM orders), f AS (SELECT n, unnest([n::VARCHAR, n || 'th', n || 's', 'x' || n]) AS word FROM n)
SELECT word, try_cast(nullif(regexp_extract(word, '^([0-9]+)(s|st|nd|rd|th)?$', 1), '') AS BIGINT) AS number,
 CASE WHEN regexp_extract(word, '^([0-9]+)(s|st|nd|rd|th)?$', 1) = '' THEN NULL WHEN word LIKE '%th' THEN 'ordinal' WHEN word LIKE '%s' THEN 'decade' ELSE 'cardinal' END AS mode FROM f""")  # fmt: skip
def h06(spark, d):
    n = table(spark, d, "orders").select((F.col("o_orderkey") % 3000).cast("string").alias("n")).distinct()
    forms = n.select(F.explode(F.array("n", F.concat("n", F.lit("th")), F.concat("n", F.lit("s")), F.concat(F.lit("x"), "n"))).alias("word"))
    return forms.withColumn("m", numbers.expansion_mode(F.col("word"))).select("word", F.col("m.n").alias("number"), F.col("m.mode").alias("mode"))


@query("h08_chinese_numbers")
def h08(spark, d):
    n = table(spark, d, "orders").select((F.col("o_orderkey") * 7919 % 1_000_003).cast("string").alias("n")).distinct()
    return n.select("n", numbers.expanded(F.col("n"), F.lit("zho")).alias("simplified"), numbers.expanded(F.col("n"), F.lit("jpn")).alias("traditional"))


@query("h09_percent", f"WITH {SW} SELECT file, utt, pos, CASE WHEN regexp_matches(w, '^[0-9]+%$') THEN rtrim(w, '%') || ' percent' ELSE w END AS w FROM w")
def h09(spark, d):
    return words(spark, d).select("file", "utt", F.col("pos").cast("long").alias("pos"), F.array_join(W.percent_split(F.col("w"), "eng"), " ").alias("w"))


@query("h11_split_with_times", f"""WITH {U}, p AS (SELECT file, utt, words, utt * 1000 AS s, utt * 1000 + 777 AS e, length(array_to_string(words, '')) AS total FROM u),
e AS (SELECT file, utt, s, e, total, unnest(words) AS text, unnest(range(len(words))) AS i FROM p),
c AS (SELECT *, sum(length(text)) OVER (PARTITION BY file, utt ORDER BY i) AS t, sum(length(text)) OVER (PARTITION BY file, utt ORDER BY i) - length(text) AS f FROM e)
SELECT file, utt, i::INT AS part, text, (s + (e - s) * f // total)::BIGINT AS start_ms, (s + (e - s) * t // total)::BIGINT AS end_ms FROM c""")  # fmt: skip
def h11(spark, d):
    start = F.col("utt") * 1000
    u = utterances(spark, d).select("file", "utt", F.posexplode(W.split_timed(F.coalesce("text", F.lit("")), start, start + 777)).alias("part", "p"))
    return u.select("file", "utt", "part", "p.text", "p.start_ms", "p.end_ms")


@query("h13_disfluency", f"WITH {SW} SELECT file, utt, pos, coalesce({_map(L.FILLED_PAUSES, 'lower(w)')}, {_map(L.REPLACEMENTS, 'lower(w)')}, w) AS w FROM w")
def h13(spark, d):
    return words(spark, d).select("file", "utt", F.col("pos").cast("long").alias("pos"), W.disfluency(F.col("w")).alias("w"))


@query("h14_title_periods", f"WITH {SW} SELECT file, utt, pos, CASE WHEN lower(w) IN ({qs(L.TITLE_SURFACES)}) THEN replace(w, '.', '') ELSE w END AS w FROM w")
def h14(spark, d):
    return words(spark, d).select("file", "utt", F.col("pos").cast("long").alias("pos"), W.without_title_period(F.col("w")).alias("w"))


@query("h15_capitals", f"WITH {SW}, i AS (SELECT *, coalesce({_map(L.PRONOUN_I, 'lower(w)')}, w) AS p FROM w) SELECT file, utt, pos, CASE WHEN pos = 0 THEN upper(p[1]) || p[2:] ELSE p END AS w FROM i")
def h15(spark, d):
    p = W.pronoun_i(F.col("w"))
    return words(spark, d).select("file", "utt", F.col("pos").cast("long").alias("pos"), F.when(F.col("pos") == 0, W.capitalise_first(p)).otherwise(p).alias("w"))


@query("h17_strip_punct", f"WITH {SW} SELECT file, utt, pos, trim(" + "replace(" * len(L.ENDING_PUNCT + L.MOR_PUNCT) + "w" + "".join(f", {q(p)}, '')" for p in L.ENDING_PUNCT + L.MOR_PUNCT) + ") AS w FROM w")
def h17(spark, d):
    return words(spark, d).select("file", "utt", F.col("pos").cast("long").alias("pos"), W.strip_punct(F.col("w")).alias("w"))


@query("h16_illegal_characters", r"SELECT doc_id, regexp_replace(text, '[\[\]<>{}\x00-\x20\x15\\|^*%$#=;]', '', 'g') AS clean FROM documents")
def h16(spark, d):
    return table(spark, d, "documents").select("doc_id", W.illegal_removed(F.col("text")).alias("clean"))


@query("h19_detection_gate", r"SELECT doc_id, CASE WHEN length(regexp_replace(trim(text), '[^\p{L}]', '', 'g')) >= 40 THEN lang END AS lang FROM documents")
def h19(spark, d):
    letters = F.length(F.regexp_replace(F.trim("text"), r"[^\p{L}]", ""))
    return table(spark, d, "documents").select("doc_id", F.when(letters >= L.DETECT_LETTERS, F.col("lang")).alias("lang"))


@query("h20_translation_text", f"""WITH {U}, b AS (SELECT file, utt, trim(regexp_replace(translate(coalesce(text, ''), '()<>', ''), '\\s+', ' ', 'g')) AS before FROM u)
SELECT file, utt, before, trim(regexp_replace(replace(replace(replace(replace(before, '.', ' .'), ',', ' ,'), '!', ' !'), '?', ' ?'), '\\s+', ' ', 'g')) AS after FROM b""")  # fmt: skip
def h20(spark, d):
    b = utterances(spark, d).select("file", "utt", W.before_translation(F.coalesce("text", F.lit(""))).alias("before"))
    return b.withColumn("after", W.after_translation(F.col("before")))


@query("h21_chain_notation", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '-' ELSE (CASE WHEN event_id % 2 = 0 THEN '(' ELSE '' END) || (event_id % 10) || (CASE WHEN event_id % 5 = 0 THEN ')' ELSE '' END) END || ', -' AS notation FROM events""")
def h21(spark, d):
    i = F.col("event_id")
    one = F.array(F.struct((i % 10).cast("int").alias("chain_id"), (i % 2 == 0).alias("is_start"), (i % 5 == 0).alias("is_end")))
    none = F.filter(one, lambda x: F.lit(False))
    return table(spark, d, "events").select("event_id", W.bracket_annotation(F.array(F.when(i % 3 == 0, none).otherwise(one), none)).alias("notation"))


@query("h22_features", f"WITH {_TAG} SELECT file, utt, pos::INT AS pos, CASE WHEN feats <> '_' THEN split_part(feats, '=', 2) END AS value FROM g")
def h22(spark, d):
    return tagged(spark, d).select("file", "utt", "pos", F.get(F.map_values(W.features(F.col("feats"))), F.lit(0)).alias("value"))


@query("h23_analysis_items", f"WITH {_TAG} SELECT file, utt, pos::INT AS pos, lower(upos) || '|' || regexp_replace(lower(w), '[|&\\-+$#~\\s]', '', 'g') || CASE WHEN feats <> '_' THEN '-' || split_part(feats, '=', 2) ELSE '' END AS item FROM g")
def h23(spark, d):
    return tagged(spark, d).select("file", "utt", "pos", W.morph_item(F.col("upos"), F.lower("w"), F.col("feats")).alias("item"))


@query("h26_relations", f"WITH {_TAG} SELECT upos, coalesce({_map(L.POS_TO_RELATION, 'upos')}, 'DEP') AS relation, count(*) AS n FROM g GROUP BY 1, 2")
def h26(spark, d):
    return tagged(spark, d).groupBy("upos", morphology.relation_for(F.col("upos")).alias("relation")).agg(F.count("*").alias("n"))


@query("c30_pos_hints", f"""WITH {_TAG}, h AS (SELECT upos, CASE pos % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'n' WHEN 2 THEN 'zz' END AS hint FROM g), m AS (SELECT *, {_map(L.POS_HINTS, "hint")} AS m FROM h)
SELECT CASE WHEN hint IS NULL THEN 'none' WHEN m IS NULL THEN 'unmapped' WHEN m = upos THEN 'agrees' ELSE 'overridden' END AS hint_outcome, coalesce(m, upos) AS final_pos, count(*) AS n FROM m GROUP BY 1, 2""")  # fmt: skip
def c30(spark, d):
    hint = F.when(F.col("pos") % 4 == 0, "v").when(F.col("pos") % 4 == 1, "n").when(F.col("pos") % 4 == 2, "zz")
    return morphology.apply_hints(tagged(spark, d).select(F.col("upos").alias("pos"), hint.alias("pos_hint"))).groupBy("hint_outcome", "final_pos").agg(F.count("*").alias("n"))


@query("h27_clitics", f"WITH {SW} SELECT count(*) FILTER (regexp_matches(w, '^[A-Za-zÀ-ÿ]{{1,4}}[''’]$')) AS romance, count(*) FILTER (lower(w) IN ('n''t', '''s', '''re', '''ll', '''ve', '''d', '''m')) AS english FROM w")
def h27(spark, d):
    return words(spark, d).agg(F.count_if(morphology.clitic(F.col("w"), F.lit("fra"))).alias("romance"), F.count_if(morphology.clitic(F.col("w"), F.lit("eng"))).alias("english"))


@query("h28_tree_ranges")
def h28(spark, d):
    """Clause ranges of small bracketed trees made of the first words of a turn."""
    tree = F.concat(F.lit("(S (NP (N "), F.get("words", F.lit(0)), F.lit(")) (VP (V "), F.get("words", F.lit(1)), F.lit(") (SBAR (S (N "), F.get("words", F.lit(2)), F.lit(")))))"))
    return utterances(spark, d).where(F.size("words") >= 3).select("file", "utt", segmentation.tree_ranges(tree).alias("ranges"))


@query("h29_content_keys", "SELECT doc_id, sha256(lang || '|' || source || '|' || text) AS key FROM documents")
def h29(spark, d):
    return table(spark, d, "documents").select("doc_id", W.content_key(F.col("lang"), F.col("source"), F.col("text")).alias("key"))


@query("h31_language_codes", f"""WITH l AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' ELSE 'xyz' END AS code FROM documents)
SELECT code, coalesce({_map(L.LANG2, "code")}, code[1:2]) AS lang2, count(*) AS n FROM l GROUP BY 1, 2""")  # fmt: skip
def h31(spark, d):
    code = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "de", "deu").when(F.col("lang") == "fr", "fra").otherwise("xyz")
    return table(spark, d, "documents").select(code.alias("code")).groupBy("code", W.lang2(F.col("code")).alias("lang2")).agg(F.count("*").alias("n"))


@query("h32_engine_words", f"WITH {SW} SELECT file, utt, pos, regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS w FROM w")
def h32(spark, d):
    return words(spark, d).select("file", "utt", F.col("pos").cast("long").alias("pos"), W.letters_and_digits(F.col("w")).alias("w"))


@query("h33_compare_line", f"""WITH {S} SELECT file, utt, array_to_string(list_transform(words, lambda x, i: CASE WHEN i % 5 = 1 THEN '+' WHEN i % 7 = 1 THEN '-' ELSE '' END || x), ' ') AS line FROM s""")
def h33(spark, d):
    tokens = F.transform("words", lambda w, i: F.struct(w.alias("text"), F.when(i % 5 == 0, "extra_main").when(i % 7 == 0, "extra_gold").otherwise("match").alias("status")))
    return spiced(spark, d).select("file", "utt", W.marked_tokens(tokens).alias("line"))


# --- word lists ------------------------------------------------------------------


@query("e17_retraces", f"""WITH {U}, b AS (SELECT file, utt, flatten(list_transform(words, lambda x, i: CASE WHEN (i - 1) % 5 = 2 THEN [x, x] ELSE [x] END)) AS d FROM u WHERE len(words) > 0),
g AS (SELECT file, utt, CASE WHEN utt % 3 = 0 THEN list_concat(d, d) ELSE d END AS ws FROM b), w AS (SELECT file, utt, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM g),
f AS (SELECT *, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS y FROM w),
e AS (SELECT a.file, a.utt, z.i - a.i AS n, a.i FROM f a JOIN f z ON a.file = z.file AND a.utt = z.utt AND a.y = z.y AND a.i < z.i),
k AS (SELECT *, i - row_number() OVER (PARTITION BY file, utt, n ORDER BY i) AS g FROM e), r AS (SELECT file, utt, min(i) AS lo, max(i) AS hi FROM k GROUP BY file, utt, n, g HAVING count(*) >= n),
m AS (SELECT DISTINCT file, utt, unnest(generate_series(lo, hi)) AS i FROM r)
SELECT w.file, w.utt, string_agg(x, ' ' ORDER BY i) AS said, string_agg(CASE WHEN m.i IS NULL THEN 'false' ELSE 'true' END, ' ' ORDER BY i) AS marks FROM w LEFT JOIN m USING (file, utt, i) GROUP BY 1, 2""")  # fmt: skip
def e17(spark, d):
    """Marked openings of repeated stretches; each fifth word, and the whole of each third turn, is said twice."""
    twice = F.flatten(F.transform("words", lambda w, i: F.when(i % 5 == 2, F.array(w, w)).otherwise(F.array(w))))
    u = utterances(spark, d).where(F.size("words") > 0).select("file", "utt", F.when(F.col("utt") % 3 == 0, F.concat(twice, twice)).otherwise(twice).alias("ws"))
    return u.select("file", "utt", F.array_join("ws", " ").alias("said"), F.array_join(F.transform(sequences.retraces(F.col("ws")), lambda b: b.cast("string")), " ").alias("marks"))


@query("e18_compounds", f"""WITH {U}, p AS (SELECT file, utt, list_concat(['air', 'port', 'port', 'some', 'thing'], words) AS ws FROM u)
SELECT file, utt, replace(replace(array_to_string(ws, ' '), 'air port', 'airport'), 'some thing', 'something') AS merged FROM p""")  # fmt: skip
def e18(spark, d):
    ws = F.concat(F.array(*map(F.lit, ["air", "port", "port", "some", "thing"])), "words")
    return utterances(spark, d).select("file", "utt", F.array_join(sequences.merge_compounds(ws), " ").alias("merged"))


@query("e19_abbreviations", f"WITH {U} SELECT file, utt, 'USA x ' || array_to_string(list_transform(words, lambda x: x || '_'), ' ') || ' FBI TV' AS merged FROM u WHERE len(words) >= 2")
def e19(spark, d):
    ws = F.concat(F.array(*map(F.lit, ["U", "S", "A", "x"])), F.transform("words", lambda w: F.concat(w, F.lit("_"))), F.array(*map(F.lit, ["F", "B", "I", "T", "V"])))
    return utterances(spark, d).where(F.size("words") >= 2).select("file", "utt", F.array_join(sequences.merge_abbreviations(ws), " ").alias("merged"))


@query("e20_single_letters", f"WITH {U} SELECT file, utt, 'abc ' || array_to_string(list_transform(words, lambda x: x || '_'), ' ') || ' de' AS joined FROM u WHERE len(words) >= 2")
def e20(spark, d):
    ws = F.concat(F.array(*map(F.lit, "abc")), F.transform("words", lambda w: F.concat(w, F.lit("_"))), F.array(*map(F.lit, "de")))
    return utterances(spark, d).where(F.size("words") >= 2).select("file", "utt", F.array_join(sequences.join_single_letters(ws), " ").alias("joined"))


@query("e21_long_turns", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(generate_series(0, greatest(ceil(len(w) / 300.0)::INT, 1) - 1)) AS k FROM w)
SELECT doc_id, k::INT AS chunk, len(w[k * 300 + 1 : k * 300 + 300])::INT AS words, coalesce(w[k * 300 + 1], '') AS first FROM c""")  # fmt: skip
def e21(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(sequences.chunks(W.words_of(F.col("text")))).alias("chunk", "w"))
    return c.select("doc_id", "chunk", F.size("w").alias("words"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first"))


@query("e23_retokenise", f"""WITH {S}, e AS (SELECT file, utt, unnest(words) AS w, unnest(range(len(words))) AS i FROM s),
p AS (SELECT file, utt AS turn, i, CASE WHEN w IN ('.', '?', '!') OR right(w, 1) NOT IN ('.', '?', '!') THEN [w] ELSE list_filter([w[:-2], right(w, 1)], lambda x: x <> '') END AS ps FROM e),
x AS (SELECT file, turn, i, unnest(ps) AS text, unnest(range(len(ps))) AS j FROM p),
c AS (SELECT *, coalesce(sum((text IN ('.', '?', '!'))::INT) OVER (PARTITION BY file, turn ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM x),
m AS (SELECT *, max((text IN ('.', '?', '!'))::INT) OVER (PARTITION BY file, turn, u) AS closed, sum((text NOT IN ('‡', '„', ','))::INT) OVER (PARTITION BY file, turn, u ORDER BY i, j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS more FROM c),
k AS (SELECT * FROM m WHERE closed = 1 OR more > 0)
SELECT file, turn, u::BIGINT AS utt, string_agg(text, ' ' ORDER BY i, j) || CASE WHEN max(closed) = 1 THEN '' ELSE ' .' END AS said FROM k GROUP BY 1, 2, 3""")  # fmt: skip
def e23(spark, d):
    w = spiced(spark, d).select("file", F.col("utt").alias("turn"), "words")
    r = segmentation.retokenised(w, "words", "said").select("file", "turn", "said")
    return segmentation.each_utterance(r, F.transform("said", lambda u: F.array_join(u, " ")), "said").select("file", "turn", "utt", "said")


@query("e24_split_by_assignment", f"""WITH {SW}, g AS (SELECT file, utt, pos, w, (pos // 4) % 3 AS grp FROM w), c AS (SELECT *, coalesce(grp <> lag(grp) OVER (PARTITION BY file, utt ORDER BY pos), false)::INT AS c FROM g),
p AS (SELECT *, sum(c) OVER (PARTITION BY file, utt ORDER BY pos) AS part FROM c) SELECT file, utt, part::BIGINT AS part, string_agg(w, ' ' ORDER BY pos) AS text FROM p GROUP BY 1, 2, 3""")  # fmt: skip
def e24(spark, d):
    g = words(spark, d).withColumn("grp", F.expr("(pos div 4) % 3"))
    p = segmentation.split_by_assignment(g, ["file", "utt"], "pos", "grp")
    return p.groupBy("file", "utt", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("text"))


@query("e25_group_assignment")
def e25(spark, d):
    g = words(spark, d).select("file", "utt", "pos", F.when(F.col("pos") % 5 != 1, F.expr("pos div 2")).alias("grp"))
    return segmentation.merge_small_groups(g, ["file", "utt"], "pos", "grp")


@query("e26_boundary_groups", f"WITH {SW} SELECT file, utt, pos::INT AS pos, coalesce(sum((w IN ('.', ','))::INT) OVER (PARTITION BY file, utt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp FROM w")
def e26(spark, d):
    return segmentation.boundary_groups(words(spark, d), ["file", "utt"], "pos", F.col("w").isin(".", ",")).select("file", "utt", "pos", F.col("grp").cast("long").alias("grp"))


@query("e27_particles", f"""WITH {SW}, b AS (SELECT *, (coalesce(lag(w) OVER o || ' ' || w, w) = 'ok um' OR (w IN ('um', 'ok') AND coalesce(w || ' ' || lead(w) OVER o, w) <> 'ok um'))::INT AS b FROM w WINDOW o AS (PARTITION BY file, utt ORDER BY pos))
SELECT file, utt, pos::INT AS pos, coalesce(sum(b) OVER (PARTITION BY file, utt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM b""")  # fmt: skip
def e27(spark, d):
    return segmentation.split_at_particles(words(spark, d), ["file", "utt"], "pos", "w", ["um", "ok", "ok um"]).select("file", "utt", "pos", F.col("part").cast("long").alias("part"))


# --- transcripts as text -----------------------------------------------------------


@query("a07_parse_transcripts", f"""WITH {U} SELECT file, utt, speaker, len(words)::BIGINT AS n_words, CASE WHEN utt % 2 = 0 THEN utt * 1000 END AS start_ms, CASE WHEN utt % 2 = 0 THEN utt * 1000 + 900 END AS end_ms FROM
 (SELECT file, utt, upper(speaker)[1:3] AS speaker, list_filter(list_transform(words, lambda x: regexp_replace(x, '[^\\p{{L}}]', '', 'g')), lambda x: x <> '') AS words FROM u)""")  # fmt: skip
def a07(spark, d):
    """Conversations written as transcript files, read back as utterances."""
    u = utterances(spark, d)
    plain = F.filter(F.transform("words", lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), lambda w: w != "")
    timed = F.col("utt") % 2 == 0
    rows = u.select("file", "utt", F.upper("speaker").substr(1, 3).alias("speaker"), F.concat(F.array_join(plain, " "), F.lit(" .")).alias("text"), F.when(timed, F.col("utt") * 1000).alias("start_ms"), F.when(timed, F.col("utt") * 1000 + 900).alias("end_ms"))
    heads = rows.select("file").distinct().select("file", F.lit(0).alias("seq"), F.lit("Languages").alias("key"), F.lit("eng, spa").alias("value"))
    files = transcripts.render(rows, heads, rows.select("file", "utt", F.lit("com").alias("label"), F.lit("x").alias("content")))
    back = transcripts.utterances(transcripts.lines_of(files))
    return back.select("file", "utt", "speaker", F.size("words").cast("long").alias("n_words"), "start_ms", "end_ms")


@query("a20_turns_json", "SELECT user_id AS file, count(*) AS turns, count(DISTINCT event_type) AS speakers FROM events GROUP BY 1")
def a20(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("speaker"), F.col("event_id").alias("start_ms"), (F.col("event_id") + 1).alias("end_ms"))
    t = payloads.turns_json(e).withColumn("t", F.from_json("turns", "array<struct<start_ms:bigint,end_ms:bigint,track:string>>"))
    return t.select("file", F.size("t").cast("long").alias("turns"), F.size(F.array_distinct(F.col("t.track"))).cast("long").alias("speakers"))


@query("a21_rttm", "SELECT user_id::VARCHAR AS file, event_id * 10 AS start_ms, event_id * 10 + 500 AS end_ms, event_type AS speaker FROM events")
def a21(spark, d):
    i = F.col("event_id")
    line = F.format_string("SPEAKER %d 1 %s 0.500 <NA> <NA> %s <NA> <NA>", "user_id", F.format_string("%.2f", i / 100.0), "event_type")
    return payloads.rttm(table(spark, d, "events").select(line.alias("value")))


@query("a31_provider_payload", "SELECT user_id AS file, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS seq, event_type AS text, event_id * 1000 AS start_ms FROM events")
def a31(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("file")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(x["event_type"].alias("text"), x["event_id"].cast("double").alias("from"), (x["event_id"] + 1.0).alias("to"))).alias("sentences"))).alias("value"))
    return payloads.provider_segments(e, "sentences array<struct<text:string,from:double,to:double>>", "sentences", "text", "from", "to", None, 1000.0).select("file", "seq", "text", "start_ms")
