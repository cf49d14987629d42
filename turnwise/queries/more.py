"""Gates, placeholders, realignment, pauses, sentences and Cantonese text."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions.cantonese import character_tokens, normalise
from turnwise.operators import alignment, joins, morphology, segmentation
from turnwise.queries.base import U, query, spans, utterances
from turnwise.queries.text import tagged
from turnwise.session import table


@query("b17_placeholders", f"WITH {U} SELECT file, utt FROM u WHERE len(words) > 0 AND utt % 3 <> 0")
def b17(spark, d):
    """Analyses that hold nothing are taken out."""
    u = utterances(spark, d).select("file", "utt", F.when(F.col("utt") % 3 != 0, F.col("words")).otherwise(F.array().cast("array<string>")).alias("items"))
    return morphology.without_placeholders(u).select("file", "utt")


@query("b23_validation_gates", f"WITH {U} SELECT file, utt, CASE WHEN len(words) = 0 THEN 'reject' WHEN len(words) > 200 THEN 'warn' ELSE 'ok' END AS gate FROM u")
def b23(spark, d):
    """Rows that break a rule before the work are set aside; rules after it only warn."""
    return morphology.gate(utterances(spark, d), {"words": F.size("words") > 0}, {"length": F.size("words") <= 200}).select("file", "utt", "gate")


@query("b25_misaligned_tiers", f"WITH {U} SELECT file, utt FROM u WHERE utt % 4 = 1 AND len(words) > 0")
def b25(spark, d):
    mor = F.when(F.col("utt") % 4 == 1, F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0)))).otherwise(F.col("words"))
    return morphology.misaligned(utterances(spark, d).withColumn("mor", mor)).select("file", "utt")


@query("c17_realigned_tokens", f"""WITH {U} SELECT file, utt, string_agg(x, '|' ORDER BY i) AS words FROM (SELECT file, utt, unnest(words) AS x, unnest(range(len(words))) AS i FROM u WHERE len(words) > 0) GROUP BY 1, 2""")
def c17(spark, d):
    """Tokens of two characters put back together to the words they came from."""
    u = utterances(spark, d).where(F.size("words") > 0).select("file", "utt", F.col("words").alias("ws"))
    w = u.select("file", "utt", F.posexplode("ws").alias("pos", "text"))
    parts = F.flatten(F.transform("ws", lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 2).cast("int")), lambda k: F.substr(x, k * 2 + 1, F.lit(2)))))
    t = u.select("file", "utt", F.posexplode(parts).alias("pos", "text"))
    m = joins.tokens_to_words(w, t, ["file", "utt"]).join(t.withColumnRenamed("pos", "token"), ["file", "utt", "token"])
    one = m.groupBy("file", "utt", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token", "text"))), lambda x: x["text"]), "").alias("w"))
    return one.groupBy("file", "utt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "w"))), lambda x: x["w"]), "|").alias("words"))


@query("d31_hint_counters", f"WITH {U}, w AS (SELECT file, unnest(range(len(words))) AS i FROM u) SELECT file, count(*) FILTER (i % 4 = 0) AS hinted, count(*) FILTER (i % 4 <> 0) AS plain FROM w GROUP BY 1")
def d31(spark, d):
    w = utterances(spark, d).select("file", F.posexplode("words").alias("i", "w")).select("file", F.when(F.col("i") % 4 == 0, "v").alias("pos_hint"), F.lit("NOUN").alias("pos"))
    h = morphology.apply_hints(w)
    return h.groupBy("file").agg(F.count_if(F.col("hint_outcome") != "none").alias("hinted"), F.count_if(F.col("hint_outcome") == "none").alias("plain"))


@query("e22_long_pauses")
def e22(spark, d):
    t = spans(spark, d).select("file", "line", F.when(F.col("line") % 3 == 0, "and").otherwise(F.col("speaker")).alias("text"), "start_ms", "end_ms")
    return segmentation.split_on_pauses(t, ["file"], "line")


@query("e31_token_jumps", "SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def e31(spark, d):
    """Where the row of a path changes: events as the path, their kind as its row."""
    step = F.struct(F.col("event_id").alias("at"), F.struct(F.col("event_type").alias("i"), F.struct("event_id", "event_type").alias("j")).alias("p"))
    path = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["p"]).alias("path"))
    return path.select(F.explode(alignment.token_jumps(F.col("path"))).alias("j")).select("j.event_id", "j.event_type")


@query("h18_cantonese", f"WITH {U} SELECT file, utt, '佢哋 話 ' || speaker AS text, '佢|哋|話' AS tokens FROM u")
def h18(spark, d):
    t = normalise(F.concat(F.lit("他们 話 "), "speaker"))
    return utterances(spark, d).select("file", "utt", t.alias("text"), F.array_join(F.slice(character_tokens(F.regexp_replace(t, "[a-z ]", "")), 1, 3), "|").alias("tokens"))


@query("h24_sentences")
def h24(spark, d):
    t = tagged(spark, d).withColumn("n", F.col("pos") + 1)
    s = t.groupBy("file", "utt").agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("id_start"), F.when((F.col("n") == 2) & (F.col("file") % 2 == 0), 3).otherwise(0).alias("id_end"), F.col("w").alias("text"), F.lower("w").alias("lemma"), F.col("upos"), "feats", F.when(F.col("n") == 1, 0).otherwise(1).alias("head"), F.lit("nsubj:x").alias("deprel")))).alias("ud"))
    return s.select("file", "utt", morphology.mapped_sentence("ud").alias("m")).select("file", "utt", "m.mor", "m.gra")
