"""Aggregates, sinks, job tables, sets, sorts and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnwise.operators import jobs, joins, metrics
from turnwise.queries.base import U, query, utterances
from turnwise.queries.text import _TAG, tagged
from turnwise.session import shared_folder, table
from turnwise.sources import listing, payloads, transcripts
from turnwise.streaming import events as streams, stateful

_FILES = "SELECT o_orderkey AS job_id, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_quantity > 49 THEN 'cancelled' WHEN l_linenumber = 7 THEN 'pending' ELSE 'done' END AS status FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def file_rows(spark, d):
    s = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_quantity") > 49, "cancelled").when(F.col("l_linenumber") == 7, "pending").otherwise("done")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("n"), s.alias("status"))


@query("d20_job_status", f"""WITH f AS ({_FILES}), c AS (SELECT job_id, count(*) AS files, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status = 'pending') AS pending FROM f GROUP BY 1)
SELECT *, CASE WHEN pending > 0 THEN 'running' WHEN cancelled > 0 THEN 'cancelled' WHEN error > 0 THEN 'failed' ELSE 'completed' END AS job_status FROM c""")  # fmt: skip
def d20(spark, d):
    return jobs.job_status(file_rows(spark, d))


@query("d21_counters", f"WITH f AS ({_FILES}) SELECT count(*) AS files, count(DISTINCT job_id) AS jobs, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS failed FROM f")
def d21(spark, d):
    return jobs.counters(file_rows(spark, d))


@query("d16_next_attempt", "SELECT l_suppkey AS work_unit, coalesce(max(l_linenumber), 0) + 1 AS next_attempt FROM lineitem GROUP BY 1")
def d16(spark, d):
    return jobs.next_attempt(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("work_unit"), F.col("l_linenumber").alias("attempt_number")), ["work_unit"])


@query("i04_retry_plan", "SELECT event_id, CASE WHEN event_id % 4 + 1 < 3 THEN 'retry' ELSE 'give_up' END AS disposition, CASE WHEN event_id % 4 + 1 < 3 THEN value + least(60.0, power(2.0, event_id % 4)) END::DOUBLE AS next_eligible_at FROM events WHERE event_type = 'error'")
def i04(spark, d):
    a = table(spark, d, "events").select("event_id", (F.col("event_id") % 4 + 1).alias("attempt_number"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("outcome"), F.col("value").alias("finished_at"))
    return jobs.retry_plan(a).select("event_id", "disposition", "next_eligible_at")


def cache_rows(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("task"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("engine_version"), (F.col("doc_id") % 40).alias("created_at"))


@query("d15_cache_statistics", "SELECT lang AS task, 'v' || (doc_id % 3) AS engine_version, count(*) AS entries, grouping(lang, 'v' || (doc_id % 3))::INT AS level FROM documents GROUP BY GROUPING SETS ((), (lang), (lang, 'v' || (doc_id % 3)))")
def d15(spark, d):
    return jobs.cache_statistics(cache_rows(spark, d)).withColumn("level", F.col("level").cast("int"))


@query("a30_cache_upsert", "SELECT key, max(v) AS version FROM (SELECT doc_id % 500 AS key, doc_id AS v FROM documents) GROUP BY 1")
def a30(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 500).alias("key"), F.col("doc_id").alias("version"))
    return jobs.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["key"], "version")


@query("a30_cache_delete", "SELECT doc_id AS key FROM documents WHERE doc_id % 5 <> 0")
def a30d(spark, d):
    rows = cache_rows(spark, d).select("key")
    return jobs.delete(rows, rows.where("key % 5 = 0"), ["key"])


@query("h35_expired", "SELECT doc_id AS key FROM documents WHERE doc_id % 40 * 86400 < 40 * 86400 - 30 * 86400")
def h35(spark, d):
    rows = cache_rows(spark, d).withColumn("created_at", F.col("created_at") * 86400)
    return jobs.expired(rows, "created_at", F.lit(40 * 86400), 30).select("key")


@query("e29_latest_row", "SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1")
def e29(spark, d):
    return jobs.latest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("g07_dedup_latest", "SELECT event_type, user_id % 10 AS k, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def g07(spark, d):
    e = table(spark, d, "events").withColumn("k", F.col("user_id") % 10)
    return jobs.latest(e, ["event_type", "k"], "event_id").select("event_type", "k", "event_id")


@query("f01_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def f01(spark, d):
    return jobs.newest_first(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 100)


@query("f02_attempts_ordered", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS n FROM lineitem")
def f02(spark, d):
    return jobs.attempts_in_order(table(spark, d, "lineitem"), ["l_orderkey"], "l_shipdate", "l_linenumber").select("l_orderkey", "l_linenumber", "n")


@query("f03_latest_one", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def f03(spark, d):
    return jobs.latest_one(table(spark, d, "events"), "ts", "event_id").select("event_id")


@query("f04_ready_queue", "SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O'")
def f04(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.col("o_orderdate").alias("submitted_at"))
    return jobs.ready_queue(o).select("job_id")


@query("f05_top_classes", f"""WITH {_TAG}, c AS (SELECT lang, upos, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, upos) AS k FROM c)
SELECT lang, string_agg(upos || ':' || n, ', ' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY 1""")  # fmt: skip
def f05(spark, d):
    return metrics.top_string(tagged(spark, d), ["lang"], "upos", 3)


@query("f06_positioned_tokens", "SELECT user_id, string_agg(event_type, '' ORDER BY event_id % 7 / 2.0, event_id) AS s FROM events GROUP BY 1")
def f06(spark, d):
    e = table(spark, d, "events").withColumn("p", F.col("event_id") % 7 / 2.0)
    return joins.positioned(e, ["user_id"], "p", "event_id", "event_type").select("user_id", F.array_join("tokens", "").alias("s"))


@query("d08_majority_first_seen", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) SELECT user_id, event_type, n FROM r WHERE k = 1")
def d08(spark, d):
    return metrics.mode_first_seen(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("d09_primary_language", "WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM c) SELECT source, lang, n FROM r WHERE k = 1")
def d09(spark, d):
    return metrics.mode_first_seen(table(spark, d, "documents"), ["source"], "lang", "doc_id")


@query("d10_detected_languages", "WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM c) SELECT source, string_agg(lang, ',' ORDER BY k) AS languages FROM r WHERE k = 1 OR n >= 3 GROUP BY 1")
def d10(spark, d):
    return metrics.detected_languages(table(spark, d, "documents"), "source", "lang", "doc_id").select("source", F.array_join("languages", ",").alias("languages"))


@query("d13_d14_pair_rollup", f"""WITH {_TAG}, r AS (SELECT lang, count(DISTINCT file) AS files, count(*) AS total, count(*) FILTER (status = 'spliced') AS spliced, count(*) FILTER (f1) AS flag_propn_for_function_word, count(*) FILTER (status = 'spliced' AND NOT f1 AND NOT f2) AS clean FROM fl GROUP BY 1)
SELECT lang, files, total, spliced, flag_propn_for_function_word, clean, round(spliced / total, 6) AS splice_rate, round(CASE WHEN spliced > 0 THEN clean / spliced ELSE 0 END, 6) AS clean_rate FROM r""")  # fmt: skip
def d13(spark, d):
    from turnwise.operators import morphology

    t = tagged(spark, d).withColumn("status", morphology.status(F.col("mor")))
    t = t.withColumn("flags", morphology.flags(F.col("w"), F.col("lang"), F.col("upos"), F.col("feats"), F.col("status")))
    r = metrics.per_pair_rollup(t, "lang", ["spliced"], ["propn_for_function_word"])
    return r.select("lang", "files", "total", "spliced", "flag_propn_for_function_word", "clean", F.round("splice_rate", 6).alias("splice_rate"), F.round("clean_rate", 6).alias("clean_rate"))


@query("d19_rejections", "SELECT event_type AS reason, count(*) AS n FROM events WHERE value < 5 GROUP BY 1")
def d19(spark, d):
    return jobs.rejections(table(spark, d, "events").withColumn("reason", F.when(F.col("value") < 5, F.col("event_type"))), "reason")


@query("d26_run_times", "SELECT event_type AS name, round(avg(value), 6) AS mean_s, count(*) AS runs FROM events GROUP BY 1")
def d26(spark, d):
    return jobs.run_time_average(table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("elapsed_s"))).withColumn("mean_s", F.round("mean_s", 6))


@query("d27_distinct_speakers", "SELECT conv_id AS file, count(DISTINCT role) AS speakers FROM conversations GROUP BY 1")
def d27(spark, d):
    return metrics.distinct_speakers(table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("role").alias("speaker")))


@query("d29_review_queue", "SELECT event_id AS line, CASE event_id % 4 WHEN 0 THEN 'review' ELSE 'hold' END AS tier FROM events WHERE event_id % 4 < 2")
def d29(spark, d):
    tier = F.when(F.col("event_id") % 4 == 0, "review").when(F.col("event_id") % 4 == 1, "hold").otherwise("trust")
    return jobs.review_summary(table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), tier.alias("tier")))[1].select("line", "tier")


@query("d30_language_batches", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def d30(spark, d):
    return metrics.language_batches(table(spark, d, "documents"), "lang", "text")


@query("a13_metrics_long", "WITH c AS (SELECT user_id AS file, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1), l AS (SELECT file, 'n' AS metric, n::DOUBLE AS x FROM c UNION ALL SELECT file, 'mean', mean FROM c), f AS (SELECT file, metric, rtrim(printf('%.4f', x), '0') AS v FROM l) SELECT file, metric, CASE WHEN v LIKE '%.' THEN v || '0' ELSE v END AS value FROM f")
def a13(spark, d):
    # summed in the order of the events: a mean that lies between two texts does not depend on how the rows are dealt; events without a number, or of one number, count each
    order = Window.partitionBy("user_id").orderBy("event_id", "ts", "value")
    so_far = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), "value", F.row_number().over(order).alias("at"), so_far.alias("s"))
    c = e.groupBy("file").agg(F.count("*").alias("n"), F.try_divide(F.max_by("s", "at"), F.count("value")).alias("mean"))
    return metrics.long_metrics(c, "file", ["n", "mean"])


@query("a14_metrics_wide", "SELECT user_id AS file, count(*) FILTER (event_type = 'click') || '.0' AS click, count(*) FILTER (event_type = 'error') || '.0' AS error FROM events GROUP BY 1")
def a14(spark, d):
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("file")).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "error")])
    return metrics.wide_metrics(metrics.long_metrics(c, "file", ["click", "error"]), "file", ["click", "error"])


@query("a17_fixed_columns", "SELECT conv_id AS file, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def a17(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("file")).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("turns"), F.lit(1).alias("extra"))
    return payloads.csv_columns(c, ["file", "turns", "chars"])


@query("a16_json_report", """SELECT '{"conv_id":' || conv_id || ',"turns":' || count(*) || '}' AS value FROM conversations GROUP BY conv_id""")
def a16(spark, d):
    return payloads.json_rows(table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")))


@query("a27_a28_names", "SELECT doc_id, 'x/' || doc_id || '.gold.cha' AS gold, 'x/' || doc_id || '.csv' AS report, 'x/' || doc_id || '_new.cha' AS renamed FROM documents")
def a28(spark, d):
    from turnwise.operators.joins import gold_path

    p = F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit(".cha"))
    return table(spark, d, "documents").select("doc_id", gold_path(p).alias("gold"), listing.output_name(p, "replace_extension", "csv").alias("report"), listing.output_name(p, "rewrite_stem", stem_suffix="_new").alias("renamed"))


@query("a32_provenance", "SELECT doc_id, lang AS engine FROM documents")
def a32(spark, d):
    doc = F.concat(F.lit("@UTF8\n@Begin\n*CHI:\thello .\n@End\n"))
    rows = table(spark, d, "documents").select("doc_id", "lang", transcripts.inject_provenance(doc, {"engine": "none", "v": "1"}).alias("value"))
    swapped = rows.withColumn("value", F.replace("value", F.lit("engine=none"), F.concat(F.lit("engine="), "lang")))
    return swapped.select("doc_id", transcripts.extract_provenance(F.col("value"))["engine"].alias("engine"))


@query("a04_dummy_files", "SELECT doc_id, doc_id % 5 = 0 AS dummy FROM documents")
def a04(spark, d):
    head = F.when(F.col("doc_id") % 5 == 0, "@UTF8\n@Options:\tdummy\n").otherwise("@UTF8\n@Options:\tmulti\n")
    return table(spark, d, "documents").select("doc_id", listing.is_dummy(F.concat(head, F.lit("*CHI:\thi ."))).alias("dummy"))


@query("g02_unit_union", f"WITH {U} SELECT file, utt, 'main' AS side FROM u WHERE utt % 2 = 0 UNION ALL SELECT file, utt, 'gold' FROM u WHERE utt % 3 = 0")
def g02(spark, d):
    u = utterances(spark, d).select("file", "utt")
    return joins.unit_union(u.where("utt % 2 = 0"), u.where("utt % 3 = 0"))


@query("g04_g06_sets", "SELECT event_id, event_id % 3 < 2 AS same FROM events")
def g06(spark, d):
    from turnwise.functions.sequences import feature_set

    i = F.col("event_id") % 3
    a = F.array(F.lit("x"), F.lit("y"), F.lit("x"))
    b = F.when(i == 0, F.array(F.lit("y"), F.lit("x"))).when(i == 1, F.array(F.lit("x"), F.lit("y"), F.lit("y"))).otherwise(F.array(F.lit("x")))
    return table(spark, d, "events").select("event_id", (feature_set(a) == feature_set(b)).alias("same"))


@query("g05_difference_axes", "SELECT event_type, count(DISTINCT user_id % 3) AS axes FROM events GROUP BY 1")
def g05(spark, d):
    return joins.difference_axes(table(spark, d, "events").withColumn("axis", F.col("user_id") % 3), ["event_type"], "axis").select("event_type", F.size("axes").cast("long").alias("axes"))


@query("h34_json_columns", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def h34(spark, d):
    j = table(spark, d, "conversations").groupBy("conv_id").agg(payloads.json_column(F.array_sort(F.collect_list("turn"))).alias("j"))
    return j.select("conv_id", F.size(payloads.from_json_column(F.col("j"), "bigint")).cast("long").alias("n"))


@query("i03_leases", """WITH c AS (SELECT event_id % 40 AS job_id, event_id AS t, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'release' ELSE 'claim' END AS action FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t DESC, seq DESC) AS r FROM c), x AS (SELECT max(event_id) AS m FROM events)
SELECT job_id, CASE WHEN action = 'release' THEN 'free' WHEN t + 20 < 9990 THEN 'expired' ELSE 'held' END AS state FROM l WHERE r = 1""")  # fmt: skip
def i03(spark, d):
    c = table(spark, d, "events").select((F.col("event_id") % 40).alias("job_id"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, "release").otherwise("claim").alias("action"), F.lit(20).alias("ttl_s"))
    return jobs.leases(c, F.lit(9990)).select("job_id", "state")


@query("i06_recovered", "SELECT CASE WHEN event_type IN ('click') THEN 'queued' ELSE event_type END AS status, count(*) AS n FROM events GROUP BY 1")
def i06(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("status"))
    return jobs.recovered(e).groupBy("status").agg(F.count("*").alias("n"))


@query("i07_changed_rows", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 1")
def i07(spark, d):
    after = table(spark, d, "documents").select("doc_id", "lang", "source")
    before = after.where("doc_id % 5 <> 1").withColumn("source", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("source")))
    return streams.changed_only(before, after, ["doc_id"], ["lang", "source"]).select("doc_id")


@query("i01_windowed_stream", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def i01(spark, d):
    """Events by day and kind through a stream into files (an addition: the tables are the stream)."""
    s = streams.event_counts(streams.event_stream(spark, f"{d}/events.parquet*"), width="1 day")
    path = shared_folder(spark, "by-day")
    stateful.store(s, path, "update")
    return stateful.stored(spark, path, "start timestamp, event_type string, n long, total double", ["start", "event_type"]).withColumn("total", F.round("total", 4))


@query("i02_job_stream", "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS updates FROM events GROUP BY 1")
def i02(spark, d):
    """State of each job after all its events, kept by a stateful stream and read from files."""
    raw = streams.event_stream(spark, f"{d}/events.parquet*")
    path = shared_folder(spark, "jobs")
    stateful.store(stateful.job_status(raw.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))), path, "update")
    return stateful.stored(spark, path, stateful.STATUS, ["job_id"])


@query("i03_lease_stream", """WITH e AS (SELECT user_id AS job_id, epoch_us(ts) // 1000 AS ms, event_id, 'w' || (user_id % 7) AS worker FROM events),
p AS (SELECT *, lag(ms) OVER (PARTITION BY job_id ORDER BY ms, event_id) AS past, lead(ms) OVER (PARTITION BY job_id ORDER BY ms, event_id) AS next, max(ms) OVER () AS newest FROM e)
SELECT job_id, ms AS at_ms, worker, CASE WHEN past IS NULL OR past + 21600000 < ms THEN 'granted' ELSE 'renewed' END AS outcome FROM p
UNION ALL SELECT job_id, ms + 21600000, worker, 'expired' FROM p WHERE coalesce(ms + 21600000 < next, ms + 21600000 <= newest - 60000)""")  # fmt: skip
def i03_stream(spark, d):
    """Leases of six hours: each event is a claim; what is not renewed in time ends by a timer."""
    raw = streams.event_stream(spark, f"{d}/events.parquet*")
    claims = raw.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.lit("claim").alias("action"), F.concat(F.lit("w"), F.col("user_id") % 7).alias("worker"))
    path = shared_folder(spark, "leases")
    stateful.store(stateful.leases(claims, 6 * 3_600_000), path)
    return stateful.stored(spark, path, stateful.LEASES)


@query("i05_sessions", "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM s GROUP BY user_id, k")
def i05(spark, d):
    return streams.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), gap="6 hours")
