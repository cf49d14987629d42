"""Registry, and the views that make transcripts of the driver's tables.

* ``utterances``: conversations; file = conversation, utt = turn, speaker = role.
* ``spiced``: the same, with words that the text rules act on at fixed positions.
* ``spans``: events; file = user, speaker = event type, ``line`` a locally shuffled
  order, times scaled so that neighbours overlap; each fifth row is untimed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from turnwise.functions.words import words_of
from turnwise.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DURATION = 300_000


def query(name: str, sql: str | None = None):
    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def utterances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("utt"), F.col("role").alias("speaker"), "text", words_of(F.col("text")).alias("words"))


# Fixed values: (modulus, rest, word) of the words put in; ``@`` stands for the word itself.
SPICE = [(11, 3, "um"), (13, 5, "gonna"), (17, 7, "@'s"), (19, 9, "12%"), (23, 11, "well-known"), (29, 13, "ok"), (31, 15, ","), (37, 17, "."), (41, 19, "Dr."), (43, 21, "i'm"), (47, 23, "mm-hmm")]


def spiced(spark: SparkSession, d: str) -> DataFrame:
    def one(w, i):
        out = None
        for m, r, s in SPICE:
            value = F.concat(w, F.lit(s[1:])) if s[0] == "@" else F.lit(s)
            out = F.when(i % m == r, value) if out is None else out.when(i % m == r, value)
        return out.otherwise(w)

    return utterances(spark, d).withColumn("words", F.transform("words", one))


def spans(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.expr("event_id + (event_id * 7919) % 601"), "event_id")
    e = table(spark, d, "events")
    start = F.expr(("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)" if dict(e.dtypes)["ts"] == "timestamp_ntz" else "(unix_micros(ts) - 1704067200000000L)") + " div 10000000L")
    timed = F.col("event_id") % 5 != 0
    return e.select(
        F.col("user_id").alias("file"), F.row_number().over(order).cast("long").alias("line"), F.col("event_type").alias("speaker"),
        F.when(timed, start).alias("start_ms"), F.when(timed, start + F.floor(F.col("value") * 100).cast("long") + 1).alias("end_ms"),
        (F.col("event_id") % 9).alias("n_words"), (F.col("event_id") % 90).alias("n_chars"), (F.col("event_id") % 3 == 0).alias("lead_filler"), (F.col("event_id") % 4 == 0).alias("trail_filler"), "event_id",
    )


U = r"u AS (SELECT conv_id AS file, turn AS utt, role AS speaker, text, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS words FROM conversations)"
_case = " ".join(f"WHEN (i - 1) % {m} = {r} THEN {'x || ' if s[0] == '@' else ''}'{s.lstrip('@').replace(chr(39), chr(39) * 2)}'" for m, r, s in SPICE)
S = f"{U}, s AS (SELECT file, utt, speaker, list_transform(words, lambda x, i: CASE {_case} ELSE x END) AS words FROM u)"
SW = S + ", w AS (SELECT file, utt, speaker, unnest(words) AS w, unnest(range(len(words))) AS pos FROM s)"
SPANS = """sp0 AS (SELECT *, (epoch_us(ts) - 1704067200000000) // 10000000 AS s0 FROM events),
sp AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id + (event_id * 7919) % 601, event_id) AS line, event_type AS speaker,
  CASE WHEN event_id % 5 <> 0 THEN s0 END AS start_ms, CASE WHEN event_id % 5 <> 0 THEN s0 + floor(value * 100)::BIGINT + 1 END AS end_ms,
  event_id % 9 AS n_words, event_id % 90 AS n_chars, event_id % 3 = 0 AS lead_filler, event_id % 4 = 0 AS trail_filler, event_id FROM sp0),
t AS (SELECT * FROM sp WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL)"""
