"""Worker and provider payloads as tables; report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.words import timed_range

MONOLOGUES = "monologues array<struct<speaker:string,elements:array<struct<value:string,start_s:double,end_s:double,kind:string,confidence:double>>>>"
TIMINGS = "indexed_timings array<struct<start_ms:bigint,end_ms:bigint,confidence:double>>"
SEGMENTS = "segments array<struct<start_ms:bigint,end_ms:bigint,speaker:string>>"
COREFERENCE = "items array<struct<annotations:array<struct<sentence_idx:int,words:array<array<struct<chain_id:int,is_start:boolean,is_end:boolean>>>>>,error:string>>"


def asr_words(rows: DataFrame, column: str = "value") -> DataFrame:
    """monologue, seq, speaker, text, start_ms, end_ms; blank and <marker> elements are dropped."""
    m = rows.select("file", F.posexplode(F.from_json(column, MONOLOGUES)["monologues"]).alias("monologue", "m"))
    e = m.select("file", "monologue", F.col("m.speaker").alias("speaker"), F.posexplode("m.elements").alias("seq", "e"))
    text = F.trim("e.value")
    return e.where((text != "") & ~(text.startswith("<") & text.endswith(">"))).select("file", "monologue", "seq", "speaker", text.alias("text"), timed_range(F.col("e.start_s"), F.col("e.end_s")).alias("t")).select("file", "monologue", "seq", "speaker", "text", "t.start_ms", "t.end_ms")


def provider_segments(rows: DataFrame, schema: str, items: str, text: str, start: str, end: str, speaker: str | None, unit_ms: float) -> DataFrame:
    """A provider's list of segments as rows of the same form; times in units of ``unit_ms``."""
    each = rows.select("file", F.posexplode(F.from_json("value", schema)[items]).alias("seq", "s"))
    ms = lambda c: F.round(F.col(f"s.{c}") * unit_ms).cast("long")
    return each.select("file", "seq", (F.col(f"s.{speaker}").cast("string") if speaker else F.lit("0")).alias("speaker"), F.trim(F.col(f"s.{text}")).alias("text"), ms(start).alias("start_ms"), ms(end).alias("end_ms")).where("text <> ''")


def rttm(lines: DataFrame) -> DataFrame:
    """file, start_ms, end_ms, speaker of RTTM text lines; other lines are left out."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.col("value").startswith("SPEAKER ")).select(p.alias("p")).where(F.size("p") >= 8)
    s = F.get("p", F.lit(3)).cast("double")
    return rows.select(F.get("p", F.lit(1)).alias("file"), F.round(s * 1000).cast("long").alias("start_ms"), F.round((s + F.get("p", F.lit(4)).cast("double")) * 1000).cast("long").alias("end_ms"), F.get("p", F.lit(7)).alias("speaker"))


def turns_json(segments: DataFrame) -> DataFrame:
    """file, turns (JSON), inverted (segments that end before they begin): labels become PAR<n> in their order."""
    from pyspark.sql import Window

    track = F.concat(F.lit("PAR"), (F.dense_rank().over(Window.partitionBy("file").orderBy("speaker")) - 1).cast("string"))
    rows = segments.withColumn("track", track)
    return rows.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "track")))).alias("turns"), F.count_if(F.col("end_ms") <= F.col("start_ms")).alias("inverted"))


def csv_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in a fixed order, nested values as JSON: ready for ``write.csv(header=True)``."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c)).alias(c) for c in columns])


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def plan_pairs(spark, plan: dict) -> DataFrame:
    """A comparison plan (two runs and relative paths) as pair rows; bad plans raise."""
    for key in ("left", "right", "pairs"):
        if key not in plan:
            raise ValueError(f"comparison plan lacks {key}")
    if not plan["pairs"]:
        raise ValueError("comparison plan has no pairs")
    names = [p["name"] if isinstance(p, dict) else p for p in plan["pairs"]]
    if len(set(names)) < len(names):
        raise ValueError("comparison plan repeats a pair")
    left, right = plan["left"].rstrip("/"), plan["right"].rstrip("/")
    return spark.createDataFrame([(n, f"{left}/{n}", f"{right}/{n}") for n in names], "pair string, left_path string, right_path string")


def runaway(text: Column, seconds: Column, limit: float = 8.0) -> Column:
    """More characters for each second than speech has."""
    return F.coalesce(F.length(text) / F.when(seconds > 0, seconds) > limit, F.lit(False))


def json_column(values: Column) -> Column:
    """An array as the JSON text that job tables keep."""
    return F.to_json(values)


def from_json_column(text: Column, kind: str) -> Column:
    """The array behind a JSON text of element type ``kind``; what cannot be read is null."""
    return F.from_json(text, f"array<{kind}>")
