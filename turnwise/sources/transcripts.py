"""Transcript files as tables, and back.

A file is UTF-8 text: header lines ``@Key:\\tvalue``, utterances ``*SPK:\\twords
terminator \\x15start_end\\x15``, dependent tiers ``%tier:\\tcontent``; a line that
begins with a tab continues the one before. Reading is lenient by default: lines
that fit no form become rows of kind ``error``; ``strict`` sets their files aside.
The word grammar is the documented subset below, not a full parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BULLET = "\x15"


def read_lines(spark: SparkSession, root: str | list[str], glob: str = "*.cha") -> DataFrame:
    """file, line_no, kind (header, utterance, tier, error), label, text."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(root).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines_of(raw)


def lines_of(raw: DataFrame) -> DataFrame:
    """Lines of (file, value) rows."""
    joined = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r?\n\t", " ")
    each = raw.select("file", F.posexplode(F.split(joined, r"\r?\n")).alias("line_no", "line")).where("line <> ''")
    label = F.regexp_extract("line", r"^[@*%]([^:\t]*):?", 1)
    body = F.regexp_extract("line", r"^[@*%][^:\t]*:[ \t]*(.*)$", 1)
    kind = F.when(F.col("line").rlike(r"^@[A-Za-z]"), "header").when(F.col("line").rlike(r"^\*[A-Za-z0-9]+:"), "utterance").when(F.col("line").rlike("^%[a-z]+:"), "tier").otherwise("error")
    return each.select("file", "line_no", kind.alias("kind"), label.alias("label"), F.when(kind == "error", F.col("line")).otherwise(body).alias("text"))


def strict(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of clean files, errors)."""
    errors = lines.where("kind = 'error'")
    return lines.join(errors.select("file").distinct(), "file", "left_anti"), errors


def declared_languages(lines: DataFrame) -> DataFrame:
    return lines.where("kind = 'header' AND label = 'Languages'").select("file", F.split(F.trim("text"), r"\s*,\s*").alias("languages"))


def word_struct(w: Column) -> Column:
    """struct<text, lang, pos_hint> of a word as written: ``tienda@s:spa``, ``run$v``, ``(be)cause``."""
    lang = F.regexp_extract(w, r"@s:([a-z]{3})", 1)
    hint = F.regexp_extract(w, r"\$([a-z:]+)$", 1)
    text = F.regexp_replace(F.regexp_replace(w, r"@s(:[a-z]{3})?|@[a-z]+|\$[a-z:]+$", ""), r"[()]", "")
    return F.struct(text.alias("text"), F.when(lang != "", lang).alias("lang"), F.when(hint != "", hint).alias("pos_hint"))


def utterances(lines: DataFrame) -> DataFrame:
    """file, utt, line_no, speaker, words, terminator, start_ms, end_ms, has_overlap."""
    from pyspark.sql import Window

    # one step for each value that others use several times, so that it is computed once
    body = F.trim(F.regexp_replace("text", BULLET + r"\d+_\d+" + BULLET, ""))
    clean = F.regexp_replace(F.regexp_replace(body, r"\[[^\]]*\]", " "), "[<>]", " ")
    said = lines.where("kind = 'utterance'").select("file", "line_no", "label", "text", F.split(clean, r"\s+").alias("t"))
    kept = said.withColumn("t", F.filter("t", lambda t: (t != "") & ~t.rlike(r"^(0|&[=+].*|\+<|\+\^|\+,|\+\+)$")))
    ended = kept.withColumn("last", F.try_element_at("t", F.lit(-1))).withColumn("terminator", F.when(F.col("last").rlike(r"^([.?!]|\+[./!?\".]+)$"), F.col("last")))
    words = F.when(F.col("terminator").isNotNull(), F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))).otherwise(F.col("t"))
    bare = ended.withColumn("t", F.filter(words, lambda w: ~w.rlike(r"^[,‡„]$")))
    time = lambda i: F.try_to_number(F.nullif(F.regexp_extract("text", BULLET + r"(\d+)_(\d+)" + BULLET, i), F.lit("")), F.lit("999999999999")).cast("long")
    rows = bare.select(
        "file", "line_no", F.col("label").alias("speaker"), F.transform("t", word_struct).alias("words"), "terminator",
        time(1).alias("start_ms"), time(2).alias("end_ms"), F.col("text").contains("+<").alias("has_overlap"),
    )
    return rows.withColumn("utt", (F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).cast("long"))


def tiers(lines: DataFrame) -> DataFrame:
    """file, utt, label, content: a tier belongs to the utterance before it."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("utt", F.sum((F.col("kind") == "utterance").cast("long")).over(order) - 1)
    return marked.where("kind = 'tier' AND utt >= 0").select("file", "utt", "label", F.col("text").alias("content"))


def render(utts: DataFrame, headers: DataFrame, dependents: DataFrame) -> DataFrame:
    """file, value: text of whole files, in order of headers, utterances with their tiers, and the end mark.

    ``utts``: file, utt, speaker, text (words and terminator), start_ms, end_ms; ``headers``: file, seq, key,
    value; ``dependents``: file, utt, label, content.
    """
    bullet = F.when(F.col("start_ms").isNotNull(), F.concat(F.lit(f" {BULLET}"), F.col("start_ms").cast("string"), F.lit("_"), F.col("end_ms").cast("string"), F.lit(BULLET))).otherwise("")
    h = headers.select("file", F.lit(0).alias("a"), F.col("seq").cast("long").alias("b"), F.lit("").alias("c"), F.when(F.coalesce("value", F.lit("")) == "", F.concat(F.lit("@"), "key")).otherwise(F.concat(F.lit("@"), "key", F.lit(":\t"), "value")).alias("line"))
    u = utts.select("file", F.lit(1).alias("a"), F.col("utt").cast("long").alias("b"), F.lit("").alias("c"), F.concat(F.lit("*"), "speaker", F.lit(":\t"), "text", bullet).alias("line"))
    t = dependents.select("file", F.lit(1).alias("a"), F.col("utt").cast("long").alias("b"), F.col("label").alias("c"), F.concat(F.lit("%"), "label", F.lit(":\t"), "content").alias("line"))
    e = utts.select("file").distinct().select("file", F.lit(2).alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("c"), F.lit("@End").alias("line"))
    all_ = h.unionByName(u).unionByName(t).unionByName(e)
    return all_.groupBy("file").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "c", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


def write_text(files: DataFrame, path: str) -> None:
    files.select("value").write.mode("overwrite").option("lineSep", "").text(path)


DESCRIPTION = "file string, languages array<string>, media string, participants array<struct<code:string,role:string>>, utterances array<struct<speaker:int,text:string,start_ms:bigint,end_ms:bigint>>"


def from_json(rows: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(utts, headers, dependents) of JSON descriptions; speaker codes by index, SP<n> where there is none."""
    d = rows.select(F.from_json(column, DESCRIPTION).alias("d")).select("d.*")
    who = F.concat_ws(", ", F.transform("participants", lambda p: F.concat_ws(" ", p["code"], p["role"])))
    heads = d.select("file", F.posexplode(F.filter(F.array(
        F.struct(F.lit("UTF8").alias("key"), F.lit("").alias("value")), F.struct(F.lit("Begin").alias("key"), F.lit("").alias("value")),
        F.struct(F.lit("Languages").alias("key"), F.array_join("languages", ", ").alias("value")), F.struct(F.lit("Participants").alias("key"), who.alias("value")),
        F.struct(F.lit("Media").alias("key"), F.coalesce(F.col("media"), F.lit("")).alias("value"))), lambda h: (h["key"] != "Media") | (h["value"] != ""))).alias("seq", "h")).select("file", "seq", "h.key", "h.value")
    u = d.select("file", "participants", F.posexplode("utterances").alias("utt", "u"))
    code = F.coalesce(F.get("participants", F.col("u.speaker"))["code"], F.concat(F.lit("SP"), F.col("u.speaker").cast("string")))
    utts = u.select("file", F.col("utt").cast("long").alias("utt"), code.alias("speaker"), "u.text", "u.start_ms", "u.end_ms")
    return utts, heads, utts.select("file", "utt", F.lit("").alias("label"), F.lit("").alias("content")).where("false")


def inject_provenance(value: Column, fields: dict[str, str]) -> Column:
    """A comment header with key=value pairs before the first utterance."""
    line = "@Comment:\t[provenance] " + "; ".join(f"{k}={v}" for k, v in fields.items())
    return F.regexp_replace(value, r"(?m)\A((?:@[^\n]*\n)*?)(?=\*|@End)", "$1" + line + "\n")


def extract_provenance(value: Column) -> Column:
    """map of the provenance comment, null without one."""
    found = F.regexp_extract(value, r"(?m)^@Comment:\s\[provenance\] (.*)$", 1)
    return F.when(found != "", F.str_to_map(found, F.lit("; "), F.lit("=")))
