"""Finding inputs and naming outputs, as scans and column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str | list[str], glob: str = "*.cha", recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of matching files (contents are not read until asked for)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "length", "modificationTime")


def scan_mixed(spark: SparkSession, directories: list[str], files: list[str], glob: str = "*.cha") -> DataFrame:
    """Directories by pattern, single files whatever their name."""
    parts = [scan(spark, d, glob) for d in directories] + ([spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")] if files else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["path"])


def largest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("length"), "path")


def is_dummy(text: Column) -> Column:
    """Placeholder transcripts, which hold no speech."""
    return text.rlike(r"(?m)^@Options:\s.*\bdummy\b") | text.contains("This is a dummy file")


def display_name(path: Column, base: str) -> Column:
    return F.regexp_replace(path, "^(file:)?" + "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in base.rstrip("/")) + "/", "")


def common_base(paths: DataFrame, path: str = "path") -> Column:
    """The directory that two extreme paths share (as a driver value, from one aggregated row)."""
    row = paths.agg(F.min(path).alias("a"), F.max(path).alias("b")).first()
    a, b = (row["a"] or "").split("/"), (row["b"] or "").split("/")
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)) - 1)
    return "/".join(a[:same])


def output_name(path: Column, policy: str, extension: str = "cha", stem_suffix: str = "") -> Column:
    """preserve | replace_extension | rewrite_stem."""
    if policy == "preserve":
        return path
    if policy == "replace_extension":
        return F.regexp_replace(path, r"\.[^./]+$", f".{extension}")
    return F.regexp_replace(path, r"(\.[^./]+)$", f"{stem_suffix}$1")


def audio_identity(path: Column, modified: Column, length: Column) -> Column:
    return F.concat_ws("|", path, F.unix_millis(modified).cast("string"), length.cast("string"))


def manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, digest of every artifact under a root."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", "length", F.sha2("content", 256).alias("digest"))


def verify(manifest_: DataFrame, expected: DataFrame) -> DataFrame:
    """Differences to an expected (path, digest): missing, unexpected or changed."""
    e = expected.select("path", F.col("digest").alias("want"))
    both = manifest_.select("path", "digest").join(e, "path", "full_outer")
    return both.withColumn("problem", F.when(F.col("digest").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("digest") != F.col("want"), "changed")).where("problem IS NOT NULL")


def copy_nonmatching(spark: SparkSession, source: str, target: str, suffix: str) -> int:
    """Copies files without ``suffix`` to ``target`` under their relative names; how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(conf)
    root = fs.makeQualified(at).toString()
    done, it = 0, fs.listFiles(at, True)
    while it.hasNext():
        p = it.next().getPath()
        if p.getName().endswith(suffix):
            continue
        to = jvm.org.apache.hadoop.fs.Path(target + "/" + p.toString()[len(root) :].lstrip("/"))
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to.getFileSystem(conf), to, False, conf)
        done += 1
    return done
