"""From raw documents to token ids in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``; columns that a
table has besides pass through, whatever their names.

SQL cannot express the first stage (a trained network) and the last (BPE), so
that ``ORACLE_SQL`` is None; ``tests/llm/test_pipeline.py`` holds the stages
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import bpe, decontaminate, neardup, pii, quality
from turnwise.llm.common import cut, fresh
from turnwise.session import table

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.3).

    Null and empty texts are scored like any other; repeated rows share their fate.
    """
    score = fresh(docs, "quality_score")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), out=score)
    return scored.where(F.col(score) >= 0.3).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five words, similarity of 0.8 or more.

    Rows that repeat id and text count once; rows that share an id only are told
    apart; documents without words all stay.
    """
    return neardup.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Rows are taken out by id and text, so that another text of the same id stays;
    null and empty texts stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text (null for a null text)."""
    out = pii.pseudonymise(docs, key=pii.key_of(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), digest of the decoded bytes, of every text (null: empty)."""
    own = bpe.default_vocabulary()
    coded = bpe.encode(docs, **own, decoded="decoded")
    checked = coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return checked


STAGES = [("quality", keep_good), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("pii", without_pii), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
