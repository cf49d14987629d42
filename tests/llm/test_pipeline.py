"""The stages of the pipeline, each against brute force on its own input."""

import re

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import brute_classes  # noqa: E402
from turnwise.llm import bpe  # noqa: E402
from turnwise.session import table  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents").where("doc_id < 120").cache()


def stage(name):
    return dict(pipeline.STAGES)[name]


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_columns(spark, docs, sf):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"]
    for name, f in pipeline.STAGES[1:-1]:
        assert f(spark, docs, sf).columns == docs.columns, name


def test_near_duplicates(spark, docs, sf):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ids(stage("near_duplicates")(spark, docs, sf)) == {k for k, v in brute_classes(rows, 5).items() if k == v}


def test_decontamination(spark, docs, sf):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = set()
    for r in table(spark, sf, "benchmark").collect():
        w = words(r.text)
        wins |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in wins}
    clean = {r.doc_id for r in docs.collect() if not any(tuple(w[i : i + n]) in wins for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))}
    assert ids(stage("decontamination")(spark, docs, sf)) == clean


def test_pii(spark, docs, sf):
    before = {r.doc_id: r.text for r in docs.collect()}
    mail = re.compile(r"[\w.]+@[\w.]+\w")
    for r in stage("pii")(spark, docs, sf).collect():
        assert r.n_chars == len(r.text)
        assert not set(mail.findall(before[r.doc_id])) & set(mail.findall(r.text))
        if not re.search(r"\d|@|M[rs]|Frau|Herr", before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_tokens(spark, docs, sf):
    enc = bpe.encoder(**bpe.default_vocabulary())
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in stage("bpe")(spark, docs, sf).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(before[r.doc_id])


def test_clean_documents_pass_quality(spark, sf):
    all_ = table(spark, sf, "documents")
    kept = ids(stage("quality")(spark, all_, sf))
    good = {r.doc_id for r in table(spark, sf, "labels").where("quality = 1").collect()} & ids(all_)
    assert len(good & kept) >= 0.95 * len(good)


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, shared ids, and columns whose names clash."""
    from pyspark.sql import functions as F

    bench = table(spark, sf, "benchmark").orderBy("item_id").first().text
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "a text without an id " * 3, "en", "a", 1), (3, "one two three four five six seven", "en", "a", 1),
            (3, "one two three four five six seven", "en", "a", 1), (3, "another text of the same id, quite different", "en", "b", 1), (4, long, "en", "a", 1), (5, "before " + bench + " after", "en", "a", 1), (5, "a clean text of that id", "fr", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"score": F.lit("s"), "class": F.lit(1), "_d": F.lit(2), "_hits": F.lit(3), "quality_score": F.lit(4)})
    key = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    quality = stage("quality")(spark, docs, sf)
    assert quality.columns == docs.columns and quality.count() <= docs.count()
    once = stage("near_duplicates")(spark, docs, sf)
    assert once.columns == docs.columns and key(once) == sorted({(r[0] or 0, r[1]) for r in rows}, key=str)
    clean = stage("decontamination")(spark, docs, sf)
    assert clean.columns == docs.columns and key(clean) == sorted(((r[0] or 0, r[1]) for r in rows if r[1] is None or bench not in r[1]), key=str)
    out = stage("pii")(spark, docs, sf)
    assert out.columns == docs.columns and key(out) == sorted(((r[0] or 0, r[1]) for r in rows), key=str)
    coded = stage("bpe")(spark, docs, sf)
    assert coded.count() == len(rows) and coded.where("n_tokens = 0").count() == 2
    for name, f in pipeline.STAGES[1:]:
        assert f(spark, docs.limit(0), sf).count() == 0, name
