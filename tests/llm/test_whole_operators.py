"""Cases in which an operator once did less than the whole job."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from turnwise.llm import decontaminate, neardup, pii, urlfilter


def test_rows_that_share_an_id_stay_apart_in_decontamination(spark):
    docs = [(1, "a b c"), (1, "d e f"), (1, "a b c"), (1, "clean"), (None, "a b c"), (None, "x"), (None, None), (None, ""), (2, "d e f a b c")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_d", F.lit(1)).withColumn("items", F.lit("z"))
    b = spark.createDataFrame([(7, "a b c"), (8, "d e f"), (9, "zz yy xx"), (10, "b c"), (None, "d e")], "item_id long, text string")
    abc, def_ = ("7", "10"), ("8",)
    got = Counter((r.doc_id, r.n_words, tuple(zip(r.starts, r.ends)), tuple(sorted(r["items"], key=int))) for r in decontaminate.find_hits(d, b).collect())
    assert got == Counter([(1, 3, ((0, 3),), abc), (1, 3, ((0, 3),), def_), (1, 3, ((0, 3),), abc), (1, 1, (), ()), (None, 3, ((0, 3),), abc), (None, 1, (), ()), (None, 0, (), ()), (None, 0, (), ()), (2, 6, ((0, 6),), ("7", "8", "10"))])
    left = decontaminate.decontaminate(d, b)
    assert left.columns == d.columns and Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, "clean"), (None, "x"), (None, None), (None, "")])


def test_addresses_of_any_length_stay_distinct(spark, monkeypatch):
    few = lambda names, attempt, key: F.transform(names, lambda n: F.concat(F.lit("9.9.9."), F.abs(F.hash(n, attempt(n)) % 60).cast("string")))
    monkeypatch.setattr(pii, "values_of", few)
    names = [f"ip|#{7 + i}|1.1.1.{i}" for i in range(15)] + [f"ip|#{30 + i}|9.9.9.{i}" for i in range(5)]

    def drawn(lost):
        tries = spark.createDataFrame([(n, lost.get(n, 0)) for n in names], "name string, a int")
        return [r.v for r in tries.select(few(F.array("name"), lambda n: F.col("a"), "k")[0].alias("v")).collect()]

    assert len(set(drawn({}))) < len(names)  # first draws clash, between lengths only
    got = drawn({r.name: r.attempt for r in pii.redraws(spark.createDataFrame([(n,) for n in names], "name string"), "k").collect()})
    assert len(set(got)) == len(names) and not set(got) & {f"9.9.9.{i}" for i in range(5)}


def test_deep_paths_and_capitals(spark):
    e = spark.createDataFrame([("A.com/x/y/z/w/v", "block", "2024-01-01"), ("b.com/Q", "block", "2024-01-01")], "pattern string, action string, effective string")
    c = spark.createDataFrame([(1, "http://a.com/x/y/z/w/v/u", "2024-02-01"), (2, "http://a.com/x/y/z/w", "2024-02-01"), (3, "http://B.com/Q/r", "2024-02-01"), (4, "http://b.com/q", "2024-02-01")], "id long, url string, fetched string")
    for most in (200_000, 0):
        got = {r.id: r.kept for r in urlfilter.filter_urls(c, e, broadcast_rows=most, salts=3).collect()}
        assert got == {1: False, 2: True, 3: False, 4: True}


def test_no_link_is_lost_in_a_crowd(spark):
    """4,000 sets of pairwise similarity 0.79, which is no link, and 60 pairs above 0.8 among them."""
    shared = [f"b{i}" for i in range(790)]
    rows = [(i, " ".join(shared + [f"o{i}_{k}" for k in range(105)])) for i in range(4_000)]
    pairs = [(5_000 + 2 * p, 5_001 + 2 * p) for p in range(60)]
    for p, pair in enumerate(pairs):
        rows += [(i, " ".join(shared + [f"s{p}_{k}" for k in range(12)] + [f"o{i}_{k}" for k in range(93)])) for i in pair]
    got = {r.doc_id: r.component_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), size=1).collect()}
    assert [got[b] for _, b in pairs] == [a for a, _ in pairs]
    assert all(got[i] == i for i in range(4_000))


def test_common_counts_match_set_intersection():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60 if k % 3 else 5_000, 40).astype(np.uint64)) for k in range(70)] + [np.zeros(0, np.uint64)]
    a, b = sets[:40], sets[20:]
    assert neardup.common_counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert neardup.common_counts([], b).shape == (0, len(b))


def test_documents_that_share_an_id_stay_apart(spark):
    a, b = "a b c d e f", "u v w x y z"
    docs = [(1, a), (3, a), (3, b), (7, b), (5, "m n o"), (5, "m n o"), (None, "q r s"), (None, "q r s"), (9, ""), (9, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class", F.lit("x")).withColumn("_d", F.lit(1))
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.classes(d, size=2).collect())
    assert got == Counter([(1, 1, True), (3, 1, False), (3, 3, True), (7, 3, False), (5, 5, True), (5, 5, True), (None, None, True), (None, None, True), (9, 9, True), (9, 9, True)])
    stay = neardup.deduplicate(d, size=2)
    assert stay.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in stay.collect()) == Counter([(1, a), (3, b), (5, "m n o"), (None, "q r s"), (9, ""), (9, None)])
    named = spark.createDataFrame([("k2", a), ("k1", a), ("k3", b)], "name string, body string")
    assert {r.name for r in neardup.deduplicate(named, doc_id="name", text="body", size=2).collect()} == {"k1", "k3"}


def test_the_quick_look_misses_no_entity(spark):
    """Each kind of entity alone in a text, behind each kind of character."""
    some = ["a@b.org", "1.2.3.4", "+49 123 4567", "(212) 555-0100", "212-555-0100", "123-45-6789", "4000123412341234", "0f" * 16, "Mr Smith", "Señora López", "κυρία Άννα", "г-жа Анна", "Herr. Weber"]
    before = ["", " ", "x ", "1", "-", ".", "é ", "_", "(", "\n"]
    texts = spark.createDataFrame([(b + e + t,) for e in some for b in before for t in ("", ".", " x")], "text string")
    full = F.regexp_extract_all("text", F.lit(pii.ENTITY), 0)
    assert texts.where(full != pii.matches(F.col("text"))).count() == 0
    assert texts.where(F.size(full) > 0).count() > 0.7 * texts.count()
