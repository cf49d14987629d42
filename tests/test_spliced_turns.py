"""Spliced trees are made inside a row for each utterance: nothing is joined by word, odd keys and heads come through."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import differs
from turnwise.functions.lazy import _python
from turnwise.operators import splice
from turnwise.queries import ORACLE_SQL, QUERIES

HOST = "file string, utt int, id int, text string, lemma string, upos string, head int, deprel string, lang string"
SECOND = "file string, utt int, span int, id int, word int, text string, lemma string, upos string, head int, deprel string"


def test_words_are_not_shuffled(spark, sf):
    plan = QUERIES["c34_spliced_trees"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # turns are dealt once, as texts
    assert plan.count("Exchange") <= 1 and "Join" not in plan and "Window" not in plan and "Sort" not in plan, plan
    assert plan.count("ArrowEvalPython") == 1


def test_turns_without_keys_and_long_turns_match_the_sql(spark, tmp_path):
    rows = [(None, 0, "a b c d e f g h i j k l"), (1, None, "a b c d e f g"), (None, None, "k l m n o p"), (2, 0, None), (2, 1, ""), (2, 2, "  "), (2, 3, "a"), (2, 4, "a b c d"), (3, 0, " ".join(f"w{i}" for i in range(30_000)))]
    table = spark.createDataFrame([(f, u, "user", t) for f, u, t in rows], "conv_id long, turn long, role string, text string")
    table.coalesce(1).write.parquet(str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("*.parquet")
    (tmp_path / "conversations.parquet").write_bytes(part.read_bytes())
    assert differs(spark, QUERIES["c34_spliced_trees"], ORACLE_SQL["c34_spliced_trees"], str(tmp_path)) is None


@pytest.mark.parametrize("head", [None, -1, 9])
def test_heads_that_lead_nowhere(spark, head):
    host = [("f", 0, 1, "a", "a", "NOUN", 3, "obj", None), ("f", 0, 2, "b", "b", "NOUN", head, "obj", "spa"), ("f", 0, 3, "e", "e", "NOUN", 0, "root", None), ("f", 1, 1, "c", "c", "VERB", 0, "root", None), ("f", 1, 2, "d", "d", "NOUN", 1, "obj", "spa")]
    second = [("f", u, 1, 1, 1, t, t, "NOUN", h, "root") for u, t, h in ((0, "b", 0), (1, "d", head))]
    out = splice.splice(spark.createDataFrame(host, HOST), spark.createDataFrame(second, SECOND))
    got = sorted(tuple(r) for r in out.select("utt", "id", "text", "lemma", "upos", "head", "origin").collect())
    # no tree: the word keeps its place; a root of a parse without a head is its first row
    assert got == [(0, 1, "a", "a", "NOUN", 3, "host"), (0, 2, "b", "xxx", "L2", None, "fallback"), (0, 3, "e", "e", "NOUN", 0, "host"), (1, 1, "c", "c", "VERB", 0, "host"), (1, 2, "d", "d", "NOUN", 1, "spliced")]


def test_spans_of_languages(spark):
    langs = [["spa", "spa", "fra", None, "fra"], [None, None], [], ["spa"], [None, "spa", None, "spa", "spa"]]
    host = F.transform("l", lambda x: F.struct(x.alias("lang")))
    rows = spark.createDataFrame(list(enumerate(langs)), "k int, l array<string>").select("k", host.alias("h")).select("k", splice.spans(F.col("h")).alias("s")).collect()
    assert {r.k: [tuple(x) for x in r.s] for r in rows} == {0: [(0, 1), (2, 2), (4, 4)], 1: [], 2: [], 3: [(0, 0)], 4: [(1, 1), (3, 4)]}


def test_lists_become_what_arrow_makes_of_them():
    some = [pa.array([[1, 2], None, [], [3, None]]), pa.array([[1, 2], [], [3]]), pa.array([[[1], [2, 3]], [], None, [None, []]]), pa.array([["a", None], ["b"]]), pa.array([1.5, float("inf")]), pa.array([1, None]), pa.array([True, False]), pa.array([[{"a": 1}], None, [None]])]
    for a in some:
        for i in range(len(a) + 1):
            for j in range(i, len(a) + 1):
                assert repr(_python(a.slice(i, j - i))) == repr(a.slice(i, j - i).to_pylist())
