"""Queries over whole turns: nothing after the first words is left out."""

import duckdb

from tests.test_alignment import lcs
from turnwise.functions import words as W
from turnwise.queries import QUERIES
from turnwise.queries.base import utterances
from turnwise.queries.matching import pairs
from pyspark.sql import functions as F


def test_pairs_and_error_counts_use_all_words(spark, sf):
    rows = pairs(spark, sf).collect()
    n = duckdb.sql(f"SELECT sum(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))) FROM '{sf}/conversations.parquet'").fetchall()[0][0]
    assert sum(len(r.gold) for r in rows) == n and max(len(r.gold) for r in rows) > 25
    got = {(r.file, r.utt): (r.matches, r.extra_payload, r.extra_reference) for r in QUERIES["c03_alignment_counts"](spark, sf).collect()}
    some = [r for r in rows if len(r.gold) > 25][:20]
    assert some
    for r in some:
        k = lcs(r.main, r.gold)
        assert got[r.file, r.utt] == (k, len(r.main) - k, len(r.gold) - k)


def test_error_rates_reach_every_content_word(spark, sf):
    content = lambda c: W.conform_all(F.filter(c, lambda w: ~W.is_punct_or_filler(w)))
    want = {}
    for r in pairs(spark, sf).select("speaker", content("main").alias("a"), content("gold").alias("b")).collect():
        k = lcs(r.a, r.b)
        m, i, x = want.get(r.speaker, (0, 0, 0))
        want[r.speaker] = (m + k, i + len(r.a) - k, x + len(r.b) - k)
    got = {r.speaker: (r.matches, r.insertions, r.deletions) for r in QUERIES["d01_d03_error_rates"](spark, sf).collect()}
    assert got == want


def test_commands_see_whole_turns(spark, sf):
    n = utterances(spark, sf).select(F.sum(F.size("words"))).first()[0]
    assert QUERIES["c26_token_stitching"](spark, sf).count() == n
    said = QUERIES["k03_utseg"](spark, sf).select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert said == n


def test_text_rules_reach_the_end(spark, sf):
    longest = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY length(text) DESC LIMIT 1").fetchall()[0]
    clean = QUERIES["h16_illegal_characters"](spark, sf).where(F.col("doc_id") == longest[0]).first().clean
    assert len(longest[1]) > 400 and len(clean) > 400
    n = utterances(spark, sf).select(F.sum(F.size("words"))).first()[0]
    assert QUERIES["h11_split_with_times"](spark, sf).count() == n
    assert QUERIES["h24_sentences"](spark, sf).where(F.size(F.split("gra", " ")) > 6).count() > 0
