"""Rule cascades on hand-written words and parses."""

import pytest

from turnwise.operators import cascades

ITEM = "lang string, text string, lemma string, upos string, feats string, n int"
PARSE = "file long, utt long, id long, text string, lemma string, upos string, feats string, head long, deprel string, lang string"


@pytest.fixture(params=[20_000, 3])
def rows_sent(request, monkeypatch):
    monkeypatch.setattr(cascades, "_BROADCAST_ROWS", request.param)


def test_first_rule_counts(spark, rows_sent):
    rows = [
        ("jpn", "食べちゃう", "食べる", "verb", None, 1), ("jpn", "飲んだ", "飲む", "verb", None, 2), ("jpn", "さ", "為る", "verb", None, 3), ("jpn", "さ", "差", "noun", None, 4), ("jpn", "速い", "速い", "adj", "F=1", 5),
        ("jpn", "速い", "速い", "noun", None, 6), ("jpn", "な", "だ", "aux", None, 7), ("jpn", "降りた", "降る", "verb", None, 8), ("jpn", "て", "て", "sconj", None, 9), (None, "飲んだ", "飲む", "verb", None, 10),
        ("jpn", None, None, None, None, 11), ("ita", "Dammela", "dammelo", "ADJ", "x", 12), ("ita", "dammela", "dammelo", "ADV", "x", 13), ("jpn", "飲んだ", "飲む", "verb", None, 2), ("jpn", "", "", "", None, 14),
    ]
    out = sorted(((r.n, r.upos, r.lemma) for r in cascades.applied(spark.createDataFrame(rows, ITEM), cascades.builtin(spark)).collect()))
    assert out == [
        (1, "sconj", "ば"), (2, "verb", "飲む"), (2, "verb", "飲む"), (3, "part", "為る"), (4, "noun", "差"), (5, "adj", "速い"), (6, "noun", "速い"), (7, "aux", "た"), (8, "verb", "降りる"), (9, "sconj", "て"),
        (10, "verb", "飲む"), (11, None, None), (12, "VERB", "dare"), (13, "ADV", "dammelo"), (14, "", ""),
    ]
    rules = {r.n: (r.rule, r.feats) for r in cascades.applied(spark.createDataFrame(rows, ITEM), cascades.builtin(spark)).collect()}
    assert rules[9] == (None, None) and rules[12][1].startswith("Mood=Imp") and rules[5] == (15, "F=1")
    assert cascades.applied(spark.createDataFrame([], ITEM), cascades.builtin(spark)).count() == 0
    assert cascades.applied(spark.createDataFrame(rows, ITEM), cascades.builtin(spark).limit(0)).where("rule IS NOT NULL").count() == 0


def test_split_words_become_one(spark, rows_sent):
    one = [("il", "DET", 2), ("gomito", "NOUN", 5), ("lo", "PRON", 2), ("non", "ADV", 5), ("rotola", "VERB", 0), ("via", "ADV", 3)]
    items = [(1, 1, i, t, t, u, None, h, "root" if h == 0 else f"r{i}", "ita") for i, (t, u, h) in enumerate(one, 1)]
    two = [("da", "ADP", 0), ("glie", "PRON", 1), ("la", "PRON", 1), ("par", "X", 5), ("la", "X", 4)]
    items += [(1, 2, i, t, t, u, None, h, f"r{i}", "ita") for i, (t, u, h) in enumerate(two, 1)]
    items += [(2, 1, 1, "gomito", "gomito", "X", None, 0, "root", "deu"), (2, 1, 2, "lo", "lo", "X", None, 1, "r", "deu")]
    ranges = [(1, 1, 2, 3, "Gomitolo"), (1, 1, 3, 4, "cielo"), (1, 1, 6, 9, "cielo"), (1, 2, 1, 3, "dagliela"), (1, 2, 4, 5, "parla"), (2, 1, 1, 2, "gomitolo")]
    out = cascades.regrouped(spark.createDataFrame(items, PARSE), spark.createDataFrame(ranges, "file long, utt long, first long, last long, text string"), cascades.builtin_ranges(spark))
    got = sorted((r.file, r.utt, r.id, r.text, r.lemma, r.upos, r["head"], r.deprel) for r in out.collect())
    assert got == [
        (1, 1, 1, "il", "il", "DET", 2, "r1"), (1, 1, 2, "Gomitolo", "gomitolo", "NOUN", 4, "r2"), (1, 1, 3, "non", "non", "ADV", 4, "r4"), (1, 1, 4, "rotola", "rotola", "VERB", 0, "root"), (1, 1, 5, "via", "via", "ADV", 2, "r6"),
        (1, 2, 1, "da", "dare", "VERB", 0, "r1"), (1, 2, 2, "glie", "glie", "PRON", 1, "r2"), (1, 2, 3, "la", "la", "PRON", 1, "r3"), (1, 2, 4, "parla", "parlare", "VERB", 0, "r4"),
        (2, 1, 1, "gomito", "gomito", "X", 0, "root"), (2, 1, 2, "lo", "lo", "X", 1, "r"),
    ]
    assert out.columns == [c.split()[0] for c in PARSE.split(", ")]
