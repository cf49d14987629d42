"""Queries without SQL against plain versions over the collected tables."""

import duckdb
import pandas as pd
import pytest

from tests.test_alignment import lcs
from turnwise.functions import numbers
from turnwise.operators import alignment as A
from turnwise.queries import ORACLE_SQL, QUERIES, matching, times
from turnwise.queries.base import utterances

CHECKED = {
    "c03_alignment_items", "c04_character_alignment", "c05_similarity", "c07_compare_tokens", "k09_compare", "c33_gold_projection", "d04_benchmark_rate", "e06_out_of_order", "e03_e06_repair",
    "e14_rebalance_short", "e22_long_pauses", "e25_group_assignment", "h05_number_words", "h08_chinese_numbers", "c09_speaker_correspondence", "k12_compare_runs", "c26_token_stitching", "h28_tree_ranges",
}
#: Commands and engines: what goes in must come out, see below.
COMMANDS = {"c23_overlap_recovery", "h24_sentences", "k02_morphotag", "k03_utseg", "k04_translate", "k05_coref", "k06_align", "k07_transcribe", "k10_benchmark", "k13_evaluate"}


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def test_every_query_is_checked():
    assert set(QUERIES) - set(ORACLE_SQL) == CHECKED | COMMANDS


@pytest.fixture(scope="module")
def pairs(spark, sf):
    return matching.pairs(spark, sf).collect()


def test_alignment_items(spark, sf, pairs):
    got = {}
    for r in rows(spark, sf, "c03_alignment_items"):
        got.setdefault((r.file, r.utt), []).append((r.seq, r.type, r.key, r.payload_idx, r.reference_idx))
    low = lambda ws: [w.lower() for w in ws]
    for p in pairs:
        items = sorted(got[p.file, p.utt])
        assert [i[3] for i in items if i[3] is not None] == list(range(len(p.main))) and [i[4] for i in items if i[4] is not None] == list(range(len(p.gold)))
        assert sum(i[1] == "match" for i in items) == lcs(low(p.main), low(p.gold))
        assert all(p.main[i[3]].lower() == p.gold[i[4]].lower() for i in items if i[1] == "match")


def test_character_alignment(spark, sf, pairs):
    got = {(r.file, r.utt): (r.matches, r.extra_payload, r.extra_reference) for r in rows(spark, sf, "c04_character_alignment")}
    assert len(got) == len(pairs)
    for p in sorted(pairs, key=lambda p: len(p.gold))[:25]:
        a, b = "".join(p.main), "".join(p.gold)
        n = lcs(a, b)
        assert got[p.file, p.utt] == (n, len(a) - n, len(b) - n)


def test_similarity(spark, sf):
    con = duckdb.connect()
    seen = {(r.main, r.gold): r.similarity for r in rows(spark, sf, "c05_similarity") if r.main and r.gold and r.main.isascii() and r.gold.isascii()}
    assert len(seen) > 50
    for (a, b), s in list(seen.items())[:400]:
        want = con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert s == pytest.approx(want, abs=2e-6), (a, b, s, want)


def framed(df):
    return df.toPandas().sort_values(["file", "utt", "seq"])


def test_comparisons(spark, sf):
    main, gold = framed(matching._main_words(spark, sf)), framed(matching._gold_words(spark, sf))
    want, tally = [], {}
    for file in sorted(set(main.file) | set(gold.file)):
        own = A.compare_file(main[main.file == file], gold[gold.file == file])
        want += [(file, *r[:3], *(None if x is None else int(x) for x in r[3:5]), r[5], r[7]) for r in own]
        assert sum(r[2] != "gold" for r in own) == (main.file == file).sum() and sum(r[2] != "main" for r in own) == (gold.file == file).sum()
    got = rows(spark, sf, "c07_compare_tokens")
    assert sorted(map(str, want)) == sorted(str((r.file, r.unit, r.seq, r.side, r.main_utt, r.gold_utt, r.text, r.status)) for r in got)
    for r in rows(spark, sf, "k09_compare"):
        tally[r.file] = r
        assert r.matches + r.deletions == r.total_gold_words and r.wer == pytest.approx((r.insertions + r.deletions) / r.total_gold_words, abs=1e-4)
    assert set(tally) == set(gold.file)


def test_gold_projection(spark, sf):
    got = rows(spark, sf, "c33_gold_projection")
    assert len(got) > 10 and all(r.gold_utt == r.main_utt for r in got if r.gold_utt % 3 != 1)
    said = {(r.file, r.utt): r.words for r in utterances(spark, sf).collect()}
    assert all(said[r.file, r.main_utt] for r in got)


def test_benchmark_rate(spark, sf, pairs):
    got = {(r.file, r.utt): r for r in rows(spark, sf, "d04_benchmark_rate")}
    for p in pairs:
        r = got[p.file, p.utt]
        assert r.total == len(p.gold) and r.matches == max(0, r.total - round(r.wer * r.total))


def test_order_and_repairs(spark, sf):
    t = [r for r in times.plain(spark, sf).collect() if r.start_ms is not None and r.end_ms is not None]
    by = {}
    for r in sorted(t, key=lambda r: r.line):
        by.setdefault((r.file, r.speaker), []).append(r)
    out = {}
    for r in rows(spark, sf, "e06_out_of_order"):
        out.setdefault((r.file, r.speaker), set()).add(r.line)
    for k, own in by.items():
        best = []  # longest non-decreasing run that ends at each row
        for i, r in enumerate(own):
            best.append(1 + max((best[j] for j in range(i) if own[j].start_ms <= r.start_ms), default=0))
        kept = [r for r in own if r.line not in out.get(k, set())]
        assert len(kept) == max(best) and all(a.start_ms <= b.start_ms for a, b in zip(kept, kept[1:], strict=False))
    gone = {(f, line) for (f, _), lines in out.items() for line in lines}
    repaired = rows(spark, sf, "e03_e06_repair")
    assert {(r.file, r.line) for r in repaired if r.start_ms is None and "remov" in (r.repair or "")} <= gone | {(r.file, r.line) for r in repaired}
    assert len(repaired) == times.plain(spark, sf).count()


def test_rebalanced_words(spark, sf):
    from turnwise.operators import timing

    before = {}
    for r in timing.timed(timing.heal_word_gaps(times.word_times(spark, sf))).collect():
        before.setdefault((r.file, r.utt), []).append((r.pos, r.start_ms, r.end_ms))
    after = {}
    for r in rows(spark, sf, "e14_rebalance_short"):
        after.setdefault((r.file, r.utt), []).append((r.pos, r.start_ms, r.end_ms))
    assert set(before) == set(after)
    for k in before:
        a, b = sorted(before[k]), sorted(after[k])
        assert [x[0] for x in a] == [x[0] for x in b] and sum(x[2] - x[1] for x in a) == sum(x[2] - x[1] for x in b)
        assert all(y[2] - y[1] >= min(40, x[2] - x[1]) for x, y in zip(a, b, strict=True))


def test_pauses_and_groups(spark, sf):
    chunks = {}
    for r in rows(spark, sf, "e22_long_pauses"):
        chunks.setdefault(r.file, []).append((r.line, r.chunk))
    for own in chunks.values():
        ids = [c for _, c in sorted(own)]
        assert ids[0] == 0 and all(b - a in (0, 1) for a, b in zip(ids, ids[1:], strict=False))
        assert all(ids.count(c) >= 2 for c in set(ids[: -ids.count(ids[-1])]))
    groups = {}
    for r in rows(spark, sf, "e25_group_assignment"):
        groups.setdefault((r.file, r.utt), []).append((r.pos, r.assigned))
    from turnwise.functions import lexicon as L

    for own in groups.values():
        ids = [g for _, g in sorted(own)]
        assert ids == sorted(ids) and set(ids) == set(range(max(ids) + 1))
        assert len(set(ids)) == 1 or all(ids.count(g) >= L.SMALL_GROUP for g in set(ids))


def test_numbers(spark, sf):
    said = {r.word: r.said for r in rows(spark, sf, "h05_number_words")}
    assert all(v == numbers.expand(w, "eng") for w, v in said.items()) and len(said) > 100
    digits = "零一二三四五六七八九"
    unit = {"十": 10, "百": 100, "千": 1000}
    for r in rows(spark, sf, "h08_chinese_numbers"):
        total = block = digit = 0
        for c in r.simplified:  # read the numeral back
            if c in digits:
                digit = digits.index(c)
            elif c in unit:
                block, digit = block + (digit or 1) * unit[c], 0
            else:
                total, block, digit = total + (block + digit) * 10**4, 0, 0
        assert total + block + digit == int(r.n) and r.traditional.translate(str.maketrans("萬億", "万亿")) == r.simplified


def test_speakers(spark, sf):
    u = utterances(spark, sf).collect()
    names = {}
    for r in u:
        names.setdefault(r.file, set()).add(r.speaker) if r.words else None
    got = {}
    for r in rows(spark, sf, "c09_speaker_correspondence"):
        got.setdefault(r.file, []).append(r)
    for file, own in got.items():
        if own[0].outcome == "established":
            assert {(r.l, r.r) for r in own} == {(s, f"S-{s}") for s in names[file]}
    assert sum(o[0].outcome == "established" for o in got.values()) > len(got) / 2
    for r in rows(spark, sf, "k12_compare_runs"):
        assert r.right_words <= r.left_words and r.overlap == r.right_words


def test_stitching_and_trees(spark, sf):
    said = {(r.file, r.utt): r.words for r in utterances(spark, sf).collect()}
    for r in rows(spark, sf, "c26_token_stitching"):
        w = said[r.file, r.utt][r.pos]
        if all(x.isalnum() for x in said[r.file, r.utt]):
            assert (r.start_ms, r.end_ms) == (r.pos * 100, r.pos * 100 + (90 if len(w) > 2 else 40)), w
    assert all(r.ranges for r in rows(spark, sf, "h28_tree_ranges"))


def test_commands_keep_their_utterances(spark, sf):
    u = utterances(spark, sf).collect()
    words = sum(len(r.words) for r in u)
    some = {(r.file, r.utt) for r in u if r.words}
    tiers = rows(spark, sf, "k02_morphotag")
    assert {(r.file, r.utt) for r in tiers} == some and {r.label for r in tiers} == {"mor", "gra"}
    assert sum(len(r.content.split()) for r in tiers if r.label == "mor") >= words * 0.9
    parts = {}
    for r in sorted(rows(spark, sf, "k03_utseg"), key=lambda r: r.part):
        parts.setdefault((r.file, r.utt), []).append(r.text)
    assert {k: " ".join(v).split() for k, v in parts.items()} == {(r.file, r.utt): r.words for r in u if r.words}
    assert {(r.file, r.utt) for r in rows(spark, sf, "k04_translate")} <= some
    assert {(r.file, r.utt) for r in rows(spark, sf, "k05_coref")} <= some
    placed = rows(spark, sf, "k06_align")
    assert len(placed) == len(u) and len(rows(spark, sf, "c23_overlap_recovery")) == len(u)
    assert len(rows(spark, sf, "h24_sentences")) == len({(r.file, r.utt) for r in u if r.words})
    assert len(rows(spark, sf, "k07_transcribe")) > words * 0.8
    assert all(r.matches + r.deletions > 0 for r in rows(spark, sf, "k10_benchmark"))
    assert all(0 <= r.clean_rate <= 1 and r.spliced <= r.total for r in rows(spark, sf, "k13_evaluate"))
