"""Alignment after an edit, against full runs and by hand."""

import random

from turnwise.operators import incremental as I

UTT = "file long, utt long, speaker string, words string, start_ms long, end_ms long, n_chars long"
MOST, END = 5_000, 120_000


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[3] or "")) for r in rows], UTT)


def full(spark, df):
    empty = df.limit(0)
    times = spark.createDataFrame([], "file long, utt long, pos int, start_ms long, end_ms long")
    return I.realign(empty, df, times, I.even_engine, MOST, END)


def rows_of(df):
    return sorted(((r.file, r.utt, r.pos, r.start_ms, r.end_ms) for r in df.collect()))


def test_only_touched_groups_are_sent(spark):
    before = [(1, i, "A", f"word{i} and more{i}", i * 2_000, i * 2_000 + 1_500) for i in range(10)]
    after = [r if r[1] != 5 else (*r[:3], "other words here now", *r[4:]) for r in before]
    after[8] = (*after[8][:2], "B", *after[8][3:])  # another speaker alone
    b, a = frame(spark, before), frame(spark, after)
    times = full(spark, b).drop("source")
    got = I.realign(b, a, times, I.even_engine, MOST, END)
    sent = {r.utt for r in got.where("source = 'engine'").select("utt").distinct().collect()}
    groups, _ = I.plan(b, a, times, MOST, END)
    touched = {r.utt for r in groups.where("NOT kept").collect()}
    assert 5 in sent and sent == touched and len(sent) <= 3 and 8 not in sent
    assert rows_of(got) == rows_of(full(spark, a))


def test_edits_equal_a_full_run(spark):
    r = random.Random(11)
    vocab = ["ba", "ke", "li", "mo", "nu", "pa", "ro", "si"]
    before, after = [], []
    for f in range(12):
        t, n = 0, 0
        for i in range(r.randint(0, 25)):
            t += r.randint(0, 900)
            e = t + r.randint(300, 1_800)
            row = (f, i, r.choice("AB"), " ".join(r.choice(vocab) + str(r.randint(0, 30)) for _ in range(r.randint(1, 6))), *((None, None) if r.random() < 0.1 else (t, e)))
            before.append(row)
            what = r.random()
            if what < 0.06:
                after.append((f, n, *row[2:3], "new " + row[3], *row[4:]))
                n += 1
            elif what < 0.1:
                pass
            elif what < 0.14:
                after += [(f, n, *row[2:]), (f, n + 1, "A", "put in", e, e + 10)]
                n += 2
            else:
                after.append((f, n, *row[2:]))
                n += 1
            t = e
    b, a = frame(spark, before), frame(spark, after)
    times = full(spark, b).drop("source")
    got = I.realign(b, a, times, I.even_engine, MOST, END, same_window=True)
    assert rows_of(got) == rows_of(full(spark, a))
    share = got.where("source = 'kept'").count() / got.count()
    assert 0.2 < share < 1
    again = I.realign(a, a, full(spark, a).drop("source"), I.even_engine, MOST, END, same_window=True)
    assert again.where("source = 'engine'").count() == 0 and rows_of(again) == rows_of(full(spark, a))


def test_missing_times_are_asked_again(spark):
    rows = [(1, 0, "A", "one two", 0, 1_000), (1, 1, "A", None, 1_000, 2_000), (1, 2, "A", "three", 9_000, 9_900), (2, 0, "A", "", 0, 5), (None, 0, "A", "x", 0, 9)]
    d = frame(spark, rows)
    times = spark.createDataFrame([(1, 0, 0, 0, 400), (1, 2, 0, 9_000, 9_500), (1, 2, 0, 9_000, 9_500), (1, 2, 7, 0, 1)], "file long, utt long, pos int, start_ms long, end_ms long")
    got = {(r.file, r.utt, r.pos): r.source for r in I.realign(d.where("file IS NOT NULL"), d.where("file IS NOT NULL"), times, I.even_engine, MOST, END).collect()}
    assert got == {(1, 0, 0): "engine", (1, 0, 1): "engine", (1, 2, 0): "kept"}
    assert I.realign(d.limit(0), d.limit(0), times, I.even_engine, MOST, END).count() == 0
