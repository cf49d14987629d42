from pyspark.sql import functions as F

from turnwise.functions import numbers as N
from turnwise.functions import sequences, words
from turnwise.operators import segmentation, timing
from turnwise.plans.stages import Plan, Stage
from turnwise.sources import payloads, transcripts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_number_words():
    assert [N.ordinal(n) for n in (0, 12, 20, 21, 100, 105, 1000, 1100, 2005, 10000)] == ["zeroth", "twelfth", "twentieth", "twenty-first", "one hundredth", "one hundred and fifth", "one thousandth", "one thousand, one hundredth", "two thousand, and fifth", "10000th"]
    assert [N.year(n) for n in (7, 1984, 2000, 2007, 1900, 500)] == ["seven", "nineteen eighty-four", "two thousand", "two thousand and seven", "nineteen hundred", "500"]
    assert [N.decade(n) for n in (90, 1990, 2000)] == ["nineties", "nineteen nineties", "two thousands"]
    assert [N.chinese(n) for n in (0, 10, 11, 105, 110, 1001, 10010, 100000000)] == ["零", "十", "十一", "一百零五", "一百一十", "一千零一", "一万零一十", "一亿"]
    assert N.chinese(20000, "traditional") == "二萬"
    assert N.expand("7-8", "eng") == "seven eight" and N.expand("$5", "eng") == "five dollars" and N.expand("x", "eng") == "x" and N.expand("3-year", "eng") == "three-year"


def test_word_rules(spark):
    assert one(spark, words.conform(F.lit("I'd"))) == ["i", "had"]
    assert one(spark, words.conform(F.lit("em"))) == ["um"]
    assert one(spark, words.conform(F.lit("well-known"))) == ["well", "known"]
    assert one(spark, words.percent_split(F.lit("12%"), "deu")) == ["12", "Prozent"]
    assert one(spark, words.strip_punct(F.lit("a.,"))) == "a"
    assert one(spark, words.features(F.lit("A=1|B=2"))) == {"A": "1", "B": "2"}
    assert one(spark, words.milliseconds(F.lit(0.0005))) == 1


def test_lists(spark):
    assert one(spark, sequences.lcs_length(arr(*"abc"), arr(*"xac"))) == 2
    assert one(spark, sequences.lcs_length(arr(), arr("a"))) == 0
    assert one(spark, sequences.retraces(arr("the", "dog", "The", "dog", "ran"))) == [True, True, False, False, False]
    assert one(spark, sequences.retraces(arr("a"))) == [False]
    assert one(spark, sequences.merge_compounds(arr("air", "port", "air"))) == ["airport", "air"]
    assert one(spark, sequences.merge_abbreviations(arr("F", "B", "I", "x"))) == ["FBI", "x"]
    assert one(spark, sequences.join_single_letters(arr())) == []
    assert one(spark, sequences.bag_difference(arr("a", "A"), arr("a"))) == 1


def test_pauses_start_chunks(spark):
    rows = [(1, i, w, s, e) for i, (w, s, e) in enumerate([("a", 0, 100), ("b", 100, 200), ("And", 1100, 1200), ("so", 1300, 1400), ("x", 3000, 3100)])]
    out = segmentation.split_on_pauses(spark.createDataFrame(rows, "file long, seq int, text string, start_ms long, end_ms long"), ["file"], "seq")
    assert [r.chunk for r in out.orderBy("seq").collect()] == [0, 0, 1, 1, 1]


def test_small_groups_merge(spark):
    rows = [(1, i, g) for i, g in enumerate([None, 0, 0, 1, 1, None, 2, 3])]
    out = segmentation.merge_small_groups(spark.createDataFrame(rows, "file long, seq int, g int"), ["file"], "seq", "g")
    assert [r.assigned for r in out.orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1, 1, 1]


def test_times(spark):
    rows = [(1, 1, "A", 100, 900), (1, 2, "B", 50, 80), (1, 3, "A", 500, 700), (1, 4, "B", None, None), (1, 5, "A", 500, 600)]
    df = spark.createDataFrame(rows, "file long, line long, speaker string, start_ms long, end_ms long")
    got = {r.line: (r.start_ms, r.end_ms, r.decision) for r in timing.enforce_monotonicity(df).collect()}
    assert got == {1: (100, 500, "end_clamped"), 2: (None, None, "timing_stripped"), 3: (None, None, "zero_duration"), 4: (None, None, None), 5: (500, 600, None)}
    assert timing.floor_pass(df).where("line = 2 AND start_ms IS NULL").count() == 1
    assert timing.enforce_monotonicity(df.limit(0)).count() == 0


def test_transcript_reading(spark):
    text = "﻿@UTF8\n@Languages:\teng, spa\n*CHI:\tI want &-um tienda@s:spa ,\n\tnow +... \x15100_900\x15\n%mor:\tx\nrubbish\n*MOT:\t+< okay .\n@End\n"
    lines = transcripts.lines_of(spark.createDataFrame([("f", text)], "file string, value string"))
    utts = transcripts.utterances(lines).orderBy("utt").collect()
    assert [w["text"] for w in utts[0].words] == ["I", "want", "&-um", "tienda", "now"] and utts[0].words[3]["lang"] == "spa"
    assert (utts[0].terminator, utts[0].start_ms, utts[0].end_ms) == ("+...", 100, 900)
    assert utts[1].has_overlap and utts[1].start_ms is None
    assert transcripts.tiers(lines).collect()[0].label == "mor"
    good, bad = transcripts.strict(lines)
    assert good.count() == 0 and bad.count() == 1
    assert transcripts.declared_languages(lines).first().languages == ["eng", "spa"]


def test_json_description(spark):
    doc = '{"file":"a","languages":["eng"],"participants":[{"code":"CHI","role":"Target_Child"}],"utterances":[{"speaker":0,"text":"hi .","start_ms":1,"end_ms":2},{"speaker":3,"text":"yes ."}]}'
    files = transcripts.render(*transcripts.from_json(spark.createDataFrame([(doc,)], "value string")))
    assert files.first().value == "@UTF8\n@Begin\n@Languages:\teng\n@Participants:\tCHI Target_Child\n*CHI:\thi . \x151_2\x15\n*SP3:\tyes .\n@End\n"


def test_payload_words(spark):
    v = '{"monologues":[{"speaker":"0","elements":[{"value":" hi ","start_s":0.1,"end_s":0.2},{"value":"<noise>"},{"value":"x","start_s":2.0,"end_s":1.0}]}]}'
    rows = payloads.asr_words(spark.createDataFrame([("f", v)], "file string, value string")).orderBy("seq").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in rows] == [("hi", 100, 200), ("x", None, None)]


def test_plans():
    import pytest

    ran = []
    p = Plan([Stage("b", lambda a: ran.append("b"), ("a",)), Stage("a", lambda **k: ran.append("a"))])
    p.run()
    assert ran == ["a", "b"]
    for bad in ([Stage("a", print), Stage("a", print)], [Stage("a", print, ("z",))], [Stage("a", print, ("b",)), Stage("b", print, ("a",))], [Stage("a", print, ("b",)), Stage("b", print, enabled=False)]):
        with pytest.raises(ValueError):
            Plan(bad).ordered()


def test_audio(spark, tmp_path):
    import wave

    import numpy as np

    from turnwise.sources import audio

    x = (np.sin(np.arange(16000) / 5) * 9000).astype("<i2")
    x[7000:8000] = 0
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(x.tobytes())
    r = audio.recordings(spark, str(tmp_path)).first()
    assert (r.rate, r.duration_ms, len(r.samples)) == (8000, 2000, 16000)
    cuts = audio.quiet_cuts(np.array(r.samples), 8000, 1.0, 0.4)
    assert cuts[0][0] == 0 and 6800 <= cuts[0][1] < 8000 and cuts[-1][1] == 16000


def test_schemas(spark):
    from turnwise import schemas

    assert '"name":"job_id"' in schemas.exported()["jobs"]
