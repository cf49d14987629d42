"""The commands users run, each a composition of operators over tables.

Text commands take utterances (file, utt, speaker, lang, words); audio commands
take what their engine returned (timed tokens, segments), since models and media
are outside this repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import sequences, words as W
from turnwise.functions.numbers import expanded
from turnwise.operators import alignment, joins, lexicons, metrics, morphology, phrases, segmentation, timing
from turnwise.plans.engines import infer

COMMANDS = ("morphotag", "utseg", "translate", "coref", "align", "transcribe", "transcribe_s", "compare", "benchmark", "opensmile", "avqi", "diarize")


def morphotag(utts: DataFrame, engine: str = "rules") -> DataFrame:
    """file, utt, label (mor, gra), content."""
    tagged = infer(utts.where(F.size("words") > 0).select("file", "utt", "words"), "morphology", engine)
    tiers = tagged.select("file", "utt", F.array_join(morphology.tag_items(F.col("ud")), " ").alias("mor"), F.array_join(morphology.tag_relations(F.col("ud")), " ").alias("gra"))
    return tiers.select("file", "utt", F.expr("stack(2, 'mor', mor, 'gra', gra) as (label, content)"))


def utseg(utts: DataFrame, engine: str = "rules") -> DataFrame:
    """file, utt, part, words: utterances cut where the assigned group changes."""
    kind = morphology.segmentation_class(F.col("words"))
    sent = infer(utts.where(kind == "dispatch").select("file", "utt", "words"), "segmentation", engine)
    joined = utts.join(sent, ["file", "utt"], "left")
    ids = F.when(F.size("assignments") == F.size("words"), F.col("assignments")).otherwise(F.transform("words", lambda w: F.lit(0)))
    pairs = joined.select("file", "utt", "speaker", F.posexplode(F.arrays_zip(F.col("words").alias("w"), ids.alias("g"))).alias("pos", "p")).select("file", "utt", "speaker", "pos", "p.w", "p.g")
    parts = segmentation.split_by_assignment(pairs, ["file", "utt"], "pos", "g")
    return parts.groupBy("file", "utt", "speaker", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("words"))


def translate(utts: DataFrame, engine: str = "identity") -> DataFrame:
    """Translation tiers; empty ones are left out."""
    text = utts.where(F.size("words") > 0).select("file", "utt", W.before_translation(F.array_join("words", " ")).alias("text"))
    out = infer(text, "translation", engine).withColumn("content", W.after_translation(F.col("translation")))
    return out.where(~W.is_empty_translation(F.col("content"))).select("file", "utt", F.lit("xtra").alias("label"), "content")


def coref(utts: DataFrame, engine: str = "rules") -> DataFrame:
    """Chain tiers of utterances that take part in one; a document is one payload."""
    docs = utts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("utt", "words"))).alias("sentences"))
    each = infer(docs, "coreference", engine).select("file", F.explode("chains").alias("c")).select("file", "c.utt", "c.words")
    return each.where(F.exists("words", lambda w: F.size(w) > 0)).select("file", "utt", F.lit("xcoref").alias("label"), W.bracket_annotation(F.col("words")).alias("content"))


def align(utts: DataFrame, tokens: DataFrame, duration: int) -> DataFrame:
    """Times from tokens, estimates for the rest, then order and repairs."""
    spans = alignment.recover_timing(utts.select("file", "utt", "words"), tokens)
    rows = utts.select("file", "utt", "speaker", F.size("words").alias("n_words")).join(spans, ["file", "utt"], "left").withColumnRenamed("utt", "line")
    ordered = timing.enforce_monotonicity(rows)
    return timing.estimate_untimed(timing.repair(ordered), duration).withColumnRenamed("line", "utt")


def transcribe(asr: DataFrame, lang: str = "eng", lexicon: DataFrame | None = None) -> DataFrame:
    """Utterances (file, utt, pos, text, kind) out of recogniser words (file, seq, text); multiword entries of ``lexicon`` become one word."""
    text = W.without_title_period(F.col("text")) if lang == "eng" else F.col("text")
    clean = asr.select("file", "seq", W.strip_boundary(W.strip_boundary(text, W.COMMAS), W.QUOTES).alias("text")).where("text <> ''")
    split = clean.select("file", "seq", F.posexplode(W.percent_split(F.col("text"), lang)).alias("_i", "text")).withColumn("text", expanded(F.col("text"), F.lit(lang)))
    # parts of a word are ordered by a struct: no number of parts runs into the next word
    each = split.select("file", "seq", "_i", F.posexplode(F.split("text", " ")).alias("_j", "text")).select("file", F.struct("seq", "_i", "_j").alias("seq"), "text")
    said = segmentation.retokenised(segmentation.in_order(each, ["file"], "seq", "text"), "text", "said").select("file", "said")
    words = F.transform("said", lambda u: F.transform(u, W.disfluency)) if lang == "eng" else F.col("said")
    utt = segmentation.each_utterance(said, words, "said").withColumnRenamed("said", "words")
    if lexicon is not None:
        utt = phrases.merge_multiwords(utt, lexicon)
    content = F.filter("words", lambda w: ~w.isin(W.L.ENDING_PUNCT + W.L.MOR_PUNCT))
    marks = sequences.retraces(content, 2 if lang in ("yue", "zho") else 1)
    flagged = utt.select("file", "utt", F.posexplode_outer(F.arrays_zip(content.alias("text"), marks.alias("retrace"))).alias("pos", "w")).where("pos IS NOT NULL").select("file", "utt", "pos", F.when(F.col("w.retrace"), W.strip_punct(F.col("w.text"))).otherwise(F.col("w.text")).alias("text"), F.when(F.col("w.retrace"), "retrace").otherwise("regular").alias("kind"))
    first = F.when(F.col("pos") == 0, W.capitalise_first(W.pronoun_i(F.col("text")))).otherwise(W.pronoun_i(F.col("text")))
    return flagged.withColumn("text", first if lang == "eng" else F.col("text"))


def transcribe_s(asr: DataFrame, segments: DataFrame, ends: DataFrame, lang: str = "eng") -> DataFrame:
    """As ``transcribe``, with the speakers of a diarisation; ``ends``: file, utt, end_ms, speaker."""
    return transcribe(asr, lang).join(joins.reassign_speakers(ends, segments).select("file", "utt", "speaker_new"), ["file", "utt"], "left")


def compare_words(utts: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Content words of utterances, conformed, a row for each: file, utt, seq (in order), text, pos.

    ``lexicon``: a list table (kind, key, parts) of any size, used in place of the built-in lists
    (multiword entries need nothing here, since words with ``_`` are scored by their parts).
    """
    each = utts.select("file", "utt", F.posexplode("words").alias("_p", "_w")).where(~W.is_punct_or_filler(F.col("_w")))
    value = W.conform(F.col("_w"))
    if lexicon is not None:
        each, value = lexicons.conformed(each, lexicon, "_w", "_c"), F.col("_c")
    said = each.select("file", "utt", "_p", F.posexplode(value).alias("_k", "text"))
    return said.select("file", "utt", (F.col("_p").cast("long") * (1 << 20) + F.col("_k")).alias("seq"), "text", F.lit(None).cast("string").alias("pos"))


def compare(main: DataFrame, gold: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """file, matches, insertions, deletions, total_gold_words, wer, accuracy, cwer; both sides conformed by ``lexicon`` where one is given."""
    tokens = alignment.compare(compare_words(main, lexicon), compare_words(gold, lexicon))
    rates = metrics.with_rates(metrics.tally(tokens, "file"))
    bag = metrics.bag_errors(tokens)
    return rates.join(bag, "file", "left").withColumn("cwer", F.when(F.col("total_gold_words") > 0, F.coalesce("bag_errors", F.lit(0)) / F.col("total_gold_words")).otherwise(F.lit(0.0))).drop("bag_errors")


def benchmark(asr: DataFrame, gold: DataFrame, lang: str = "eng", lexicon: DataFrame | None = None) -> DataFrame:
    """Recogniser words against gold utterances."""
    said = transcribe(asr, lang).groupBy("file", "utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("words"))
    return compare(said, gold, lexicon)


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Speaker agreement of two runs (file, speaker, token): outcome and the rate of each mapped pair."""
    found = joins.speaker_correspondence(left, right)
    a = left.join(found.select("file", F.col("l").alias("speaker"), F.concat_ws("=", "l", "r").alias("pair")), ["file", "speaker"]).withColumn("k", F.concat_ws("/", F.col("file").cast("string"), "pair"))
    b = right.join(found.select("file", F.col("r").alias("speaker"), F.concat_ws("=", "l", "r").alias("pair")), ["file", "speaker"]).withColumn("k", F.concat_ws("/", F.col("file").cast("string"), "pair"))
    return metrics.agreement(a, b, "k", "token")


def evaluate(words: DataFrame) -> DataFrame:
    """Code-switch tagging by language pair: words (file, pair, text, lang, mor, pos, feats)."""
    state = morphology.status(F.col("mor"))
    rows = words.withColumn("status", state).withColumn("flags", morphology.flags(F.col("text"), F.col("lang"), F.col("pos"), F.col("feats"), F.col("status")))
    return metrics.per_pair_rollup(rows, "pair", ["spliced", "l2xxx", "missing_mor"], ["propn_for_function_word", "feature_pos_mismatch"])


def diarize(segments: DataFrame) -> DataFrame:
    from turnwise.sources.payloads import turns_json

    return turns_json(segments)


def avqi(features: DataFrame) -> DataFrame:
    return features.withColumn("avqi", metrics.voice_quality(*[F.col(c) for c in ("cpps", "hnr", "shimmer", "shimmer_db", "slope", "tilt")]))


def opensmile(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Feature rows in long form, standardised by file."""
    long = rows.select(*keys, F.expr(f"stack({len(features)}, " + ", ".join(f"'{f}', cast({f} as double)" for f in features) + ") as (feature, value)"))
    return metrics.standardise(long, ["feature"], "value", "z")
