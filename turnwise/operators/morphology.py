"""Tagging payloads, analyses, relations, hints and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions.lazy import row_udf
from turnwise.functions.words import literal_map, morph_item, relation


def segmentation_class(words: Column) -> Column:
    return F.when(F.size(words) == 0, "empty").when(F.size(words) == 1, "single_word").otherwise("dispatch")


def tagging_payload(utts: DataFrame, declared: DataFrame, primary: str) -> DataFrame:
    """Utterances to tag with their language; others with the reason they are left out.

    ``utts``: file, utt, lang, words, has_mor, mode ('CA' is not tagged). ``declared``: file, languages.
    """
    joined = utts.join(declared, "file", "left")
    lang = F.coalesce("lang", F.get("languages", F.lit(0)), F.lit(primary))
    main = F.coalesce(F.get("languages", F.lit(0)), F.lit(primary))
    reason = F.when(F.coalesce(F.col("mode") == "CA", F.lit(False)), "ca_mode").when(F.size("words") == 0, "empty").when(F.col("has_mor"), "already_tagged").when(lang != main, "other_language")
    return joined.withColumns({"language": lang, "not_applicable": reason})


def deferred_positions(utts: DataFrame) -> DataFrame:
    """(file, utt, pos, text, lang) of words whose language is not the utterance's; ``words``: array<struct<text, lang>>."""
    each = utts.select("file", "utt", F.col("lang").alias("_u"), F.posexplode("words").alias("pos", "w"))
    return each.where(F.col("w.lang").isNotNull() & (F.col("w.lang") != F.col("_u"))).select("file", "utt", "pos", F.col("w.text").alias("text"), F.col("w.lang").alias("lang"))


def secondary_spans(words: DataFrame) -> DataFrame:
    """Neighbouring foreign words of one language as spans: file, utt, span, lang, first, last, text."""
    order = Window.partitionBy("file", "utt").orderBy("pos")
    new = F.coalesce(((F.col("pos") != F.lag("pos").over(order) + 1) | (F.col("lang") != F.lag("lang").over(order))).cast("int"), F.lit(1))
    marked = words.withColumn("_n", new).withColumn("span", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("file", "utt", "span").agg(F.first("lang").alias("lang"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def status(item: Column) -> Column:
    """missing_mor, l2xxx or spliced."""
    return F.when(item.isNull(), "missing_mor").when(item.startswith("L2|"), "l2xxx").otherwise("spliced")


def flags(text: Column, lang: Column, pos: Column, feats: Column, state: Column) -> Column:
    """Heuristic doubts about a spliced word: a closed-class word as a name, features that do not fit the class."""
    table = F.create_map(*[x for k, v in L.FUNCTION_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    closed = F.coalesce(F.array_contains(F.try_element_at(table, lang), F.lower(text)), F.lit(False))
    verbal = F.coalesce(feats.rlike("Tense=|Mood=|VerbForm="), F.lit(False))
    nominal = F.coalesce(feats.rlike("Case=|Gender="), F.lit(False)) & ~verbal
    found = F.array_compact(F.array(
        F.when((F.lower(pos) == "propn") & closed, "propn_for_function_word"),
        F.when((F.lower(pos) == "noun") & verbal, "feature_pos_mismatch"), F.when((F.lower(pos) == "verb") & nominal, "feature_pos_mismatch"),
    ))
    return F.when(state != "spliced", F.array(state)).otherwise(found)


def utterance_outcome(total: Column, spliced: Column, missing: Column) -> Column:
    return F.when(total == 0, "no_foreign_words").when(spliced == total, "all_spliced").when(missing == total, "none_tagged").otherwise("partly_spliced")


def review_tier(category: Column, pitch: Column, ear: Column) -> Column:
    """trust, review, hold, demote or untouched, from the line's category and two checks."""
    agree = (pitch == "child") & (ear == "child")
    against = (pitch == "adult") & (ear == "adult")
    return F.when(category == "unsure", F.when(agree, "trust").when(against, "demote").otherwise("review")).when(category == "conflict", F.when(agree, "review").when(against, "demote").otherwise("hold")).otherwise("untouched")


def apply_hints(words: DataFrame) -> DataFrame:
    """A transcriber's class wins over the tagger's: adds ``final_pos`` and ``hint_outcome``."""
    mapped = F.try_element_at(literal_map(L.POS_HINTS), F.lower("pos_hint"))
    outcome = F.when(F.col("pos_hint").isNull(), "none").when(mapped.isNull(), "unmapped").when(mapped == F.col("pos"), "agrees").otherwise("overridden")
    return words.withColumns({"final_pos": F.coalesce(mapped, F.col("pos")), "hint_outcome": outcome})


def merged_pos(primary: Column, secondary: Column, rel: Column, text: Column) -> Column:
    """The class of a foreign word from both taggers and its relation: first rule that applies."""
    wanted = F.try_element_at(literal_map(L.RELATION_TO_POS), rel)
    closed = ["DET", "ADP", "PRON", "CCONJ", "SCONJ", "AUX", "PART"]
    return (
        F.when(secondary.isNull(), F.coalesce(primary, wanted, F.lit("X"))).when((secondary == "VERB") & (rel == "COP"), "AUX").when(secondary == wanted, secondary)
        .when(secondary.isin(closed), secondary).when(secondary == "NOUN", secondary).when(primary == wanted, primary).otherwise(F.coalesce(wanted, secondary))
    )


def relation_for(pos: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(L.POS_TO_RELATION), pos), F.lit("DEP"))


def tag_items(ud: Column) -> Column:
    """Analysis items of array<struct<text, lemma, upos, feats, head, deprel>>."""
    return F.transform(ud, lambda w: morph_item(w["upos"], w["lemma"], w["feats"]))


def tag_relations(ud: Column) -> Column:
    """'index|head|LABEL' of each word."""
    return F.transform(ud, lambda w, i: F.concat_ws("|", (i + 1).cast("string"), w["head"].cast("string"), relation(w["deprel"])))


def sentence_maps(words: list[dict]) -> tuple[str, str]:
    """(analysis line, relation line) of a sentence with multiword ranges.

    ``words`` have id_start, id_end, text, lemma, upos, feats, head, deprel. A range
    (id_end > id_start) joins the items it covers with '~' into one word; relations count items.
    """
    ranges = {w["id_start"]: w["id_end"] for w in words if w["id_end"] and w["id_end"] > w["id_start"]}
    plain = [w for w in words if not (w["id_end"] and w["id_end"] > w["id_start"])]
    items, rels, open_to = [], [], 0
    for n, w in enumerate(plain, 1):
        feats = [] if w["feats"] in (None, "", "_") else sorted(w["feats"].split("|"))
        item = "-".join([f"{L.UD_TO_CHAT_POS.get(w['upos'], w['upos'].lower())}|{w['lemma']}", *[f.split("=")[1] for f in feats]])
        if w["id_start"] in ranges:
            open_to = ranges[w["id_start"]]
            items.append(item)
        elif w["id_start"] <= open_to:
            items[-1] += "~" + item
        else:
            items.append(item)
        rels.append(f"{n}|{w['head']}|{w['deprel'].upper().replace(':', '-')}")
    return " ".join(items), " ".join(rels)


@row_udf("struct<mor:string,gra:string>")
def mapped_sentence(sentence: list[dict] | None) -> tuple[str | None, str | None]:
    return (None, None) if sentence is None else sentence_maps(sentence)


def clitic(text: Column, lang: Column) -> Column:
    """Parts written onto another word: French and Italian elisions, English contractions."""
    return F.when(lang.isin("fra", "ita"), text.rlike("^[A-Za-zÀ-ÿ]{1,4}['’]$")).when(lang == "eng", F.lower(text).isin("n't", "'s", "'re", "'ll", "'ve", "'d", "'m")).otherwise(F.lit(False))


def misaligned(tiers: DataFrame) -> DataFrame:
    """Utterances whose analysis has another number of items than words (words, mor arrays)."""
    return tiers.where(F.size("words") != F.size("mor"))


def pos_labels(mor: Column) -> Column:
    """Upper-case classes of the items of a morphology tier (``class|lemma...``); clitics count one by one."""
    return F.transform(F.flatten(F.transform(mor, lambda x: F.split(x, "[~$]"))), lambda x: F.upper(F.substring_index(x, "|", 1)))


def translation_payload(utts: DataFrame) -> DataFrame:
    """file, utt, text of the utterances that have words."""
    return utts.where(F.size("words") > 0).select("file", "utt", F.array_join("words", " ").alias("text"))


def coreference_payload(utts: DataFrame) -> DataFrame:
    """file, sentences (utt, words) in order: a document is one payload."""
    return utts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("utt", "words"))).alias("sentences"))


def without_placeholders(tiers: DataFrame, items: str = "items") -> DataFrame:
    """Tiers that hold something."""
    return tiers.where(F.size(items) > 0)


def response_check(asked: Column, answered: Column) -> Column:
    """struct<bad_length, distinct>: an answer for each word or not, and how many different ones."""
    return F.struct((F.size(asked) != F.size(answered)).alias("bad_length"), F.size(F.array_distinct(answered)).cast("long").alias("distinct"))


def gate(rows: DataFrame, fatal: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """Adds ``gate`` (reject, warn or ok) and ``broken``, the names of the rules that do not hold.

    Rules before the work are fatal, rules after it only warn; a rule that is null is broken.
    """
    names = lambda rules: F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules.items()])) if rules else F.array().cast("array<string>")
    out = rows.withColumns({"_fatal": names(fatal), "_warn": names(warnings)})
    return out.withColumns({"gate": F.when(F.size("_fatal") > 0, "reject").when(F.size("_warn") > 0, "warn").otherwise("ok"), "broken": F.concat("_fatal", "_warn")}).drop("_fatal", "_warn")
