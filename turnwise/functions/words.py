"""Column functions on single words (all run inside the JVM)."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions.lazy import row_udf


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def words_of(text: Column) -> Column:
    """Words between white space, empty ones dropped; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def fold_ascii(w: Column) -> Column:
    """Lower case of A-Z only (what the aligner compares)."""
    return F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_punct_or_filler(w: Column) -> Column:
    """Terminators, separators and fillers, which do not count as content."""
    t = F.trim(w)
    return t.isin(L.TERMINATORS + L.SEPARATORS) | F.lower(t).isin(L.FILLERS)


def is_punct_pos(pos: Column) -> Column:
    return F.coalesce(F.upper(pos) == "PUNCT", F.lit(False))


def _spelled(w: Column) -> Column:
    return F.filter(F.split(w, ""), lambda c: c != "")


def conform(w: Column, compounds: list[tuple[str, str]] | None = None, names: list[str] | None = None, abbreviations: list[str] | None = None) -> Column:
    """What a word is scored as: an array of words. The order of the rules decides."""
    compounds = L.COMPOUNDS if compounds is None else compounds
    names = L.NAMES if names is None else names
    abbreviations = L.ABBREVIATIONS if abbreviations is None else abbreviations
    t = F.trim(w)
    low = F.lower(t)
    stem = F.substring_index(low, "'", 1)
    two = {a + b: [a, b] for a, b in compounds}

    def table(d: dict[str, list[str]]) -> Column:
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    rules = []
    if two:
        rules.append((low.isin(list(two)), F.try_element_at(table(two), low)))
    rules.append((t.isin(abbreviations), _spelled(t)))
    rules += [(low.contains(mark), F.array(stem, F.lit(word))) for mark, word in L.CONTRACTIONS]
    rules += [
        (low.isin(L.FILLERS), F.array(F.lit("um"))), (low.contains("-"), F.transform(F.split(low, "-"), F.trim)),
        (low.isin(list(L.CONFORM_WORDS)), F.try_element_at(table(L.CONFORM_WORDS), low)), (low.isin(names), F.array(F.lit("name"))),
        (low.isin(list(L.CONFORM_LATE)), F.try_element_at(table(L.CONFORM_LATE), low)), (low.isin(L.CONFORM_SPELLED), _spelled(low)),
        (low.contains("_"), F.split(low, "_")),
    ]
    return reduce(lambda acc, r: acc.when(*r), rules[1:], F.when(*rules[0])).otherwise(F.array(low))


def conform_all(words: Column, **lexicons) -> Column:
    return F.flatten(F.transform(words, lambda w: conform(w, **lexicons)))


def conform_mapped(words: Column, **lexicons) -> Column:
    """array<struct<text, source>>: conformed words with the index of the word they come from."""
    return F.flatten(F.transform(words, lambda w, i: F.transform(conform(w, **lexicons), lambda c: F.struct(c.alias("text"), i.alias("source")))))


def normalise_for_wer(w: Column) -> Column:
    return F.translate(F.lower(w), "()", "")


def without_dashes(w: Column) -> Column:
    return F.replace(w, F.lit("-"), F.lit(""))


def characters(words: Column) -> Column:
    return F.flatten(F.transform(words, _spelled))


def strip_boundary(w: Column, marks: str) -> Column:
    """Marks taken away at both ends."""
    return F.btrim(w, F.lit(marks))


QUOTES = "\"“”„‘’«»"
COMMAS = ",„‡،؛"


def milliseconds(seconds: Column) -> Column:
    """Rounded half away from zero; null for values that are not finite."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < float("inf"))
    return F.when(finite, F.round(seconds * 1000).cast("long"))


def timed_range(start_s: Column, end_s: Column) -> Column:
    """struct<start_ms, end_ms>, both null unless the end comes after the start."""
    a, b = milliseconds(start_s), milliseconds(end_s)
    good = F.coalesce(b > a, F.lit(False))
    return F.struct(F.when(good, a).alias("start_ms"), F.when(good, b).alias("end_ms"))


def disfluency(w: Column) -> Column:
    """Filled pauses first, then replacements; others stay."""
    low = F.lower(w)
    return F.coalesce(F.try_element_at(literal_map(L.FILLED_PAUSES), low), F.try_element_at(literal_map(L.REPLACEMENTS), low), w)


def without_title_period(w: Column) -> Column:
    return F.when(F.lower(w).isin(L.TITLE_SURFACES), F.replace(w, F.lit("."), F.lit(""))).otherwise(w)


def pronoun_i(w: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(L.PRONOUN_I), F.lower(w)), w)


def capitalise_first(w: Column) -> Column:
    head = F.substring(w, 1, 1)
    return F.when((head == F.lower(head)) & (head != F.upper(head)), F.concat(F.upper(head), F.substr(w, F.lit(2)))).otherwise(w)


def strip_punct(w: Column) -> Column:
    out = w
    for p in L.ENDING_PUNCT + L.MOR_PUNCT:
        out = F.replace(out, F.lit(p), F.lit(""))
    return F.trim(out)


def illegal_removed(w: Column) -> Column:
    """Characters that a transcript word cannot hold (the documented class; a word may become empty)."""
    return F.regexp_replace(w, r"[\[\]<>{}\x00-\x20\x15\\|^*%$#=;]", "")


def percent_split(w: Column, lang: str) -> Column:
    """'12%' as its digits and the word of the language (digits alone where it has none)."""
    word = L.PERCENT_WORDS.get(lang.lower())
    digits = F.regexp_extract(w, r"^([0-9]+)%$", 1)
    return F.when(digits != "", F.array(digits, F.lit(word)) if word else F.array(digits)).otherwise(F.array(w))


def split_timed(text: Column, start: Column, end: Column) -> Column:
    """array<struct<text, start_ms, end_ms>>: parts share the span by their lengths, cut with integer division."""
    def one(p: Column) -> Column:
        at = lambda n: start + F.floor((end - start) * n / p["total"]).cast("long")
        timed = F.coalesce(end > start, F.lit(False)) & (p["total"] > 0)
        return F.struct(p["text"].alias("text"), F.when(timed, at(p["before"])).alias("start_ms"), F.when(timed, at(p["before"] + F.length(p["text"]))).alias("end_ms"))

    return F.transform(placed(F.filter(F.split(text, r"\s+"), lambda p: p != "")), one)


@row_udf("array<struct<text:string,before:bigint,total:bigint>>")
def placed(parts: list[str] | None) -> list[tuple[str, int, int]] | None:
    """Parts with the characters before them and of all, in one pass."""
    if parts is None:
        return None
    ends = list(accumulate(len(p) for p in parts))
    return [(p, e - len(p), ends[-1]) for p, e in zip(parts, ends, strict=True)]


def before_translation(text: Column) -> Column:
    """Marks that disturb translation are taken out."""
    return F.trim(F.regexp_replace(F.translate(text, "()<>", ""), r"\s+", " "))


def after_translation(text: Column) -> Column:
    """Punctuation set apart, in the order of the list."""
    out = text
    for p in (".", ",", "!", "?"):
        out = F.replace(out, F.lit(p), F.lit(f" {p}"))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def is_empty_translation(text: Column) -> Column:
    return F.trim(text).isin("", ".", "!", "?")


def features(feats: Column) -> Column:
    """'A=x|B=y' as a map; '_' and null give an empty one."""
    return F.when(feats.isNull() | feats.isin("", "_"), F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(feats, F.lit(r"\|"), F.lit("=")))


def morph_item(pos: Column, lemma: Column, feats: Column) -> Column:
    """pos|lemma-Feature1-Feature2 from a tagged word."""
    name = F.coalesce(F.try_element_at(literal_map(L.UD_TO_CHAT_POS), F.upper(pos)), F.lower(pos))
    clean = F.regexp_replace(lemma, r"[|&\-+$#~\s]", "")
    values = F.transform(F.array_sort(F.map_entries(features(feats))), lambda e: e["value"])
    return F.array_join(F.concat(F.array(F.concat(name, F.lit("|"), clean)), values), "-")


def relation(label: Column) -> Column:
    """Relation labels in capitals, subtypes joined by a dash."""
    return F.upper(F.replace(label, F.lit(":"), F.lit("-")))


def lang2(code: Column) -> Column:
    """Two-letter code of a three-letter one; unknown codes by their first two letters."""
    return F.coalesce(F.try_element_at(literal_map(L.LANG2), code), F.substring(code, 1, 2))


def letters_and_digits(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")


def bracket_annotation(refs: Column) -> Column:
    """'(1, 2), -, 1)' for array<array<struct<chain_id, is_start, is_end>>>, a dash for a word without chains."""
    def one(r: Column) -> Column:
        return F.concat(F.when(r["is_start"], "(").otherwise(""), r["chain_id"].cast("string"), F.when(r["is_end"], ")").otherwise(""))

    return F.array_join(F.transform(refs, lambda w: F.when(F.size(w) == 0, F.lit("-")).otherwise(F.array_join(F.transform(w, one), " "))), ", ")


def marked_tokens(tokens: Column) -> Column:
    """Compare line: + for words only in the main side, - for words only in the gold side."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.when(t["status"] == "extra_main", "+").when(t["status"] == "extra_gold", "-").otherwise(""), t["text"])), " ")


def content_key(*parts: Column) -> Column:
    """Hash key of values joined by a bar (SHA-256; the length is that of the usual 256-bit keys)."""
    return F.sha2(F.concat_ws("|", *parts), 256)
