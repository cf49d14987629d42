"""Surrogates for personal data, by DataFrame functions only (operator 5).

Detected entities (e-mail, IPv4 and IPv6 addresses, bank accounts (IBAN), telephone, card and social
security numbers, hexadecimal secrets, names behind a title, and the words of such a name
wherever else they stand in the same text) are replaced inside the text by surrogates of the same type:

* a surrogate is a keyed hash of the entity's canonical form, so that one
  entity gets one surrogate in all documents (coreference), whatever its
  spelling: case of an address, separators of a number;
* it keeps the format: separators and digits stay where they are, a country code
  stays, capitals stay capitals, a name keeps its titles, initials, small words (``von``),
  hyphens and apostrophes, each other word of it is an entity of its own, and it
  gets given names of the title's gender (no ending where the title tells none) and words of its script (Latin, Greek
  or Cyrillic); an IPv6 address becomes one of the documentation range, written in full;
* distinctness is checked over the corpus: all entities and their surrogates are
  compared by ``groupBy``; where two entities share one, or one is itself an
  entity of the corpus, the later entity draws again until none is left;
* a format of digits that is more than an eighth full (say, 2,000 numbers of four
  digits behind one country code) is not drawn but permuted: a keyed Feistel
  network maps its numbers one to one, so that they stay distinct however full
  the format is. Such a surrogate may be another number of the corpus, which a
  format that is more than half full cannot avoid. Other formats have room for
  any corpus; an entity that lost ``_DRAWS`` draws is an error.

The key is the caller's: who has it can compute the surrogates again. It comes to the rows by a scalar subquery, so
that plans do not show it.

What is not found: names without a title that no titled name of the text shares a word with, given names
in front of a known last name that were not titled, names in lower case; IBAN surrogates keep no check digits, and
spellings of one IPv6 address that differ in more than case are different entities. A known word is replaced also where
a capital makes it a name only by its looks (``May`` after ``Mrs May``).

Replacing is a map over the documents: gaps and matches of a text are put
together again with surrogates in place of the matches. Only draws after the
first have to be looked up. Up to ``_LITERAL`` of them go along as a literal;
more are joined to the documents that need them. No text is shuffled unless so.

Defined results: null stays null, texts without entities are unchanged, and
all columns and rows are kept (repeated rows get equal texts, added columns never
take the name of one); an entity inside a longer run of digits or letters is not
one; where patterns overlap the first in the text counts, ties in the order of
``ENTITY``; a text of any length is one value; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import cut, fresh
from turnwise.session import table

# Titles that tell a gender, by script.
_MALE = "Mr|Herr|Monsieur|Señor|Signor|Sr|κύριος|господин|г-н"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Signora|Sra|κυρία|госпожа|г-жа"
# Titles that tell none, titles in capitals, and small words inside names.
_NEUTRAL = "Dr|Prof|Professor|Doctor"
_MALE_UPPER, _FEMALE_UPPER, _NEUTRAL_UPPER = "MR|HERR|MONSIEUR|SEÑOR|SIGNOR|SR|ΚΎΡΙΟΣ|ГОСПОДИН", "MRS|MS|MISS|FRAU|MADAME|SEÑORA|SIGNORA|SRA|ΚΥΡΊΑ|ГОСПОЖА", "DR|PROF|PROFESSOR|DOCTOR"
_PARTICLES = "de|del|della|der|den|di|da|do|dos|du|la|le|van|von|vom|zu|zur|ten|ter|bin|ibn|al|el|af|av"
_LITERAL = 5_000
_DRAWS = 60
_ROUNDS = 6
#: The formats whose surrogates are digits, one for one.
_DIGITS = ("phone", "ssn", "card")

_WORDC = r"\p{L}\p{N}._%+\-"
EMAIL = rf"(?<![{_WORDC}])[{_WORDC}]++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)++"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
PHONE = r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\d)"
PHONE_PLAIN = r"(?<![\d+])\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)|(?<![\d\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"
SECRET = r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])"
_GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[0-9A-Fa-f:]{{0,40}}\d){_GROUP}(?::{_GROUP}){{0,6}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\p{{L}}\p{{N}}:])"
IBAN = r"(?<![\p{L}\p{N}])(?=[A-Z]{2}\d{2}(?:[A-Z ]{0,6}\d){8})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_TITLE, _TITLE_UPPER = rf"(?:{_MALE}|{_FEMALE}|{_NEUTRAL})", rf"(?:{_MALE_UPPER}|{_FEMALE_UPPER}|{_NEUTRAL_UPPER})"
#: Titles and initials, which stay.
_HEAD, _HEAD_UPPER = rf"(?:{_TITLE}\.? ){{1,4}}(?:\p{{Lu}}\. ?){{0,4}}", rf"(?:{_TITLE_UPPER}\.? ){{1,4}}(?:\p{{Lu}}\. ?){{0,4}}"
_PART = r"\p{Lu}\p{L}+"
_WORD = rf"(?:(?:{_PARTICLES}) ){{0,3}}(?:\p{{L}}{{1,2}}['’])?{_PART}(?:['’\-]{_PART})*"
_WORD_UPPER = r"(?:\p{Lu}{1,2}['’])?\p{Lu}{2,}(?:['’\-]\p{Lu}{2,})*"
NAME = rf"(?<!\p{{L}})(?:{_HEAD}{_WORD}(?: {_WORD}){{0,2}}|{_HEAD_UPPER}{_WORD_UPPER}(?: {_WORD_UPPER})?)(?!\p{{L}})"
#: Every entity begins with a digit, ``+`` or ``(``, or where no letter comes before; inside a word nothing else is tried.
ENTITY = r"(?:(?=[\d+(])|(?<!\p{L}))(?:" + "|".join(f"(?:{x})" for x in (EMAIL, IPV4, IPV6, IBAN, PHONE, PHONE_PLAIN, SSN, CARD, SECRET, NAME)) + ")"
#: A text without any of these has no entity; the long expression then never runs.
_QUICK = rf"@|\d(?:[ .\-)]?\(?\d[ .\-)]?\(?\d|\.\d)|::|[0-9A-Fa-f]:{_GROUP}:|(?<!\p{{L}})(?:(?<!\p{{N}})[0-9a-fA-F]{{32}}|(?=[MHSFDPκгΚГ])(?:{_TITLE}|{_TITLE_UPPER})\.? )"


# Letters of the syllables (16 onsets, 16 vowels) and gender endings, by script.
_LETTERS = {"latin": ("bdfgklmnprstvzhj", "aeiouaeioaeioaei", "o", "a"), "greek": ("βγδζκλμνπρστφχθξ", "αειουαειοαειοαει", "ος", "α"), "cyrillic": ("бвгдзклмнпрстфхж", "аеиоуаеиоаеиоаеи", "", "а")}
_HEX = "0123456789abcdef"

# The steps below are chained by ``transform`` over small arrays of structs, so that
# each value is computed once and the expression stays small.


def kind(raw: Column) -> Column:
    return (
        F.when(raw.contains("@"), "email").when(raw.contains(":"), "ip6").when(raw.rlike("^" + IPV4 + "$"), "ip").when(raw.rlike(rf"^(?:{_TITLE}|{_TITLE_UPPER})\.? "), "name").when(raw.rlike("^" + IBAN + "$"), "iban")
        .when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(raw.startswith("+") | raw.rlike(rf"^(?:{PHONE_PLAIN})$"), "phone")
        .when(raw.rlike(r"^[0-9a-fA-F]{32,64}$"), "secret").when(raw.rlike(r"^\p{L}+$"), "mention").otherwise("card")
    )


def pieces(part: Column, kind_: str, form: Column) -> Column:
    """Words of a part of a name with what stands between them, and their entities; what is no capital word stays (``keep``)."""
    split = F.filter(F.split(part, r"(?<=[ '’\-])|(?=[ '’\-])"), lambda p: p != "")
    entity = lambda p: F.when(p.rlike(r"^\p{Lu}\p{L}+$"), F.concat_ws("|", F.lit(kind_), form, F.lower(p))).otherwise(F.concat(F.lit("keep||"), p))
    return F.transform(split, lambda p: F.struct(p.alias("piece"), entity(p).alias("name")))


def described(found: Column, known: Column | None = None) -> Column:
    """Matches with their kind, fixed part (country code or titles), rest, pieces and names (``type|format|canonical form``).

    ``known`` are the entities of the names of the text, by which words that stand alone are told.
    """
    first = F.transform(found, lambda r: F.struct(r.alias("raw"), kind(r).alias("k")))
    fixed = F.transform(
        first,
        lambda x: F.struct(
            x["raw"].alias("raw"), x["k"].alias("k"),
            F.when(x["k"] == "name", F.regexp_extract(x["raw"], rf"^(?:{_HEAD}|{_HEAD_UPPER})", 0)).when(x["k"] == "phone", F.regexp_extract(x["raw"], r"^\+\d{1,3}(?=[ .\-(])", 0)).when(x["k"] == "iban", F.substr(x["raw"], F.lit(1), F.lit(2))).otherwise("").alias("fixed"),
        ),
    )
    rest = F.transform(fixed, lambda x: F.struct(x["raw"].alias("raw"), x["k"].alias("k"), x["fixed"].alias("fixed"), F.substr(x["raw"], F.length(x["fixed"]) + F.lit(1)).alias("rest")))
    parts = F.transform(
        rest,
        lambda x: F.struct(
            x["raw"].alias("raw"), x["k"].alias("k"), x["fixed"].alias("fixed"), x["rest"].alias("rest"),
            F.when(x["k"].isin("email", "ip", "ip6", "secret"), F.lower(x["raw"])).otherwise(F.regexp_replace(x["rest"], "[^0-9]", "")).alias("canon"),
            F.when(x["k"] == "iban", F.regexp_replace(F.regexp_replace(x["rest"], " ", ""), "[0-9]", "0")).otherwise(F.lit(None)).alias("layout"),
            F.substring_index(x["rest"], " ", -1).alias("last"),
            F.when(x["rest"].rlike(r"[Ͱ-Ͽ]"), "greek").when(x["rest"].rlike(r"[Ѐ-ӿ]"), "cyrillic").otherwise("latin").alias("script"),
            F.when(x["fixed"].rlike(rf"(?:^| )(?:{_FEMALE}|{_FEMALE_UPPER})\.? "), "f").when(x["fixed"].rlike(rf"(?:^| )(?:{_MALE}|{_MALE_UPPER})\.? "), "m").otherwise("n").alias("gender"),
        ),
    )
    none = F.array().cast("array<struct<piece:string,name:string>>")
    alone = (lambda x: none) if known is None else (lambda x: F.array(F.struct(x["raw"].alias("piece"), F.coalesce(F.try_element_at(F.filter(known, lambda e: F.substring_index(e, "|", -1) == F.lower(x["raw"])), F.lit(-1)), F.concat(F.lit("keep||"), x["raw"])).alias("name"))))
    named = F.transform(
        parts,
        lambda x: F.struct(
            x["raw"].alias("raw"), x["k"].alias("k"), x["fixed"].alias("fixed"), x["rest"].alias("rest"), x["canon"].alias("canon"), x["layout"].alias("layout"),
            F.when(x["k"] == "name", F.concat(pieces(F.substr(x["rest"], F.lit(1), F.length(x["rest"]) - F.length(x["last"])), "given", F.concat(x["script"], x["gender"])), pieces(x["last"], "last", x["script"])))
            .when(x["k"] == "mention", alone(x)).otherwise(none).alias("ps"),
        ),
    )
    return F.transform(
        named,
        lambda x: F.struct(
            x["raw"].alias("raw"), x["k"].alias("k"), x["fixed"].alias("fixed"), x["rest"].alias("rest"), F.transform(x["ps"], lambda p: p["piece"]).alias("pieces"),
            F.when(x["k"].isin("name", "mention"), F.transform(x["ps"], lambda p: p["name"]))
            .otherwise(F.array(F.concat_ws("|", x["k"], F.concat(x["fixed"], F.lit("#"), F.coalesce(x["layout"], F.length(x["canon"]).cast("string"))), x["canon"]))).alias("names"),
        ),
    )


def permuted(digits: Column, form: Column, key: str | Column) -> Column:
    """A keyed permutation of all strings of as many digits: a Feistel network of additions."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substr(digits, F.lit(1), half).alias("l"), F.substr(digits, half + 1).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        left, right = acc["l"], acc["r"]
        into, by = F.when(i % 2 == 0, left).otherwise(right), F.when(i % 2 == 0, right).otherwise(left)
        add = F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("permute"), form, i.cast("string"), by), 256), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")
        room = F.rpad(F.lit("1"), F.length(into) + 1, F.lit("0")).cast("decimal(38,0)")
        out = F.lpad(((F.coalesce(into.try_cast("decimal(38,0)"), F.lit(0)) + add) % room).cast("decimal(38,0)").cast("string"), F.length(into), F.lit("0"))
        return F.struct(F.when(i % 2 == 0, out).otherwise(left).alias("l"), F.when(i % 2 == 0, right).otherwise(out).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def values_of(names: Column, attempt, key: str | Column) -> Column:
    """The surrogates of entities in canonical form (what distinctness is checked on).

    ``attempt`` gives the number of draws an entity has lost, or -1 for a permutation.
    """
    drawn = F.transform(names, lambda n: F.struct(F.split(n, r"\|", 3).alias("p"), n.alias("n"), attempt(n).alias("a")))
    hashed = F.transform(drawn, lambda x: F.struct(F.get(x["p"], F.lit(0)).alias("t"), F.get(x["p"], F.lit(1)).alias("form"), F.get(x["p"], F.lit(2)).alias("canon"), x["a"].alias("a"),
                                                   F.sha2(F.concat_ws("|", F.lit(key), x["n"], x["a"].cast("string")), 256).alias("h")))
    by_script = lambda f, i: F.when(f.startswith("greek"), _LETTERS["greek"][i]).when(f.startswith("cyrillic"), _LETTERS["cyrillic"][i]).otherwise(_LETTERS["latin"][i])
    tr = lambda h, to: F.call_function("translate", h, F.lit(_HEX), to)
    spelled = F.transform(hashed, lambda x: F.struct(x["t"].alias("t"), x["form"].alias("form"), x["canon"].alias("canon"), x["a"].alias("a"), x["h"].alias("h"), tr(x["h"], by_script(x["form"], 0)).alias("c"), tr(x["h"], by_script(x["form"], 1)).alias("v")))

    def value(x: Column) -> Column:
        h, n = x["h"], F.length(x["canon"])
        # three syllables; a word that has lost draws gets longer
        syllables = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(2) + F.greatest(x["a"], F.lit(0)), F.lit(20))), lambda i: F.concat(F.substr(x["c"], 2 * i + 1, F.lit(1)), F.substr(x["v"], 2 * i + 2, F.lit(1)))), "")
        ending = F.when(x["form"].endswith("f"), by_script(x["form"], 3)).when(x["form"].endswith("m"), by_script(x["form"], 2)).otherwise("")
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.conv(F.substr(h, 4 * i + 1, F.lit(4)), 16, 10).cast("int") % 223 + 1).cast("string")), ".")
        groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substr(h, 4 * i + 1, F.lit(4))), ":")
        local = F.greatest(F.lit(10), F.least(F.length(F.substring_index(x["canon"], "@", 1)), F.lit(40)))
        domain = F.when(h.endswith("0"), "@example.org").when(h.endswith("1"), "@example.net").otherwise("@example.com")
        return (
            F.when(x["t"] == "email", F.concat(F.substr(F.translate(h, "0123456789", "ghjkmnpqrs"), F.lit(1), local), domain)).when(x["t"] == "ip", octets)
            .when(x["t"] == "keep", x["canon"]).when(x["t"] == "ip6", F.concat(F.lit("2001:db8:"), groups))
            .when(x["t"] == "secret", F.substr(h, F.lit(1), n)).when(x["t"] == "last", syllables).when(x["t"] == "given", F.concat(syllables, F.substr(x["c"], F.lit(60), F.lit(1)), ending))
            .when((x["a"] < 0) & (n > 1), permuted(x["canon"], F.concat_ws("|", x["t"], x["form"]), key)).otherwise(F.substr(F.translate(h, "abcdef", "274953"), F.lit(1), n))
        )

    return F.transform(spelled, value)


def surrogates(found: Column, attempts: Column | None, key: str | Column, known: Column | None = None) -> Column:
    """What stands in for each match, in its own format."""
    attempt = (lambda n: F.lit(0)) if attempts is None else (lambda n: F.coalesce(F.try_element_at(attempts, n), F.lit(0)))
    valued = F.transform(described(found, known), lambda x: F.struct(x["raw"].alias("raw"), x["k"].alias("k"), x["fixed"].alias("fixed"), x["rest"].alias("rest"), x["pieces"].alias("pieces"), values_of(x["names"], attempt, key).alias("vs")))
    first = F.transform(valued, lambda x: F.struct(x["raw"].alias("raw"), x["k"].alias("k"), x["fixed"].alias("fixed"), x["rest"].alias("rest"), x["pieces"].alias("pieces"), x["vs"].alias("vs"), F.get(x["vs"], F.lit(0)).alias("v")))

    def one(x: Column) -> Column:
        upper = (x["raw"] == F.upper(x["raw"])) & (x["raw"] != F.lower(x["raw"]))
        spread = F.array_join(
            F.transform(F.split(x["rest"], ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(x["v"], F.length(F.regexp_replace(F.substr(x["rest"], F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), ""
        )
        # a piece that stays is its own value; the others take the case of what they stand for
        cased = lambda p, v: F.when((v == p) | ~p.rlike(r"^\p{Lu}\p{L}+$"), p).when(p == F.upper(p), F.upper(v)).otherwise(F.initcap(v))
        name = F.array_join(F.zip_with(x["pieces"], x["vs"], cased), "")
        return (
            F.when(x["k"].isin("email", "secret"), F.when(upper, F.upper(x["v"])).otherwise(x["v"])).when(x["k"].isin("ip", "ip6"), x["v"])
            .when(x["k"].isin("name", "mention"), F.concat(x["fixed"], name)).otherwise(F.concat(x["fixed"], spread))
        )

    return F.transform(first, one)


def names_of(found: Column, known: Column | None = None) -> Column:
    """The entities of the matches of a text."""
    return F.filter(F.flatten(F.transform(described(found, known), lambda x: x["names"])), lambda n: ~n.startswith("keep|"))


def matches(text: Column) -> Column:
    return F.when(text.rlike(_QUICK), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def names_known(found: Column) -> Column:
    """The entities of titled names among the matches of a text: their words are looked for without a title."""
    return F.array_sort(F.array_distinct(names_of(F.filter(found, lambda m: m.rlike(rf"^(?:{_TITLE}|{_TITLE_UPPER})\.? ")))))


def pattern(known: Column) -> Column:
    """``ENTITY``, and words of known names as they are written in names or in capitals."""
    words = F.transform(known, lambda e: F.substring_index(e, "|", -1))
    either = F.array_join(F.transform(words, lambda w: F.concat(F.lit("(?i:"), w, F.lit(")"))), "|")
    return F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?=\p{Lu})(?U:"), either, F.lit(r")(?!\p{L})"))


def entities(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Every distinct entity of the corpus (``name``) and how many matches it has."""
    found = docs.select(F.explode(matches(F.col(text))).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    return found.select("n", F.explode(names_of(F.array("m"))).alias("name")).groupBy("name").agg(F.sum("n").alias("n"))


def redraws(names: DataFrame, key: str | DataFrame) -> DataFrame:
    """(name, attempt) of the entities whose first surrogates are not used.

    Of the entities that draw one surrogate, the one with the fewest draws (ties:
    in order of the name) keeps it; none may keep an entity of the corpus. All
    entities of a format of digits that is more than an eighth full get -1.
    """
    shape = F.regexp_extract("name", r"^([^|]*\|[^|]*)\|", 1)
    digits, length = F.substring_index("name", "|", 1).isin(*_DIGITS), F.length(F.regexp_extract("name", r"^[^|]*\|[^|]*\|(.*)$", 1))
    shaped = cut(names.select("name", F.when(digits & (length < 18), F.pow(F.lit(10.0), length)).alias("room"), shape.alias("shape")), "entities")
    full = shaped.where("room IS NOT NULL").groupBy("shape").agg(F.count("*").alias("k"), F.max("room").alias("room")).where("8 * k > room").select("shape")
    crowded = cut(shaped.join(full, "shape", "left_semi").select("name"), "crowded")
    cur = cut(shaped.join(full, "shape", "left_anti").select("name", F.lit(0).alias("attempt")), "draws")
    # what is compared: all but the length of the original, which a surrogate (of an address) may not keep
    plain = lambda c: F.regexp_replace(c, r"^([^|]*\|[^|#]*)#\d+\|", "$1|")
    form = F.regexp_extract(plain(F.col("name")), r"^[^|]*\|[^|]*\|", 0)
    real = shaped.select(plain(F.col("name")).alias("real")).distinct()
    for _ in range(_DRAWS):
        value = F.get(values_of(F.array("name"), lambda n: F.col("attempt"), key if isinstance(key, str) else F.col("_key")), F.lit(0))
        keyed = cur if isinstance(key, str) else cur.withColumn("_key", key.scalar())
        drawn = keyed.withColumn("drawn", F.concat(form, value)).drop("_key")
        order = Window.partitionBy("drawn").orderBy("attempt", "name")
        ranked = drawn.withColumn("r", F.row_number().over(order)).join(real, F.col("drawn") == F.col("real"), "left")
        lost = (F.col("r") > 1) | F.col("real").isNotNull()
        cur = cut(ranked.select("name", F.when(lost, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), lost.alias("again")), "draws")
        if cur.where("again").isEmpty():
            break
        cur = cur.select("name", "attempt")
    else:
        raise RuntimeError(f"entities still share a surrogate after {_DRAWS} draws")
    return cur.where("attempt > 0").select("name", "attempt").union(crowded.select("name", F.lit(-1)))


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; all columns and rows are kept.

    ``count`` names a column to add: how many matches the text had.
    """
    if not key:
        raise ValueError("surrogates need a key")
    secret = docs.sparkSession.createDataFrame([(key,)], "k string")
    taken = redraws(entities(docs, text=text), secret)
    few = taken.limit(_LITERAL + 1).collect()
    body, hits, known, kept = F.col(text), fresh(docs, "_hits"), fresh(docs, "_known"), fresh(docs, "_key")

    found = docs.withColumn(hits, matches(body)).withColumn(known, F.when(F.size(hits) > 0, names_known(F.col(hits))).otherwise(F.array().cast("array<string>")))
    named = F.size(known) > 0
    found = found.withColumn(hits, F.when(named, F.regexp_extract_all(body, pattern(F.col(known)), F.lit(0))).otherwise(F.col(hits))).withColumn(kept, secret.scalar())

    def replaced(attempts: Column | None) -> Column:
        gaps = F.when(named, F.split(body, pattern(F.col(known)), -1)).otherwise(F.split(body, ENTITY, -1))
        joined = F.array_join(F.zip_with(gaps, surrogates(F.col(hits), attempts, F.col(kept), F.col(known)), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
        return F.when(F.size(hits) > 0, joined).otherwise(body)

    if len(few) <= _LITERAL:
        attempts = F.create_map(*[F.lit(x) for r in few for x in (r["name"], r["attempt"])]) if few else None
    else:  # many draws: the documents that hold such an entity get their own little map
        row, own = fresh(docs, "_row"), fresh(docs, "_attempts")
        found = found.withColumn(row, F.sha2(body, 256))
        needs = found.select(row, F.explode(F.array_distinct(names_of(F.col(hits), F.col(known)))).alias("name")).distinct().join(taken, "name")
        found = found.join(needs.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias(own)), row, "left")
        attempts = F.col(own)
    out = found.withColumn(text, replaced(attempts))
    return out.select(*docs.columns, *([F.coalesce(F.size(hits), F.lit(0)).cast("long").alias(count)] if count else []))


#: The key of the registered query and of the pipeline where none is set: it makes runs equal and hides nothing from who reads this.
OPEN_KEY = "the open key of the registered query"


def key_of(spark: SparkSession) -> str:
    """The key set as ``spark.turnwise.pii.secret`` (Spark hides values of that name), else ``OPEN_KEY``."""
    return spark.conf.get("spark.turnwise.pii.secret", None) or OPEN_KEY


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates: doc_id, text, n_entities (matches of the original)."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key_of(spark), count="n_entities")
