"""Rule cascades: rules as rows of a table, the first that holds decides.

A rule is a row (lang, priority, text_is, text_has, lemma_is, lemma_has, upos, new_upos, new_lemma,
new_feats). A condition that is null does not count; ``upos`` lists the classes of which the word must have one. Of the
rules of the word's language whose conditions all hold, the one with the smallest priority counts.

Rules are looked up once for each distinct (lang, text, lemma, upos) of the corpus. A table of
at most ``_BROADCAST_ROWS`` rules is broadcast. Of a longer one, rules with ``text_is`` are joined on that
text; rules without are joined on the language, words dealt to ``_SALTS`` parts each of which
meets all rules of the language.

A range rule is a row (lang, text, kind, new_upos, new_lemma, new_feats) on words that a parser split:
``one`` makes them one word again, ``first`` gives its first part another analysis.

Defined results: a null language or text meets no rule that asks for it; null values of an analysis leave
the word's own; a rule without any condition holds for every word of its language; equal priorities go by
the values of the rule; repeated rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import language_rules as R

RULE = "lang string, priority int, text_is string, text_has string, lemma_is string, lemma_has string, upos array<string>, new_upos string, new_lemma string, new_feats string"
RANGE_RULE = "lang string, text string, kind string, new_upos string, new_lemma string, new_feats string"
_BROADCAST_ROWS = 20_000
_SALTS = 64
_NEW = ["new_upos", "new_lemma", "new_feats"]
_KEYS = ["lang", "text", "lemma", "upos"]


def builtin(spark: SparkSession) -> DataFrame:
    """The rules of the package for single words (Japanese verb forms, Italian commands)."""
    rows = []
    for i, (where, what, upos, new, lemma) in enumerate(R.JAPANESE):
        has = dict(zip(where.split("+"), what.split("|"), strict=True))
        rows.append(("jpn", i, has.get("is"), has.get("has"), has.get("lemma_is"), has.get("lemma_has"), [upos] if upos else None, new, lemma, None))
    rows += [("ita", i, t, None, None, None, ["ADJ", "NOUN", "VERB"], "VERB", lemma, R.COMMAND_FEATURES) for i, (t, lemma) in enumerate(R.ITALIAN_COMMANDS)]
    return spark.createDataFrame(rows, RULE)


def builtin_ranges(spark: SparkSession) -> DataFrame:
    rows = [("ita", t, "one", upos, lemma, feats) for t, upos, lemma, feats in R.ITALIAN_ONE_WORD]
    rows += [("ita", t, "first", "VERB", lemma, R.COMMAND_FEATURES) for t, lemma in R.ITALIAN_FIRST_VERB]
    return spark.createDataFrame(rows, RANGE_RULE)


def _holds(text: Column, lemma: Column, upos: Column) -> Column:
    def when(rule: str, test: Column) -> Column:
        return F.col(rule).isNull() | F.coalesce(test, F.lit(False))

    low = F.lower(text)
    return (
        when("r.text_is", low == F.lower(F.col("r.text_is"))) & when("r.text_has", text.contains(F.col("r.text_has"))) & when("r.lemma_is", lemma == F.col("r.lemma_is"))
        & when("r.lemma_has", lemma.contains(F.col("r.lemma_has"))) & when("r.upos", F.array_contains("r.upos", upos))
    )


def decided(types: DataFrame, rules: DataFrame) -> DataFrame:
    """(lang, text, lemma, upos, new_upos, new_lemma, new_feats, priority) of the types that a rule holds for."""
    t, r = types.select(*_KEYS).distinct().alias("t"), rules.alias("r")
    fits = _holds(F.col("t.text"), F.col("t.lemma"), F.col("t.upos"))
    same = F.col("t.lang") == F.col("r.lang")
    kept = [F.col(f"t.{k}").alias(k) for k in _KEYS] + [F.col(f"r.{c}").alias(c) for c in ["priority", *_NEW]]
    if rules.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS:
        met = t.join(F.broadcast(r), same & fits).select(*kept)
    else:
        exact = t.join(rules.where("text_is IS NOT NULL").alias("r"), same & (F.lower("t.text") == F.lower("r.text_is")) & fits).select(*kept)
        dealt = types.select(*_KEYS).distinct().withColumn("_salt", F.pmod(F.xxhash64(*_KEYS), F.lit(_SALTS)).cast("int")).alias("t")
        spread = rules.where("text_is IS NULL").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).alias("r")
        met = exact.union(dealt.join(spread, same & (F.col("t._salt") == F.col("r._salt")) & fits).select(*kept))
    best = met.groupBy(*_KEYS).agg(F.min(F.struct("priority", *_NEW)).alias("b"))
    return best.select(*_KEYS, "b.*")


def applied(items: DataFrame, rules: DataFrame) -> DataFrame:
    """``items`` (lang, text, lemma, upos, feats and others) with the analyses of their rules; adds ``rule``, its priority."""
    found = decided(items, rules).select(*[F.col(k).alias(f"_{k}") for k in _KEYS], *[F.col(c).alias(f"_{c}") for c in _NEW], F.col("priority").alias("_priority"))
    on = [F.col(f"i.{k}").eqNullSafe(F.col(f"_{k}")) for k in _KEYS]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    new = {"upos": "_new_upos", "lemma": "_new_lemma", "feats": "_new_feats"}
    cols = [F.coalesce(new[c], F.col(f"i.{c}")).alias(c) if c in new else F.col(f"i.{c}").alias(c) for c in items.columns]
    return items.alias("i").join(found, cond, "left").select(*cols, F.col("_priority").alias("rule"))


def regrouped(items: DataFrame, ranges: DataFrame, rules: DataFrame) -> DataFrame:
    """Parses whose split words follow the range rules.

    ``items``: file, utt, id (1, 2, ...), text, lemma, upos, feats, head (0: root), deprel, lang.
    ``ranges``: file, utt, first, last, text: items first to last are parts of the word ``text``.

    A word of a ``one`` rule takes the place of its parts, with head and relation of the first part whose
    head lies outside; if none does, those of its first part, the head becoming the root. The others are numbered
    anew, and heads inside the range point to the word. A range that overlaps an earlier one is left alone, and so is
    one that names items that are not there. A head that is no item becomes null.
    """
    key = Window.partitionBy("file", "utt").orderBy("first", F.desc("last"), "text").rowsBetween(Window.unboundedPreceding, -1)
    langs = items.groupBy("file", "utt").agg(F.min("lang").alias("lang"), F.max("id").alias("_n"))
    apart = ranges.where("first >= 1 AND last >= first").withColumn("_far", F.max("last").over(key)).where("_far IS NULL OR first > _far").drop("_far")
    inside = apart.join(langs, ["file", "utt"]).where("last <= _n").drop("_n")
    rule = rules.groupBy("lang", F.lower("text").alias("_low")).agg(F.min(F.struct("kind", *_NEW)).alias("_r"))
    small = rules.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS
    hit = inside.withColumn("_low", F.lower("text")).join(F.broadcast(rule) if small else rule, ["lang", "_low"])
    member = hit.select("file", "utt", F.explode(F.sequence("first", "last")).alias("id"), F.col("first").alias("_first"), F.col("last").alias("_last"), F.col("text").alias("_text"), "_r")
    one = F.coalesce(F.col("_r.kind") == "one", F.lit(False))
    order = Window.partitionBy("file", "utt").orderBy("id")
    owner = F.when(one, F.col("_first")).otherwise(F.col("id"))
    rows = items.join(member, ["file", "utt", "id"], "left").withColumn("_owner", owner)
    rows = rows.withColumn("_new", F.sum((F.col("id") == F.col("_owner")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    outer = ~F.col("head").between(F.col("_first"), F.col("_last"))
    part = Window.partitionBy("file", "utt", "_owner")
    rows = rows.withColumn("_up", F.coalesce(F.min(F.when(outer, F.struct("id", "head", "deprel"))).over(part), F.min(F.struct("id", F.lit(0).cast(items.schema["head"].dataType).alias("head"), "deprel")).over(part)))
    kept = F.col("id") == F.col("_owner")
    head = F.when(one, F.col("_up.head")).otherwise(F.col("head"))
    changed = F.coalesce(one | ((F.col("_r.kind") == "first") & (F.col("id") == F.col("_first"))), F.lit(False))
    value = {
        "id": F.col("_new").cast(items.schema["id"].dataType), "text": F.when(one, F.col("_text")).otherwise(F.col("text")), "deprel": F.when(one, F.col("_up.deprel")).otherwise(F.col("deprel")), "head": head,
        **{c: F.when(changed, F.coalesce(F.col(f"_r.new_{c}"), F.col(c))).otherwise(F.col(c)) for c in ("upos", "lemma", "feats")},
    }
    own = [c for c in items.columns if c not in ("file", "utt")]
    # an utterance is one row while heads look up their new numbers: no word carries the numbers of the others through a sort
    whole = rows.groupBy("file", "utt").agg(
        F.collect_list("id").alias("_ids"), F.collect_list("_new").alias("_news"),
        F.collect_list(F.when(kept, F.struct(*[value[c].alias(c) if c in value else F.col(c) for c in own]))).alias("_words"),
    )
    number = lambda h: F.get("_news", F.array_position("_ids", h.cast(items.schema["id"].dataType)).cast("int") - 1).cast(items.schema["head"].dataType)
    placed = F.transform("_words", lambda w: w.withField("head", F.when(w["head"] == 0, w["head"]).otherwise(number(w["head"]))))
    each = whole.select("file", "utt", F.explode_outer(placed).alias("w")).where("w IS NOT NULL")
    return each.select(*[F.col(c) if c in ("file", "utt") else F.col(f"w.{c}").alias(c) for c in items.columns])
