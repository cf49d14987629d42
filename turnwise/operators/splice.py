"""Grafting parses of second-language spans into the tree of their utterance.

Tables:

* host: file, utt, id (1, 2, ...), text, lemma, upos, head, deprel, lang: one row a word; ``lang``
  is null for words of the utterance's own language;
* second: file, utt, span, id, word, text, lemma, upos, head, deprel: the parse of each span on its own; ``word``
  (1, 2, ...) is the word of the span that a row belongs to, which has several rows where it is contracted.

An utterance is worked on in one row, as the array of its words and that of the parses of its spans, so that nothing is
joined by word: tables of rows are gathered once, and who has the arrays shuffles nothing (``splice_turns``).
The grafted tree is renumbered by a running sum of the rows that each word takes up. The root
of a span hangs where its word nearest to the utterance's root hung, so that every step
from span to span goes up in the host tree: the result has one root and no cycle whatever
the spans are. Where a span does not fit (its words are not those of the parse) or the host is no tree,
its words keep their place as ``L2|xxx``. Numbers and heads, walks in arrays that an utterance bounds, are
Python, in pieces of Arrow batches; texts, classes and relations are native.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.lazy import row_udf

HOST, SECOND = ("id", "head", "text", "lemma", "upos", "deprel", "lang"), ("span", "id", "word", "text", "lemma", "upos", "head", "deprel")

# Classes that a relation allows, likeliest first; relations that are not named allow all.
CONSTRAINTS = {
    "det": ["DET"], "amod": ["ADJ"], "advmod": ["ADV"], "case": ["ADP"], "mark": ["SCONJ"], "cc": ["CCONJ"], "ccomp": ["VERB"], "advcl": ["VERB"], "aux": ["AUX"], "cop": ["AUX"],
    "nummod": ["NUM"], "discourse": ["INTJ"], "punct": ["PUNCT"], "nsubj": ["NOUN", "PRON", "PROPN"], "obj": ["NOUN", "PRON", "PROPN"], "iobj": ["NOUN", "PRON", "PROPN"],
    "obl": ["NOUN", "PRON"], "nmod": ["NOUN", "PROPN"], "appos": ["NOUN", "PROPN"], "xcomp": ["VERB", "ADJ"], "acl": ["VERB", "ADJ"], "vocative": ["NOUN", "PROPN"], "root": ["VERB", "NOUN", "ADJ"],
}
# Classes that a dependent of a word leaves to it.
BY_DEPENDENT = {"det": ["NOUN", "PROPN"], "nsubj": ["VERB", "ADJ"], "csubj": ["VERB", "ADJ"], "obj": ["VERB"], "iobj": ["VERB"], "case": ["NOUN", "PRON", "PROPN"]}
CLOSED = ["DET", "ADP", "SCONJ", "CCONJ", "AUX", "PART", "PRON"]
NOMINAL = ["NOUN", "PROPN"]


def _lists(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def base(deprel: Column) -> Column:
    return F.substring_index(deprel, ":", 1)


def allowed(deprel: Column, dependents: Column) -> Column:
    """Classes a word may have by its relation and its dependents' relations (null: all)."""
    known, narrow = F.try_element_at(_lists(CONSTRAINTS), base(deprel)), _lists(BY_DEPENDENT)

    def step(acc: Column, d: Column) -> Column:
        some = F.try_element_at(narrow, base(d))
        both = F.array_intersect(acc, some)
        return F.when(some.isNull(), acc).when(acc.isNull(), some).when(F.size(both) == 0, acc).otherwise(both)

    return F.aggregate(F.coalesce(dependents, F.array().cast("array<string>")), known, step)


def merged_class(first: Column, second: Column, deprel: Column, dependents: Column, particle: Column, has_particle: Column) -> Column:
    """Class of a foreign word from the host's guess ``first`` and the parse of its own language ``second``.

    In this order: particle and head of a phrasal verb; no verb under a copula; the second guess where the
    relation allows it, where it is a closed class, where it is a noun; the first guess where the relation
    allows it; the likeliest class of the relation; whatever there is.
    """
    may, none = allowed(deprel, dependents), F.lit(False)
    fits = lambda c: F.coalesce(may.isNull() | F.array_contains(may, c), none)
    copula = F.coalesce(F.exists(dependents, lambda d: base(d) == "cop"), none)
    likely = F.get(may, F.lit(0))
    return (
        F.when(F.coalesce(particle, none), "PART").when(F.coalesce(has_particle, none) & (second == "VERB"), second)
        .when(copula & (second == "VERB"), F.when(first.isin(NOMINAL), "NOUN").otherwise("ADJ"))
        .when(second.isNotNull() & (fits(second) | second.isin(CLOSED) | second.isin(NOMINAL)), second)
        .when(first.isNotNull() & fits(first), first).otherwise(F.coalesce(likely, second, first, F.lit("NOUN")))
    )


def corrected_relation(deprel: Column, upos: Column, head_upos: Column, dependents: Column) -> Column:
    """The relation of a grafted word where the host's does not go with its class."""
    may = F.try_element_at(_lists(CONSTRAINTS), base(deprel))
    doubtful = (base(deprel) == "flat") | ~F.coalesce(may.isNull() | F.array_contains(may, upos), F.lit(True))
    case = F.coalesce(F.exists(dependents, lambda d: base(d) == "case"), F.lit(False))
    guess = (
        F.when((upos == "ADV") & head_upos.isin("VERB", "ADJ", "ADV"), "advmod").when((upos == "ADJ") & head_upos.isin(NOMINAL), "amod").when((upos == "DET") & head_upos.isin(NOMINAL), "det")
        .when(upos.isin(NOMINAL) & (head_upos == "VERB"), F.when(case, "obl").otherwise("obj")).when(upos.isin(NOMINAL) & head_upos.isin(NOMINAL), "nmod")
    )
    return F.when(doubtful, F.coalesce(guess, deprel)).otherwise(deprel)


def _depths(heads: list[int]) -> list[int | None]:
    """Steps from each word to the root; all null where a walk does not end there or there is not one root."""
    n, depth = len(heads), {0: 0}
    for at in range(1, n + 1):
        path = []
        while at not in depth and 0 < at <= n:
            depth[at] = None  # met again on the same walk: a cycle
            path.append(at)
            at = heads[at - 1] if heads[at - 1] is not None else -1
        below = depth.get(at)
        for p in reversed(path):
            below = None if below is None else below + 1
            depth[p] = below
    whole = sum(h == 0 for h in heads) == 1 and None not in depth.values()
    return [depth[i] if whole else None for i in range(1, n + 1)]


def _mended(heads: list[int]) -> list[int]:
    """Heads with one root and no cycle: the first root stays (the first row where there is none), others and lost rows hang on it."""
    n = len(heads)
    out = [h if h is not None and 0 <= h <= n else 0 for h in heads]
    root = out.index(0) if 0 in out else 0
    out = [0 if i == root else (root + 1 if h == 0 else h) for i, h in enumerate(out)]
    for i in range(n):
        at, steps = i + 1, 0
        while at and steps <= n:
            at, steps = out[at - 1], steps + 1
        if at:
            out[i] = root + 1
    return out


def spans(host: Column) -> Column:
    """Array of (first, last): places (from 0) of the runs of words of one other language in an array of host words, which must be a column."""

    def ends(step: int) -> Column:
        same = lambda x, i: F.coalesce(F.get(host, i + step)["lang"] == x["lang"], F.lit(False))
        return F.filter(F.transform(host, lambda x, i: F.when(x["lang"].isNotNull() & ~same(x, i), i)), lambda i: i.isNotNull())

    return F.transform(F.arrays_zip(ends(-1).alias("first"), ends(1).alias("last")), lambda z: F.struct(z["first"].alias("first"), z["last"].alias("last")))


_PLAN = ("at", "chunk", "id", "head", "near", "over", "main", "has_particle", "lost", "kin", "near_kin")


@row_udf("struct<at: array<int>, chunk: array<int>, id: array<bigint>, head: array<bigint>, near: array<int>, over: array<int>, main: array<boolean>, has_particle: array<boolean>, lost: array<boolean>, kin: array<array<string>>, near_kin: array<array<string>>>")
def _plan(ids, heads, deprels, firsts, lasts, span, number, word, given, relation):
    """The rows of an utterance's new tree, as lists side by side.

    at, chunk: places of the host word and of the row of its parse (null: the word stays); id, head: new numbers; near, over: for the
    root of a span, the places of its word nearest to the utterance's root and of that word's head; main: whether a row stands
    for its word; has_particle; lost: whether its head was mended; kin, near_kin: relations of the dependents of a main row's word and of near.
    """
    if ids is None:
        return None
    n, deep = len(ids), _depths(heads)
    depth = [deep[i - 1] if i is not None and 0 < i <= n else None for i in ids]
    place = {i: p for p, i in enumerate(ids) if i is not None}
    kin, parsed, fits = defaultdict(list), defaultdict(list), {}
    for h, d in zip(heads, deprels, strict=True):
        if h is not None and h > 0 and d is not None:
            kin[h].append(d)
    for k, no in enumerate(span or ()):
        parsed[no].append(k)
    for no, (a, b) in enumerate(zip(firsts, lasts, strict=True), 1):
        rows = parsed.get(no, [])
        words = [word[k] for k in rows]
        # one row after another, and the words are those of the span
        tidy = [number[k] for k in rows] == list(range(1, len(rows) + 1)) and None not in words and words == sorted(words) and sorted(set(words)) == list(range(1, b - a + 2))
        if tidy and None not in depth[a : b + 1]:
            up, first, main = _mended([given[k] for k in rows]), {}, {}
            for i, (w, u) in enumerate(zip(words, up, strict=True), 1):
                first.setdefault(w, i)
                if u == 0 or words[u - 1] != w:  # the row that stands for a word: the first whose head lies outside the word
                    main.setdefault(w, i)
            fits[a] = b, rows, words, up, first, main

    # new numbers: a running sum of widths
    begins, stands, at, p = {}, [0] * n, 1, 0
    while p < n:
        begins[p] = at
        if p in fits:
            b, rows, _, _, _, main = fits[p]
            stands[p : b + 1] = [at + main[w] - 1 for w in range(1, b - p + 2)]
            at, p = at + len(rows), b + 1
        else:
            stands[p] = at
            at, p = at + 1, p + 1
    new_head = lambda p: 0 if heads[p] == 0 else stands[place[heads[p]]] if heads[p] in place else None

    out = []
    for p, at in begins.items():
        if p not in fits:
            out.append((p, None, at, new_head(p), None, None, False, False, False, None, None))
            continue
        b, rows, words, up, _, main = fits[p]
        near = min(range(p, b + 1), key=lambda q: (depth[q], ids[q]))
        over, heads_of_particles = place.get(heads[near]), {u for k, u in zip(rows, up, strict=True) if relation[k] == "compound:prt"}
        for i, (k, w, u) in enumerate(zip(rows, words, up, strict=True), 1):
            q, stays = p + w - 1, main[w] == i
            hangs = (new_head(near), near, over) if u == 0 else (at + u - 1, None, None)
            out.append((q, k, at + i - 1, *hangs, stays, i in heads_of_particles, u != given[k], sorted(kin[ids[q]]) if stays else None, sorted(kin[ids[near]]) if u == 0 else None))
    return dict(zip(_PLAN, map(list, zip(*out, strict=True)), strict=True)) if out else None


def splice(host: DataFrame, second: DataFrame) -> DataFrame:
    """file, utt, id, text, lemma, upos, head, deprel, origin (``host``, ``spliced`` or ``fallback``)."""
    key = ["file", "utt"]
    both = host.select(*key, F.struct(*HOST).alias("h")).unionByName(second.select(*key, F.struct(*SECOND).alias("s")), allowMissingColumns=True)
    turns = both.groupBy(*key).agg(F.array_sort(F.collect_list("h")).alias("host"), F.array_sort(F.collect_list("s")).alias("second"))
    return splice_turns(turns.withColumn("runs", spans(F.col("host"))))


def splice_turns(turns: DataFrame) -> DataFrame:
    """As ``splice``, from one row for each utterance: file, utt, host and second (arrays of their rows, in order), runs (``spans`` of host)."""
    each = lambda a, field, kind: F.transform(a, lambda x: x[field].cast(kind))
    numbers = [each("host", "id", "bigint"), each("host", "head", "bigint"), each("host", "deprel", "string"), each("runs", "first", "int"), each("runs", "last", "int")]
    turns = turns.withColumn("plan", _plan(*numbers, *[each("second", c, "bigint") for c in ("span", "id", "word", "head")], each("second", "deprel", "string")))

    def row(at: Column, i: Column) -> Column:
        of = lambda c: F.get(F.col("plan")[c], i)
        found = {"h": F.get("host", at), "c": F.get("second", of("chunk")), "near": F.get("host", of("near")), "head_upos": F.get("host", of("over"))["upos"]}
        return F.struct(*[of(c).alias(c) for c in _PLAN if c not in ("at", "chunk", "near", "over")], *[v.alias(k) for k, v in found.items()])

    rows = turns.select("file", "utt", F.inline(F.transform(F.col("plan")["at"], row)))
    h, c, near = F.col("h"), F.col("c"), F.col("near")
    grafted, own = c.isNotNull(), h["lang"].isNull()
    merged = merged_class(h["upos"], c["upos"], h["deprel"], F.col("kin"), c["deprel"] == "compound:prt", F.col("has_particle"))
    rows = rows.withColumn("upos", F.when(F.col("main"), merged).when(grafted, c["upos"]).when(own, h["upos"]).otherwise("L2"))
    hung = F.when(near["head"] == 0, "root").otherwise(corrected_relation(near["deprel"], F.col("upos"), F.col("head_upos"), F.col("near_kin")))
    return rows.select(
        "file", "utt", "id", F.when(grafted, c["text"]).otherwise(h["text"]).alias("text"), F.when(grafted, c["lemma"]).when(own, h["lemma"]).otherwise("xxx").alias("lemma"), "upos", "head",
        F.when(near.isNotNull(), hung).when(F.col("lost"), "dep").when(grafted, c["deprel"]).otherwise(h["deprel"]).alias("deprel"), F.when(grafted, "spliced").when(own, "host").otherwise("fallback").alias("origin"),
    )


def tiers(spliced: DataFrame) -> DataFrame:
    """file, utt, mor, gra: the tiers of the grafted trees."""
    rows = spliced.groupBy("file", "utt").agg(F.array_sort(F.collect_list(F.struct("id", "upos", "lemma", "head", "deprel"))).alias("t"))
    mor = F.transform("t", lambda x: F.concat(F.when(x["upos"] == "L2", "L2").otherwise(F.lower(x["upos"])), F.lit("|"), x["lemma"]))
    gra = F.transform("t", lambda x: F.concat_ws("|", x["id"].cast("string"), x["head"].cast("string"), F.upper(F.replace(x["deprel"], F.lit(":"), F.lit("-")))))
    return rows.select("file", "utt", F.array_join(mor, " ").alias("mor"), F.array_join(gra, " ").alias("gra"))
