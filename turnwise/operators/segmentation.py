"""Turns into utterances: retokenising, pauses, assignments, trees and particles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions.lazy import lazy_udf
from turnwise.functions.words import literal_map
from turnwise.session import fresh


def _parts(clean: Column) -> Column:
    """A word and the punctuation glued to its end, as an array."""
    marks = L.ENDING_PUNCT + list(L.RTL_PUNCT)
    last = F.substring(clean, -1, 1)
    whole = clean.isin(marks)
    glued = ~whole & last.isin([m for m in marks if len(m) == 1])
    plain = lambda c: F.coalesce(F.try_element_at(literal_map(L.RTL_PUNCT), c), c)
    front = F.substr(clean, F.lit(1), F.length(clean) - 1)
    return F.when(whole, F.array(plain(clean))).when(glued, F.filter(F.array(front, plain(last)), lambda x: x != "")).otherwise(F.array(clean))


def retokenised(rows: DataFrame, words: str, out: str) -> DataFrame:
    """``retokenise`` within each row: ``out`` is an array of utterances, arrays of words, of the array ``words`` (null: null). Nothing is sorted or shuffled."""
    p, e, m = (fresh(rows, f"_{c}") for c in "pem")
    size = fresh(rows, "_n")
    clean = F.transform(words, lambda w: F.replace(F.translate(w, "¿¡", "  "), F.lit("。"), F.lit(".")))
    cut = rows.withColumn(p, F.flatten(F.transform(clean, _parts)))
    cut = cut.withColumn(e, F.filter(F.transform(p, lambda x, i: F.when(x.isin(L.ENDING_PUNCT), i)), lambda i: i.isNotNull()))
    # ends of utterances, and the last word that counts: what follows the last end is a rest, without the separators at its end
    cut = cut.withColumn(size, F.coalesce(F.element_at(F.when(F.size(e) > 0, F.col(e)), -1) + 1, F.lit(0)))
    cut = cut.withColumn(m, F.coalesce(F.array_max(F.transform(p, lambda x, i: F.when(~x.isin(L.MOR_PUNCT), i + 1))), F.lit(0)) - F.col(size))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(e, i - 1) + 1)
    closed = F.transform(e, lambda x, i: F.slice(p, begin(i) + 1, x - begin(i) + 1))
    rest = F.when(F.col(m) > 0, F.array(F.concat(F.slice(p, F.col(size) + 1, F.greatest(m, F.lit(0))), F.array(F.lit("."))))).otherwise(F.array().cast("array<array<string>>"))
    return cut.withColumn(out, F.concat(closed, rest)).drop(p, e, m, size)


def in_order(words: DataFrame, keys: list[str], seq: str, text: str) -> DataFrame:
    """``keys`` and ``text``, the words of a key as an array in the order of ``seq``."""
    each = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t")))).alias(text))
    return each.withColumn(text, F.transform(text, lambda x: x["t"]))


def retokenise(words: DataFrame, keys: list[str], seq: str, text: str) -> DataFrame:
    """Utterances out of a stream of words, cut after sentence-final punctuation.

    Punctuation at the end of a word becomes a word of its own; marks that
    read from the right become plain ones; a rest without a mark at its end
    loses separators there and gets a full stop. Adds ``utt`` and ``pos``.
    Words of a key travel as one array.
    """
    said = each_utterance(retokenised(in_order(words, keys, seq, text), text, text).select(*keys, F.col(text)), F.col(text), text)
    return said.select(*keys, "utt", F.posexplode(text).alias("pos", text))


def each_utterance(rows: DataFrame, utts: Column, out: str) -> DataFrame:
    """A row for each element of an array of utterances: the other columns of ``rows``, ``utt`` (from 0) and ``out``."""
    # not posexplode: the filter that it infers would have the utterances worked out again for each use of them
    kept = [F.col(c) for c in rows.columns if c != out]
    return rows.select(*kept, F.posexplode_outer(utts).alias("_utt", out)).where("_utt IS NOT NULL").select(*kept, F.col("_utt").cast("long").alias("utt"), out)


def split_on_pauses(words: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Adds ``chunk``: a long pause before a listed sentence opener starts a new one (running state, by key).

    ``words`` has text, start_ms, end_ms; the pause counts from the last timed word, and the chunk
    must hold two words already.
    """
    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    spec = ", ".join(f"{c} {kinds[c]}" for c in [*keys, seq]) + ", chunk int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq)
        chunk = size = 0
        end, out = None, []
        for text, s, e in rows[["text", "start_ms", "end_ms"]].itertuples(index=False):
            word = text.lower()
            a = next((i for i, c in enumerate(word) if c.isalnum()), len(word))
            b = next((i for i, c in enumerate(reversed(word)) if c.isalnum()), len(word))
            opener = word[a : len(word) - b]
            if size >= L.LONG_PAUSE_LEAST and end is not None and not pd.isna(s) and s - end >= L.LONG_PAUSE_MS and opener in L.LONG_PAUSE_STARTERS:
                chunk, size = chunk + 1, 0
            if not pd.isna(s) and not pd.isna(e):
                end = e
            size += 1
            out.append(chunk)
        return rows[[*keys, seq]].assign(chunk=out)

    return words.select(*keys, seq, "text", "start_ms", "end_ms").groupBy(*keys).applyInPandas(run, spec)


def split_by_assignment(words: DataFrame, keys: list[str], seq: str, group: str, out: str = "part") -> DataFrame:
    """A new part wherever the assigned group changes."""
    order = Window.partitionBy(*keys).orderBy(seq)
    change = F.coalesce((F.col(group) != F.lag(group).over(order)).cast("int"), F.lit(0))
    return words.withColumn("_c", change).withColumn(out, F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def boundary_groups(words: DataFrame, keys: list[str], seq: str, boundary: Column, out: str = "grp") -> DataFrame:
    """Group ids from boundary actions: a boundary closes its group."""
    order = Window.partitionBy(*keys).orderBy(seq)
    b = words.withColumn("_b", F.coalesce(boundary.cast("int"), F.lit(0)))
    return b.withColumn(out, F.coalesce(F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_b")


def merge_small_groups(words: DataFrame, keys: list[str], seq: str, group: str, least: int = L.SMALL_GROUP) -> DataFrame:
    """Gaps of a group column filled forward, then backward; groups under ``least`` words join the next, the last one the one before.

    Returns keys, seq, ``assigned`` (0, 1, ... in order). Merging carries words along, a running state by key.
    """
    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    spec = ", ".join(f"{c} {kinds[c]}" for c in [*keys, seq]) + ", assigned int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq).reset_index(drop=True)
        filled = rows[group].ffill().bfill().fillna(0).tolist()
        runs: list[int] = []
        for i, g in enumerate(filled):
            if i and g == filled[i - 1]:
                runs[-1] += 1
            else:
                runs.append(1)
        out: list[int] = []
        carry = 0
        for n in runs:
            carry += n
            if carry >= least:
                out.append(carry)
                carry = 0
        if carry:
            if out:
                out[-1] += carry
            else:
                out.append(carry)
        ids = [k for k, n in enumerate(out) for _ in range(n)]
        return rows[[*keys, seq]].assign(assigned=ids)

    return words.select(*keys, seq, group).groupBy(*keys).applyInPandas(run, spec)


def split_at_particles(words: DataFrame, keys: list[str], seq: str, text: str, particles: list[str]) -> DataFrame:
    """Adds ``part``: a listed final particle of one or two words ends a part, the longer match first."""
    order = Window.partitionBy(*keys).orderBy(seq)
    one = F.col(text).isin([p for p in particles if " " not in p])
    pair = F.concat_ws(" ", F.lag(text).over(order), F.col(text)).isin([p for p in particles if " " in p])
    opens_pair = F.concat_ws(" ", F.col(text), F.lead(text).over(order)).isin([p for p in particles if " " in p])
    closing = words.withColumn("_b", (pair | (one & ~opens_pair)).cast("int"))
    return closing.withColumn("part", F.coalesce(F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_b")


# --- bracketed trees ---------------------------------------------------------------


def parse_tree(text: str) -> list:
    """'(S (NP (N dog)) (VP (V ran)))' as nested [label, children]; leaves are strings."""
    stack: list[list] = [["ROOT", []]]
    for token in text.replace("(", " ( ").replace(")", " ) ").split():
        if token == "(":
            stack.append([None, []])
        elif token == ")":
            if len(stack) > 1:
                node = stack.pop()
                stack[-1][1].append(node)
        elif stack[-1][0] is None:
            stack[-1][0] = token
        else:
            stack[-1][1].append(token)
    while len(stack) > 1:
        node = stack.pop()
        stack[-1][1].append(node)
    return stack[0]


def clause_ranges(text: str, labels: tuple[str, ...] = ("S", "SBAR", "SQ", "SINV")) -> list[tuple[int, int]]:
    """(first leaf, last leaf) of the clauses of a tree, without repetitions, in order."""
    out: list[tuple[int, int]] = []

    def walk(node, at: int) -> int:
        start = at
        for child in node[1]:
            at = at + 1 if isinstance(child, str) else walk(child, at)
        if node[0] in labels and at > start:
            out.append((start, at - 1))
        return at

    walk(parse_tree(text), 0)
    return sorted(set(out))


@lazy_udf("array<struct<first:int,last:int>>")
def tree_ranges(trees: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"first": a, "last": b} for a, b in clause_ranges(t)] for t in trees])
