"""Dictionary matching: all phrases of a list in one pass over each text.

A phrase list is a table (phrase array<string>, value array<string>); texts are arrays of symbols, words or
characters. The list becomes an automaton over symbols (a trie whose states also know where to go on
when a symbol does not fit), so that a text is read once whatever the list's size. Matches are
leftmost-longest: from the left, at each place the longest phrase that begins there.

A list of at most ``_BROADCAST_ROWS`` phrases is sent to the workers, each of which builds the automaton once. A longer one is
joined by hashes to the places of the texts, in shards of bounded size, one row for each length of a phrase that fits there
(salted, since a frequent phrase has many places), and what is found is held against the text. What that shuffles grows with
places and lengths. Both
ways give the same matches. Phrases are compared as they are given: bring both sides to one case
before. Empty and null phrases do not count; of equal phrases the smallest value does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BROADCAST_ROWS, _SHARD_ROWS, _SHARES = 200_000, 100_000, 4


class Automaton:
    """States are numbers; 0 is the start."""

    def __init__(self, phrases: Iterator[tuple[str, ...]]):
        self.next: list[dict[str, int]] = [{}]
        self.phrase = [-1]  # number of the phrase that ends in a state
        self.depth = [0]
        for number, phrase in enumerate(phrases):
            at = 0
            for symbol in phrase:
                to = self.next[at].get(symbol)
                if to is None:
                    to = self.next[at][symbol] = len(self.next)
                    self.next.append({})
                    self.phrase.append(-1)
                    self.depth.append(self.depth[at] + 1)
                at = to
            self.phrase[at] = number
        self.back, self.shorter = [0] * len(self.next), [0] * len(self.next)
        level = list(self.next[0].values())
        while level:  # states by depth: the longest proper suffix that is a state, and the longest that is a phrase
            below = []
            for state in level:
                for symbol, to in self.next[state].items():
                    at = self.back[state]
                    while at and symbol not in self.next[at]:
                        at = self.back[at]
                    self.back[to] = self.next[at].get(symbol, 0)
                    self.shorter[to] = self.back[to] if self.phrase[self.back[to]] >= 0 else self.shorter[self.back[to]]
                    below.append(to)
            level = below

    def longest(self, symbols: list[str]) -> dict[int, tuple[int, int]]:
        """start: (end, phrase number) of the longest phrase that begins there."""
        out: dict[int, tuple[int, int]] = {}
        state, step, back, phrase, shorter, depth = 0, self.next, self.back, self.phrase, self.shorter, self.depth
        for end, symbol in enumerate(symbols, 1):
            while state and symbol not in step[state]:
                state = back[state]
            state = step[state].get(symbol, 0)
            found = state if phrase[state] >= 0 else shorter[state]
            while found:  # longer phrases from the same start come later and replace shorter ones
                out[end - depth[found]] = (end, phrase[found])
                found = shorter[found]
        return out


def leftmost(found: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, number) of the matches that are kept, none overlapping."""
    out, free = [], 0
    for start in sorted(found):
        if start >= free:
            free, number = found[start]
            out.append((start, free, number))
    return out


def _tidy(phrases: DataFrame) -> DataFrame:
    return phrases.where("size(phrase) > 0 AND NOT exists(phrase, x -> x IS NULL)").groupBy("phrase").agg(F.min("value").alias("value"))


_MATCHES = "array<struct<start:int,end:int,value:array<string>>>"


def _sent(texts: DataFrame, symbols: str, phrases: list, out: str) -> DataFrame:
    """Each worker builds the automaton of the whole list."""
    sent = texts.sparkSession.sparkContext.broadcast(([tuple(p) for p, _ in phrases], [v for _, v in phrases]))
    built: list[Automaton] = []

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys, values = sent.value
        if not built:
            built.append(Automaton(iter(keys)))
        for batch in batches:
            yield pd.Series([[] if t is None else [(a, b, values[n]) for a, b, n in leftmost(built[0].longest(list(t)))] for t in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return texts.withColumn(out, F.pandas_udf(run, _MATCHES)(F.col(symbols)))


def _joined(texts: DataFrame, symbols: str, phrases: DataFrame, out: str, shards: int) -> DataFrame:
    """The list meets the places of the texts, not the texts: each place goes out once for each length of a phrase, as hashes.

    A text is named by a hash too. Both may clash without harm, since what comes back to a text is held against its symbols.
    """
    lengths = sorted(r.n for r in phrases.select(F.size("phrase").alias("n")).distinct().collect())  # at most the longest phrase
    text = F.xxhash64(symbols)

    def places(n: int):
        at = F.sequence(F.lit(1), F.size(symbols) - (n - 1))
        return F.when(F.size(symbols) >= n, F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(n), F.slice(symbols, i, n)).alias("h")))).otherwise(F.array())

    asked = texts.select(text.alias("_text"), F.explode(F.concat(*[places(n) for n in lengths])).alias("p")).select("_text", "p.at", F.col("p.h").alias("_h"), F.pmod(F.xxhash64("_text"), F.lit(_SHARES)).cast("int").alias("_share"))
    listed = phrases.select("phrase", "value", F.xxhash64(F.size("phrase"), "phrase").alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))).alias("_share"))
    match = F.struct((F.col("at") - 1).alias("start"), (-F.size("phrase")).alias("less"), "phrase", "value")
    met = asked.repartition(shards, "_h", "_share").join(listed.repartition(shards, "_h", "_share"), ["_h", "_share"]).groupBy("_text").agg(F.array_sort(F.collect_set(match)).alias("_found"))
    zero = F.struct(F.array().cast(_MATCHES).alias("kept"), F.lit(0).alias("free"))

    def step(a, m):
        fits = (m["start"] >= a["free"]) & (F.slice(symbols, m["start"] + 1, -m["less"]) == m["phrase"])
        end = m["start"] - m["less"]
        one = F.array(F.struct(m["start"].alias("start"), end.alias("end"), m["value"].alias("value")))
        return F.when(fits, F.struct(F.concat(a["kept"], one).alias("kept"), end.alias("free"))).otherwise(a)

    joined = texts.withColumn("_text", text).join(met, "_text", "left")
    kept = F.aggregate("_found", zero, step)["kept"]
    return joined.withColumn(out, F.coalesce(kept, F.array().cast(_MATCHES))).drop("_text", "_found")


def find(texts: DataFrame, phrases: DataFrame, symbols: str = "words", out: str = "matches") -> DataFrame:
    """``texts`` with ``out``: array of start, end (exclusive, from 0) and value of the phrases found, in order.

    A null text has no matches; a null symbol fits no phrase.
    """
    tidy = _tidy(phrases)
    some = tidy.limit(_BROADCAST_ROWS + 1).collect()  # bounded
    if len(some) <= _BROADCAST_ROWS:
        return _sent(texts, symbols, [(r.phrase, list(r.value)) for r in some], out)
    shards = -(-tidy.count() * _SHARES // _SHARD_ROWS)
    return _joined(texts, symbols, tidy, out, max(shards, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def replaced(symbols: Column, matches: Column) -> Column:
    """The symbols with each match's symbols replaced by its value (native)."""
    starts = F.transform(matches, lambda m: m["start"])
    inside = F.flatten(F.transform(matches, lambda m: F.sequence(m["start"], m["end"] - 1)))
    at = F.map_from_arrays(starts, F.transform(matches, lambda m: m["value"]))
    each = F.transform(symbols, lambda s, i: F.when(F.array_contains(starts, i), F.try_element_at(at, i)).when(F.array_contains(inside, i), F.array().cast("array<string>")).otherwise(F.array(s)))
    return F.when(F.size(matches) > 0, F.flatten(each)).otherwise(symbols)


def entries(lexicon: DataFrame, kind: str, join: str | None = None) -> DataFrame:
    """(phrase, value) of a list (kind, key, parts) of ``operators.lexicons``: its parts in lower case, to be written as one word, put together by ``join``."""
    low = F.transform("parts", F.lower)
    return lexicon.where((F.col("kind") == kind) & (F.size("parts") > 1)).select(low.alias("phrase"), F.array(F.array_join(low if join is None else "parts", join or "")).alias("value"))


def merge_multiwords(utts: DataFrame, lexicon: DataFrame, symbols: str = "words") -> DataFrame:
    """Multiword entries (kind ``multiword``) of a list of any size as one word with ``_``, as the text writes them."""
    low = utts.withColumn("_low", F.transform(symbols, F.lower))
    found = find(low, entries(lexicon, "multiword", "_"), "_low", "_m")
    own = F.transform("_m", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.array(F.array_join(F.slice(symbols, m["start"] + 1, m["end"] - m["start"]), "_")).alias("value")))
    return found.withColumn(symbols, replaced(F.col(symbols), own)).drop("_low", "_m")


def rewrite_text(rows: DataFrame, words: DataFrame, text: str = "text", script: DataFrame | None = None) -> DataFrame:
    """A text by characters: ``script`` (source, target) one for one first, then ``words`` (source, target), the longest that fits at each place."""
    out = rows
    for pairs in [p for p in (script, words) if p is not None]:
        cut = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
        listed = pairs.select(cut(F.col("source")).alias("phrase"), F.array("target").alias("value"))
        chars = find(out.withColumn("_c", cut(F.col(text))), listed, "_c", "_m")
        out = chars.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(replaced(F.col("_c"), F.col("_m")), ""))).drop("_c", "_m")
    return out
