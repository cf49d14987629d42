"""Near-duplicates by an LSH forest of MinHash signatures (operator 4).

1. Every document becomes its set of word shingles (64-bit hashes), its size, a
   128-bit fingerprint of the set and ``trees`` short signatures. Only these
   leave the task; texts are never shuffled.
2. Sets with equal size and fingerprint collapse to one node (they are not
   compared further), by an aggregate with partial sums, whatever the number of
   copies.
3. Each tree is one sorted order of the signatures of all nodes, dealt by range
   of (tree, signature, node), so that a crowded region spreads over many tasks.
   The ``reach`` next nodes in an order that share a prefix of at least ``depth``
   minima are candidates; in a crowded region these are the ones with the longest
   common prefix, so that the depth adapts to the region. The rows at the ends of
   the ranges are stitched in a second step. Candidates are confirmed on full
   sets, in cells of bounded size, and give a first set of classes.
4. A region of up to ``reach`` + 1 nodes is compared in full by step 3. The nodes
   of more crowded regions are gathered in zones, the connected components of
   regions that share nodes. A zone that step 3 has made one class is done. Any
   other is compared in full, by pairs of salted blocks of bounded size: block
   pairs whose sizes cannot reach the similarity, or which hold one class only,
   are left out, and a task counts the common shingles of two blocks from
   inverted lists, some sets of each at a time. So no candidate is ever dropped, however crowded a region is;
   what it costs is the cross comparison of the classes in such a zone.
5. Classes are connected components of the links, by contraction.

A pair with similarity s is a candidate in one order with probability s^depth:
at 0.8, 32 orders and depth 4 one in 20 million such pairs is missed, and it
only matters if no other member of the class links the two.

Defined results: documents without words have size 0 and are linked with
nothing. Rows are told apart by id and text: rows that share both are one
document and get equal rows, rows that share an id only are separate documents.
The name of a class is the smallest id in it; a null id never names a class that
has another, and a document is ``kept`` if its id is the name. Ids may be of any
type that can be ordered; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import shingles
from turnwise.llm.common import cut, fresh, slices, utf8
from turnwise.llm.components import components
from turnwise.session import table

#: Up to so many document keys (about 24 bytes each) are broadcast to pick texts; more are joined by a shuffle.
_BROADCAST_KEYS = 1_000_000
_TREE_WIDTH = 6
#: Shingles of a block of a crowded zone (8 bytes each); a longer document is a block of its own.
_BLOCK = 500_000
#: A set counts in a block as at least so many shingles: a block has about _BLOCK / _LEAST sets at most.
_LEAST = 100
#: Sets of each side whose common shingles are counted at once; the rest of two blocks waits.
_TILE = 1000


def fingerprints(docs: DataFrame, *, doc_id: str, text: str, size: int, trees: int) -> DataFrame:
    """doc_id, tk (hash of the text), n, h1, h2 (fingerprint of the set), sig (all signatures, big-endian)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tk"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                each = shingles.sets(*utf8(part.column("text")), size)
                sums = np.array([(int(s.sum()), int((s * (s | np.uint64(1))).sum())) if len(s) else (0, 0) for s in each], np.uint64).reshape(-1, 2)
                sig = [shingles.signature(s, trees * _TREE_WIDTH).astype(">u4").tobytes() if len(s) else None for s in each]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tk"), pa.array([len(s) for s in each], pa.int64()), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), pa.array(sig, pa.binary())],
                    ["doc_id", "tk", "n", "h1", "h2", "sig"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, tk long, n long, h1 long, h2 long, sig binary")


# --- the forest -----------------------------------------------------------------

_STEP = "a long, b long, region binary, tree int, key binary, node long, n long"


def _emit(a=(), b=(), region=(), crowd=(), tree=(), key=(), node=(), n=()) -> pa.RecordBatch:
    """Candidate pairs, then nodes of crowded regions, then end rows."""
    p, c, e = len(a), len(crowd), len(tree)

    def col(kind, pairs=None, crowds=None, ends=None):
        parts = [(pairs, p), (crowds, c), (ends, e)]
        return pa.concat_arrays([pa.nulls(k, kind) if x is None else pa.array(x, kind) for x, k in parts])

    return pa.RecordBatch.from_arrays(
        [
            col(pa.int64(), pairs=a), col(pa.int64(), pairs=b), col(pa.binary(), crowds=region), col(pa.int32(), ends=tree),
            col(pa.binary(), ends=[k.tobytes() for k in key]), col(pa.int64(), crowds=crowd, ends=node), col(pa.int64(), ends=n),
        ],
        ["a", "b", "region", "tree", "key", "node", "n"],
    )


def _walk(ordered: DataFrame, depth: int, reach: int, share: tuple[int, int]) -> DataFrame:
    """Along the partitions of an ordered table: candidate pairs, nodes of crowded regions, and the end rows."""
    num, den = share

    def run(batches):
        kept = None  # the last rows of the batch before
        head_left = reach + 1
        for batch in batches:
            tree, node, n = (batch.column(c).to_numpy() for c in ("tree", "node", "n"))
            key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, _TREE_WIDTH)
            new = len(tree)
            if not new:
                continue
            head = min(head_left, new)
            head_left -= head
            if head:
                yield _emit(tree=tree[:head], key=key[:head], node=node[:head], n=n[:head])
            if kept is not None:
                tree, key, node, n = (np.concatenate(x) for x in zip(kept, (tree, key, node, n), strict=True))
            old = len(tree) - new
            # length of the run of rows with the same tree and first minima that ends at a row
            same = np.zeros(len(tree), bool)
            same[1:] = (tree[1:] == tree[:-1]) & (key[1:, :depth] == key[:-1, :depth]).all(axis=1)
            begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(tree))))
            left, right = [], []
            for w in range(1, min(reach, len(tree) - 1) + 1):
                i = np.arange(max(old, w), len(tree))
                i = i[i - begin[i] >= w]
                j = i - w
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                fit = (den * small >= num * large) & (node[i] != node[j])
                left.append(np.minimum(node[i], node[j])[fit])
                right.append(np.maximum(node[i], node[j])[fit])
            # rows of runs of more than reach + 1, as far as they can be seen here
            over = np.flatnonzero(np.arange(len(tree)) - begin > reach)
            if len(over):
                mark = np.zeros(len(tree) + 1, np.int64)
                np.add.at(mark, over - reach - 1, 1)
                np.add.at(mark, over + 1, -1)
                crowd = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                names = [int(t).to_bytes(4, "big") + k.tobytes() for t, k in zip(tree[crowd], key[crowd, :depth], strict=True)]
                yield _emit(region=names, crowd=node[crowd])
            if left:
                pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
                yield _emit(a=pair[0], b=pair[1])
            kept = tuple(x[-reach - 1 :] for x in (tree, key, node, n))
        if kept is not None:
            yield _emit(tree=kept[0], key=kept[1], node=kept[2], n=kept[3])

    return ordered.mapInArrow(run, _STEP)


def forest(nodes: DataFrame, *, trees: int, depth: int, reach: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a < b) and the nodes of crowded regions (region, node) of ``nodes`` (node, n, sig)."""
    spark = nodes.sparkSession
    width = _TREE_WIDTH * 4
    rows = nodes.select("node", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("sig", t * width + 1, width))).alias("tree", "key"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by_range = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    both = cut(_walk(by_range, depth, reach, share), "walk")
    # at most 2 * (reach + 1) end rows for each range: few, however many documents there are
    ends = both.where("tree IS NOT NULL").select("tree", "key", "node", "n").distinct().repartition(1).sortWithinPartitions("tree", "key", "node")
    stitched = cut(_walk(ends, depth, reach, share), "ends")
    pairs = both.where("a IS NOT NULL").select("a", "b").union(stitched.where("a IS NOT NULL").select("a", "b")).distinct()
    crowds = both.where("region IS NOT NULL").select("region", "node").union(stitched.where("region IS NOT NULL").select("region", "node")).distinct()
    return pairs, crowds


# --- confirmation on full sets ----------------------------------------------------


def full_sets(keys: DataFrame, docs: DataFrame, *, doc_id: str, text: str, size: int) -> DataFrame:
    """node, s (the sorted shingles) of the documents (source id and text hash) in ``keys``; one row for each node."""
    kind = docs.schema[doc_id].dataType
    wanted = keys.select(F.col("source.doc_id").cast(kind).alias("k"), F.col("source.tk").alias("tk"), "node")
    if wanted.limit(_BROADCAST_KEYS + 1).count() <= _BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    own = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text"))
    source = own.join(wanted, own["d"].eqNullSafe(wanted["k"]) & (F.xxhash64("text") == wanted["tk"])).select("node", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                raw = [s.tobytes() for s in shingles.sets(*utf8(part.column("text")), size)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(raw, pa.binary())], ["node", "s"])

    # rows that repeat a document give its set once
    return source.mapInArrow(run, "node long, s binary").groupBy("node").agg(F.any_value("s").alias("s"))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, *, share: tuple[int, int], **columns) -> DataFrame:
    """Links (a, b) among the candidate pairs, by their full sets, as stars of each cell.

    A node is named by the smallest of its candidates; an edge lies in the cell of
    the names of its ends. A name has at most 2 * trees * reach bearers, so that a
    cell is bounded, and each set travels about once.
    """
    num, den = share
    ends = pairs.select(F.col("a").alias("node"), "b").union(pairs.select(F.col("b").alias("node"), F.col("a").alias("b")))
    names = ends.groupBy("node").agg(F.least(F.min("b"), F.col("node")).alias("name"))
    left = names.select(F.col("node").alias("a"), F.col("name").alias("x"))
    right = names.select(F.col("node").alias("b"), F.col("name").alias("y"))
    placed = cut(pairs.join(left, "a").join(right, "b").select("a", "b", F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2")), "cells")
    seats = placed.select(F.col("a").alias("node"), "c1", "c2").union(placed.select(F.col("b").alias("node"), "c1", "c2")).distinct()
    full = full_sets(nodes.join(seats.select("node").distinct(), "node", "left_semi"), docs, **columns)
    members = full.join(seats, "node").select("c1", "c2", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "s")
    edges = placed.select("c1", "c2", "a", "b", F.lit(None).cast("binary").alias("s"))

    def check(cell: pa.Table) -> pa.Table:
        own: dict[int, np.ndarray] = {}
        todo = []
        for a, b, s in zip(cell.column("a").to_pylist(), cell.column("b").to_pylist(), cell.column("s"), strict=True):
            if b is None:
                own[a] = np.frombuffer(s.as_buffer(), np.uint64)
            else:
                todo.append((a, b))
        class_ = Classes(own)
        for a, b in sorted(todo):
            if class_.find(a) != class_.find(b) and _linked(own[a], own[b], num, den):  # one class needs no more links
                class_.join(a, b)
        star = [(k, class_.find(k)) for k in own if class_.find(k) != k]
        return pa.table({"a": pa.array([k for k, _ in star], pa.int64()), "b": pa.array([r for _, r in star], pa.int64())})

    return members.unionByName(edges).groupBy("c1", "c2").applyInArrow(check, "a long, b long")


class Classes:
    """Classes of the few nodes of one cell or block pair."""

    def __init__(self, nodes) -> None:
        self.up = {k: k for k in nodes}

    def find(self, k):
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a, b) -> bool:
        x, y = self.find(a), self.find(b)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _linked(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    """intersection / union >= num / den, in integers."""
    if not len(s) or not len(t) or den * min(len(s), len(t)) < num * max(len(s), len(t)):
        return False
    at = np.searchsorted(s, t)
    both = int((s[np.minimum(at, len(s) - 1)] == t).sum())
    return den * both >= num * (len(s) + len(t) - both)


# --- crowded zones ------------------------------------------------------------------


def zones(crowds: DataFrame) -> DataFrame:
    """(node, zone): regions that share nodes are one zone."""
    own = cut(crowds.groupBy("node").agg(F.array_sort(F.collect_set(F.xxhash64("region"))).alias("r")), "regions")  # a node is in one region of each tree at most
    edges = own.select(F.col("r")[0].alias("a"), F.explode("r").alias("b")).distinct()
    named = components(edges)
    return own.select("node", F.col("r")[0].alias("region")).join(named, F.col("region") == named["node"], "left").select(own["node"], F.coalesce("label", "region").alias("zone"))


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``, from the lists of the sets that hold a shingle.

    Shingles in few sets add one to each of their pairs; frequent ones are
    columns of a product of two matrices of zeros and ones.
    """
    out = np.zeros((len(a), len(b)), np.float32)
    tokens, sides = [], []
    for sets in (a, b):
        t = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(t, kind="stable")
        tokens.append(t[order])
        sides.append(who[order])
    shared = np.intersect1d(*(np.unique(t) for t in tokens), assume_unique=True)
    first = [np.searchsorted(t, shared, side="left") for t in tokens]
    count = [np.searchsorted(t, shared, side="right") - f for t, f in zip(tokens, first, strict=True)]
    product = count[0] * count[1]
    rare = np.flatnonzero(product <= 256)
    for lo in range(0, len(rare), 4096):
        own = rare[lo : lo + 4096]
        k = product[own]
        which = np.repeat(own, k)
        at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        i = sides[0][first[0][which] + at // count[1][which]]
        j = sides[1][first[1][which] + at % count[1][which]]
        np.add.at(out, (i, j), 1)
    dense = np.flatnonzero(product > 256)
    for lo in range(0, len(dense), 1024):
        own = dense[lo : lo + 1024]
        cols = []
        for sets, side, f, c in zip((a, b), sides, first, count, strict=True):
            m = np.zeros((len(sets), len(own)), np.float32)
            n = c[own]
            at = np.repeat(f[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            m[side[at], np.repeat(np.arange(len(own)), n)] = 1
            cols.append(m)
        out += cols[0] @ cols[1].T
    return out.astype(np.int64)


def linked_pairs(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Linked pairs of sets with unlike labels, one of ``left`` and one of ``right`` (places in ``sets``); one block with itself if they are equal.

    The table of counts is filled in tiles: memory follows their size and not that of the blocks.
    """
    size = np.array([len(s) for s in sets])
    alone = np.array_equal(left, right)
    for x in range(0, len(left), _TILE):
        one = left[x : x + _TILE]
        for y in range(x if alone else 0, len(right), _TILE):
            two = right[y : y + _TILE]
            unlike = label[one][:, None] != label[two][None]
            if not unlike.any():
                continue
            both = common_counts([sets[i] for i in one], [sets[j] for j in two])
            for i, j in zip(*np.nonzero(unlike & (den * both >= num * (size[one][:, None] + size[two][None] - both))), strict=True):
                yield int(one[i]), int(two[j])


def crowded(zoned: DataFrame, nodes: DataFrame, docs: DataFrame, *, share: tuple[int, int], **columns) -> DataFrame:
    """Links (a, b) between the classes of each zone of ``zoned`` (node, n, zone, label); all pairs of classes are covered."""
    num, den = share
    # a large class has blocks of its own, so that it is never compared with itself; other nodes lie by size
    of = zoned.groupBy("zone", "label").agg(F.sum("n").alias("all"))
    sized = zoned.join(cut(of, "sums"), ["zone", "label"]).withColumn("part", F.when(F.col("all") >= _BLOCK, F.col("label")).otherwise(-1 - F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)))))
    parts = sized.groupBy("zone", "part").agg(F.ceil(F.sum(F.greatest("n", F.lit(_LEAST))) / F.lit(_BLOCK)).alias("k"))
    placed = cut(sized.join(cut(parts, "parts"), ["zone", "part"]).select("zone", "node", "n", "label", F.xxhash64("part", F.pmod(F.xxhash64("node"), F.col("k"))).alias("block")), "zones")
    blocks = placed.groupBy("zone", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("l"), F.max("label").alias("h"))
    one, two = (blocks.select("zone", *[F.col(c).alias(f"{c}{k}") for c in ("block", "lo", "hi", "l", "h")]) for k in (1, 2))
    met = one.join(two, "zone").where("block1 <= block2").where("NOT (l1 = h1 AND l2 = h2 AND l1 = l2)").where(f"{den} * hi1 >= {num} * lo2 AND {den} * hi2 >= {num} * lo1")
    sides = F.when(F.col("block1") == F.col("block2"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    halves = met.select("zone", "block1", "block2", F.explode(sides).alias("side")).withColumn("block", F.when(F.col("side") == 1, F.col("block2")).otherwise(F.col("block1")))
    seats = placed.join(halves, ["zone", "block"]).select("zone", "block1", "block2", "side", "node", "label")
    full = full_sets(nodes.join(placed.select("node").distinct(), "node", "left_semi"), docs, **columns)

    def check(pair: pa.Table) -> pa.Table:
        side = np.array(pair.column("side").to_pylist())
        ids, labels = pair.column("node").to_pylist(), pair.column("label").to_pylist()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in pair.column("s")]
        left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
        class_, out = Classes(labels), []
        if len(left) and len(right):
            number = {x: k for k, x in enumerate(dict.fromkeys(labels))}
            label = np.array([number[x] for x in labels])
            for a, b in linked_pairs(sets, label, left, right, num, den):
                if class_.join(labels[a], labels[b]):
                    out.append((ids[a], ids[b]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return full.join(seats, "node").select("zone", "block1", "block2", "side", "node", "label", "s").groupBy("zone", "block1", "block2").applyInArrow(check, "a long, b long")


# --- classes ------------------------------------------------------------------------


def _classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, share: tuple[int, int] = (4, 5),
             trees: int = 32, depth: int = 4, reach: int = 4) -> DataFrame:
    """doc_id, tk, n, class (null: no words), component_id for each row of ``docs``."""
    columns = {"doc_id": doc_id, "text": text, "size": size}
    prints = cut(fingerprints(docs, trees=trees, **columns), "prints")
    some = prints.where("n > 0")
    one = some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("name"), F.min(F.struct("doc_id", "tk")).alias("source"), F.any_value("sig").alias("sig"))
    nodes = cut(one.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers hold once they are written
    pairs, crowds = forest(nodes.select("node", "n", "sig"), trees=trees, depth=depth, reach=reach, share=share)
    links = cut(confirmed(cut(pairs, "candidates"), nodes, docs, share=share, **columns), "links")
    labels = components(links)
    zoned = zones(crowds).join(labels, "node", "left").select("node", "zone", F.coalesce("label", "node").alias("label"))
    zoned = cut(zoned.join(nodes.select("node", "n"), "node"), "zoned")
    open_ = zoned.groupBy("zone").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("zone")
    zoned = zoned.join(open_, "zone", "left_semi")
    if not zoned.isEmpty():
        labels = components(cut(links.union(crowded(zoned, nodes, docs, share=share, **columns)), "links"))
    each = nodes.select("h1", "h2", "n", "node", "name").join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    names = each.groupBy("class").agg(F.min("name").alias("component_id"))
    named = each.join(names, "class").select("h1", "h2", "n", "class", "component_id")
    out = some.select("doc_id", "tk", "h1", "h2", "n").join(named, ["h1", "h2", "n"]).select("doc_id", "tk", "n", "class", "component_id")
    return out.unionByName(prints.where("n = 0").select("doc_id", "tk", "n", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id")))


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    return _classes(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (ties: by a hash of the text, then of the whole row).

    Documents without words stay, all of them.
    """
    rows = cut(_classes(docs, doc_id=doc_id, text=text, **options).where("class IS NOT NULL").select("doc_id", "tk", "class", "component_id"), "classes")
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    lead = cut(rows.where(named).groupBy("class", "doc_id", "tk").agg(F.count("*").alias("copies")), "lead")  # mostly one for each class
    best = lead.groupBy("class").agg(F.min("tk").alias("t"))
    marked = cut(lead.join(best, "class").select("doc_id", "tk", "copies", (F.col("tk") == F.col("t")).alias("stays")), "marked")
    d, k = fresh(docs, "_d"), fresh(docs, "_k")
    gone = rows.where(~named).select("doc_id", "tk").union(marked.where("NOT stays").select("doc_id", "tk")).distinct().select(F.col("doc_id").alias(d), F.col("tk").alias(k))
    out = docs.join(gone, docs[doc_id].eqNullSafe(gone[d]) & (F.xxhash64(docs[text]) == gone[k]), "left_anti")
    several = marked.where("stays AND copies > 1").select(F.col("doc_id").alias(d), F.col("tk").alias(k))
    if several.isEmpty():
        return out
    same = out[doc_id].eqNullSafe(several[d]) & (F.xxhash64(out[text]) == several[k])
    row = F.struct(*[F.col(c) for c in docs.columns])
    again = out.join(several, same, "left_semi").groupBy(F.col(doc_id).alias(d), F.xxhash64(text).alias(k)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("r"))
    return out.join(several, same, "left_anti").unionByName(again.select("r.*"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: 2-word shingles, similarity of at least 0.8."""
    return classes(table(spark, sf_dir, "documents"), size=2)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
f AS (SELECT s, count(*) AS c FROM g GROUP BY 1),
r AS (SELECT g.doc_id, g.s, n.n, row_number() OVER (PARTITION BY g.doc_id ORDER BY f.c, g.s) AS k FROM g JOIN f USING (s) JOIN n USING (doc_id)),
p AS (SELECT doc_id, s, n FROM r WHERE k <= n - ceil(n * 0.8) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
i AS (SELECT c.a, c.b, c.na, c.nb, count(*) AS m FROM c JOIN g x ON x.doc_id = c.a JOIN g y ON y.doc_id = c.b AND y.s = x.s GROUP BY ALL),
e AS (SELECT a, b FROM i WHERE 100 * m >= 80 * (na + nb - m) UNION SELECT b, a FROM i WHERE 100 * m >= 80 * (na + nb - m)),
reach AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT e.b, reach.label FROM reach JOIN e ON e.a = reach.node WHERE reach.label < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.label) AS component_id, min(reach.label) = d.doc_id AS kept
FROM documents d JOIN reach ON reach.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
