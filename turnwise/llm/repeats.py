"""Removal of repeated byte strings by a hash-compared suffix sort (operator 2).

A string of ``LENGTH`` bytes is removed where it also starts earlier (smaller
document, or same document and earlier start). Sending each position of the
corpus through a shuffle is out of the question, so that positions are first
thinned without loss:

1. The anchor of a string is its smallest hashed ``_GRAM``-byte substring (the
   leftmost). It depends on the string alone, so that equal strings have equal
   anchors. Consecutive starts with one anchor form a run; about one run for 35
   bytes. Documents lie in blocks of bounded size; each block sends one packed
   row of its distinct anchors, their context hash and first place to each
   bucket of anchors, and gets one byte for each back: the anchor is unique;
   all its contexts are equal and the first is here, or elsewhere; or it has
   several contexts. The first three settle whole runs.
2. Runs with several contexts are asked again in parts of ``_PART`` starts, by
   the bytes that all strings of a part have in common (93 of 100). What is near
   an edit is unique by then, what is far from it is settled.
3. The strings of the parts that are left are the candidate suffixes. Each block
   sorts them by ``suffix_order``: a stable mergesort on eight bytes at a time,
   whose ties skip their common extension, found by binary search over prefix
   polynomial hashes, so that comparing two suffixes takes a logarithmic number
   of steps. Equal neighbours are verified byte by byte; a collision is resolved
   on the bytes. The first of each set of equal strings in a block is sent, as
   two independent 64-bit hashes (128 bits) and its place, to a bucket, which
   answers with one bit: there is an earlier one in another block.

What a bucket gets of one anchor or string is one entry for each block,
however often it occurs, so that no passage makes a task hot. The text is
shuffled once (by block) and that exchange is reused by the four passes.

Defined results: null counts as the empty text; texts under ``LENGTH`` bytes lose
nothing; rows that share id and text are one document and get equal rows; rows
that share an id but not the text are told apart by block and text; a null
id comes after all others. Ids are integers; further columns are ignored; an empty
table gives no rows. A document lies in one block and is held whole by its task,
while its hashes are made in slices of 1 MB, so that the longest document, and not
the number of copies, bounds what a block needs.

Steps 1 and 2 decide by hashes (64 bits of the anchor and 64 bits of the context);
only strings that reach step 3 are verified on their bytes, or by two independent
hashes between blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import utf8
from turnwise.llm.shingles import mix, prefix_hash, range_hash
from turnwise.session import table

LENGTH, _GRAM, _PART = 100, 32, 8
_SECOND_BASE = 0xC2B2AE3D27D4EB4F
_SLICE = 1 << 20
_LOW24 = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def byte_keys(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as a big-endian number (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    x = padded[: len(data)].astype(np.uint64)
    for k in range(1, 8):
        x = (x << np.uint64(8)) | padded[k : k + len(data)]
    return x


def common_extension(total: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes (up to ``most``) the suffixes at ``a`` and ``b`` share, by binary search."""
    lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) >> 1
        same = (total[a + mid] - total[a]) * down[a] == (total[b + mid] - total[b]) * down[b]
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int, total: np.ndarray, down: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``starts`` by their ``length`` bytes, class of equal strings in that order).

    Ties of the mergesort are compared with the first of their group: the common
    extension tells how many bytes to skip and on which side of the first a
    suffix lies, and the eight bytes after it are the next key.
    """
    n = len(starts)
    order = np.argsort(keys[starts], kind="stable")
    group = np.concatenate(([0], np.cumsum(keys[starts[order]][1:] != keys[starts[order]][:-1]))) if n else np.zeros(0, np.int64)
    settled = np.zeros(n, bool)
    skip = np.full(n, min(8, length), np.int64)
    while n:
        size = np.bincount(group)
        live = np.flatnonzero(~settled & (size[group] > 1))
        if not len(live):
            break
        first = np.zeros(len(size), np.int64)
        firsts = np.concatenate(([True], group[live][1:] != group[live][:-1]))
        first[group[live][firsts]] = live[firsts]
        head = first[group[live]]
        a, b = starts[order[live]], starts[order[head]]
        reach = skip[live] + common_extension(total, down, a + skip[live], b + skip[live], length - skip[live])
        equal = reach >= length
        for o in range(0, length - 7, 8):  # verification on the bytes
            equal &= keys[a + o] == keys[b + o]
        if length > 8:
            equal &= keys[a + length - 8] == keys[b + length - 8]
        for i in np.flatnonzero((reach >= length) & ~equal):  # a collision: the bytes decide
            x, y = data[a[i] : a[i] + length], data[b[i] : b[i] + length]
            reach[i] = int((x != y).argmax()) if (x != y).any() else length
        reach = np.where(equal, length, np.minimum(reach, length - 1))
        at_a, at_b = data[np.minimum(a + reach, len(data) - 1)], data[np.minimum(b + reach, len(data) - 1)]
        side = np.where(equal, 0, np.where(at_a < at_b, -1, 1))
        near = np.where(side < 0, reach, -reach)
        over = (8 * np.clip(8 - (length - reach), 0, 8)).astype(np.uint64)  # bits after the end of the strings
        key = np.where(equal, np.uint64(0), keys[np.minimum(a + reach, len(data) - 1)] >> np.minimum(over, np.uint64(56)))
        by = np.lexsort((key, near, side, group[live]))
        order[live] = order[live][by]
        settled[live] = equal[by]
        skip[live] = np.minimum(reach[by] + 8, length)
        parts = [x[by] for x in (group[live], side, near, key)]
        change = np.concatenate(([False], np.any([p[1:] != p[:-1] for p in parts], axis=0)))
        mark = np.zeros(n, bool)
        mark[live] = change
        mark[1:] |= group[1:] != group[:-1]
        group = np.cumsum(mark)  # groups only ever split
        late = live[(skip[live] >= length) & ~settled[live]]
        settled[late] = True  # all bytes compared by keys
    return order, group


class Slice:
    """Some documents of a block (or a part of a long one) with their hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, doc: np.ndarray, base: np.ndarray) -> None:
        self.data, self.off, self.doc, self.base = data, off, doc, base
        self.total, self.down = prefix_hash(data)
        n = len(data)
        self.first = self.count = self.at = np.zeros(0, np.int64)
        self.anchor = self.context = np.zeros(0, np.uint64)
        self.piece = np.zeros(0, np.int64)
        if n < LENGTH:
            return
        gram = mix((self.total[_GRAM:] - self.total[: n - _GRAM + 1]) * self.down[: n - _GRAM + 1])
        # leftmost minimum: 40 bits of hash, then the position
        ranked = sliding_min((gram & ~_LOW24) | np.arange(len(gram), dtype=np.uint64), LENGTH - _GRAM + 1)
        at = (ranked & _LOW24).astype(np.int64)
        # the starts of whole strings, document by document, and where runs begin
        number = np.maximum(np.diff(off) - LENGTH + 1, 0)
        shift = off[:-1] - (np.cumsum(number) - number)
        starts = np.arange(int(number.sum())) + np.repeat(shift, number)
        if not len(starts):
            return
        at = at[starts]
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1], out=new[1:])
        new[(np.cumsum(number) - number)[number > 0]] = True
        head = np.flatnonzero(new)
        self.first = starts[head]
        self.count = np.diff(np.append(head, len(at)))
        self.piece = np.searchsorted(off, self.first, side="right") - 1
        self.at = at[head]
        self.anchor = gram[self.at]
        self.context = self.contexts(self.first, self.count, self.at)

    def contexts(self, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of all bytes of consecutive strings and of where their anchor lies."""
        return mix(range_hash(self.total, self.down, first, first + count + LENGTH - 1) + mix(((at - first) * 256 + count).astype(np.uint64)))

    def split(self, runs: np.ndarray):
        """Runs in parts of up to ``_PART`` starts: (first, count, piece, core hash, context).

        Parts are aligned to the anchor. All strings of a part hold its core, so
        that a string that also occurs elsewhere has its core there as well.
        """
        first, at, piece = self.first[runs], self.at[runs], self.piece[runs]
        last = first + self.count[runs] - 1
        high = (at - first) // _PART
        n = high - (at - last) // _PART + 1
        j = np.repeat(high, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        first, last, at, piece = (np.repeat(x, n) for x in (first, last, at, piece))
        f, t = np.maximum(first, at - _PART * j - _PART + 1), np.minimum(last, at - _PART * j)
        core = at - _PART * j
        key = mix(range_hash(self.total, self.down, core, core + LENGTH - _PART + 1) + mix(j.astype(np.uint64)))
        return f, t - f + 1, piece, key, self.contexts(f, t - f + 1, at)

    def places(self, start: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row in the block, byte position in the document)."""
        return self.doc[piece], start - self.off[piece] + self.base[piece]

class Block:
    """The distinct documents of a block, in one fixed order."""

    def __init__(self, rows: pa.Table) -> None:
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text")
        data, off = utf8(texts)
        several = len(set(ids)) < len(ids)
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, data[off[i] : off[i + 1]].tobytes() if several else b""))
        self.ids, self.texts, self.copies = [], [], []
        for i in order:
            t = data[off[i] : off[i + 1]]
            if self.ids and self.ids[-1] == ids[i] and len(self.texts[-1]) == len(t) and (self.texts[-1] == t).all():
                self.copies[-1] += 1
            else:
                self.ids.append(ids[i])
                self.texts.append(t)
                self.copies.append(1)
        self.key = np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)
        self.slices = list(self._cut())

    def _cut(self):
        pieces, size = [], 0
        for d, t in enumerate(self.texts):
            for a in range(0, max(1, len(t) - LENGTH + 1), _SLICE):
                part = t[a : a + _SLICE + LENGTH - 1]
                if pieces and size + len(part) > _SLICE:
                    yield self._slice(pieces)
                    pieces, size = [], 0
                pieces.append((part, d, a))
                size += len(part)
        if pieces:
            yield self._slice(pieces)

    @staticmethod
    def _slice(pieces) -> Slice:
        off = np.concatenate(([0], np.cumsum([len(p) for p, _, _ in pieces]))).astype(np.int64)
        return Slice(np.concatenate([p for p, _, _ in pieces]), off, np.array([d for _, d, _ in pieces]), np.array([a for _, _, a in pieces]))


def _firsts(keys: tuple[np.ndarray, ...], row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, row, pos; start of each set of equal keys in that order)."""
    order = np.lexsort((pos, row, *keys[::-1]))
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(change)


_ANCHOR = np.dtype([("a", "<u8"), ("c", "<u8"), ("id", "<i8"), ("pos", "<u4"), ("flag", "u1")])
_STRING = np.dtype([("h", "<u8"), ("g", "<u8"), ("id", "<i8"), ("pos", "<u4")])


def _packed(x: np.ndarray) -> bytes:
    """Columns one after the other (they compress better than records)."""
    return b"".join(np.ascontiguousarray(x[n]).tobytes() for n in x.dtype.names)


def _unpacked(raw: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(raw) // dtype.itemsize
    out, at = np.empty(n, dtype), 0
    for name in dtype.names:
        size = n * dtype[name].itemsize
        out[name] = np.frombuffer(raw, dtype[name], n, at)
        at += size
    return out


def _rows(kind: str, to: list[int], block: list[int], blob: list[bytes]) -> pa.Table:
    return pa.table({"kind": pa.array([kind] * len(to)), "to": pa.array(to, pa.int64()), "src": pa.array(block, pa.int64()), "blob": pa.array(blob, pa.binary())})


_SPEC = "kind string, to long, src long, blob binary"


def _distinct(block: Block, parts: list[tuple[np.ndarray, ...]]):
    """Entries of distinct keys; the entry of each part; whether a part is its first.

    ``parts``: (key, context, row, position) of each slice, in the order of the block.
    """
    key, context, row, pos = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    order = np.argsort(key, kind="stable")  # parts are in order of row and position
    ordered = key[order]
    change = np.ones(len(order), bool)
    change[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(change)
    own = np.zeros(len(first), _ANCHOR)
    lead = order[first]
    own["a"], own["c"], own["id"], own["pos"] = key[lead], context[lead], block.key[row[lead]], pos[lead]
    n = np.diff(np.append(first, len(order)))
    if len(first):
        several = np.maximum.reduceat(context[order], first) != np.minimum.reduceat(context[order], first)
        own["flag"] = (n > 1) + 2 * several
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(first)), n)
    is_first = np.zeros(len(order), bool)
    is_first[lead] = True
    return own, which, is_first


def _runs(block: Block):
    return _distinct(block, [(s.anchor, s.context, *s.places(s.first, s.piece)) for s in block.slices])


class Parts:
    """The parts of the runs with several contexts, by slice."""

    def __init__(self, block: Block, several: np.ndarray) -> None:
        self.of, at, parts = [], 0, []
        for s in block.slices:
            first, count, piece, key, context = s.split(np.flatnonzero(several[at : at + len(s.first)]))
            at += len(s.first)
            self.of.append((s, first, count, piece))
            parts.append((key, context, *s.places(first, piece)))
        self.distinct = _distinct(block, parts)


def _statuses(distinct, replies: pa.Table, kind: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(has several contexts, is a repeat) of each part, from the answers of the buckets."""
    own, which, is_first = distinct
    status = np.zeros(len(own), np.uint8)
    got = _blobs(replies, kind)
    for k, i in _deal(own, "a", buckets):
        status[i] = np.frombuffer(got[k], np.uint8)
    each = status[which]
    return each == 3, (each == 2) | ((each == 1) & ~is_first)


def _blobs(replies: pa.Table, kind: str) -> dict[int, bytes]:
    own = replies.filter(pc.equal(replies.column("kind"), kind))
    return dict(zip(own.column("src").to_pylist(), own.column("blob").to_pylist(), strict=True))


def _deal(x: np.ndarray, key: str, buckets: int):
    """(bucket, positions) of packed entries, in a fixed order."""
    b = (x[key] >> np.uint64(8)) % np.uint64(buckets)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(buckets + 1).astype(np.uint64))
    return [(k, order[cut[k] : cut[k + 1]]) for k in range(buckets) if cut[k + 1] > cut[k]]


def _merge(rows: pa.Table, dtype: np.dtype, names: tuple[str, ...]):
    """Entries of all blocks in order of key, id, block and place; where they came from."""
    blobs = [_unpacked(b, dtype) for b in rows.column("blob").to_pylist()]
    src = np.array(rows.column("src").to_pylist(), np.int64)
    lengths = [len(b) for b in blobs]
    all_ = np.concatenate(blobs) if blobs else np.zeros(0, dtype)
    order = np.lexsort((all_["pos"], np.repeat(src, lengths), all_["id"], *[all_[n] for n in names[::-1]]))
    s = all_[order]
    change = np.zeros(len(order), bool)
    change[:1] = True
    for n in names:
        change[1:] |= s[n][1:] != s[n][:-1]
    return s, order, np.flatnonzero(change), src, lengths


def _suffixes(block: Block, parts: Parts, several: np.ndarray):
    """Strings of the parts with several contexts: distinct ones, and all places.

    Returns entries of distinct strings; the entry of each place; (rows,
    positions); whether a place is the first of its string in the block.
    """
    at, sets, members, seen = 0, [], [], 0
    for s, first, count, piece in parts.of:
        own = np.flatnonzero(several[at : at + len(first)])
        at += len(first)
        if not len(own):
            continue
        c = count[own]
        start = np.repeat(first[own], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        order, group = suffix_order(s.data, start, LENGTH, s.total, s.down, byte_keys(s.data))
        second, down = prefix_hash(s.data, _SECOND_BASE)
        row, pos = s.places(start, np.repeat(piece[own], c))
        order = order[np.lexsort((pos[order], row[order], group))]  # the first place of each set leads
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        lead = start[order[head]]
        found = np.zeros(len(head), _STRING)
        found["h"] = mix(range_hash(s.total, s.down, lead, lead + LENGTH))
        found["g"] = mix(range_hash(second, down, lead, lead + LENGTH))
        found["id"], found["pos"] = row[order[head]], pos[order[head]]
        leads = np.zeros(len(order), bool)
        leads[head] = True
        members.append((seen + group, row[order], pos[order], leads))
        sets.append(found)
        seen += len(found)
    if not sets:
        return np.zeros(0, _STRING), np.zeros(0, np.int64), np.zeros((2, 0), np.int64), np.zeros(0, bool)
    all_ = np.concatenate(sets)
    which, row, pos, leads = (np.concatenate(x) for x in zip(*members, strict=True))
    order, first = _firsts((all_["h"], all_["g"]), all_["id"], all_["pos"])
    to = np.empty(len(order), np.int64)
    to[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    one = np.zeros(len(order), bool)
    one[order[first]] = True
    own = all_[order[first]]
    own["id"] = block.key[own["id"]]
    return own, to[which], np.stack([row, pos]), leads & one[which]


def _removed(block: Block, replies: pa.Table, buckets: int) -> list[np.ndarray]:
    """For each document +1 and -1 where removed strings begin and end."""
    edge = [np.zeros(len(t) + 1, np.int32) for t in block.texts]

    def mark(row: np.ndarray, pos: np.ndarray, count: np.ndarray) -> None:
        if not len(row):
            return
        by = np.argsort(row, kind="stable")
        row, pos, count = row[by], pos[by], count[by]
        cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        for a, b in zip(cuts, [*cuts[1:], len(row)], strict=True):
            np.add.at(edge[row[a]], pos[a:b], 1)
            np.add.at(edge[row[a]], pos[a:b] + count[a:b] - 1 + LENGTH, -1)

    several, gone = _statuses(_runs(block), replies, "runs!", buckets)
    parts, at = Parts(block, several), 0
    for s in block.slices:
        own = np.flatnonzero(gone[at : at + len(s.first)])
        at += len(s.first)
        mark(*s.places(s.first[own], s.piece[own]), s.count[own])
    several, gone = _statuses(parts.distinct, replies, "parts!", buckets)
    at = 0
    for s, first, count, piece in parts.of:
        own = np.flatnonzero(gone[at : at + len(first)])
        at += len(first)
        mark(*s.places(first[own], piece[own]), count[own])
    own, which, place, leads = _suffixes(block, parts, several)
    late, got = np.zeros(len(own), bool), _blobs(replies, "strings!")
    for k, i in _deal(own, "h", buckets):
        late[i] = np.unpackbits(np.frombuffer(got[k], np.uint8), count=len(i)).astype(bool)
    row, pos = place[:, late[which] | ~leads]
    mark(row, pos, np.ones(len(row), np.int64))
    return edge


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the maximal removed runs, kept (binary)."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    room = block_bytes or min(max(4 << 20, size // 512), 32 << 20)
    blocks = max(1, math.ceil(size / room))
    placed = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def sent(kind: str, own: np.ndarray, key: str, here: int) -> pa.Table:
        dealt = _deal(own, key, blocks)
        return _rows(kind, [k for k, _ in dealt], [here] * len(dealt), [_packed(own[i]) for _, i in dealt])

    def passed_on(replies: pa.Table, here: int) -> pa.Table:
        """Answers that the block needs again in a later pass."""
        return replies.select(["kind", "block", "src", "blob"]).rename_columns(["kind", "to", "src", "blob"])

    def ask_runs(rows: pa.Table) -> pa.Table:
        return sent("runs", _runs(Block(rows))[0], "a", rows.column("block")[0].as_py())

    def ask_parts(key, rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows("parts", [], [], [])
        block, here = Block(rows), rows.column("block")[0].as_py()
        several, _ = _statuses(_runs(block), replies, "runs!", blocks)
        return pa.concat_tables([sent("parts", Parts(block, several).distinct[0], "a", here), passed_on(replies, here)])

    def ask_strings(key, rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows("strings", [], [], [])
        block, here = Block(rows), rows.column("block")[0].as_py()
        parts = Parts(block, _statuses(_runs(block), replies, "runs!", blocks)[0])
        several, _ = _statuses(parts.distinct, replies, "parts!", blocks)
        return pa.concat_tables([sent("strings", _suffixes(block, parts, several)[0], "h", here), passed_on(replies, here)])

    def answer(rows: pa.Table) -> pa.Table:
        """For runs and parts: 1 first of equal contexts, 2 not the first, 3 several contexts, 0 unique.

        For strings one bit: there is an earlier one in another block. Answers on their way pass.
        """
        kind, here = rows.column("kind")[0].as_py(), rows.column("to")[0].as_py()
        if kind.endswith("!"):
            return rows.select(["kind", "to", "src", "blob"])
        one = kind == "strings"
        s, order, first, src, lengths = _merge(rows, _STRING, ("h", "g")) if one else _merge(rows, _ANCHOR, ("a",))
        n = np.diff(np.append(first, len(s)))
        lead = np.zeros(len(s), bool)
        lead[first] = True
        out = np.zeros(len(s), np.uint8)
        if one:
            out[order] = ~lead
        elif len(s):
            flag = np.maximum.reduceat(s["flag"], first)
            several = (np.maximum.reduceat(s["c"], first) != np.minimum.reduceat(s["c"], first)) | (flag >= 2)
            each = np.repeat(np.where(several, 3, np.where((n > 1) | (flag >= 1), 2, 0)), n)
            out[order] = np.where(lead & (each == 2), 1, each)
        ends = np.cumsum(lengths)
        cut = [out[e - k : e] for e, k in zip(ends, lengths, strict=True)]
        return _rows(kind + "!", src.tolist(), [here] * len(src), [np.packbits(x).tobytes() if one else x.tobytes() for x in cut])

    def remove(key, rows: pa.Table, replies: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"doc_id": [], "n_bytes": [], "starts": [], "ends": [], "kept": []}
        if rows.num_rows:
            block = Block(rows)
            edge = _removed(block, replies, blocks)
            for i, t, e, k in zip(block.ids, block.texts, edge, block.copies, strict=True):
                on = np.cumsum(e[:-1]) > 0
                step = np.diff(np.concatenate(([0], on.view(np.int8), [0])))
                out = (i, len(t), np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), t[~on].tobytes())
                for _ in range(k):
                    for c, v in zip(cols.values(), out, strict=True):
                        c.append(v)
        big = pa.list_(pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(cols.values(), (pa.int64(), pa.int64(), big, big, pa.binary()), strict=True)], names=list(cols))

    by_block = placed.groupBy("block")

    def answered(asked: DataFrame):
        return asked.groupBy("kind", "to").applyInArrow(answer, _SPEC).withColumnRenamed("to", "block").groupBy("block")

    runs = answered(by_block.applyInArrow(ask_runs, _SPEC))
    parts = answered(by_block.cogroup(runs).applyInArrow(ask_parts, _SPEC))
    strings = answered(by_block.cogroup(parts).applyInArrow(ask_strings, _SPEC))
    return by_block.cogroup(strings).applyInArrow(remove, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest over all documents."""
    found = repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS s
      FROM (SELECT doc_id, x, unnest(generate_series(0, len(x) // 2 - 100)) AS p FROM h WHERE len(x) >= 200)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w),
d AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS new FROM r WHERE k > 1),
g AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM d),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, g),
edges AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, len(x) // 2, len(x) // 2 FROM h),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS f, a AS t FROM edges),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM gaps JOIN h USING (doc_id) WHERE t > f GROUP BY 1),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT h.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
