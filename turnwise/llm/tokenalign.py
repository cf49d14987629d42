"""Cross-tokenizer alignment (operator 11).

Two tokenizers read the same bytes. Offsets at which tokens of both end cut the text into
groups; the tokens of a group are linked with each other. The steps:

1. ``mapInPandas`` reads whole texts in chunks of some millions of characters. Two pointers
   walk over the cumulative token ends of A and B and emit groups and links. Texts are
   cut before a blank that follows a visible character: no token of either side crosses
   there (checked on B's vocabulary, else texts stay whole), so that each distinct part of a
   chunk is walked once. Each document keeps its distinct links as numbers of a
   dictionary of its chunk; equal links are counted, never listed.
2. Spark counts in how many documents each id pair is linked: the dictionaries hold one row
   for each pair and chunk, so that a pair found everywhere has one row a chunk; maxima for
   each A and B id follow by window.
3. Counts and maxima are joined back to the dictionary rows, and each chunk meets its
   documents again (``cogroup``), in memory bounded by the chunk.

Defined results: null and empty texts, and texts whose tokens do not give back their bytes, have no
tokens (zeros and an empty group string); each row is a document of its own, ids repeated or null
or not; further columns are ignored; an empty table gives an empty one. Special tokens'
spellings are plain text. A text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import cut
from turnwise.llm.treebpe import byte_symbols
from turnwise.session import table

#: Characters of text in a chunk; parts encoded at once; parts kept in a worker.
CHUNK, _PARTS, _KEPT = 4_000_000, 20_000, 400_000

# Fixed value: the split of byte-level models.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Before a blank that follows a visible character and is not the last character.
_EDGE = re.compile(r"(?<=\S)(?= (?!\Z))")


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        spelt = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (spelt.get(i, "") for i in range(max(spelt) + 1))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size, self.b_size = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.name = [str(i) for i in range(max(len(self.a_bytes), len(pieces)))]
        self.parts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.ranked = self._by_rank(a_path)

    def _by_rank(self, path: str):
        """A faster encoder over the same file, where its ids rise in the order of its merges (then id and rank are one); else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"].get("".join(p)) for p in pairs]
        single = [i for t, i in model["vocab"].items() if len(t) == 1]
        plain = not spec["normalizer"] and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True}
        extras = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if None in made or made != sorted(set(made)) or len(single) != 256 or max(single) > min(made) or not plain or any(model.get(k) for k in extras):
            return None
        return tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in [*single, *made]}, special_tokens={})

    def split(self, text: str) -> list[str]:
        """Parts of blank + text that tokens do not cross, each with its leading blank."""
        return _EDGE.split(" " + text) if self.parts else [" " + text]

    def encode(self, parts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides for each part (which begins with a blank: B adds it by itself)."""
        a = [self.ranked.encode_ordinary(p) for p in parts] if self.ranked else [e.ids for e in self.a.encode_batch(parts, add_special_tokens=False)]
        return list(zip(a, self.b.encode([p[1:] for p in parts], num_threads=1), strict=True))


@lru_cache(maxsize=2)
def parts_of(a_path: str, b_path: str) -> Parts:
    """Loaded once in each Python worker, from paths that every node has."""
    return Parts(Tokenizers(a_path, b_path))


def walk(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> list[tuple[list[int], list[int]]]:
    """Groups of two token rows over the same bytes (none of them empty): two pointers over the cumulative ends."""
    out, i, j, from_a, from_b, at_a, at_b = [], 0, 0, 0, 0, a_size[a[0]], b_size[b[0]]
    while True:
        if at_a == at_b:
            i += 1
            j += 1
            out.append((a[from_a:i], b[from_b:j]))
            if i == len(a):
                return out
            from_a, from_b = i, j
            at_a += a_size[a[i]]
            at_b += b_size[b[j]]
        elif at_a < at_b:
            i += 1
            at_a += a_size[a[i]]
        else:
            j += 1
            at_b += b_size[b[j]]


class Parts:
    """Alignments of distinct parts, kept for all chunks of a worker until there are ``_KEPT`` of them."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.done, self.said = 0, []
        self.sums = np.zeros((0, 5), np.int64)
        self.keys = self.times = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)

    def align(self) -> None:
        """Walks the parts that are numbered, but not yet aligned."""
        new = list(self.number)[self.done :]
        sums, keys, times = [], [], []
        for at in range(0, len(new), _PARTS):
            some, k, n = new[at : at + _PARTS], [], []
            for p, (a, b) in zip(some, self.t.encode(some), strict=True):
                found = _part(self.t, p, a, b, k, n)
                sums.append(found[:5] if found else (-1, 0, 0, 0, 0))
                self.said.append(found[5] if found else "")
            keys.append(np.array(k, np.int64))
            times.append(np.array(n, np.int64))
        self.done = len(self.number)
        if new:
            self.sums = np.concatenate([self.sums, np.array(sums, np.int64)])
            self.keys, self.times = np.concatenate([self.keys, *keys]), np.concatenate([self.times, *times])
            self.start = np.concatenate([[0], np.cumsum(self.sums[:, 4])])


def _part(t: Tokenizers, part: str, a: list[int], b: list[int], keys: list[int], times: list[int]):
    """(n_a, n_b, groups, links, pairs, group string) of a part, its pairs put behind ``keys`` and ``times``; None if tokens do not give back its bytes."""
    raw = part.encode()
    if not b or b"".join([t.b_bytes[i] for i in b]) != raw or b"".join([t.a_bytes[i] for i in a]) != raw:
        return None
    groups, before, links, said, name = walk(a, b, t.a_size, t.b_size), len(keys), 0, [], t.name
    for x, y in groups:
        if len(x) == len(y) == 1:
            keys.append(x[0] << 32 | y[0])
            links += 1
            said.append(name[x[0]] + "|" + name[y[0]])
            continue
        n = len(x) * len(y)
        links += n
        said.append(",".join([name[i] for i in x]) + "|" + ",".join([name[i] for i in y]))
        if n <= 64:
            for p in x:
                high = p << 32
                keys += [high | q for q in y]
        else:
            times += [1] * (len(keys) - len(times))
            many = Counter(y).items()
            for p, k in Counter(x).items():
                keys += [p << 32 | q for q, _ in many]
                times += [k * m for _, m in many]
    times += [1] * (len(keys) - len(times))
    return len(a), len(b), len(groups), links, len(keys) - before, ";".join(said)


def _align_chunk(known: Parts, texts: list[str | None]):
    """For each text (n_a, n_b, groups, links, group string, pair numbers, times); and the keys of the chunk's pairs."""
    if known.done > _KEPT:
        known.clear()
    number, split = known.number, known.t.split
    rows = [np.array([number.setdefault(p, len(number)) for p in split(x)], np.int64) if x else None for x in texts]
    known.align()
    size, start, said, none = known.sums[:, 4], known.start, known.said, np.zeros(0, np.int64)
    out = []
    for row in rows:
        if row is None or (known.sums[row, 0] < 0).any():
            out.append([0, 0, 0, 0, "", none, none])
            continue
        ends = np.cumsum(size[row])
        where = np.repeat(start[row] - (ends - size[row]), size[row]) + np.arange(ends[-1])
        keys = known.keys[where]
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], known.times[where][order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out.append([*known.sums[row, :4].sum(0).tolist(), ";".join([said[p] for p in row.tolist()]), keys[first], np.add.reduceat(weight, first)])
    keys, at = np.unique(np.concatenate([r[5] for r in out] or [none]), return_inverse=True)
    ends = np.cumsum([len(r[5]) for r in out])
    for r, end in zip(out, ends.tolist(), strict=True):
        r[5] = at[end - len(r[5]) : end]
    return out, keys


def _chunks(frames, chunk: int):
    """(ids, texts) of about ``chunk`` characters, over the batches of a task."""
    ids, texts, size = [], [], 0
    for frame in frames:
        for i, x in zip(frame["doc_id"], frame["text"], strict=True):
            if texts and size + len(x or "") > chunk:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(x)
            size += len(x or "")
    if texts:
        yield ids, texts


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def _split_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)


def align(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;...``), links (array of a, b and how often they are linked)."""
    source = _source(docs, doc_id, text)

    def run(frames):
        known = parts_of(a_path, b_path)
        for ids, texts in _chunks(frames, chunk):
            found, keys = _align_chunk(known, texts)
            for at in range(0, len(ids), 64):
                some = found[at : at + 64]
                links = [[dict(zip(("a", "b", "n"), x, strict=True)) for x in zip(*[v.tolist() for v in _split_keys(keys[f[5]])], f[6].tolist(), strict=True)] for f in some]
                yield pd.DataFrame({"doc_id": pd.Series(ids[at : at + 64], dtype=object), **{c: [f[k] for f in some] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links", "groups"))}, "links": links})

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int,n:long>>")


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64) if n else np.zeros(0, np.int64)


def _first_pass(source: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    """Rows of documents (with packed links) and rows of the chunks' pair dictionaries (``a`` not null)."""

    def run(frames):
        known = parts_of(a_path, b_path)
        task = TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(_chunks(frames, chunk)):
            found, keys = _align_chunk(known, texts)
            held = np.zeros(len(keys), np.int64)
            for f in found:
                held[f[5]] += 1
            steps = [np.diff(f[5], prepend=0) for f in found]
            yield pd.DataFrame({
                "chunk": task | k, "doc_id": pd.Series(ids, dtype=object), **{c: [f[i] for f in found] for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                "groups_sha256": [hashlib.sha256(f[4].encode()).hexdigest() if f[0] else "" for f in found],
                "n_pairs": [len(s) for s in steps], "pairs": [_packed(s) for s in steps], "times": [_packed(f[6]) for f in found], "at": None, "a": None, "b": None, "docs": None,
            })
            for at in range(0, len(keys), 100_000):
                a, b = _split_keys(keys[at : at + 100_000])
                n = len(a)
                none = [None] * n
                yield pd.DataFrame({
                    "chunk": task | k, "doc_id": pd.Series(none, dtype=object), **{c: none for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pairs", "times")},
                    "at": np.arange(at, at + n, dtype=np.int32), "a": a, "b": b, "docs": held[at : at + n],
                })

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"chunk long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, pairs binary, times binary, at int, a int, b int, docs long")


def _counted(rows: DataFrame) -> DataFrame:
    """a, b, docs, best_a, best_b: documents that hold the pair, and whether no pair of its A (B) id has more."""
    counts = rows.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    top = lambda side: F.col("docs") == F.max("docs").over(Window.partitionBy(side))
    return counts.withColumn("best_a", top("a")).withColumn("best_b", top("b"))


def pair_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """a, b, docs, best_a, best_b of all linked id pairs: a token map from one vocabulary to the other."""
    return _counted(_first_pass(_source(docs, doc_id, text), a_path, b_path, chunk).where("a IS NOT NULL"))


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256.

    ``n_best`` (``n_best_b``): links whose pair no other pair of the A (B) id exceeds in documents;
    ``count_sum``: sum of those documents over the links.
    """
    first = cut(_first_pass(_source(docs, doc_id, text), a_path, b_path, chunk), "aligned")
    rows = first.where("a IS NOT NULL").select("chunk", "at", "a", "b", "docs")
    said = rows.drop("docs").join(_counted(rows), ["a", "b"]).select(F.col("chunk").alias("of"), "at", "docs", "best_a", "best_b")
    known = first.where("a IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pairs", "times")
    kind = known.schema["doc_id"].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        order = np.argsort(at)
        count, a, b = (right.column(c).to_numpy()[order].astype(np.int64) for c in ("docs", "best_a", "best_b"))
        found = []
        for n, pairs, times in zip(left.column("n_pairs").to_pylist(), left.column("pairs").to_pylist(), left.column("times").to_pylist(), strict=True):
            pair, weight = np.cumsum(_unpacked(pairs, n)), _unpacked(times, n)
            found.append([int((weight * v[pair]).sum()) if n else 0 for v in (a, b, count)])
        best_a, best_b, total = (pa.array(v, pa.int64()) for v in zip(*found, strict=True)) if found else (pa.array([], pa.int64()),) * 3
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(left.column(c) for c in names), best_a, best_b, total, left.column("groups_sha256")], [*names, "n_best", "n_best_b", "count_sum", "groups_sha256"])

    return known.groupBy("chunk").cogroup(said.groupBy("of")).applyInArrow(
        meet, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string"
    )


def default_paths() -> dict[str, str]:
    import public_tokenizers

    return {"a_path": public_tokenizers.path("byte_bpe_50k.json"), "b_path": public_tokenizers.path("piece_bpe_32k.model")}


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns over all documents."""
    return score(table(spark, sf_dir, "documents"), **default_paths())
