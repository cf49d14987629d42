"""BPE encoding and decoding by a segment tree over adjacent pairs (operator 13).

A word is a row of symbols. Leaf i of its segment tree holds the rank of the pair
(symbol i, next symbol) and i itself, inner nodes hold the minimum of their children, so
that the root is the leftmost pair of lowest rank. A merge rewrites one symbol and
changes three leaves (the pair itself, the one before it, the one that vanishes);
each change climbs to the root. This goes on until the root is empty.

Distinct words of a batch are merged side by side: words of similar length form
a forest, one numpy row each, and a round takes one merge from every word that
has one left. Words of more than ``_WIDE`` symbols get a tree of their own in plain Python, so
that a word of n bytes costs n log n in either form. Finished words are kept in
a cache of bounded size for each Python worker.

The model file is the JSON of the ``tokenizers`` library. Understood are models of this
kind: NFC, white space to one space, lower case; a split pattern whose matches are the
words; byte-level symbols; merges whose last symbol carries the word end. Anything else
raises. Decoding writes the tokens with single spaces between them, as the library
does for a file without a decoder.

Defined results: null counts as the empty text, which has no ids; special tokens
of the file are recognised inside texts, as the library does; repeated rows are
encoded one by one; further columns are ignored; an empty table gives an empty one.
No row is grouped, sorted or shuffled. A text is read in blocks cut before white space.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import fresh, slices
from turnwise.session import table

#: Longest word (in symbols) that is merged in a forest.
_WIDE = 64
#: Words merged at once, words kept in the cache, characters of a text read at once.
_FOREST, _CACHE, _BLOCK = 8_192, 400_000, 1_000_000
_NONE = np.iinfo(np.int64).max
_GAP = re.compile(r"[ \n\t]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Model:
    """Tables of one model file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [s["type"] for s in steps]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        split = steps[0]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or model["type"] != "BPE" or spec.get("decoder") or spec.get("post_processor") or not plain:
            raise ValueError(f"not a model of the documented kind: {path}")
        if split["behavior"] != "Removed" or not split["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            raise ValueError(f"not a split of the documented kind: {path}")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        signs = byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + end] for s in signs], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.pairs = {vocab[a] * self.size + vocab[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = np.array([vocab[a + b] for a, b in pairs] or [0], np.int64)
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.ranks = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        self.word = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.library = Tokenizer.from_file(path)
        self.byte = {c: b for b, c in enumerate(signs)}
        self.settled, self.odd = {chr(i) for i in range(128)}, set()
        self.cache: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` where the pair has no merge."""
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1) if len(self.keys) else np.zeros(len(want), np.int64)
        return np.where(self.keys[at] == want, self.ranks[at], _NONE) if len(self.keys) else np.full(len(want), _NONE)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """Loaded once in each Python worker, from a path that every node has."""
    return Model(path)


def _forest(m: Model, sym: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Merges the rows of ``sym`` (padded symbol ids; row i has ``size[i]`` of them) side by side."""
    n, wide = sym.shape
    shift = int(wide).bit_length()
    low = (1 << shift) - 1
    column = np.arange(wide)
    inside = column[None, :-1] + 1 < size[:, None]
    rank = np.full((n, wide), _NONE)
    rank[:, :-1][inside] = m.rank(sym[:, :-1][inside], sym[:, 1:][inside])
    tree = np.full((n, 2 * wide), _NONE)
    tree[:, wide:] = np.where(rank < _NONE, (rank << shift) | column, _NONE)
    for at in range(wide - 1, 0, -1):
        tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])
    after = np.where(column[None, :] + 1 < size[:, None], column[None, :] + 1, wide)  # ``wide``: none
    before = np.broadcast_to(column - 1, (n, wide)).copy()  # -1: none
    alive = column[None, :] < size[:, None]
    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        best = tree[rows, 1]
        left = best & low
        right = after[rows, left]
        sym[rows, left] = m.merged[best >> shift]
        alive[rows, right] = False
        following = after[rows, right]
        after[rows, left] = following
        has = following < wide
        before[rows[has], following[has]] = left[has]
        tree[rows, wide + right] = _NONE
        tree[rows, wide + left] = _NONE
        r = m.rank(sym[rows[has], left[has]], sym[rows[has], following[has]])
        tree[rows[has], wide + left[has]] = np.where(r < _NONE, (r << shift) | left[has], _NONE)
        prior = before[rows, left]
        had = prior >= 0
        r = m.rank(sym[rows[had], prior[had]], sym[rows[had], left[had]])
        tree[rows[had], wide + prior[had]] = np.where(r < _NONE, (r << shift) | prior[had], _NONE)
        climb = np.concatenate([right, left, prior[had]]) + wide
        of = np.concatenate([rows, rows, rows[had]])
        while climb[0] > 1:  # all leaves are equally deep
            climb = climb >> 1
            tree[of, climb] = np.minimum(tree[of, 2 * climb], tree[of, 2 * climb + 1])
        rows = rows[tree[rows, 1] < _NONE]
    flat, ends = sym[alive].astype("<u4").tobytes(), np.cumsum(alive.sum(1)).tolist()
    return [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _tree(m: Model, sym: list[int]) -> bytes:
    """One long word: the same tree in plain lists."""
    n = len(sym)
    wide = 1 << max(n - 1, 1).bit_length()
    none, pairs, merged = (m.merged.size, n), m.pairs, m.merged
    tree = [none] * (2 * wide)

    def leaf(i: int, j: int) -> tuple[int, int]:
        rank = pairs.get(sym[i] * m.size + sym[j])
        return none if rank is None else (rank, i)

    def climb(at: int) -> None:
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a <= b else b
            at >>= 1

    for i in range(n - 1):
        tree[wide + i] = leaf(i, i + 1)
    for at in range(wide - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != none:
        rank, i = tree[1]
        j = after[i]
        sym[i], sym[j] = int(merged[rank]), -1
        k = after[i] = after[j]
        tree[wide + j] = none
        climb(wide + j)
        tree[wide + i] = leaf(i, k) if k < n else none
        climb(wide + i)
        if k < n:
            before[k] = i
        if before[i] >= 0:
            tree[wide + before[i]] = leaf(before[i], i)
            climb(wide + before[i])
    return np.array([s for s in sym if s >= 0], "<u4").tobytes()


def merge_words(m: Model, words: list[str]) -> list[bytes]:
    """Ids of each word (not empty), as little-endian unsigned 32-bit integers."""
    raw = [w.encode() for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    out: list[bytes] = [b""] * len(words)
    low = 0
    for wide in [2 << k for k in range(_WIDE.bit_length() - 1)]:
        some = np.flatnonzero((size > low) & (size <= wide))
        low = wide
        for at in range(0, len(some), _FOREST):
            rows = some[at : at + _FOREST]
            flat = np.frombuffer(b"".join(raw[i] for i in rows.tolist()), np.uint8)
            inside = np.arange(wide)[None, :] < size[rows][:, None]
            sym = np.zeros((len(rows), wide), np.int64)
            sym[inside] = m.inner[flat]
            ends = np.cumsum(size[rows]) - 1
            sym[np.arange(len(rows)), size[rows] - 1] = m.last[flat[ends]]
            for i, ids in zip(rows.tolist(), _forest(m, sym, size[rows]), strict=True):
                out[i] = ids
    for i in np.flatnonzero(size > low).tolist():
        flat = np.frombuffer(raw[i], np.uint8)
        out[i] = _tree(m, [*m.inner[flat[:-1]].tolist(), int(m.last[flat[-1]])])
    return out


def normal(text: str) -> str:
    """NFC and lower case, each letter by itself and not by its place in a word; white space is in no word, so that its form is no matter."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _blocks(text: str) -> Iterator[str]:
    """Pieces of about ``_BLOCK`` characters; each but the first begins with white space, which no word holds."""
    start = 0
    while start < len(text):
        end = start + _BLOCK
        if end < len(text):
            found = _GAP.search(text, end)
            end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def _strange(m: Model, text: str) -> bool:
    """Whether the text holds a letter that Python's tables and the library's read differently (newer editions of Unicode)."""
    new = set(text) - m.settled - m.odd
    for c in new:
        probe = f"a{c}b '{c}s {c}{c}\u0301"
        (m.settled if m.word.findall(normal(probe)) == _library_words(m, probe) else m.odd).add(c)
    return bool(m.odd) and not m.odd.isdisjoint(text)


def _library_words(m: Model, text: str) -> list[str]:
    said = m.library.pre_tokenizer.pre_tokenize_str(m.library.normalizer.normalize_str(text))
    return [bytes(map(m.byte.__getitem__, w)).decode() for w, _ in said]


def pieces(m: Model, text: str) -> Iterator[list[str] | bytes]:
    """Lists of parts between blanks, and between them the ids of special tokens."""
    for part in m.cut.split(text) if m.cut else [text]:
        if part in m.special:
            yield np.array([m.special[part]], "<u4").tobytes()
        else:
            for block in _blocks(part):
                if _strange(m, block):
                    yield _library_words(m, block)
                else:
                    yield normal(block).replace("\n", " ").split(" ")


def encode_texts(m: Model, texts: list[str]) -> list[bytes]:
    """Ids of each text; new words of all texts are merged together."""
    read = [list(pieces(m, t)) for t in texts]
    known = m.cache
    if len(known) > _CACHE:
        known.clear()
    new = list({w for t in read for p in t if isinstance(p, list) for w in p if w not in known})
    if new:
        # a word of the library is one match of the pattern already, and is found again as a whole or as the same matches
        split = [_library_words(m, w) if _strange(m, w) else m.word.findall(w) for w in new]
        words = list({w for s in split for w in s})
        ids = dict(zip(words, merge_words(m, words), strict=True))
        known.update((w, b"".join([ids[x] for x in s])) for w, s in zip(new, split, strict=True))
    return [b"".join([b"".join([known[w] for w in p]) if isinstance(p, list) else p for p in t]) for t in read]


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in one binary value."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        m = model(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = encode_texts(m, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


@lru_cache(maxsize=4)
def _spelling(path: str, numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens (or of their numbers), each with a space behind it, and where each begins."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    tokens = [names.get(i, "") for i in range(max(names) + 1)]
    each = [(str(i) if numbers else t).encode() + b" " for i, t in enumerate(tokens)]
    return np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in each])])


def spell(path: str, ids: bytes, numbers: bool = False) -> bytes:
    """The tokens of the ids (or the ids in decimal), joined by one space."""
    raw, start = _spelling(path, numbers)
    at = np.frombuffer(ids, "<u4").astype(np.int64)
    if not len(at):
        return b""
    size = start[at + 1] - start[at]
    ends = np.cumsum(size)
    where = np.repeat(start[at] - (ends - size), size) + np.arange(ends[-1])
    return raw[where].tobytes()[:-1]


def decode(coded: DataFrame, *, ids: str = "ids", path: str, out: str = "decoded", decimal: str | None = None) -> DataFrame:
    """Adds the decoded text (null ids: null) and, where ``decimal`` names a column, the ids in decimal, joined by one space.

    Where a name is taken, the new column has a number at its end.
    """
    names = [fresh(coded, out)]
    if decimal:
        names.append(fresh(coded.withColumn(names[0], F.lit("")), decimal))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields) + "".join(f", `{n}` string" for n in names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = part.column(ids).to_pylist()
                said = [pa.array([None if v is None else spell(path, v, numbers).decode() for v in raw], pa.string()) for numbers in (False, True)[: len(names)]]
                yield pa.RecordBatch.from_arrays([*part.columns, *said], [*part.schema.names, *names])

    return coded.mapInArrow(run, spec)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the decimal ids and of the decoded text."""
    path = path or default_path()
    said = decode(encode(docs, path=path), path=path, decimal="decimal")
    return said.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("decimal", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest over all documents."""
    return digest(table(spark, sf_dir, "documents"))
