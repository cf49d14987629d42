"""Byte-level BPE encoding and decoding with overlapping chunks (operator 7).

A text of up to ``chunk`` characters is one chunk and is encoded where it lies.
A longer text becomes chunk rows of ``chunk`` characters plus an overlap, which
are dealt to all tasks:

1. each chunk is pre-tokenised from its own first character, which may lie
   inside a token, so that its first boundaries may be wrong;
2. neighbours are stitched at the first position in their overlap at which both
   have a boundary: a pre-token match depends only on where it starts and on
   what follows, so that from a common boundary on both read the same tokens;
3. each chunk encodes the pieces between its two stitches, every match apart;
4. the ids of a text are put together in chunk order.

Where the boundaries of an overlap never agree (one token longer than the
overlap), the whole text goes through the encoder as one chunk instead. Tokens
that end within ``_LOOK`` characters of a cut chunk end are not trusted, since the
pattern looks at what follows. Decoding concatenates the bytes of the ids.

Defined results: null counts as the empty text, which has no ids; repeated
rows are encoded one by one; no special tokens are known, so that their
spelling in a text is ordinary text; further columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import fresh, slices
from turnwise.session import table

#: Characters at a cut chunk end that a token must not reach.
_LOOK = 16


@lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """Loaded once in each Python worker, from a path that every node has."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: A pre-token that is already cut out: its whole text is one match.
_PIECE = "(?s:.+)"


@lru_cache(maxsize=4)
def pre_tokens(pattern: str):
    return regex.compile(pattern)


def boundaries(text: str, pattern: str, whole: bool) -> list[int]:
    """Trusted starts and ends of the pre-tokens of ``text`` read from its first character.

    ``whole``: the text ends here, so that its last tokens are right as well.
    """
    limit = len(text) if whole else len(text) - _LOOK
    out = [0]
    for m in pre_tokens(pattern).finditer(text):
        if m.end() > limit:
            break
        if m.start() != out[-1]:
            out.append(m.start())  # the pattern skipped something
        out.append(m.end())
    return out


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _unpack(enc: tiktoken.Encoding, ids) -> bytes:
    """The bytes of packed ids."""
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ranks_path: str, pattern: str, chunk: int = 32_768, overlap: int = 1_024, decoded: str | None = None) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in one binary value.

    ``decoded``: a further column of that name with the bytes that the ids decode to. A text that is one
    chunk is decoded in the Python worker that encoded it, so that a task needs one worker and not two.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [_pack(enc.encode_ordinary(v.as_py())) for v in part.column("text")]
                columns = {"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    columns[decoded] = pa.array([_unpack(enc, x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    spec = f"doc_id {id_type}, ids binary" + (f", `{decoded}` binary" if decoded else "")
    short = source.where(F.length("text") <= chunk).mapInArrow(whole, spec)

    def cut(batches):
        for batch in batches:
            for key, uid, value in zip(batch.column("doc_id"), batch.column("row").to_pylist(), batch.column("text"), strict=True):
                t = value.as_py()
                n = max(1, -(-(len(t) - overlap) // chunk))
                for k in range(n):
                    end = len(t) if k == n - 1 else (k + 1) * chunk + overlap
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()], key.type), pa.array([uid]), pa.array([k]), pa.array([n]), pa.array([t[k * chunk : end]])],
                        ["doc_id", "row", "k", "n", "piece"],
                    )

    def read(batches):
        for batch in batches:
            left, right = [], []
            for k, n, v in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist(), batch.column("piece"), strict=True):
                b = boundaries(v.as_py(), pattern, k == n - 1)
                left.append([x for x in b if x < overlap])
                right.append([x - chunk for x in b if x >= chunk])
            big = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, big), pa.array(right, big)], [*batch.schema.names, "lefts", "rights"])

    # a row is named by its content, so that repeated ids and recomputed tasks are no matter
    long = source.where(F.length("text") > chunk).withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)))
    chunks = long.dropDuplicates(["row"]).mapInArrow(cut, f"doc_id {id_type}, row string, k long, n long, piece string")
    bounds = chunks.repartition("row", "k").mapInArrow(read, f"doc_id {id_type}, row string, k long, n long, piece string, lefts array<int>, rights array<int>")
    order = Window.partitionBy("row").orderBy("k")
    stitched = bounds.withColumn("from", F.array_min(F.array_intersect("lefts", F.lag("rights").over(order)))).withColumn("to", F.lead("from").over(order))
    stitched = stitched.select("doc_id", "row", "k", "n", "piece", F.when(F.col("k") == 0, 0).otherwise(F.col("from")).alias("from"),
                               F.when(F.col("k") == F.col("n") - 1, F.length("piece")).otherwise(F.col("to") + chunk).alias("to"))

    def pieces(batches):
        enc = encoder(ranks_path, _PIECE)
        cache: dict[str, bytes] = {}
        for batch in batches:
            out = []
            for v, a, b in zip(batch.column("piece"), batch.column("from").to_pylist(), batch.column("to").to_pylist(), strict=True):
                if a is None or b is None:
                    out.append(None)  # no common boundary: the whole text is read again below
                    continue
                parts, t = [], v.as_py()
                for m in pre_tokens(pattern).finditer(t, a):
                    if m.end() > b:
                        break
                    ids = cache.get(m[0])
                    if ids is None:
                        ids = _pack(enc.encode_ordinary(m[0]))
                        if len(m[0]) < 64:
                            if len(cache) > 50_000:
                                cache.clear()
                            cache[m[0]] = ids
                    parts.append(ids)
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "k")), pa.array(out, pa.binary())], ["doc_id", "row", "k", "ids"])

    coded = stitched.mapInArrow(pieces, f"doc_id {id_type}, row string, k long, ids binary")
    joined = coded.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.count_if(F.col("ids").isNull()).alias("lost"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("parts"),
    )
    copies = long.groupBy("row").agg(F.count("*").cast("int").alias("copies"))
    named = joined.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    good = named.where("lost = 0").select("doc_id", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x)), "")).alias("ids"))
    if decoded:
        good = decode(good, ranks_path=ranks_path, pattern=pattern, out=decoded)
    again = long.join(joined.where("lost > 0").select("row"), "row", "left_semi").select("doc_id", "text")
    return short.unionByName(good).unionByName(again.mapInArrow(whole, spec))


def decode(coded: DataFrame, *, ids: str = "ids", ranks_path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """Adds the raw bytes of the ids, concatenated (null ids: null); where ``out`` is taken, under a name with a number at its end."""
    out = fresh(coded, out)
    kept = [(f.name, f.dataType.simpleString()) for f in coded.schema.fields]
    spec = ", ".join(f"`{n}` {t}" for n, t in [*kept, (out, "binary")])

    def run(batches):
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [None if not v.is_valid else _unpack(enc, v.as_buffer()) for v in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, out])

    return coded.mapInArrow(run, spec)


def default_vocabulary() -> dict[str, str]:
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    own = options or default_vocabulary()
    return encode(docs, **own, decoded="decoded").select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest over all documents."""
    return digest(table(spark, sf_dir, "documents"))
