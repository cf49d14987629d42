"""Model engines behind one contract: a function over iterators of pandas batches.

An engine loads once for each Python worker and maps batches. The engines here
are rule-based and deterministic, so that every command runs without a network;
``register`` puts others in their place. Audio engines need models and media
files, and only have their contract here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from turnwise.functions import lexicon as L
from turnwise.functions.lazy import pieces

Engine = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_ENGINES: dict[tuple[str, str], tuple[Engine, str]] = {}


def register(task: str, name: str, engine: Engine, schema: str) -> None:
    _ENGINES[task, name] = (engine, schema)


def engines(task: str | None = None) -> list[tuple[str, str]]:
    return sorted(k for k in _ENGINES if task is None or k[0] == task)


def infer(df: DataFrame, task: str, name: str = "rules") -> DataFrame:
    """The rows of ``df`` through an engine; one row in, one row out, keys kept.

    An engine gets batches of bounded size, however many rows an Arrow batch has.
    """
    if (task, name) not in _ENGINES:
        raise KeyError(f"no engine {name} for {task}; known: {engines(task)}")
    engine, schema = _ENGINES[task, name]
    kinds = to_arrow_schema(T.DataType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (pa.RecordBatch.from_arrays(piece, batch.schema.names).to_pandas() for batch in batches if batch.num_rows for piece in pieces(tuple(batch.columns)))
        for out in engine(small):
            yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    return df.mapInArrow(run, schema)


_UD = "array<struct<text:string,lemma:string,upos:string,feats:string,head:int,deprel:string>>"


def _class(word: str) -> tuple[str, str]:
    low = word.lower()
    if not any(c.isalnum() for c in word):
        return "PUNCT", low
    if low.isdigit():
        return "NUM", low
    for lang, words in L.FUNCTION_WORDS.items():
        if low in words:
            return ("DET" if low in ("a", "an", "the", "le", "la", "les", "der", "die", "das", "el", "los", "las") else "ADP" if low in ("of", "to", "in", "on", "at", "de", "en", "mit", "von", "con") else "PRON" if low in ("i", "you", "he", "she", "it", "we", "they", "je", "tu", "il", "elle", "ich", "du", "er", "yo") else "CCONJ", low)
    if low.endswith("ing") and len(low) > 4:
        return "VERB", low[:-3]
    if low.endswith("ed") and len(low) > 3:
        return "VERB", low[:-2]
    if low.endswith("ly"):
        return "ADV", low
    return ("PROPN", low) if word[:1].isupper() else ("NOUN", low[:-1] if low.endswith("s") and len(low) > 3 else low)


def tag(words: list[str]) -> list[dict]:
    """A plain tagger by endings and closed classes; the first verb (else the first word) is the root."""
    classes = [_class(w) for w in words]
    root = next((i for i, (p, _) in enumerate(classes) if p == "VERB"), 0)
    out = []
    for i, (w, (p, lemma)) in enumerate(zip(words, classes, strict=True)):
        feats = "Number=Plur" if p == "NOUN" and w.lower() != lemma else "Tense=Past" if p == "VERB" and w.lower().endswith("ed") else "_"
        out.append({"text": w, "lemma": lemma, "upos": p, "feats": feats, "head": 0 if i == root else root + 1, "deprel": "root" if i == root else L.POS_TO_RELATION.get(p, "DEP").lower()})
    return out


def _tagger(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"file": b["file"], "utt": b["utt"], "ud": [tag(list(w)) for w in b["words"]]})


def _segmenter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A new group at conjunctions, after three words at least."""
    for b in batches:
        out = []
        for words in b["words"]:
            g, n, ids = 0, 0, []
            for w in words:
                if n >= 3 and w.lower() in ("and", "but", "so", "then", "et", "mais", "und", "aber", "y", "pero"):
                    g, n = g + 1, 0
                n += 1
                ids.append(g)
            out.append(ids)
        yield pd.DataFrame({"file": b["file"], "utt": b["utt"], "assignments": out})


def _translator(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks the text as untranslated; keeps length and order, which is what the rules around it need."""
    for b in batches:
        yield pd.DataFrame({"file": b["file"], "utt": b["utt"], "translation": [re.sub(r"\s+", " ", t).strip() for t in b["text"]]})


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated capitalised words of a document as chains."""
    for b in batches:
        out = []
        for sentences in b["sentences"]:
            seen: dict[str, int] = {}
            count: dict[str, int] = {}
            for s in sentences:
                for w in s["words"]:
                    count[w] = count.get(w, 0) + 1
            rows = []
            for s in sentences:
                marks = []
                for w in s["words"]:
                    if w[:1].isupper() and count[w] > 1:
                        marks.append([{"chain_id": seen.setdefault(w, len(seen)), "is_start": True, "is_end": True}])
                    else:
                        marks.append([])
                rows.append({"utt": s["utt"], "words": marks})
            out.append(rows)
        yield pd.DataFrame({"file": b["file"], "chains": out})


register("morphology", "rules", _tagger, f"file long, utt long, ud {_UD}")
register("segmentation", "rules", _segmenter, "file long, utt long, assignments array<int>")
register("translation", "identity", _translator, "file long, utt long, translation string")
register("coreference", "rules", _chains, "file long, chains array<struct<utt:bigint,words:array<array<struct<chain_id:int,is_start:boolean,is_end:boolean>>>>>")
