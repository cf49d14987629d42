"""Cantonese text: script conversion, word replacement, character tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Small tables of our own; pass larger ones for real use.
SCRIPT = {"们": "們", "话": "話", "说": "說", "这": "這", "时": "時", "会": "會", "来": "來", "过": "過"}
WORDS = {"他們": "佢哋", "他": "佢", "這個": "呢個", "沒有": "冇"}


def normalise(text: Column, script: dict[str, str] | None = None, words: dict[str, str] | None = None) -> Column:
    """Characters first, one for one; then words, at each place the longest that fits, from the left."""
    script, words = script or SCRIPT, words or WORDS
    out = F.translate(text, "".join(script), "".join(script.values()))
    longest = "|".join(sorted(words, key=len, reverse=True))
    parts, found = F.split(out, longest, -1), F.regexp_extract_all(out, F.lit(longest), 0)
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.zip_with(parts, found, lambda p, w: F.concat(p, F.coalesce(F.try_element_at(table, w), F.lit("")))), "")


def character_tokens(text: Column) -> Column:
    """Single characters without white space."""
    return F.filter(F.split(text, ""), lambda c: F.trim(c) != "")
