"""Schemas of the tables, in words; ``exported`` gives them as JSON."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = {
    "lines": "file string, line_no int, kind string, label string, text string",
    "utterances": "file string, utt bigint, line_no int, speaker string, words array<struct<text:string,lang:string,pos_hint:string>>, terminator string, start_ms bigint, end_ms bigint, has_overlap boolean",
    "tiers": "file string, utt bigint, label string, content string",
    "tokens": "file string, seq bigint, text string, start_ms bigint, end_ms bigint",
    "segments": "file string, seq bigint, start_ms bigint, end_ms bigint, speaker string",
    "compared": "file bigint, unit int, seq int, side string, main_utt bigint, gold_utt bigint, text string, pos string, status string",
    "jobs": "job_id string, command string, lang string, status string, submitter string, path string, submitted_at double, completed_at double",
    "attempts": "attempt_id string, job_id string, work_unit string, attempt_number int, started_at double, finished_at double, outcome string, disposition string",
    "cache": "key string, task string, engine_version string, created_at double, data string",
}


def exported() -> dict[str, str]:
    return {name: T._parse_datatype_string(ddl).json() for name, ddl in TABLES.items()}
