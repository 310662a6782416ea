"""Registered queries and their reference SQL."""

from __future__ import annotations

from . import accepting, arranging, chunking, describing, exercising, judging, keeping, materials, owning, parsing, relating, retrieving, shaping, texts

FLAGSHIP = "source_summary"
GROUPS = (relating, texts, retrieving, judging, keeping, parsing, chunking, arranging, exercising, shaping, describing, accepting, owning, materials)


def queries():
    return {name: run for group in GROUPS for name, (run, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
