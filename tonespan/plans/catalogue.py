"""Registered queries over the driver's tables and their DuckDB oracles."""

from __future__ import annotations

from tonespan.plans import level_queries, live_queries, span_queries, voice_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (span_queries, level_queries, voice_queries, live_queries):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)


def flagship(spark, sf_dir):
    return QUERIES["q10_talk_rank"](spark, sf_dir)
