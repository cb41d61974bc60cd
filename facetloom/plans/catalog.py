"""Registered queries of the library's own operators, with the SQL that says what each returns."""

from __future__ import annotations

from facetloom.plans import analytics, collections, commands

FLAGSHIP = "zset_topk"
_ALL = collections.QUERIES | analytics.QUERIES | commands.QUERIES


def queries() -> dict:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
