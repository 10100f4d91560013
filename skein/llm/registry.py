"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from skein.llm import bpe, covertree, html, licenses, linededup, packing, pii, quality, sharding, simhash

MODULES = (licenses, sharding, bpe, linededup, simhash, covertree, html, quality, packing, pii)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
