"""The queries of the numbered operators, and their SQL where it can say the same."""

from __future__ import annotations

from shelfmark.llm import langid, licenses, linededup, mixing, orderhash, phrases, pieces, quality, search, simhash, substrings, tokenstore, toxicity
from shelfmark.llm.session import ready

MODULES = [substrings, toxicity, tokenstore, licenses, simhash, pieces, mixing, quality, orderhash, langid, search, phrases, linededup]


def _shipped(query):
    def run(spark, sf_dir):
        ready(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: _shipped(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: sql for m in MODULES for k, sql in m.SQL.items()}
