"""Registered queries: each takes (spark, sf_dir) and gives a DataFrame; most have an equivalent in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> tuple[dict, dict]:
    from loreweave.queries import chunks, discovery, drafts, fusion, graph, retrieval, runs, structure, support, vectors  # noqa: F401

    return QUERIES, ORACLES
