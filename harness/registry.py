"""Where queries and their checks are collected."""

from __future__ import annotations

from harness.views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TEXTS: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its DuckDB text if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            TEXTS[name], ORACLES[name] = oracle, with_views(oracle)
        return fn

    return add
