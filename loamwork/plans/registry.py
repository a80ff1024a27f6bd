"""Registered queries of the engine and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, and its DuckDB SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from loamwork.plans import q_assembly, q_bins, q_coverage, q_refine, q_repeats, q_rules, q_system  # noqa: F401


def queries() -> dict[str, Callable]:
    """Name to (spark, sf_dir) -> DataFrame."""
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    _load()
    return dict(ORACLES)
