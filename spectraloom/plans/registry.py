"""Where queries and their SQL oracles are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def load_all() -> None:
    from spectraloom.plans import (  # noqa: F401
        q_aggregate,
        q_bands,
        q_classify,
        q_holdout,
        q_patches,
        q_reduction,
        q_spectra,
        q_select,
        q_sources,
        q_stats,
    )
