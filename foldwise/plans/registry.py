"""Registry of named queries: a Spark job and an independent SQL oracle each.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` = the
same result in DuckDB SQL over the given tables (views of the same names).
Oracles are written the direct way (per-fold statistics by an explicit
fold-expanded join, quantiles by ``quantile_cont`` ...), so they check the
Spark plans' shortcuts rather than repeat them.

Doubles are rounded on both sides (sums run in different orders).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
DOCS: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        DOCS[name] = (fn.__doc__ or "").strip()
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    """Import the modules that register queries."""
    from foldwise.plans import (q_features, q_splits_encoders, q_metrics_reports,  # noqa: F401
                                q_sources, q_models)
    return QUERIES, ORACLE
