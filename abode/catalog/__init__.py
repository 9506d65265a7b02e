"""Catalog of registered queries: one Spark job per operator plus its SQL oracle text.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the driver tables
(or data Spark derives from them). ``oracle`` holds an equivalent SQL text over the same
tables for operators that SQL can express.
"""

from __future__ import annotations

from typing import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from abode.catalog import (  # noqa: F401
        q_flows, q_scalars, q_filters, q_profile, q_split_impute, q_contracts_io, q_models, q_drift, q_stream, q_geo, q_jobs,
    )
