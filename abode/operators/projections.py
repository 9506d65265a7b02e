"""Projections, filters and predicates (group C)."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNSELECT = "unselect"


def keep_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the listed columns that exist, in list order; absent names are ignored."""
    present = set(df.columns)
    return df.select(*[c for c in cols if c in present])


def drop_existing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def where_not_null(df: DataFrame, col: str) -> DataFrame:
    """Rows whose column is not null."""
    return df.where(F.col(col).isNotNull())


def rent_rows(df: DataFrame, price: str = "price_value", rent: str = "rent_value",
              deposit: str = "credit_value") -> DataFrame:
    """C4: rent listings: no sale price, and both rent and deposit present."""
    return df.where(F.col(price).isNull() & F.col(rent).isNotNull() & F.col(deposit).isNotNull())


def where_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Membership filter; null is not a member."""
    return df.where(F.col(col).isin(list(values)))


def where_not_contains(df: DataFrame, col: str, needle: str) -> DataFrame:
    """Drop rows whose text contains ``needle``; rows with null text are kept."""
    return df.where(~F.coalesce(F.col(col).contains(needle), F.lit(False)))


def drop_null_any(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    return df.na.drop("any", subset=list(cols))


def within_bounds(df: DataFrame, bounds: dict) -> DataFrame:
    """Keep rows with ``lo <= col <= hi`` for every ``col: (lo, hi)``; null fails."""
    cond = F.lit(True)
    for col, (lo, hi) in bounds.items():
        cond = cond & F.col(col).between(F.lit(lo), F.lit(hi))
    return df.where(cond)


def fill_unselect(df: DataFrame, cols: Sequence[str], value: str = UNSELECT) -> DataFrame:
    """Null -> 'unselect' for the listed string columns that exist."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in present})


def features_and_label(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    """One frame holding the features plus the target renamed to ``label``."""
    return df.withColumnRenamed(target, label)


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """C11: the inference schema: every expected column must exist; reorder to the list."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing feature columns: {missing}")
    return df.select(*expected)
