"""Callers' columns carried through an operator in one struct, so that no name of theirs meets one of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "_row"


def kept(df: DataFrame, replaced) -> list[str]:
    """Columns of ``df`` that an operator passes on: all but those it replaces, in whatever case."""
    names = {r.lower() for r in replaced}
    return [c for c in df.columns if c.lower() not in names]


def carried(df: DataFrame, columns, **needed) -> DataFrame:
    """``columns`` in the struct ``ROW``, and the ``needed`` columns by the operator's names."""
    row = F.struct(F.lit(0).cast("tinyint").alias("_none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    return df.select(row.alias(ROW), *[c.alias(name) for name, c in needed.items()])


def restored(df: DataFrame, columns, *added) -> DataFrame:
    """The carried columns under their names, then the ``added`` ones."""
    return df.select(*[F.col(f"{ROW}.c{i}").alias(c) for i, c in enumerate(columns)], *added)
