"""Lookup of a table with one row per key, for rows of which one key may hold a large share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_097_152  # a lookup table up to this many rows is broadcast
SALTS = 64                  # beyond it, each key's rows are dealt over so many tasks


def attach(rows: DataFrame, table: DataFrame, key: str, spread, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per ``key``, written before: it is counted first).

    Null keys match. ``spread`` is a column of ``rows`` by which the rows of one key are dealt
    out when the table is too large to broadcast; it steers only where a row goes.
    """
    others = [c for c in table.columns if c != key]
    held = table.withColumnRenamed(key, "_key")
    if table.count() <= bound:
        return rows.join(F.broadcast(held), F.col(key).eqNullSafe(F.col("_key")), "left").select(*rows.columns, *others)
    held = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return (dealt.join(held, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_deal") == F.col("_salt")), "left")
            .select(*rows.columns, *others))
