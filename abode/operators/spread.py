"""Joins on a key that may hold a large share of the rows: its rows are dealt over parts, its partner rows copied to each.

The number of parts follows the key's own count, so ordinary keys are joined as always. The hot keys are few (rows
divided by ``HOT_ROWS``) and known from counts that the caller has anyway.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.session import materialize

HOT_ROWS = 1 << 20          # rows of one key that one task joins
BROADCAST_KEYS = 1 << 21    # hot keys that are broadcast; beyond (2**41 rows) the plain join is left to the planner


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, hot_rows: int | None = None) -> DataFrame | None:
    """(keys, _parts) of the keys with more than ``hot_rows`` rows; None where there are none."""
    hot_rows = hot_rows or HOT_ROWS
    rows = counts.where(F.col(n) > hot_rows).select(*keys, F.ceil(F.col(n) / hot_rows).cast("int").alias("_parts"))
    rows = materialize(rows, "hot-keys")
    return rows if 0 < rows.count() <= BROADCAST_KEYS else None


def spread_join(big: DataFrame, small: DataFrame, keys: Sequence[str], hot: DataFrame | None, spread: Sequence[str], how: str = "inner") -> DataFrame:
    """``big.join(small, keys)`` with the hot keys' rows of ``big`` dealt out by a hash of ``spread``."""
    if hot is None:
        return big.join(small, list(keys), how)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = big.join(F.broadcast(hot), list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    copied = small.join(F.broadcast(hot), list(keys), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")
