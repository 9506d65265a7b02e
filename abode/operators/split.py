"""Seeded, stateless splits (group J).

A row's split depends only on its key and the seed (an md5-derived uniform number), so
assignment is parallel, needs no shuffle, survives re-execution after executor loss and
does not move when rows are reordered. ``randomSplit`` is avoided: it depends on
partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
CUT_BUCKETS = 65_536


def hash_uniform(key, seed: int) -> Column:
    """Uniform number in [0, 1) from ``md5(key || ':' || seed)`` (first 32 bits)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / TWO_32


def hash_uniform_sql(key: str, seed: int) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT) / 4294967296.0)"


def two_way_split(df: DataFrame, key: str, test_size: float, seed: int, out: str = "split",
                  names=("train", "val")) -> DataFrame:
    """Rows with ``u < test_size`` go to the held-out split (default ``val``)."""
    return df.withColumn(out, F.when(hash_uniform(key, seed) < test_size, F.lit(names[1])).otherwise(F.lit(names[0])))


def three_way_split(df: DataFrame, key: str, test_size: float, val_size: float, seed: int,
                    out: str = "split") -> DataFrame:
    """Test first (``u1 < test_size``), then val as a share of the remainder (``u2 < val_size``)."""
    u1, u2 = hash_uniform(key, seed), hash_uniform(key, seed + 1)
    return df.withColumn(out, F.when(u1 < test_size, "test").when(u2 < val_size, "val").otherwise("train"))


def _exact_mark(df: DataFrame, key: str, seed: int, frac: float, flag: str) -> DataFrame:
    """Flag the ``ceil(n * frac)`` rows with the smallest ``(u, key)``.

    Rows are counted in ``CUT_BUCKETS`` equal buckets of ``u``; the running count over that fixed-size
    table names the bucket in which the cut falls and how many of its rows are still to take. Only that
    bucket is ranked, and its last taken ``(u, key)`` decides for every row by comparison: the payload is
    neither shuffled nor leaves the JVM. Rows with equal keys share a side; a null key is never flagged.
    """
    u = hash_uniform(key, seed)
    keys = df.select(u.alias("_u"), F.col(key).alias("_k"), F.floor(u * CUT_BUCKETS).alias("_b")).where(F.col("_u").isNotNull())
    every = Window.partitionBy()
    counts = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select("_b", "_c", F.sum("_c").over(Window.orderBy("_b")).alias("_to"), F.sum("_c").over(every).alias("_n"))
    cut = F.ceil(F.col("_n") * F.lit(frac))
    cut = counts.where((F.col("_to") >= cut) & (F.col("_to") - F.col("_c") < cut)).select("_b", (cut - F.col("_to") + F.col("_c")).alias("_r"))
    ranked = keys.join(F.broadcast(cut), "_b").withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_u", "_k")))
    last = ranked.where("_i = _r").select(F.struct("_u", "_k").alias("_last")).scalar()
    return df.withColumn(flag, F.coalesce(u.isNotNull() & (F.struct(u.alias("_u"), F.col(key).alias("_k")) <= last), F.lit(False)))


def exact_two_way_split(df: DataFrame, key: str, test_size: float, seed: int, out: str = "split",
                        names=("train", "val")) -> DataFrame:
    """Exactly ``ceil(n * test_size)`` held-out rows (the library's size rule)."""
    marked = _exact_mark(df, key, seed, test_size, "_held")
    return marked.withColumn(out, F.when(F.col("_held"), names[1]).otherwise(names[0])).drop("_held")


def exact_three_way_split(df: DataFrame, key: str, test_size: float, val_size: float, seed: int,
                          out: str = "split") -> DataFrame:
    """J3 for three splits: test = ceil(n*t); val = ceil(rest*v) of the remainder."""
    marked = _exact_mark(df, key, seed, test_size, "_test")
    rest = marked.where(~F.col("_test"))
    rest = _exact_mark(rest, key, seed + 1, val_size, "_val")
    test = marked.where(F.col("_test")).withColumn(out, F.lit("test"))
    rest = rest.withColumn(out, F.when(F.col("_val"), "val").otherwise("train")).drop("_val")
    return test.drop("_test").unionByName(rest.drop("_test"))


def expected_sizes(n: int, fractions) -> list[int]:
    """Sizes the ceil rule gives, for tests: each held-out split takes ceil of what is left."""
    sizes, rest = [], n
    for f in fractions:
        k = math.ceil(rest * f)
        sizes.append(k)
        rest -= k
    return [rest] + sizes
