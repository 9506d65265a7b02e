"""Profiling (group E5-E14, E17, E18): one pass over all columns wherever possible.

Wide per-column statistics are computed as one aggregate with many expressions, or as an
unpivot to ``(column, value)`` followed by one ``groupBy``: never one job per column.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.operators.ordered import approx_quantiles, long_numeric, moments_of_counts, quantiles_of_counts, value_counts_long

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def object_columns(df: DataFrame) -> list[str]:
    """Columns pandas would hold as objects: strings and booleans."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def long_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unpivot columns to ``(column, value string)``, nulls dropped."""
    return (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], list(cols), "column_name", "value").where(F.col("value").isNotNull()))


def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """E5: ``(column, value, count)`` for every listed (default: non-numeric) column, nulls excluded.

    One unpivot + one aggregate with map-side partial counts, so a hot value collapses
    before the shuffle.
    """
    cols = list(cols) if cols is not None else object_columns(df)
    return long_strings(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
                     accuracy: int = 10000) -> DataFrame:
    """Count, mean, std (n-1), min, 25/50/75 %, max per numeric column.

    ``approx=False`` gives exact interpolated quantiles: the source is read once, into value counts,
    and all statistics come from those; ``approx=True`` a one-pass mergeable sketch (``percentile_approx``).
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    probs, names = [0.25, 0.5, 0.75], ["p25", "p50", "p75"]
    if approx:
        moments = long_numeric(df, cols).groupBy("column_name").agg(
            F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max"))
        q = approx_quantiles(df, cols, probs, names, accuracy)
    else:
        counts = value_counts_long(long_numeric(df, cols))
        moments, q = moments_of_counts(counts), quantiles_of_counts(counts, probs, names)
    # all sides have one row per column: bounded broadcasts. A column without values has count 0.
    return _columns(df, cols).join(F.broadcast(moments), "column_name", "left").join(F.broadcast(q), "column_name", "left").select(
        "column_name", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_object(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, unique, top, freq per non-numeric column; ties for top -> smallest value."""
    cols = list(cols) if cols is not None else object_columns(df)
    vc = value_counts(df, cols)
    found = vc.groupBy("column_name").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("top"),
        F.max("count").alias("freq"))
    return _columns(df, cols).join(F.broadcast(found), "column_name", "left").fillna(0, ["count", "unique"])


def _columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column name, so columns without any value keep their row."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column_name"))


def missing_share(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing share in percent per column, from one ``count(*)``/``count(c)`` pass; null for an empty table."""
    cols = list(cols) if cols is not None else df.columns
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    stacked = one.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_nn_{i}").alias("non_null")) for i, c in enumerate(cols)
    ])).alias("s")).select("s.column_name", "_n", "s.non_null")
    return stacked.select(
        "column_name", (F.col("_n") - F.col("non_null")).alias("n_missing"),
        F.try_divide(100.0 * (F.col("_n") - F.col("non_null")), F.col("_n")).alias("missing_pct"))


def missing_band(pct_col="missing_pct"):
    """E8 bands: >90, >75, >50, <=50 (each column in its highest band)."""
    p = F.col(pct_col)
    return F.when(p > 90, ">90").when(p > 75, ">75").when(p > 50, ">50").otherwise("<=50")


def columns_missing_above(df: DataFrame, threshold: float, cols: Sequence[str] | None = None) -> DataFrame:
    """E8 + H1: columns whose missing share exceeds ``threshold``, sorted descending then by name."""
    return missing_share(df, cols).where(F.col("missing_pct") > threshold).orderBy(F.desc("missing_pct"), "column_name")


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number of rows beyond the first of each identical group (null equals null)."""
    cols = list(cols) if cols is not None else df.columns
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
                      F.count(F.lit(1)).alias("n_distinct_rows"))


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width histogram over ``[min, max]`` per column, last bin closed.

    Returns ``(column, bin, lo, hi, count)`` for non-empty bins; a constant column fills bin 1.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    longdf = long_numeric(df, cols)
    rng = longdf.groupBy("column_name").agg(F.min("value").alias("lo_all"), F.max("value").alias("hi_all"))
    width = F.col("hi_all") - F.col("lo_all")
    idx = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo_all")) / width * bins) + 1, F.lit(bins)))
    # rng has one row per column: bounded, broadcast.
    binned = longdf.join(F.broadcast(rng), "column_name").withColumn("bin", idx.cast("int"))
    return binned.groupBy("column_name", "bin").agg(
        F.first("lo_all").alias("_lo"), F.first("hi_all").alias("_hi"), F.count(F.lit(1)).alias("count")
    ).select("column_name", "bin",
             (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") - 1) / bins).alias("lo"),
             (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / bins).alias("hi"),
             "count")


def box_stats(df: DataFrame, cols: Sequence[str] | None = None, whisker: float = 1.5) -> DataFrame:
    """Quartiles, IQR whiskers (most extreme values within 1.5 IQR) and outlier count."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    counts = value_counts_long(long_numeric(df, cols))  # the source is read once
    q = quantiles_of_counts(counts, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_f = F.col("q1") - whisker * F.col("iqr")
    hi_f = F.col("q3") + whisker * F.col("iqr")
    j = counts.join(F.broadcast(q), "column_name")  # one row per column
    v = F.col("value")
    return j.groupBy("column_name").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.first("iqr").alias("iqr"),
        F.min(F.when(v >= lo_f, v)).alias("whisker_lo"), F.max(F.when(v <= hi_f, v)).alias("whisker_hi"),
        F.coalesce(F.sum(F.when((v < lo_f) | (v > hi_f), F.col("cnt"))), F.lit(0)).alias("n_outliers"))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation for every pair ``a < b`` (pairwise complete), one aggregate."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def high_correlation_pairs(df: DataFrame, threshold: float = 0.8, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairs with ``|corr| >= threshold``."""
    return correlation_matrix(df, cols).where(F.abs("corr") >= threshold)


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values rendered as strings, sorted."""
    v = F.col(col).cast("string").alias("value")
    return df.select(v).where(F.col("value").isNotNull()).distinct().orderBy("value")


def table_info(df: DataFrame) -> DataFrame:
    """Per column: position, Spark type, non-null count, and the table's row count."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    return one.select("_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                 F.col(f"_nn_{i}").alias("non_null")) for i, c in enumerate(cols)])).alias("s")
    ).select("s.position", "s.column_name", "s.dtype", "s.non_null", F.col("_n").alias("n_rows"))


# Open ranges of the integer and float widths (numpy int8..int64, float16/32).
INT_RANGES = [("int8", "tinyint", -128, 127), ("int16", "smallint", -32768, 32767),
              ("int32", "int", -2147483648, 2147483647),
              ("int64", "bigint", -9223372036854775808, 9223372036854775807)]
FLOAT16_MAX = 65504.0
FLOAT32_MAX = 3.4028234663852886e38


def narrowest_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Smallest width whose open range holds the column's min and max.

    Floats that fit half precision are reported as ``float16`` with Spark type ``float``
    (Spark has no half float).
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    kinds = {f.name: isinstance(f.dataType, INTEGRAL_TYPES) for f in df.schema.fields}
    one = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.min(F.col(c).cast("double")).alias(f"_lo{i}"), F.max(F.col(c).cast("double")).alias(f"_hi{i}"))])
    rows = []
    for i, c in enumerate(cols):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        if kinds[c]:
            np_t = None
            sp_t = None
            for npn, spn, mn, mx in INT_RANGES:
                cond = (lo > float(mn)) & (hi < float(mx))
                np_t = F.when(cond, F.lit(npn)) if np_t is None else np_t.when(cond, F.lit(npn))
                sp_t = F.when(cond, F.lit(spn)) if sp_t is None else sp_t.when(cond, F.lit(spn))
            np_t, sp_t = np_t.otherwise(F.lit("int64")), sp_t.otherwise(F.lit("bigint"))
        else:
            c16 = (lo > -FLOAT16_MAX) & (hi < FLOAT16_MAX)
            c32 = (lo > -FLOAT32_MAX) & (hi < FLOAT32_MAX)
            np_t = F.when(c16, "float16").when(c32, "float32").otherwise("float64")
            sp_t = F.when(c16 | c32, "float").otherwise("double")
        rows.append(F.struct(F.lit(c).alias("column_name"), lo.alias("min"), hi.alias("max"),
                             np_t.alias("numpy_type"), sp_t.alias("spark_type")))
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def geo_density(df: DataFrame, lat: str = "location_latitude", lon: str = "location_longitude",
                step: float = 0.1, hue: str | None = None) -> DataFrame:
    """Point density on a ``step``-degree grid, optionally split by a category."""
    keys = [F.floor(F.col(lat) / step).cast("long").alias("lat_cell"),
            F.floor(F.col(lon) / step).cast("long").alias("lon_cell")]
    if hue:
        keys.append(F.col(hue))
    pts = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
