"""Statistics fitted on train and applied to every split (groups E1-E4, F1-F2b, G1).

Global statistics are scalar subqueries (one partial aggregate, no cross join, nothing
collected). Per-key statistics are aggregates joined back on the key. A per-key table
whose row count has a proven bound is broadcast; otherwise no hint is given, and AQE
broadcasts it once it has measured it small, or splits skewed partitions of a hot key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left", bounded: bool = False) -> DataFrame:
    """Join a per-key statistics table; broadcast only when its size bound is proven."""
    return big.join(F.broadcast(small) if bounded else small, on=on, how=how)


def frequent_levels(fit_df: DataFrame, cols: Sequence[str], min_freq: float = 0.01) -> dict[str, Column]:
    """E1 fit: per column, the array of levels whose share of non-null rows is at least ``min_freq``.

    One unpivot + one aggregate for all columns, as one scalar subquery of the plan that uses it: no job
    runs while that plan is built, and nothing comes to the driver. A column has at most ``1/min_freq``
    frequent levels, so the arrays are small whatever the table.
    """
    if not 0 < min_freq <= 1:
        raise ValueError("min_freq must lie in (0, 1]: it bounds the vocabulary to 1 / min_freq levels a column")
    longdf = fit_df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column_name", "_lvl").where(F.col("_lvl").isNotNull())
    counts = longdf.groupBy("column_name", "_lvl").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per column: a bounded table, broadcast back onto the per-level counts
    totals = counts.groupBy("column_name").agg(F.sum("_cnt").alias("_tot"))
    freq = counts.join(F.broadcast(totals), "column_name").where(
        F.col("_cnt") / F.col("_tot") >= F.lit(float(min_freq)))
    held = freq.agg(F.struct(*[F.sort_array(F.collect_set(F.when(F.col("column_name") == c, F.col("_lvl")))).alias(f"l{i}")
                               for i, c in enumerate(cols)]).alias("levels")).scalar()
    return {c: held.getField(f"l{i}") for i, c in enumerate(cols)}


def collapse_rare(df: DataFrame, vocab: dict[str, Column], other: str = "Other") -> DataFrame:
    """E1 apply: levels outside the fitted vocabulary -> ``other``; null stays null."""
    return df.withColumns({
        c: F.when(F.col(c).isNull(), F.lit(None).cast("string")).when(F.array_contains(levels, F.col(c).cast("string")), F.col(c))
        .otherwise(F.lit(other)) for c, levels in vocab.items()})


def group_rare(df: DataFrame, col: str, min_freq: float = 0.01, other: str = "Other",
               fit_df: DataFrame | None = None) -> DataFrame:
    """Levels whose share of non-null rows is strictly below ``min_freq`` -> ``other``; null stays.

    Shares come from ``fit_df`` (default: ``df`` itself).
    """
    vocab = frequent_levels(fit_df if fit_df is not None else df, [col], min_freq)
    return collapse_rare(df, vocab, other)


def mode_value(df: DataFrame, col: str) -> Column:
    """Most frequent non-null value, ties -> smallest, as a scalar subquery.

    Two steps instead of one ``mode`` buffer: per-value counts (partial aggregation, a hot
    value collapses map-side), then ``min_by`` over ``(-count, value)``.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    return counts.agg(F.min_by(col, F.struct(-F.col("_cnt"), F.col(col)))).scalar()


def mode_values(df: DataFrame, cols: Sequence[str]) -> Column:
    """E2 for several columns of one type in ONE pass: a struct scalar subquery ``{col: mode}``.

    One unpivot + value-count aggregate (map-side combine), then per column ``min_by`` over
    ``(-count, value)`` restricted to that column's rows (rows of other columns have a null
    ordering and are skipped).
    """
    longdf = df.select(*[F.col(c) for c in cols]).unpivot([], list(cols), "_c", "_v").where(F.col("_v").isNotNull())
    counts = longdf.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_cnt"))
    picks = [F.min_by("_v", F.when(F.col("_c") == c, F.struct(-F.col("_cnt"), F.col("_v")))).alias(c) for c in cols]
    return counts.agg(F.struct(*picks)).scalar()


def fill_modes(df: DataFrame, cols: Sequence[str], fit_df: DataFrame, cast: str | None = "int") -> DataFrame:
    """E2 applied to several columns with one fitting pass: null -> train mode, then truncating cast."""
    m = mode_values(fit_df, cols)
    return df.withColumns({c: (F.coalesce(F.col(c), m.getField(c)).cast(cast) if cast
                               else F.coalesce(F.col(c), m.getField(c))) for c in cols})


def fill_mode(df: DataFrame, col: str, fit_df: DataFrame, cast: str | None = "int") -> DataFrame:
    """E2 applied: null -> train mode, then truncating cast."""
    filled = F.coalesce(F.col(col), mode_value(fit_df, col))
    return df.withColumn(col, filled.cast(cast) if cast else filled)


def global_mean(df: DataFrame, col: str) -> Column:
    """Mean ignoring nulls, as a scalar subquery."""
    return df.agg(F.avg(col)).scalar()


def group_mean(df: DataFrame, key: str, cols: Sequence[str], suffix: str = "_mean") -> DataFrame:
    """Mean per key for each column."""
    return df.groupBy(key).agg(*[F.avg(c).alias(f"{c}{suffix}") for c in cols])


def fill_group_mean(df: DataFrame, key: str, col: str) -> DataFrame:
    """G1: null -> mean of its key group, keeping row grain.

    Written as a per-key aggregate joined back rather than ``avg().over(partitionBy(key))``:
    a window would put every row of a hot key in one task, the aggregate combines map-side
    and the join ships only the per-key table (AQE broadcasts it or splits a hot key).
    Rows with a null key take the mean of the null-key group, as the window form does.
    """
    means = df.groupBy(key).agg(F.avg(col).alias("_gm")).withColumnRenamed(key, "_gk")
    j = df.join(means, F.col(key).eqNullSafe(F.col("_gk")), "left")
    return j.withColumn(col, F.coalesce(F.col(col), F.col("_gm"))).drop("_gk", "_gm")


def fill_location(df: DataFrame, city: str = "city_slug", cols: Sequence[str] = ("location_latitude", "location_longitude"),
                  split: str = "split", train: str = "train", fallback_imputed_for: Sequence[str] = ()) -> DataFrame:
    """Location imputation with statistics from the train split only.

    * train rows: null -> city mean of train -> train global mean; rows with a null city
      take the train global mean even when they had a coordinate (F2b);
    * other splits: null -> train city mean (a city whose train coordinates are all null
      uses the train global mean) -> train global mean for unknown or null cities (F2);
    * splits in ``fallback_imputed_for`` fall back to the mean of the *imputed* train
      coordinates for unknown or null cities instead (F2a, the three-way flow's test split).

    The per-city table is joined without a hint (the number of cities has no proven
    bound): AQE broadcasts it once measured small, and splits a hot city otherwise.
    """
    tr = df.where(F.col(split) == train)
    stats = tr.where(F.col(city).isNotNull()).groupBy(city).agg(
        F.lit(True).alias("_known"), *[F.avg(c).alias(f"_cm_{i}") for i, c in enumerate(cols)])
    out = lookup_join(df, stats, on=city, how="left")
    tr_stats = lookup_join(tr, stats, on=city, how="left") if fallback_imputed_for else None
    is_train = F.col(split) == train
    # all global means of train in one pass (one scalar subquery returning a struct)
    means = tr.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)])).scalar()
    imputed = None
    if fallback_imputed_for:
        exprs = []
        for i, c in enumerate(cols):
            ov = means.getField(f"m{i}")
            tv = F.when(F.col(city).isNull(), ov).otherwise(F.coalesce(F.col(c), F.col(f"_cm_{i}"), ov))
            exprs.append(F.avg(tv).alias(f"i{i}"))
        imputed = tr_stats.agg(F.struct(*exprs)).scalar()
    for i, c in enumerate(cols):
        cm = F.col(f"_cm_{i}")
        overall = means.getField(f"m{i}")
        train_val = F.when(F.col(city).isNull(), overall).otherwise(F.coalesce(F.col(c), cm, overall))
        new = F.when(is_train, train_val).otherwise(F.coalesce(F.col(c), cm, overall))
        if fallback_imputed_for:
            imputed_mean = imputed.getField(f"i{i}")
            alt = F.coalesce(F.col(c), F.when(F.col("_known"), F.coalesce(cm, overall)), imputed_mean)
            new = F.when(F.col(split).isin(*fallback_imputed_for), alt).otherwise(new)
        out = out.withColumn(f"_new_{i}", new)
    for i, c in enumerate(cols):
        out = out.withColumn(c, F.col(f"_new_{i}"))
    return out.drop("_known", *[f"_new_{i}" for i in range(len(cols))], *[f"_cm_{i}" for i in range(len(cols))])
