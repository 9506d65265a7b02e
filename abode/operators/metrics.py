"""Regression metrics, metric flattening, registry gate and model comparison."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.config import MIN_VAL_R2


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: Sequence[str] = ("split", "model")) -> DataFrame:
    """r2, mae, rmse per group, long form ``(*by, metric, value)``; r2 of a constant label is null.

    Two passes for stability: the group means (one row per group, broadcast) are joined
    back so the total sum of squares is ``sum((y - mean)^2)``.
    """
    by = list(by)
    means = pred.groupBy(*by).agg(F.avg(label).alias("_mu"))
    j = pred.join(F.broadcast(means), by, "inner")
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    agg = j.groupBy(*by).agg(
        F.sum((y - p) * (y - p)).alias("_ssr"), F.sum((y - F.col("_mu")) * (y - F.col("_mu"))).alias("_sst"),
        F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("_mse"))
    wide = agg.select(*by, (1 - F.try_divide("_ssr", "_sst")).alias("r2"), "mae", F.sqrt("_mse").alias("rmse"))
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("r2", "mae", "rmse")])).alias("s")
    ).select(*by, "s.metric", "s.value")


def flatten_metrics(metrics: DataFrame, nested: bool = True, prefix: str = "") -> DataFrame:
    """``split_model_metric`` (nested layout) or ``{prefix}model_metric`` (flat layout)."""
    if nested:
        name = F.concat_ws("_", "split", "model", "metric")
    else:
        name = F.concat(F.lit(prefix), F.concat_ws("_", "model", "metric"))
    return metrics.select(name.alias("name"), F.col("value").cast("double").alias("value"))


def registry_gate(metrics: DataFrame, threshold: float = MIN_VAL_R2, split: str = "val",
                  keys: Sequence[str] = ("task", "model")) -> DataFrame:
    """Val r2 present, a number and ``>= threshold`` (inclusive) per model."""
    r2 = metrics.where((F.col("split") == split) & (F.col("metric") == "r2"))
    keys = [k for k in keys if k in metrics.columns]
    return r2.groupBy(*keys).agg(F.max(F.when(~F.isnan("value"), F.col("value"))).alias("val_r2")).withColumn(
        "qualifies", F.coalesce(F.col("val_r2") >= F.lit(threshold), F.lit(False)))


def compare_models(flat: DataFrame, models: Sequence[str], prefixes: Sequence[str] = ("val_", "")) -> DataFrame:
    """r2 per model from flat names, trying ``val_<model>_r2`` first, then ``<model>_r2``."""
    rows = []
    for m in models:
        cands = [F.max(F.when(F.col("name") == f"{p}{m}_r2", F.col("value"))) for p in prefixes]
        rows.append(F.struct(F.lit(m).alias("model"), F.coalesce(*cands).alias("r2")))
    return flat.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("s")).select("s.*").where(
        F.col("r2").isNotNull())


def latest_qualified(versions: DataFrame, threshold: float = MIN_VAL_R2,
                     keys: Sequence[str] = ("task", "model")) -> DataFrame:
    """H5 + K12: newest version per model among those whose val r2 passes the gate."""
    ok = versions.where((F.col("val_r2") >= threshold) & ~F.isnan("val_r2"))
    return ok.groupBy(*keys).agg(F.max("version").alias("latest_version"),
                                 F.max_by("val_r2", "version").alias("val_r2"))
