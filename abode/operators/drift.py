"""Train-versus-current drift (group L).

Our own documented formulas (no p-values):

* numeric columns: Wasserstein-1 distance between the two empirical distributions divided
  by the reference standard deviation (drift when >= 0.1), and the Kolmogorov-Smirnov
  statistic ``max |F_ref - F_cur|``;
* categorical columns, and numeric columns with at most 5 distinct values: Jensen-Shannon
  distance of level shares (natural log, square root), drift when >= 0.1;
* dataset verdict: share of drifted columns >= 0.5.

CDFs come from one value-count aggregate over both sides and running sums inside buckets of the values
(``ordered``), which carry the next value along: one exchange of the counts, no per-column single-task window,
no join of the values with themselves.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.operators.ordered import ordered_sums
from abode.operators.profile import numeric_columns
from abode.session import materialize

TARGETS = ("price_value", "total_credit")


def common_columns(ref: DataFrame, cur: DataFrame, subset: Sequence[str] | None = None,
                   targets: Sequence[str] = TARGETS) -> list[str]:
    """L1: columns present in both frames (and in ``subset``), targets removed."""
    cols = [c for c in ref.columns if c in cur.columns and (subset is None or c in subset)]
    return [c for c in cols if c not in targets]


def _long(df: DataFrame, cols, side: str, as_string: bool) -> DataFrame:
    t = "string" if as_string else "double"
    longdf = df.select(*[F.col(c).cast(t).alias(c) for c in cols]).unpivot([], list(cols), "column_name", "value")
    if not as_string:
        longdf = longdf.withColumn("value", F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value")))
    return longdf.where(F.col("value").isNotNull()).withColumn("side", F.lit(side))


def numeric_drift(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L2 + L4: ``(column_name, n_distinct, wasserstein, ref_std, wasserstein_norm, ks)``."""
    both = _long(ref, cols, "ref", False).unionByName(_long(cur, cols, "cur", False))
    counts = both.groupBy("column_name", "value").agg(
        F.count_if(F.col("side") == "ref").alias("c_ref"), F.count_if(F.col("side") == "cur").alias("c_cur"))
    # Written once: the CDF pass, totals, level shares and the reference std all read it.
    counts = materialize(counts, "drift-counts")
    cdf = ordered_sums(counts, "column_name", "value", {"cum_ref": "c_ref", "cum_cur": "c_cur"})
    tot = counts.groupBy("column_name").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"),
                                            F.count(F.lit(1)).alias("n_distinct"))
    # tot has one row per column: bounded, broadcast
    j = cdf.join(F.broadcast(tot), "column_name")
    gap = F.abs(F.try_divide("cum_ref", "n_ref") - F.try_divide("cum_cur", "n_cur"))  # null where a side is empty
    stats = j.groupBy("column_name").agg(
        F.sum(gap * (F.col("next_value") - F.col("value"))).alias("wasserstein"), F.max(gap).alias("ks"),
        F.first("n_distinct").alias("n_distinct"))
    # Reference std from the per-value counts (two passes over distinct values: mean, then
    # squared deviations), so the raw reference rows are not scanned a second time.
    # As stddev_samp: null below two reference rows. ref_mean has one row per column: broadcast.
    n_ref = F.sum("c_ref")
    ref_mean = counts.groupBy("column_name").agg(
        F.when(n_ref > 0, F.sum(F.col("c_ref") * F.col("value")) / n_ref).alias("_mu"))
    std = (counts.join(F.broadcast(ref_mean), "column_name").groupBy("column_name").agg(
        F.when(n_ref > 1, F.sqrt(F.sum(F.col("c_ref") * (F.col("value") - F.col("_mu")) ** 2) / (n_ref - 1)))
        .alias("ref_std")))
    js = _js_from_counts(counts)
    out = stats.join(F.broadcast(std), "column_name", "left").join(F.broadcast(js), "column_name", "left")
    # one distinct value: distance 0; a side without values: null; a constant reference: no normed distance
    return out.withColumn("wasserstein", F.when(F.col("ks").isNotNull(), F.coalesce("wasserstein", F.lit(0.0)))).withColumn(
        "wasserstein_norm", F.try_divide("wasserstein", "ref_std"))


def categorical_drift(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L3: Jensen-Shannon distance of level shares per column.

    Levels of both sides come from one aggregate over the union (a level seen on one side
    only has a zero count on the other), so no outer join is needed.
    """
    both = _long(ref, cols, "ref", True).unionByName(_long(cur, cols, "cur", True))
    counts = both.groupBy("column_name", "value").agg(
        F.count_if(F.col("side") == "ref").alias("c_ref"), F.count_if(F.col("side") == "cur").alias("c_cur"))
    return _js_from_counts(counts)


def _js_from_counts(counts: DataFrame) -> DataFrame:
    """JS distance per column from ``(column_name, value, c_ref, c_cur)`` counts."""
    tot = counts.groupBy("column_name").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"))
    j = counts.join(F.broadcast(tot), "column_name")
    p, q = F.try_divide("c_ref", "n_ref"), F.try_divide("c_cur", "n_cur")
    m = (p + q) / 2

    def kl(a):
        return F.when(a > 0, a * F.log(F.try_divide(a, m))).otherwise(F.lit(0.0))

    both = (F.min("n_ref") > 0) & (F.min("n_cur") > 0)  # else there is nothing to compare: null
    return j.groupBy("column_name").agg(F.when(both, F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(kl(p)) + 0.5 * F.sum(kl(q))))).alias("js"))


def drift_report(ref: DataFrame, cur: DataFrame, subset: Sequence[str] | None = None,
                 threshold: float = 0.1, max_categorical_distinct: int = 5) -> DataFrame:
    """L1-L5 per column: ``(column_name, kind, stat, score, drift)``."""
    cols = common_columns(ref, cur, subset)
    nums = [c for c in numeric_columns(ref.select(*cols))]
    cats = [c for c in cols if c not in nums]
    parts = []
    if nums:
        nd = numeric_drift(ref, cur, nums)
        both = nd
        as_cat = F.col("n_distinct") <= max_categorical_distinct
        parts.append(both.select(
            "column_name", F.when(as_cat, "categorical").otherwise("numeric").alias("kind"),
            F.when(as_cat, "jensen_shannon").otherwise("wasserstein_norm").alias("stat"),
            F.when(as_cat, F.col("js")).otherwise(F.col("wasserstein_norm")).alias("score"),
            F.when(as_cat, F.lit(None).cast("double")).otherwise(F.col("ks")).alias("ks")))
    if cats:
        parts.append(categorical_drift(ref, cur, cats).select(
            "column_name", F.lit("categorical").alias("kind"), F.lit("jensen_shannon").alias("stat"),
            F.col("js").alias("score"), F.lit(None).cast("double").alias("ks")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("drift", F.coalesce(F.col("score") >= F.lit(threshold), F.lit(False)))


def dataset_drift(report: DataFrame, share: float = 0.5) -> DataFrame:
    """Number and share of drifted columns; dataset drift when the share >= ``share``."""
    return report.agg(F.count(F.lit(1)).alias("n_columns"), F.count_if("drift").alias("n_drifted")).withColumn(
        "share_drifted", F.col("n_drifted") / F.col("n_columns")).withColumn(
        "dataset_drift", F.col("share_drifted") >= F.lit(share))


def save_report(report: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write the report table (parquet or JSON) and return it read back."""
    report.write.mode("overwrite").format(fmt).save(path)
    return report.sparkSession.read.schema(report.schema).format(fmt).load(path)
