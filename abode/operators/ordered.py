"""Order statistics without a single-task window and without Python.

A running total over a global order (CDFs, exact quantiles) needs rows in order.
``Window.partitionBy(key).orderBy(value)`` would put all values of one key in one task, so
the values are first dealt to buckets that follow their order:

1. all work is on value counts, one row per distinct (key, value): a hot value is one row;
2. each key's distinct values are cut by approximate quantiles into buckets of about ``BUCKET_ROWS``
   values. The cut points steer only the dealing, any are right; they are written once, so
   that all readers deal alike;
3. running sums and the next value are windows inside a (key, bucket): one hash exchange of
   the counts;
4. a table of one row per (key, bucket), the edges, adds what lies before a bucket and the first
   value after it. It is joined on the same (key, bucket), without a hint.

Quantiles need only the buckets that hold a wanted rank, so the others are left out before step 3.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abode.session import materialize

BUCKET_ROWS = 1 << 16   # distinct values of a bucket, about
MAX_BUCKETS = 4096      # of a key
STRIDE = 64             # cut points are searched in strides, then inside one


def long_numeric(df: DataFrame, cols: Sequence[str], drop_null: bool = True) -> DataFrame:
    """Unpivot numeric columns to ``(column, value double)``; NaN is treated as missing."""
    longdf = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "column_name", "value")
    longdf = longdf.withColumn("value", F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value")))
    return longdf.where(F.col("value").isNotNull()) if drop_null else longdf


def value_counts_long(longdf: DataFrame, key: str = "column_name", value: str = "value") -> DataFrame:
    """``(key, value, cnt)``, written once: every statistic of the values reads it."""
    return materialize(longdf.groupBy(key, value).agg(F.count(F.lit(1)).alias("cnt")), "value-counts")


def bucketed(counts: DataFrame, key: str, value: str, bucket_rows: int | None = None) -> DataFrame:
    """Add ``_bucket``: the number of the key's cut points below the value. ``counts`` is read twice: pass a written table."""
    rows = bucket_rows or BUCKET_ROWS
    most = counts.groupBy(key).count().agg(F.max("count")).first()[0] or 0  # one number
    n = min(MAX_BUCKETS, -(-most // rows))
    if n <= 1:
        return counts.withColumn("_bucket", F.lit(0))
    probs = [i / n for i in range(1, n)]
    cuts = materialize(counts.groupBy(key).agg(F.percentile_approx(value, probs, 10 * n).alias("_cuts")), "value-cuts")
    held = counts.join(cuts.withColumnRenamed(key, "_cut_key"), F.col(key).eqNullSafe(F.col("_cut_key")))

    def below(cut_points):
        return F.size(F.filter(cut_points, lambda c: c < F.col(value)))

    heads = F.transform(F.sequence(F.lit(STRIDE), F.greatest(F.size("_cuts"), F.lit(STRIDE)), F.lit(STRIDE)), lambda i: F.get("_cuts", i - 1))
    stride = below(heads) * STRIDE
    return held.withColumn("_bucket", stride + below(F.slice("_cuts", stride + 1, F.lit(STRIDE)))).select(*counts.columns, "_bucket")


def edges(dealt: DataFrame, key: str, value: str, sums: dict) -> DataFrame:
    """One row per (key, bucket): ``_before_<out>`` of each sum, ``_in_<out>`` inside it and ``_after``, the first value beyond it."""
    table = dealt.groupBy(key, "_bucket").agg(*[F.sum(c).alias(f"_in_{o}") for o, c in sums.items()], F.min(value).alias("_low"))
    order = Window.partitionBy(key).orderBy("_bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return table.select(key, "_bucket", *[F.col(f"_in_{o}") for o in sums], F.lead("_low").over(order).alias("_after"),
                        *[F.coalesce(F.sum(f"_in_{o}").over(before), F.lit(0)).alias(f"_before_{o}") for o in sums])


def _with_edges(dealt: DataFrame, border: DataFrame, key: str) -> DataFrame:
    border = border.withColumnsRenamed({key: "_edge_key", "_bucket": "_edge_bucket"})
    return dealt.join(border, F.col(key).eqNullSafe(F.col("_edge_key")) & (F.col("_bucket") == F.col("_edge_bucket")))


def ordered_sums(counts: DataFrame, key: str, value: str, sums: dict, bucket_rows: int | None = None) -> DataFrame:
    """Add the inclusive running sums ``{out: column}`` in order of ``value`` per ``key``, and ``next_value``.

    ``counts`` has one row per (key, value) and is read more than once: pass a written table.
    """
    dealt = bucketed(counts, key, value, bucket_rows)
    rows = _with_edges(dealt, edges(dealt, key, value, sums), key)
    inside = Window.partitionBy(key, "_bucket").orderBy(value)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({**{f"_cum_{o}": F.sum(c).over(running) for o, c in sums.items()}, "_next": F.lead(value).over(inside)})
    return rows.select(*counts.columns, F.coalesce("_next", "_after").alias("next_value"),
                       *[(F.col(f"_before_{o}") + F.col(f"_cum_{o}")).alias(o) for o in sums])


def _ranks(p: float, n):
    """(position, lower rank, upper rank) of a quantile among ``n`` rows, interpolated linearly."""
    position = F.lit(float(p)) * (n - 1)
    return position, F.floor(position).cast("long"), F.ceil(position).cast("long")


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], names: Sequence[str], key: str = "column_name", value: str = "value",
                        bucket_rows: int | None = None) -> DataFrame:
    """Exact interpolated quantiles (``percentile``/``quantile_cont``) of written ``(key, value, cnt)``: one row per key, a column per quantile."""
    start, end = F.col("_before_cum"), F.col("_before_cum") + F.col("_in_cum")
    n = F.sum("_in_cum").over(Window.partitionBy(key))
    wanted = F.lit(False)
    for p in probs:
        _, lo, hi = _ranks(p, F.col("_all"))
        wanted = wanted | ((start <= lo) & (lo < end)) | ((start <= hi) & (hi < end))

    dealt = bucketed(counts, key, value, bucket_rows)
    border = edges(dealt, key, value, {"cum": "cnt"}).withColumn("_all", n).where(wanted)
    rows = _with_edges(dealt, border, key)
    running = Window.partitionBy(key, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before_cum") + F.sum("cnt").over(running)
    rows = rows.select(key, value, "_all", "cnt", upto.alias("_upto"))
    first = F.col("_upto") - F.col("cnt")
    found = []
    for p, name in zip(probs, names):
        _, lo, hi = _ranks(p, F.col("_all"))
        found += [F.max(F.when((first <= r) & (r < F.col("_upto")), F.col(value))).alias(f"_{side}_{name}") for side, r in (("lo", lo), ("hi", hi))]
    found = rows.groupBy(key).agg(F.max("_all").alias("_n"), *found)
    out = []
    for p, name in zip(probs, names):
        position, _, _ = _ranks(p, F.col("_n"))
        share = position - F.floor(position)
        out.append((F.col(f"_lo_{name}") + share * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return found.select(key, *out)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per column: ``(column_name, prob, quantile)``."""
    names = [f"q{i}" for i in range(len(probs))]
    wide = quantiles_of_counts(value_counts_long(long_numeric(df, cols)), probs, names)
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.col(q).alias("quantile")) for p, q in zip(probs, names)]))
    return wide.select("column_name", each.alias("s")).select("column_name", "s.*")


def moments_of_counts(counts: DataFrame, key: str = "column_name", value: str = "value") -> DataFrame:
    """count, mean, std (n-1), min and max per key of written ``(key, value, cnt)``; the deviations are taken from the mean in a second aggregate."""
    v, c = F.col(value), F.col("cnt")
    first = counts.groupBy(key).agg(F.sum(c).alias("count"), (F.sum(c * v) / F.sum(c)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    means = first.select(F.col(key).alias("_mean_key"), F.col("mean").alias("_mean"))
    spread = (counts.join(means, F.col(key).eqNullSafe(F.col("_mean_key"))).groupBy("_mean_key")
              .agg(F.when(F.sum(c) > 1, F.sqrt(F.sum(c * (v - F.col("_mean")) * (v - F.col("_mean"))) / (F.sum(c) - 1))).alias("std")))
    return first.join(spread, F.col(key).eqNullSafe(F.col("_mean_key")), "left").select(key, "count", "mean", "std", "min", "max")


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str],
                     accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles (``percentile_approx``, mergeable sketch) per column, one pass."""
    longdf = long_numeric(df, cols)
    pa = F.percentile_approx("value", [float(p) for p in probs], accuracy)
    out = longdf.groupBy("column_name").agg(pa.alias("_q"))
    return out.select("column_name", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
