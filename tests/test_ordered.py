"""Running sums, next values and quantiles over buckets of value counts, against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from abode.operators import ordered as O
from abode.session import materialize


def counts_frame(spark):
    """Three keys (one null): a hot value with most rows, far-off values, infinities, one single value."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(v), int(c)) for v, c in zip(rng.normal(size=900).round(3), rng.integers(1, 5, 900))]
    rows += [("hot", 0.12345, 100_000), ("hot", 1e300, 1), ("hot", -1e300, 2), ("hot", float("inf"), 3)]
    rows += [(None, float(i * i), i % 7 + 1) for i in range(400)] + [("one", 5.0, 9)]
    df = spark.createDataFrame(rows, "k string, v double, c long").groupBy("k", "v").agg(F.sum("c").alias("cnt")).withColumn("d", F.col("cnt") % 3)
    return materialize(df.repartition(5), "test-counts")


@pytest.mark.parametrize("bucket_rows", [1, 7, 300, 1 << 16])
def test_sums_and_next_values_at_every_bucket_size(spark, bucket_rows):
    counts = counts_frame(spark)
    got = O.ordered_sums(counts, "k", "v", {"cum": "cnt", "cumd": "d"}, bucket_rows).toPandas()
    assert len(got) == counts.count()
    if bucket_rows < 1000:
        assert O.bucketed(counts, "k", "v", bucket_rows).select("_bucket").distinct().count() >= 3
    for _, g in got.groupby(got["k"].fillna("<null>")):
        g = g.sort_values("v")
        assert (g["cum"].values == g["cnt"].cumsum().values).all() and (g["cumd"].values == g["d"].cumsum().values).all()
        assert np.array_equal(g["next_value"].values[:-1], g["v"].values[1:]) and math.isnan(g["next_value"].values[-1])


def test_more_cut_points_than_a_stride(spark):
    rows = materialize(spark.range(3000).select(F.lit("a").alias("k"), (F.col("id") * 7919 % 3001).cast("double").alias("v"), F.lit(1).cast("long").alias("cnt")), "test-counts")
    dealt = O.bucketed(rows, "k", "v", 12)
    sizes = [r["count"] for r in dealt.groupBy("_bucket").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 60
    borders = dealt.groupBy("_bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_bucket").collect()
    assert all(a.hi < b.lo for a, b in zip(borders, borders[1:]))


@pytest.mark.parametrize("bucket_rows", [1, 5, 1 << 16])
def test_quantiles_against_numpy(spark, bucket_rows):
    counts = counts_frame(spark).where(~F.col("v").isin(float("inf"), 1e300, -1e300) | F.col("v").isNull())
    counts = materialize(counts, "test-counts")
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r for r in O.quantiles_of_counts(counts, probs, [f"q{i}" for i in range(6)], "k", "v", bucket_rows).collect()}
    pdf = counts.toPandas()
    assert set(got) == {"hot", None, "one"}
    for k, r in got.items():
        own = pdf[pdf["k"].isna() if k is None else pdf["k"] == k]
        values = np.repeat(own["v"].values, own["cnt"].values)
        for i, p in enumerate(probs):
            assert math.isclose(r[f"q{i}"], float(np.quantile(values, p)), rel_tol=1e-12, abs_tol=1e-12)


def test_moments_and_empty_counts(spark):
    counts = counts_frame(spark).where("k = 'one' OR k IS NULL")
    got = {r["k"]: r for r in O.moments_of_counts(counts, "k", "v").collect()}
    pdf = counts.where("k IS NULL").toPandas()
    values = np.repeat(pdf["v"].values, pdf["cnt"].values)
    assert math.isclose(got[None]["std"], values.std(ddof=1), rel_tol=1e-12) and got[None]["count"] == len(values)
    assert got["one"]["std"] == 0.0 and got["one"]["mean"] == 5.0
    none = materialize(counts.limit(0), "test-counts")
    assert O.ordered_sums(none, "k", "v", {"cum": "cnt"}).count() == 0
    assert O.quantiles_of_counts(none, [0.5], ["m"], "k", "v").count() == 0
