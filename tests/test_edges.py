"""Edge data: nullable longs, constant and empty columns, text flags, NaN metrics, settings that must raise."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from abode.functions import scalars as S
from abode.operators import drift, geo, impute, metrics, models, profile
from abode.operators import split as J
from abode.session import ensure_checkpoint_dir
from abode.sources.files import read_listings_csv

BIG = 2 ** 53 + 1


def test_exact_split_keeps_payload_and_sizes(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") + BIG).alias("v"))
    out = J.exact_two_way_split(df, "k", 0.2, 42)
    assert sorted(map(repr, out.select("k", "v").collect())) == sorted(map(repr, df.collect()))
    assert out.where("split = 'val'").count() == math.ceil(1003 * 0.2)
    three = {r["split"]: r["count"] for r in J.exact_three_way_split(df, "k", 0.15, 0.1275, 1).groupBy("split").count().collect()}
    assert [three[s] for s in ("train", "test", "val")] == J.expected_sizes(1003, [0.15, 0.1275])
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan
    assert J.exact_two_way_split(df.limit(0), "k", 0.2, 42).count() == 0


def test_gate_rejects_nan(spark):
    m = spark.createDataFrame([("a", "val", "r2", float("nan")), ("b", "val", "r2", 0.7)], "model string, split string, metric string, value double")
    assert {r.model: r.qualifies for r in metrics.registry_gate(m).collect()} == {"a": False, "b": True}
    v = spark.createDataFrame([("t", "a", 1, 0.7), ("t", "a", 2, float("nan"))], "task string, model string, version int, val_r2 double")
    assert [r.latest_version for r in metrics.latest_qualified(v).collect()] == [1]


def test_constant_label_has_no_r2(spark):
    p = spark.createDataFrame([("val", "m", 1.0, 2.0), ("val", "m", 1.0, 0.0)], "split string, model string, label double, prediction double")
    assert {r.metric: r.value for r in metrics.regression_metrics(p).collect()} == {"r2": None, "mae": 1.0, "rmse": 1.0}


def test_drift_on_constant_and_empty_columns(spark):
    ref = spark.createDataFrame([(1.0, None, "a", None), (1.0, None, "a", None)], "c double, e double, s string, n string")
    cur = spark.createDataFrame([(1.0, 2.0, "a", "x"), (3.0, 4.0, "b", "y")], "c double, e double, s string, n string")
    out = {r.column_name: r for r in drift.numeric_drift(ref, cur, ["c", "e"]).collect()}
    assert out["c"].wasserstein == 1.0 and out["c"].ref_std == 0.0 and out["c"].wasserstein_norm is None and out["c"].ks == 0.5
    assert (out["e"].wasserstein, out["e"].ks, out["e"].js) == (None, None, None)
    cat = {r.column_name: r.js for r in drift.categorical_drift(ref, cur, ["s", "n"]).collect()}
    assert cat["s"] > 0 and cat["n"] is None


def test_text_flags(spark):
    df = spark.createDataFrame([("true", "unselect"), (None, "false")], "a string, b string")
    assert [tuple(r) for r in df.select(S.flag_sum(["a", "b"]), S.bool_code("a"), S.bool_code("b")).collect()] == [(1, 1, -1), (0, -1, 0)]


def test_profiles_keep_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None, "x", None)], "a double, b double, s string, t string")
    assert {r.column_name: r["count"] for r in profile.describe_numeric(df, ["a", "b"]).collect()} == {"a": 1, "b": 0}
    assert {r.column_name: (r["count"], r.unique) for r in profile.describe_object(df, ["s", "t"]).collect()} == {"s": (1, 1), "t": (0, 0)}
    assert {r.missing_pct for r in profile.missing_share(df.limit(0)).collect()} == {None}


def test_statistics_without_spread(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0)], "g string, v double")
    assert geo.anova_f(df, "g", "v").first().f is None
    assert geo.welch_t(df, "g", "v", "g", "h").first().t is None
    rows = [(s, 1.0 * i, 5.0, 35.0 + i, 51.0) for i, s in enumerate("abc")]
    p = spark.createDataFrame(rows, "neighborhood_slug string, price_per_m2 double, mean_size double, lat double, lon double")
    assert [r.neighbour for r in geo.similar_neighbourhoods(p, ["a"]).orderBy("rank").collect()] == ["b", "c"]


def test_presets_are_taken_as_they_are(spark):
    assert models.gradient_boosting({"max_depth": 22, "subsample": 0.5}).getMaxDepth() == 22
    assert models.gradient_boosting({"subsample": 0.5}).getSubsamplingRate() == 1.0
    with pytest.raises(ValueError):
        models.gradient_boosting({"max_depth": 31})
    for bad in (0, -0.1, 1.5):
        with pytest.raises(ValueError):
            impute.frequent_levels(spark.range(1), ["id"], bad)


def test_checkpoint_folder_is_required_off_local():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_csv_with_unnamed_index(spark, tmp_path):
    (tmp_path / "x.csv").write_text(",city,size\n0,tehran,80\n1,karaj,\n")
    rows = read_listings_csv(spark, str(tmp_path / "x.csv"), spark.createDataFrame([], "city string, size double").schema)
    assert [tuple(r) for r in rows.orderBy("city").collect()] == [("karaj", None), ("tehran", 80.0)]
    with pytest.raises(ValueError):
        read_listings_csv(spark, str(tmp_path / "x.csv"), spark.createDataFrame([], "size double, city string").schema)


def test_scratch_tables_can_be_released(spark):
    import os
    from abode import session
    table = session.materialize(spark.range(5), "release-test")
    path = next(p for p in session._PATHS if "release-test" in p)
    local = path.replace("file:", "")
    assert table.count() == 5 and os.path.isdir(local)
    kept, session._PATHS[:] = [p for p in session._PATHS if p != path], [path]
    assert session.release_scratch(spark) == 1 and not os.path.isdir(local)
    session._PATHS[:] = kept
