"""Invariants: splits, leakage, encoders, persistence, metrics, gate, drift, order statistics."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from abode.config import PRICE
from abode.operators import encode as K
from abode.operators import metrics as M
from abode.operators import split as J
from abode.sources.listing_view import listing_view
from tests.conftest import SF0001


def test_splits_disjoint_complete_deterministic(spark):
    L = listing_view(spark, SF0001).select("listing_id")
    n = L.count()
    a = J.three_way_split(L, "listing_id", 0.15, 0.1275, 42)
    b = J.three_way_split(L.repartition(3), "listing_id", 0.15, 0.1275, 42)
    assert a.count() == n and a.select("listing_id").distinct().count() == n
    assert a.exceptAll(b).count() == 0
    ex = J.exact_three_way_split(L, "listing_id", 0.15, 0.1275, 42)
    sizes = {r["split"]: r["count"] for r in ex.groupBy("split").count().collect()}
    train, test, val = J.expected_sizes(n, [0.15, 0.1275])
    assert sizes == {"train": train, "test": test, "val": val}


def test_statistics_do_not_leak_from_val(spark, price_df):
    d = J.two_way_split(price_df, "listing_id", 0.2, 42)
    pert = d.withColumn("price_value", F.when(F.col("split") == "val", F.lit(9e10)).otherwise(F.col("price_value")))
    t1, p1 = K.target_encoding_table(d.where(F.col("split") == "train"), ["city_slug"], "price_value")
    t2, p2 = K.target_encoding_table(pert.where(F.col("split") == "train"), ["city_slug"], "price_value")
    assert t1.collect() == t2.collect()
    from abode.operators.impute import fill_location
    loc = d.withColumn("location_latitude", F.when(F.col("listing_id") % 3 == 0, None).otherwise(F.col("location_latitude")))
    pl = loc.withColumn("location_latitude", F.when(F.col("split") == "val", F.lit(80.0)).otherwise(F.col("location_latitude")))
    a = {r["listing_id"]: r["location_latitude"] for r in fill_location(loc).where("split = 'train'").collect()}
    b = {r["listing_id"]: r["location_latitude"] for r in fill_location(pl).where("split = 'train'").collect()}
    assert a == b


def test_sigmoid_weight_and_unseen_prior(spark):
    rows = [("a", 1.0), ("a", 3.0)] + [("b", 10.0)] * 3
    df = spark.createDataFrame(rows, "c string, y double")
    table, prior = K.target_encoding_table(df, ["c"], "y", 10.0, 20.0, "sigmoid")
    enc = {r["level"]: r["encoding"] for r in table.collect()}
    prior_v = (1 + 3 + 30) / 5
    w = 1 / (1 + math.exp(-(2 - 20) / 10))
    assert math.isclose(w, 0.14185, abs_tol=1e-5)
    assert math.isclose(enc["a"], prior_v * (1 - w) + 2.0 * w, rel_tol=1e-12)
    new = spark.createDataFrame([("zz",), (None,)], "c string")
    got = [r["c_te"] for r in K.apply_target_encoding(new, table, prior, ["c"]).collect()]
    assert all(math.isclose(g, prior_v) for g in got)


def test_additive_mode_values_and_spark_encoder(spark):
    rows = [("a", 1.0), ("a", 3.0)] + [("b", 10.0)] * 3
    df = spark.createDataFrame(rows, "c string, y double")
    table, _ = K.target_encoding_table(df, ["c"], "y", 10.0, mode="additive")
    enc = {r["level"]: r["encoding"] for r in table.collect()}
    assert math.isclose(enc["a"], 6.0, rel_tol=1e-9)           # (4 + 10*6.8) / 12
    assert math.isclose(enc["b"], 7.538462, rel_tol=1e-6)      # (30 + 68) / 13
    from pyspark.ml.feature import StringIndexer, TargetEncoder
    idx = StringIndexer(inputCol="c", outputCol="ci").fit(df).transform(df)
    te = TargetEncoder(inputCols=["ci"], outputCols=["ce"], labelCol="y", targetType="continuous", smoothing=10.0)
    spark_enc = {r["c"]: r["ce"] for r in te.fit(idx).transform(idx).select("c", "ce").distinct().collect()}
    assert math.isclose(spark_enc["a"], enc["a"], rel_tol=1e-9) and math.isclose(spark_enc["b"], enc["b"], rel_tol=1e-9)


def test_one_hot_unseen_is_zeros(spark):
    from pyspark.ml import Pipeline
    train = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    model = Pipeline(stages=K.one_hot_stages(["c"])).fit(train)
    out = model.transform(spark.createDataFrame([("x",), ("new",), (None,)], "c string")).collect()
    vecs = [r["c_ohe"].toArray().tolist() for r in out]
    assert sum(vecs[0]) == 1 and sum(vecs[1]) == 0 and sum(vecs[2]) == 1


def test_pipeline_reload_scores_equal(spark, price_df, tmp_path):
    from pyspark.ml import PipelineModel
    from abode.operators import models as MD
    from abode.plans.price import prepare_price_dataset
    d = prepare_price_dataset(price_df).withColumnRenamed("price_value", "label")
    learner = MD.random_forest({"n_estimators": 3, "max_depth": 3, "random_state": 1})
    model = MD.task_pipeline(PRICE, learner, ["building_size", "location_latitude", "location_longitude"]).fit(d)
    p = str(tmp_path / "m")
    model.write().overwrite().save(p)
    again = PipelineModel.load(p)
    a = [r["prediction"] for r in model.transform(d).orderBy("listing_id").collect()]
    b = [r["prediction"] for r in again.transform(d).orderBy("listing_id").collect()]
    assert a == b and len(a) == 40


def test_regression_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(100, 10, 200)
    p = y + rng.normal(0, 5, 200)
    df = spark.createDataFrame([(float(a), float(b), "val", "m") for a, b in zip(y, p)], "label double, prediction double, split string, model string")
    got = {r["metric"]: r["value"] for r in M.regression_metrics(df).collect()}
    assert math.isclose(got["r2"], 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), rel_tol=1e-9)
    assert math.isclose(got["mae"], np.mean(np.abs(y - p)), rel_tol=1e-9)
    assert math.isclose(got["rmse"], math.sqrt(np.mean((y - p) ** 2)), rel_tol=1e-9)


def test_gate_and_names(spark):
    rows = [("price", "a", "val", "r2", 0.70), ("price", "b", "val", "r2", 0.65), ("price", "c", "val", "r2", 0.64),
            ("price", "d", "val", "r2", None)]
    m = spark.createDataFrame(rows, "task string, model string, split string, metric string, value double")
    got = {r["model"]: r["qualifies"] for r in M.registry_gate(m).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}
    flat = M.flatten_metrics(m.where("model = 'a'"), nested=False, prefix="val_").first()["name"]
    nested = M.flatten_metrics(m.withColumn("split", F.lit("test")).where("model = 'a'")).first()["name"]
    assert flat == "val_a_r2" and nested == "test_a_r2"
    rf = spark.createDataFrame([("val_random_forest_r2", 0.7), ("lightgbm_r2", 0.6)], "name string, value double")
    cmp = {r["model"]: r["r2"] for r in M.compare_models(rf, ["random_forest", "lightgbm"]).collect()}
    assert cmp == {"random_forest": 0.7, "lightgbm": 0.6}


def test_exact_quantiles_match_numpy(spark):
    from abode.operators.ordered import exact_quantiles
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    q = {(r["column_name"], r["prob"]): r["quantile"] for r in exact_quantiles(li, ["l_quantity", "l_extendedprice"], [0.1, 0.5, 0.9]).collect()}
    pdf = li.select("l_quantity", "l_extendedprice").toPandas()
    for c in ("l_quantity", "l_extendedprice"):
        for p in (0.1, 0.5, 0.9):
            assert math.isclose(q[(c, p)], float(np.percentile(pdf[c], p * 100)), rel_tol=1e-12)


def test_drift_zero_on_identical_and_categorical_rule(spark):
    from abode.operators.drift import drift_report
    df = spark.createDataFrame([(float(i), i % 3, "abc"[i % 3]) for i in range(100)], "x double, small long, s string")
    rep = {r["column_name"]: r for r in drift_report(df, df).collect()}
    assert all(abs(r["score"]) < 1e-12 and not r["drift"] for r in rep.values())
    assert rep["small"]["kind"] == "categorical" and rep["x"]["kind"] == "numeric"
    shifted = df.withColumn("x", F.col("x") + 50)
    assert {r["column_name"]: r["drift"] for r in drift_report(df, shifted).collect()}["x"] is True


def test_scale_settings_size_partitions_from_input():
    from abode.session import PARTITION_BYTES, scale_settings
    big = scale_settings(100 * 1024 ** 4, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // PARTITION_BYTES
    assert big["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == big["spark.sql.shuffle.partitions"]
    assert int(scale_settings(10 ** 6, 8)["spark.sql.shuffle.partitions"]) == 24
