"""Model store and the restartable scoring stream."""

from __future__ import annotations

import shutil

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from abode.config import PRICE
from abode.operators import model_store as ST
from abode.plans.price import apply_price_statistics, fit_price_statistics, load_price_statistics, prepare_price_features, save_price_statistics
from abode.sources.listing_view import listing_view
from abode.streaming import jobs as N
from tests.conftest import SF0001


def constant(v):
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, CAST({v} AS DOUBLE) AS prediction FROM __THIS__")])


def test_versions_gate_and_missing_models(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, 2.0), (2, None)], "listing_id long, size double")
    with pytest.raises(ST.ModelNotFound, match="random_forest.*price.*training job"):
        ST.score(spark, root, "price", "random_forest", rows)
    assert [ST.publish(spark, root, "price", "random_forest", constant(v), ["size"], {"val_r2": r}) for v, r in ((1, 0.7), (2, 0.6), (3, None))] == [1, 2, 3]
    assert ST.publish(spark, root, "credit", "random_forest", constant(9), ["size"], {"val_r2": float("nan")}) == 1
    score = lambda **kw: {r.listing_id: r.prediction for r in ST.score(spark, root, "price", "random_forest", rows, **kw).collect()}
    assert score() == {1: 3.0, 2: 3.0} and score(version=2) == {1: 2.0, 2: 2.0} and score(qualified=True) == {1: 1.0, 2: 1.0}
    for kw in ({"version": 9}, {}):
        with pytest.raises(ST.ModelNotFound):
            ST.resolve(spark, root, "price", "random_forest" if kw else "lightgbm", **kw)
    with pytest.raises(ST.ModelNotFound, match="qualified"):
        ST.resolve(spark, root, "credit", "random_forest", qualified=True)
    with pytest.raises(Exception, match="size"):
        ST.score(spark, root, "price", "random_forest", rows.drop("size"))
    got = {(r.task, r.model): (r.latest_version, r.latest_qualified_version) for r in ST.latest_versions(spark, root).collect()}
    assert got == {("price", "random_forest"): (3, 1), ("credit", "random_forest"): (1, None)}


def test_a_cut_off_publisher_leaves_no_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")

    class Broken:
        def write(self):
            raise OSError("lost")

    with pytest.raises(OSError):
        ST.publish(spark, root, "price", "m", Broken(), [])
    assert ST.manifest(spark, root).count() == 0
    assert ST.publish(spark, root, "price", "m", constant(1), []) == 2  # the first number stays claimed
    monkeypatch.setattr(ST, "manifest", lambda *a: spark.createDataFrame([], ST.MANIFEST))  # a publisher that saw no other
    assert ST.publish(spark, root, "price", "m", constant(2), []) == 3


def test_statistics_survive_a_round_trip(spark, price_df, tmp_path):
    stats = fit_price_statistics(prepare_price_features(price_df))
    save_price_statistics(spark, stats, str(tmp_path / "s"))
    again = load_price_statistics(spark, str(tmp_path / "s"))
    assert {k: again[k] for k in again if k != "cities"} == {k: stats[k] for k in stats if k != "cities"}
    assert sorted(map(tuple, again["cities"].collect())) == sorted(map(tuple, stats["cities"].collect()))


def test_a_killed_stream_gives_each_listing_once(spark, tmp_path, monkeypatch):
    data = tmp_path / "data"
    data.mkdir()
    for t in ("customer", "nation"):
        shutil.copy(f"{SF0001}/{t}.parquet", data / f"{t}.parquet")
    spark.read.parquet(f"{SF0001}/orders.parquet").repartition(4).write.parquet(str(data / "orders.parquet"))
    root, statistics = str(tmp_path / "store"), str(tmp_path / "statistics")
    feats = prepare_price_features(listing_view(spark, SF0001))
    save_price_statistics(spark, fit_price_statistics(feats), statistics)
    scorer = PipelineModel(stages=[SQLTransformer(statement="SELECT *, building_size * location_latitude AS prediction FROM __THIS__")])
    ST.publish(spark, root, "price", "plain", scorer, PRICE["inference_columns"])
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    real, seen = N.write_batch, []

    def killed(df, batch_id, to):
        real(df, batch_id, to)
        seen.append(batch_id)
        if len(seen) == 2:  # written, but the batch is not committed yet
            raise RuntimeError("killed")

    monkeypatch.setattr(N, "write_batch", killed)
    start = lambda: N.continuous_scoring(spark, str(data), root, "price", "plain", statistics, sink, checkpoint, max_files=1)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    start().awaitTermination()
    assert len(set(seen)) >= 4 and len(seen) > len(set(seen))  # several batches, one of them twice
    got = N.read_scored(spark, sink)
    want = scorer.transform(apply_price_statistics(feats, load_price_statistics(spark, statistics)).select("listing_id", *PRICE["inference_columns"])).select("listing_id", "prediction")
    assert got.count() == want.count() > 0 and got.select("listing_id").distinct().count() == got.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
