"""Flow tests on the 40-row sale and rent frames: derived columns, sizes, splits."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from abode.config import PRICE
from abode.operators import contracts as B
from abode.operators.split import expected_sizes
from abode.plans.credit import prepare_credit_dataset, prepare_credit_features
from abode.plans.price import prepare_price_dataset, prepare_price_features


def test_price_features(price_df):
    out = prepare_price_features(price_df)
    rows = {r["listing_id"]: r for r in out.collect()}
    assert len(rows) == 40
    assert [rows[i]["building_age"] for i in (0, 1, 2)] == ["new", "mid_age", "old"]     # ages 3, 13 and 25
    assert [rows[i]["rooms_count"] for i in (0, 1)] == ["1_room", "3_rooms"]
    assert rows[1]["non_luxury_score"] == "none" and rows[2]["non_luxury_score"] == "low"  # row 2 has a lift only
    assert [rows[i]["luxury_score"] == "none" for i in (0, 1)] == [False, True]             # row 0 has a pool
    assert "construction_year" not in out.columns and "has_pool" not in out.columns


def test_price_dataset_exact_split(price_df):
    d = prepare_price_dataset(price_df, exact=True)
    counts = {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    assert counts == {"train": 32, "val": 8} == dict(zip(["train", "val"], expected_sizes(40, [0.2])))
    row = d.where("listing_id = 1").first()
    assert row["floor_cat"] == "low-height" and row["total_floors_cat"] == "low"


def test_credit_features(credit_df):
    out = prepare_credit_features(credit_df)
    assert out.count() == 40
    assert "total_credit" in out.columns and "rent_value" not in out.columns and "price_value" not in out.columns
    rows = {r["listing_id"]: r for r in out.collect()}
    assert math.isclose(rows[3]["total_credit"], 200 * 6.6e6 + 6 * 3.15e8, rel_tol=1e-9)
    r = rows[1]
    assert (r["floor"], r["total_floors_count"], r["unit_per_floor"]) == ("low_floors", "mid_low_floors", "unselect")
    assert r["cat3_slug"] == "apartment-rent"            # single level: not rare


def test_credit_dataset_exact_three_way(credit_df):
    d = prepare_credit_dataset(credit_df, exact=True)
    counts = {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    assert counts == {"train": 29, "val": 5, "test": 6}
    assert expected_sizes(40, [0.15, 0.1275]) == [29, 6, 5]


def test_credit_dataset_hash_split_nonempty(credit_df):
    d = prepare_credit_dataset(credit_df)
    assert d.count() == 40
    assert set(r[0] for r in d.select("split").distinct().collect()) <= {"train", "val", "test"}


def test_contract_passes_and_fails(price_df):
    d = prepare_price_dataset(price_df)
    rep = B.contract_report(d, B.price_rules())
    assert B.gate(rep).where(~F.col("passed")).count() == 0
    bad = d.withColumn("price_value", F.when(F.col("listing_id") == 0, F.lit(1.0)).otherwise(F.col("price_value")))
    with pytest.raises(B.DataValidationError):
        B.gate(B.contract_report(bad, B.price_rules()))
    failing = B.failing_rows(bad, B.price_rules(), ["listing_id"]).collect()
    assert [(r["listing_id"], r["broken_rules"]) for r in failing] == [(0, ["price_value_in_range"])]


def test_raw_contract_requires_columns(spark, price_df):
    assert B.missing_columns(spark, price_df, ["price_value", "nope"]).collect()[0][0] == "nope"
    with pytest.raises(B.DataValidationError):
        B.validate_raw(spark, price_df.drop("rent_value"))
    rep = B.validate_raw(spark, price_df)
    assert rep.agg(F.sum("n_failed")).first()[0] == 0


def test_inference_schema(price_df):
    from abode.operators.projections import MissingColumnsError, require_columns
    d = prepare_price_dataset(price_df)
    assert require_columns(d, PRICE["inference_columns"]).columns == PRICE["inference_columns"]
    with pytest.raises(MissingColumnsError):
        require_columns(d.drop("floor_cat"), PRICE["inference_columns"])
