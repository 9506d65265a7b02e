"""Edge cases of the scalar functions, bins and per-key statistics (hand-computed answers)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from abode.config import CREDIT, PRE_1370_LABEL, PRICE
from abode.functions import scalars as S
from abode.functions.bins import interval_bin


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_digits(spark):
    assert _one(spark, [("۱۳۹۵",), ("a۱",), (None,)], "x string", S.persian_to_ascii("x")) == ["1395", "a1", None]


def test_to_number_rejects_what_pandas_rejects(spark):
    vals = [("1",), (" 2.5 ",), ("1d",), ("1f",), ("30+",), ("nan",), ("1e3",), (".5",), ("1_0",), (None,)]
    assert _one(spark, vals, "x string", S.to_number("x")) == [1.0, 2.5, None, None, None, None, 1000.0, 0.5, None, None]


def test_age_bins(spark):
    from abode.plans.price import add_building_age
    years = [1405, 1404, 1403, 1399, 1398, 1374, 1373, 1204]  # ages -1, 0, 1, 5, 6, 30, 31, 200
    df = spark.createDataFrame([(str(y),) for y in years], "construction_year string")
    got = [r[0] for r in add_building_age(df, PRICE).collect()]
    assert got == ["unselect", "unselect", "new", "new", "relatively_new", "old", "very_old", "very_old"]


def test_before_1370_modes(spark):
    from abode.plans.price import add_building_age
    df = spark.createDataFrame([("قبل از ۱۳۷۰",)], "construction_year string")
    assert add_building_age(df, PRICE).first()[0] == "unselect"
    assert add_building_age(df, PRICE, [PRE_1370_LABEL]).first()[0] == "very_old"  # age 34


def test_credit_floor_bins(spark):
    vals = [("-1",), ("0",), ("1",), ("30+",), ("31",), ("unselect",), (None,)]
    col = interval_bin(S.clean_floor_text("x"), CREDIT["floor_bins"], CREDIT["floor_labels"], missing="unselect")
    assert _one(spark, vals, "x string", col) == ["unselect", "underground", "low_floors", "very_high", "unselect",
                                                   "unselect", "unselect"]


def test_credit_total_floor_bins(spark):
    col = interval_bin(S.clean_floor_text("x"), CREDIT["total_floors_bins"], CREDIT["total_floors_labels"], missing="unselect")
    assert _one(spark, [("0",), ("3",), ("31",)], "x string", col) == ["unselect", "low_floors", "unselect"]


def test_units(spark):
    vals = [("0",), ("0.5",), ("1",), ("2",), ("5",), ("6",), ("more_than_8",), ("abc",), (None,)]
    col = interval_bin(S.clean_unit_per_floor("x"), CREDIT["unit_bins"], CREDIT["unit_labels"], include_lowest=True,
                       missing="unselect")
    assert _one(spark, vals, "x string", col) == ["1", "1", "1", "2", "5-6", "5-6", "9+", "unselect", "unselect"]


def test_amenity_sum_and_bool_code(spark):
    df = spark.createDataFrame([(True, True), (None, None), (False, True)], "a boolean, b boolean")
    assert [r[0] for r in df.select(S.flag_sum(["a", "b"])).collect()] == [2, 0, 1]
    assert [r[0] for r in df.select(S.luxury_label(S.flag_sum(["a", "b"]))).collect()] == ["low", "none", "low"]
    assert [r[0] for r in df.select(S.bool_code("a")).collect()] == [1, -1, 0]


def test_tri_state(spark):
    assert _one(spark, [("true",), ("false",), ("unselect",), (None,)], "x string", S.tri_state_bool("x")) == [
        True, False, False, None]


def test_total_credit(spark):
    got = _one(spark, [(10_000_000.0, 100_000_000.0), (-1.0, 5.0)], "r double, c double", S.total_credit("r", "c"))
    assert math.isclose(got[0], 2.6e9, rel_tol=1e-9) and got[1] == 0.0


def test_clamp_keeps_null(spark):
    assert _one(spark, [(-2.0,), (None,), (3.0,)], "x double", S.clamp_negative("x")) == [0.0, None, 3.0]


def test_price_floor_mode(spark):
    from abode.operators.impute import fill_mode
    df = spark.createDataFrame([(5.0,), (5.0,), (2.0,), (2.0,), (None,)], "floor double")
    got = sorted(r[0] for r in fill_mode(df, "floor", df).collect())
    assert got == [2, 2, 2, 5, 5]


def test_rare_levels(spark):
    from abode.operators.impute import group_rare
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert [r[0] for r in group_rare(df, "c", 0.5).collect()] == ["a", "a", "Other", None]


def test_not_contains_keeps_null(spark):
    from abode.operators.projections import where_not_contains
    df = spark.createDataFrame([("x-rent",), (None,), ("x-sell",)], "c string")
    assert sorted(r[0] or "" for r in where_not_contains(df, "c", "-rent").collect()) == ["", "x-sell"]


def test_location_impute(spark):
    from abode.operators.impute import fill_location
    rows = [("train", "x", 1.0, 1.0), ("train", "x", None, None), ("train", None, 5.0, 5.0), ("val", "x", None, None),
            ("val", "y", None, None)]
    df = spark.createDataFrame(rows, "split string, city_slug string, location_latitude double, location_longitude double")
    got = [r["location_latitude"] for r in fill_location(df).orderBy("split", F.col("city_slug").asc_nulls_first(),
                                                                     "location_latitude").collect()]
    # train: null-city row takes the global mean (3.0) even with a coordinate; x nulls -> 1.0
    # val: x -> 1.0 (city mean), unknown y -> 3.0 (train mean)
    assert got == [3.0, 1.0, 1.0, 1.0, 3.0]


def test_location_impute_test_fallback(spark):
    from abode.operators.impute import fill_location
    rows = [("train", "x", 1.0), ("train", None, 5.0), ("test", "z", None)]
    df = spark.createDataFrame(rows, "split string, city_slug string, location_latitude double").withColumn(
        "location_longitude", F.col("location_latitude"))
    out = {r["split"]: r["location_latitude"] for r in fill_location(df, fallback_imputed_for=("test",)).collect()
           if r["split"] == "test"}
    # imputed train: x -> 1.0, null city -> raw mean 3.0; mean of imputed = 2.0
    assert out["test"] == 2.0


def test_money_and_percent(spark):
    vals = [(2.5e12,), (3.456e9,), (1.26e6,), (1234.0,)]
    assert _one(spark, vals, "v double", S.format_money("v")) == ["2.50T IRR", "3.46B IRR", "1.3M IRR", "1,234 IRR"]
    got = _one(spark, [(110.0, 100.0), (5.0, 0.0), (5.0, None)], "p double, a double", S.percent_error("p", "a"))
    assert math.isclose(got[0], 10.0) and got[1] == 0.0 and got[2] is None
