"""Shared fixtures: one local session and small listing frames with hand-derivable answers."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"

RAW_SCHEMA = T.StructType([
    T.StructField("listing_id", T.LongType()),
    T.StructField("cat2_slug", T.StringType()), T.StructField("cat3_slug", T.StringType()),
    T.StructField("city_slug", T.StringType()), T.StructField("neighborhood_slug", T.StringType()),
    T.StructField("land_size", T.DoubleType()), T.StructField("building_size", T.DoubleType()),
    T.StructField("deed_type", T.StringType()), T.StructField("has_business_deed", T.BooleanType()),
    T.StructField("floor", T.StringType()), T.StructField("rooms_count", T.StringType()),
    T.StructField("total_floors_count", T.StringType()), T.StructField("unit_per_floor", T.StringType()),
    T.StructField("has_balcony", T.StringType()), T.StructField("has_elevator", T.BooleanType()),
    T.StructField("has_warehouse", T.BooleanType()), T.StructField("has_parking", T.BooleanType()),
    T.StructField("construction_year", T.StringType()), T.StructField("is_rebuilt", T.BooleanType()),
    T.StructField("has_warm_water_provider", T.StringType()), T.StructField("has_heating_system", T.StringType()),
    T.StructField("has_cooling_system", T.StringType()), T.StructField("has_restroom", T.StringType()),
    T.StructField("has_security_guard", T.BooleanType()), T.StructField("has_barbecue", T.BooleanType()),
    T.StructField("building_direction", T.StringType()), T.StructField("has_pool", T.BooleanType()),
    T.StructField("has_jacuzzi", T.BooleanType()), T.StructField("has_sauna", T.BooleanType()),
    T.StructField("floor_material", T.StringType()), T.StructField("property_type", T.StringType()),
    T.StructField("location_latitude", T.DoubleType()), T.StructField("location_longitude", T.DoubleType()),
    T.StructField("price_value", T.DoubleType()), T.StructField("rent_value", T.DoubleType()),
    T.StructField("credit_value", T.DoubleType()),
])

N_ROWS = 40
YEARS = ("۱۴۰۱", "1391", "1379")      # ages 3, 13 and 25 in 1404; every third year is in Persian digits
FLOORS = ("0", "3", "30+", None)


def own_row(i: int) -> dict:
    """Columns both tasks share, as a rule of i; columns that are not named stay null."""
    return {
        "listing_id": i, "city_slug": "karaj" if i % 4 == 0 else "mashhad", "neighborhood_slug": f"quarter-{i % 5}",
        "building_size": 50.0 + (7 * i) % 90, "deed_type": ("multi_page", "written_agreement")[i % 2],
        "floor": FLOORS[i % 4], "total_floors_count": str(4 + i % 3), "rooms_count": ("یک", "سه")[i % 2],
        "construction_year": YEARS[i % 3], "has_balcony": ("true", "unselect")[i % 2],
        "has_elevator": i % 2 == 0, "has_parking": i % 3 == 0, "has_warehouse": i % 5 == 0, "has_business_deed": i % 7 == 0,
        "is_rebuilt": i % 8 == 0, "has_security_guard": False, "has_barbecue": False, "has_pool": i % 10 == 0,
        "has_jacuzzi": False, "has_sauna": False, "floor_material": ("stone", "mosaic")[i % 2],
        "location_latitude": 36.1 - 0.003 * i, "location_longitude": 59.2 + 0.002 * i,
    }


def sale_row(i: int) -> dict:
    return own_row(i) | {"cat2_slug": "residential-sell", "cat3_slug": "apartment-sell", "price_value": 1.5e9 + 1e8 * (i * i % 23)}


def rent_row(i: int) -> dict:
    return own_row(i) | {"cat2_slug": "residential-rent", "cat3_slug": "apartment-rent", "rent_value": 6e6 + 2e5 * (i % 11), "credit_value": 3e8 + 5e6 * i}


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]").appName("abode-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(s.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="abode-test-ckpt-"))
    yield s


def _frame(spark, rows):
    names = [f.name for f in RAW_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_SCHEMA)


@pytest.fixture
def price_df(spark):
    return _frame(spark, [sale_row(i) for i in range(N_ROWS)])


@pytest.fixture
def credit_df(spark):
    return _frame(spark, [rent_row(i) for i in range(N_ROWS)])
