"""Listing view derived from the driver tables.

The driver tables hold no listings, so a listing table is derived from ``orders`` (unique
key) joined to ``customer`` and ``nation`` with deterministic expressions that also create
the messy values real exports carry: nulls, Persian digits, tri-state strings, ``30+``,
``unselect`` and bad numbers. Each expression is valid Spark SQL and DuckDB SQL, so the
SQL oracle derives the identical table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.sources.tables import read_table

# The derivation rules of the test listing view (see FIXTURES.md section 4).
# k = o_orderkey, p = o_totalprice.
LISTING_COLUMNS = [
    ("listing_id", "k"),
    ("cat2_slug", "CASE WHEN k%10<=3 THEN 'residential-sell' WHEN k%10=4 THEN 'commercial-sell' WHEN k%10=5 THEN 'real-estate-services' WHEN k%10<=8 THEN 'residential-rent' WHEN k%400=9 THEN 'short-term-rent' ELSE 'commercial-rent' END"),
    ("cat3_slug", "CASE WHEN k%23=0 THEN NULL WHEN k%10<=3 AND k%7=0 THEN 'house-villa-sell' WHEN k%10<=3 THEN 'apartment-sell' WHEN k%10=4 AND k%19=0 THEN 'office-rent' WHEN k%10=4 THEN 'office-sell' WHEN k%10=5 THEN 'presell' WHEN k%10<=8 AND k%7=0 THEN 'house-villa-rent' WHEN k%10<=8 THEN 'apartment-rent' WHEN k%500=9 THEN 'industry-agriculture-business-rent' ELSE 'shop-rent' END"),
    ("city_slug", "CASE WHEN k%101=0 THEN NULL WHEN k%53=0 THEN concat('village-',CAST(k AS STRING)) ELSE n_name END"),
    ("neighborhood_slug", "CASE WHEN k%9=0 THEN NULL WHEN k%53=0 AND k%101<>0 THEN concat('village-',CAST(k AS STRING),'-0') ELSE concat(n_name,'-',CAST(c_custkey%8 AS STRING)) END"),
    ("building_size", "CASE WHEN k%97=0 THEN NULL ELSE CAST(10+(k*7)%3100 AS DOUBLE) END"),
    ("land_size", "CASE WHEN k%5=0 THEN CAST(50+k%900 AS DOUBLE) END"),
    ("price_value", "CASE WHEN k%10<=5 THEN p*CAST(200000 AS DOUBLE) END"),
    ("rent_value", "CASE WHEN k%10>=6 AND k%17<>0 THEN CASE WHEN k%211=0 THEN CAST(-1 AS DOUBLE) ELSE p*CAST(40 AS DOUBLE) END END"),
    ("credit_value", "CASE WHEN k%10>=6 AND k%29<>0 THEN p*CAST(1000 AS DOUBLE) END"),
    ("location_latitude", "CASE WHEN k%6=0 OR n_nationkey=7 THEN NULL ELSE CAST(25+n_nationkey%14 AS DOUBLE)+CAST(k%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) END"),
    ("location_longitude", "CASE WHEN k%6=0 OR n_nationkey=7 THEN NULL ELSE CAST(44+n_nationkey%19 AS DOUBLE)+CAST(k%997 AS DOUBLE)/CAST(1000 AS DOUBLE) END"),
    ("construction_year", "CASE WHEN k%11=0 THEN NULL WHEN k%13=0 THEN 'قبل از ۱۳۷۰' WHEN k%3=0 THEN translate(CAST(1366+k%40 AS STRING),'0123456789','۰۱۲۳۴۵۶۷۸۹') ELSE CAST(1366+k%40 AS STRING) END"),
    ("floor", "CASE WHEN k%12=0 THEN NULL WHEN k%12=1 THEN 'unselect' WHEN k%12=2 THEN '30+' ELSE CAST(k%37-2 AS STRING) END"),
    ("total_floors_count", "CASE WHEN k%14=0 THEN NULL WHEN k%14=1 THEN 'unselect' WHEN k%14=2 THEN '30+' ELSE CAST(k%34 AS STRING) END"),
    ("unit_per_floor", "CASE WHEN k%8=0 THEN NULL WHEN k%8=1 THEN 'unselect' WHEN k%8=2 THEN 'more_than_8' ELSE CAST(k%10 AS STRING) END"),
    ("rooms_count", "CASE k%8 WHEN 0 THEN NULL WHEN 1 THEN 'بدون اتاق' WHEN 2 THEN 'یک' WHEN 3 THEN 'دو' WHEN 4 THEN 'سه' WHEN 5 THEN 'چهار' WHEN 6 THEN 'پنج یا بیشتر' ELSE 'نامشخص' END"),
    ("has_balcony", "CASE k%4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'unselect' END"),
    ("has_elevator", "CASE WHEN k%5=4 THEN NULL ELSE k%2=0 END"),
    ("has_warehouse", "k%3=0"),
    ("has_parking", "k%7<4"),
    ("has_security_guard", "CASE WHEN k%9=4 THEN NULL ELSE k%6=0 END"),
    ("has_barbecue", "k%24=0"),
    ("has_pool", "k%16=0"),
    ("has_jacuzzi", "k%18=0"),
    ("has_sauna", "k%20=0"),
    ("is_rebuilt", "CASE WHEN k%4=3 THEN NULL ELSE k%4=0 END"),
    ("has_business_deed", "CASE WHEN k%3=2 THEN NULL ELSE k%3=0 END"),
    ("deed_type", "CASE WHEN k IN (53,153,163) THEN 'inherited' ELSE CASE k%5 WHEN 1 THEN 'single_page' WHEN 2 THEN 'multi_page' WHEN 3 THEN 'written_agreement' WHEN 4 THEN 'other' END END"),
    ("floor_material", "CASE k%6 WHEN 1 THEN 'ceramic' WHEN 2 THEN 'stone' WHEN 3 THEN 'mosaic' WHEN 4 THEN 'carpet' WHEN 5 THEN 'unselect' END"),
    ("has_warm_water_provider", "CASE k%4 WHEN 1 THEN 'package' WHEN 2 THEN 'powerhouse' WHEN 3 THEN 'water_heater' END"),
    ("has_heating_system", "CASE k%5 WHEN 1 THEN 'split' WHEN 2 THEN 'heater' WHEN 3 THEN 'fan_coil' WHEN 4 THEN 'fireplace' END"),
    ("has_cooling_system", "CASE k%4 WHEN 1 THEN 'split' WHEN 2 THEN 'water_cooler' WHEN 3 THEN 'fan_coil' END"),
    ("has_restroom", "CASE k%4 WHEN 1 THEN 'seat' WHEN 2 THEN 'squat' WHEN 3 THEN 'squat_seat' END"),
    ("building_direction", "CASE k%5 WHEN 1 THEN 'north' WHEN 2 THEN 'south' WHEN 3 THEN 'east' WHEN 4 THEN 'west' END"),
    ("property_type", "CASE WHEN k%2=0 THEN 'apartment' END"),
    ("user_type", "CASE WHEN k%2=0 THEN 'personal' ELSE 'agency' END"),
    ("created_at_month", "o_orderdate"),
]
# End of fixed values.


def listing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as a lazy DataFrame over orders x customer x nation.

    ``orders`` -> ``customer`` is a key join whose both sides grow with the data: no hint,
    so the planner picks sort-merge (or AQE a broadcast once it has measured a small side).
    ``nation`` has a fixed 25 rows, so it is broadcast.
    """
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), "o_custkey", "o_orderdate"
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "inner")
    )
    return base.select(*[F.expr(expr).alias(name) for name, expr in LISTING_COLUMNS])


def listing_view_sql() -> str:
    """The same derivation as a SQL query (used by the oracle side)."""
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in LISTING_COLUMNS)
    return (
        "SELECT\n  " + cols + "\nFROM (SELECT o_orderkey AS k, o_totalprice AS p, o_custkey, o_orderdate FROM orders) o\n"
        "JOIN customer ON o.o_custkey = customer.c_custkey\n"
        "JOIN nation ON customer.c_nationkey = nation.n_nationkey"
    )
