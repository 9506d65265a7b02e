"""Contract (group B) and source/sink (group A, F4) queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.catalog import register
from abode.catalog.sqltext import hash_u, num, price_features_sql, with_listings
from abode.config import PRICE, RAW_REQUIRED_COLUMNS
from abode.operators import contracts as B
from abode.operators.split import two_way_split
from abode.plans.price import prepare_price_features
from abode.session import scratch_path
from abode.sources import files as A
from abode.sources.listing_view import LISTING_COLUMNS, listing_view
from abode.sources.tables import read_table

_REQ = RAW_REQUIRED_COLUMNS + ["floor_cat", "total_floors_cat", "luxury_score"]


@register("b01_required_columns", with_listings(
    "SELECT column_name FROM (VALUES " + ", ".join(f"('{c}')" for c in _REQ) + ") v(column_name) "
    "WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM listings))"))
def b01(spark, sf_dir):
    return B.missing_columns(spark, listing_view(spark, sf_dir), _REQ)


@register("b01b_required_column_counts", with_listings("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, " + (f"count({c}) AS n_rows FROM listings" if c in RAW_REQUIRED_COLUMNS else "CAST(NULL AS BIGINT) AS n_rows")
    for c in _REQ)))
def b01b(spark, sf_dir):
    return B.column_counts(listing_view(spark, sf_dir), _REQ)


def _rule_sql(r: B.Rule, src: str, split: str | None, numeric: bool) -> str:
    c = r.column
    if r.kind == "not_null":
        checked, failed = "TRUE", f"{c} IS NULL"
    elif r.kind == "range":
        v = f"CAST({c} AS DOUBLE)" if numeric else num(c)
        checked, failed = f"{c} IS NOT NULL", f"{c} IS NOT NULL AND ({v} IS NULL OR NOT ({v} BETWEEN {r.lo} AND {r.hi}))"
    else:
        checked = f"{c} IS NOT NULL"
        failed = "FALSE" if numeric else f"{c} IS NOT NULL AND {num(c)} IS NULL"
    sp = split or "'all'"
    grp = f" GROUP BY {split}" if split else ""
    return (f"SELECT {sp} AS split, '{r.name}' AS rule, count_if({checked}) AS n_checked, "
            f"count_if({failed}) AS n_failed FROM {src}{grp}")


_NUMERIC_LISTING = {"building_size", "land_size", "price_value", "rent_value", "credit_value",
                    "location_latitude", "location_longitude", "listing_id"}


def _split_listings_sql():
    return f"(SELECT *, CASE WHEN {hash_u('listing_id', 42)} < 0.2 THEN 'val' ELSE 'train' END AS split FROM listings) s"


@register("b05_contract_report_raw_listings", with_listings("\nUNION ALL\n".join(
    _rule_sql(r, _split_listings_sql(), "split", r.column in _NUMERIC_LISTING) for r in B.price_rules())))
def b05(spark, sf_dir):
    L = two_way_split(listing_view(spark, sf_dir), "listing_id", 0.2, 42)
    return B.contract_report(L, B.price_rules())


@register("b05_contract_report_price_features", with_listings("\nUNION ALL\n".join(
    _rule_sql(r, f"(SELECT *, CASE WHEN {hash_u('listing_id', 42)} < 0.2 THEN 'val' ELSE 'train' END AS split "
                 f"FROM ({price_features_sql()}) f) s", "split", True) for r in B.price_rules())))
def b05b(spark, sf_dir):
    d = two_way_split(prepare_price_features(listing_view(spark, sf_dir)), "listing_id", 0.2, 42)
    return B.contract_report(d, B.price_rules())


_COERCE = [B.Rule(f"{c}_coerce_double", c, "coerce_double") for c in ("floor", "total_floors_count", "construction_year", "building_size")]


@register("b04_coercion_failures", with_listings("\nUNION ALL\n".join(
    _rule_sql(r, "listings", None, r.column in _NUMERIC_LISTING) for r in _COERCE)))
def b04(spark, sf_dir):
    return B.contract_report(listing_view(spark, sf_dir), _COERCE, split=None)


def _fail_sql():
    parts = []
    for r in B.price_rules():
        c = r.column
        if r.kind == "not_null":
            f = f"{c} IS NULL"
        else:
            v = f"CAST({c} AS DOUBLE)"
            f = f"{c} IS NOT NULL AND ({v} IS NULL OR NOT ({v} BETWEEN {r.lo} AND {r.hi}))"
        parts.append(f"CASE WHEN {f} THEN '{r.name}' END")
    arr = f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
    return f"SELECT listing_id, array_to_string({arr}, ',') AS broken_rules FROM listings WHERE len({arr}) > 0"


@register("b06_failing_rows", with_listings(_fail_sql()))
def b06(spark, sf_dir):
    bad = B.failing_rows(listing_view(spark, sf_dir), B.price_rules(), ["listing_id"])
    return bad.select("listing_id", F.array_join("broken_rules", ",").alias("broken_rules"))


@register("b07_gate", with_listings(
    "SELECT split, sum(n_failed) AS n_failed, sum(n_failed) = 0 AS passed FROM (\n" + "\nUNION ALL\n".join(
        _rule_sql(r, _split_listings_sql(), "split", r.column in _NUMERIC_LISTING) for r in B.price_rules())
    + "\n) r GROUP BY split"))
def b07(spark, sf_dir):
    L = two_way_split(listing_view(spark, sf_dir), "listing_id", 0.2, 42)
    return B.gate(B.contract_report(L, B.price_rules()), skip=True)


# ---- sources and sinks -------------------------------------------------------------

_CSV_COLS = [n for n, _ in LISTING_COLUMNS if n != "created_at_month"]


@register("a01_csv_roundtrip", with_listings(f"SELECT {', '.join(_CSV_COLS)} FROM listings"))
def a01(spark, sf_dir):
    L = listing_view(spark, sf_dir).select(*_CSV_COLS)
    path = scratch_path(spark, "listings-csv")
    L.withColumn("Unnamed: 0", F.col("listing_id")).select("Unnamed: 0", *_CSV_COLS).write.option(
        "header", True).option("escape", '"').csv(path)
    schema = T.StructType([T.StructField("Unnamed: 0", T.LongType())] + list(L.schema.fields))
    return A.read_listings_csv(spark, path, schema)


def _city_class_csv(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    lookup = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("city"), F.col("r_name").alias("city_class"))
    path = scratch_path(spark, "city-class-csv")
    lookup.write.option("header", True).csv(path)
    return A.read_lookup_csv(spark, path, T.StructType([T.StructField("city", T.StringType()),
                                                       T.StructField("city_class", T.StringType())]))


@register("a02_lookup_csv_join", with_listings(
    "SELECT listing_id, city_slug, r_name AS city_class FROM listings "
    "LEFT JOIN nation ON listings.city_slug = nation.n_name LEFT JOIN region ON nation.n_regionkey = region.r_regionkey"))
def a02(spark, sf_dir):
    lookup = _city_class_csv(spark, sf_dir)
    L = listing_view(spark, sf_dir).select("listing_id", "city_slug")
    # the lookup is a file-backed table; the planner broadcasts it when its file size
    # is under the broadcast threshold, and falls back to a shuffle join otherwise.
    return L.join(lookup, L.city_slug == lookup.city, "left").select("listing_id", "city_slug", "city_class")


@register("a03_read_train_split", with_listings(
    f"SELECT listing_id, price_value FROM ({price_features_sql()}) f WHERE {hash_u('listing_id', 42)} >= 0.2"))
def a03(spark, sf_dir):
    d = two_way_split(prepare_price_features(listing_view(spark, sf_dir)), "listing_id", 0.2, 42)
    root = scratch_path(spark, "price-splits")
    d.write.partitionBy("split").parquet(root)
    return A.read_splits(spark, root).where(F.col("split") == "train").select("listing_id", "price_value")


@register("a04_write_splits_counts", with_listings(
    f"SELECT CASE WHEN {hash_u('listing_id', 42)} < 0.2 THEN 'val' ELSE 'train' END AS split, count(*) AS n_rows "
    f"FROM ({price_features_sql()}) f GROUP BY 1"))
def a04(spark, sf_dir):
    d = two_way_split(prepare_price_features(listing_view(spark, sf_dir)), "listing_id", 0.2, 42)
    return A.write_splits(d, scratch_path(spark, "price-splits"))


_NOT_NULL = [r for r in B.price_rules() if r.kind == "not_null"]
_RANGE = [r for r in B.price_rules() if r.kind == "range"]


@register("b02_not_null_counts", with_listings("\nUNION ALL\n".join(
    _rule_sql(r, "listings", None, r.column in _NUMERIC_LISTING) for r in _NOT_NULL)))
def b02(spark, sf_dir):
    return B.contract_report(listing_view(spark, sf_dir), _NOT_NULL, split=None)


@register("b03_range_counts", with_listings("\nUNION ALL\n".join(
    _rule_sql(r, "listings", None, r.column in _NUMERIC_LISTING) for r in _RANGE)))
def b03(spark, sf_dir):
    return B.contract_report(listing_view(spark, sf_dir), _RANGE, split=None)
