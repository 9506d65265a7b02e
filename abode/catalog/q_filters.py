"""Projection and filter queries (group C) over the listing view."""

from __future__ import annotations

from abode.catalog import register
from abode.catalog.sqltext import price_features_sql, with_listings
from abode.config import CREDIT, PRICE
from abode.operators import projections as C
from abode.plans.price import prepare_price_features
from abode.sources.listing_view import LISTING_COLUMNS, listing_view

_KEEP = ["listing_id", "city_slug", "not_a_column", "building_size", "price_value", "absent_too"]
_ALL = [n for n, _ in LISTING_COLUMNS]
_AFTER_DROP = [c for c in _ALL if c not in CREDIT["drop_always"]]


@register("c01_keep_existing", with_listings("SELECT listing_id, city_slug, building_size, price_value FROM listings"))
def c01(spark, sf_dir):
    return C.keep_existing(listing_view(spark, sf_dir), _KEEP)


@register("c02_drop_existing", with_listings(f"SELECT {', '.join(_AFTER_DROP)} FROM listings"))
def c02(spark, sf_dir):
    return C.drop_existing(listing_view(spark, sf_dir), CREDIT["drop_always"] + ["no_such_column"])


@register("c03_sale_rows", with_listings("SELECT listing_id, price_value FROM listings WHERE price_value IS NOT NULL"))
def c03(spark, sf_dir):
    return C.where_not_null(listing_view(spark, sf_dir), "price_value").select("listing_id", "price_value")


@register("c04_rent_rows", with_listings(
    "SELECT listing_id, rent_value, credit_value FROM listings "
    "WHERE price_value IS NULL AND rent_value IS NOT NULL AND credit_value IS NOT NULL"))
def c04(spark, sf_dir):
    return C.rent_rows(listing_view(spark, sf_dir)).select("listing_id", "rent_value", "credit_value")


_SELLS = ", ".join(f"'{s}'" for s in PRICE["sell_cat2_slugs"])


@register("c05_membership", with_listings(f"SELECT listing_id, cat2_slug FROM listings WHERE cat2_slug IN ({_SELLS})"))
def c05(spark, sf_dir):
    return C.where_in(listing_view(spark, sf_dir), "cat2_slug", PRICE["sell_cat2_slugs"]).select("listing_id", "cat2_slug")


@register("c06_not_contains_keep_null", with_listings(
    "SELECT listing_id, cat3_slug FROM listings WHERE NOT coalesce(cat3_slug LIKE '%-rent%', FALSE)"))
def c06(spark, sf_dir):
    return C.where_not_contains(listing_view(spark, sf_dir), "cat3_slug", "-rent").select("listing_id", "cat3_slug")


@register("c07_drop_null_any", with_listings(
    "SELECT listing_id, building_size, city_slug FROM listings WHERE building_size IS NOT NULL AND city_slug IS NOT NULL"))
def c07(spark, sf_dir):
    return C.drop_null_any(listing_view(spark, sf_dir), ["building_size", "city_slug"]).select("listing_id", "building_size", "city_slug")


@register("c08_within_bounds", with_listings(
    "SELECT listing_id, building_size, price_value FROM listings "
    "WHERE building_size BETWEEN 20 AND 3000 AND price_value BETWEEN 500000000 AND 80000000000"))
def c08(spark, sf_dir):
    o = PRICE["outliers"]
    return C.within_bounds(listing_view(spark, sf_dir), {
        "building_size": (o["building_size_min"], o["building_size_max"]),
        "price_value": (o["price_value_min"], o["price_value_max"]),
    }).select("listing_id", "building_size", "price_value")


_FILL = CREDIT["fill_unselect_cols"]


@register("c09_fill_unselect", with_listings(
    "SELECT listing_id, " + ", ".join(f"coalesce({c}, 'unselect') AS {c}" for c in _FILL) + " FROM listings"))
def c09(spark, sf_dir):
    return C.fill_unselect(listing_view(spark, sf_dir).select("listing_id", *_FILL), _FILL + ["absent_column"])


@register("c10_features_and_label", with_listings(
    "SELECT listing_id, building_size, city_slug, price_value AS label FROM listings"))
def c10(spark, sf_dir):
    return C.features_and_label(
        listing_view(spark, sf_dir).select("listing_id", "building_size", "city_slug", "price_value"), "price_value")


@register("c11_inference_schema", with_listings(
    f"SELECT {', '.join(c for c in PRICE['inference_columns'] if c not in ('floor_cat', 'total_floors_cat'))} "
    f"FROM ({price_features_sql()}) f"))
def c11(spark, sf_dir):
    expected = [c for c in PRICE["inference_columns"] if c not in ("floor_cat", "total_floors_cat")]
    return C.require_columns(prepare_price_features(listing_view(spark, sf_dir)), expected)
