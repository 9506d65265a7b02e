"""Scalar-function queries (group D) over every listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from abode.catalog import register
from abode.catalog.sqltext import age_bin, age_years, digits, flag_sum, lux_label, num, rooms, tri, with_listings
from abode.config import CREDIT, PRE_1370_LABEL, PRICE
from abode.functions import scalars as S
from abode.functions.bins import interval_bin, interval_bin_sql
from abode.sources.listing_view import listing_view


def _L(spark, sf_dir):
    return listing_view(spark, sf_dir)


@register("d01_persian_digits", with_listings(
    f"SELECT listing_id, {digits('construction_year')} AS construction_year_ascii FROM listings"))
def d01(spark, sf_dir):
    return _L(spark, sf_dir).select("listing_id", S.persian_to_ascii("construction_year").alias("construction_year_ascii"))


@register("d02_rooms_count", with_listings(f"SELECT listing_id, {rooms('rooms_count')} AS rooms_code FROM listings"))
def d02(spark, sf_dir):
    return _L(spark, sf_dir).select("listing_id", S.map_rooms_count("rooms_count").alias("rooms_code"))


_LUX = PRICE["luxury_cols"]


@register("d03_luxury_label", with_listings(
    f"SELECT listing_id, {lux_label(flag_sum(_LUX))} AS luxury_score, "
    f"{lux_label('CASE WHEN listing_id % 50 = 0 THEN NULL ELSE ' + flag_sum(_LUX) + ' END')} AS luxury_score_nullable FROM listings"))
def d03(spark, sf_dir):
    n = S.flag_sum(_LUX)
    return _L(spark, sf_dir).select(
        "listing_id", S.luxury_label(n).alias("luxury_score"),
        S.luxury_label(F.when(F.col("listing_id") % 50 == 0, F.lit(None)).otherwise(n)).alias("luxury_score_nullable"))


@register("d04_flag_sum", with_listings(
    f"SELECT listing_id, CAST({flag_sum(_LUX)} AS BIGINT) AS n_luxury, "
    f"CAST({flag_sum([tri('has_balcony'), 'has_elevator', 'has_warehouse', 'has_parking'])} AS BIGINT) AS n_non_luxury FROM listings"))
def d04(spark, sf_dir):
    return _L(spark, sf_dir).select(
        "listing_id", S.flag_sum(_LUX).alias("n_luxury"),
        S.flag_sum([S.tri_state_bool("has_balcony"), "has_elevator", "has_warehouse", "has_parking"]).alias("n_non_luxury"))


@register("d05_tri_state_bool", with_listings(f"SELECT listing_id, {tri('has_balcony')} AS has_balcony FROM listings"))
def d05(spark, sf_dir):
    return _L(spark, sf_dir).select("listing_id", S.tri_state_bool("has_balcony").alias("has_balcony"))


@register("d06_bool_code", with_listings(
    "SELECT listing_id, coalesce(CAST(is_rebuilt AS INTEGER), -1) AS is_rebuilt, "
    "coalesce(CAST(has_business_deed AS INTEGER), -1) AS has_business_deed, "
    "coalesce(CAST(has_elevator AS INTEGER), -1) AS has_elevator FROM listings"))
def d06(spark, sf_dir):
    return _L(spark, sf_dir).select(
        "listing_id", *[S.bool_code(c).alias(c) for c in ("is_rebuilt", "has_business_deed", "has_elevator")])


@register("d07_to_number", with_listings(
    f"SELECT listing_id, {num('floor')} AS floor_num, {num('total_floors_count')} AS total_floors_num, "
    f"{num('unit_per_floor')} AS unit_num, {num('construction_year')} AS year_num FROM listings"))
def d07(spark, sf_dir):
    return _L(spark, sf_dir).select(
        "listing_id", S.to_number("floor").alias("floor_num"), S.to_number("total_floors_count").alias("total_floors_num"),
        S.to_number("unit_per_floor").alias("unit_num"), S.to_number("construction_year").alias("year_num"))


def _floor_text_sql(x):
    s = f"trim({x})"
    return f"(CASE WHEN {x} IS NULL OR {s} = 'unselect' THEN NULL ELSE {num(f'(CASE WHEN ends_with({s}, {chr(39)}+{chr(39)}) THEN replace({s}, {chr(39)}+{chr(39)}, {chr(39)}{chr(39)}) ELSE {s} END)')} END)"


@register("d08_floor_text", with_listings(
    f"SELECT listing_id, {_floor_text_sql('floor')} AS floor_clean, {_floor_text_sql('total_floors_count')} AS total_floors_clean FROM listings"))
def d08(spark, sf_dir):
    return _L(spark, sf_dir).select(
        "listing_id", S.clean_floor_text("floor").alias("floor_clean"),
        S.clean_floor_text("total_floors_count").alias("total_floors_clean"))


def _unit_sql(x):
    return (f"(CASE WHEN {x} IS NULL OR trim({x}) = 'unselect' THEN NULL WHEN trim({x}) = 'more_than_8' THEN 9.0 "
            f"ELSE {num(x)} END)")


@register("d09_unit_per_floor", with_listings(f"SELECT listing_id, {_unit_sql('unit_per_floor')} AS unit_per_floor FROM listings"))
def d09(spark, sf_dir):
    return _L(spark, sf_dir).select("listing_id", S.clean_unit_per_floor("unit_per_floor").alias("unit_per_floor"))


@register("d10_clamp_negative", with_listings(
    f"SELECT listing_id, CASE WHEN {num('floor')} < 0 THEN 0.0 ELSE {num('floor')} END AS floor_clamped, "
    "CASE WHEN rent_value < 0 THEN 0.0 ELSE rent_value END AS rent_clamped FROM listings"))
def d10(spark, sf_dir):
    return _L(spark, sf_dir).select(
        "listing_id", S.clamp_negative(S.to_number("floor")).alias("floor_clamped"),
        S.clamp_negative("rent_value").alias("rent_clamped"))


@register("d11_total_credit", with_listings(
    "SELECT listing_id, CASE WHEN rent_value < 0 OR credit_value < 0 THEN 0.0 "
    "ELSE (credit_value + (rent_value * 100) / 3) * 6 END AS total_credit FROM listings"))
def d11(spark, sf_dir):
    return _L(spark, sf_dir).select("listing_id", S.total_credit("rent_value", "credit_value").alias("total_credit"))


@register("d12_building_age_years", with_listings(
    f"SELECT listing_id, {age_years('construction_year')} AS building_age_years FROM listings"))
def d12(spark, sf_dir):
    return _L(spark, sf_dir).select("listing_id", S.building_age_years("construction_year").alias("building_age_years"))


@register("d13a_pre1370_package", with_listings(
    f"SELECT listing_id, {age_bin('construction_year')} AS building_age FROM listings"))
def d13a(spark, sf_dir):
    from abode.plans.price import add_building_age
    return add_building_age(_L(spark, sf_dir).select("listing_id", "construction_year"), PRICE)


@register("d13b_pre1370_documented", with_listings(
    f"SELECT listing_id, {age_bin('construction_year', PRICE, [PRE_1370_LABEL])} AS building_age FROM listings"))
def d13b(spark, sf_dir):
    from abode.plans.price import add_building_age
    return add_building_age(_L(spark, sf_dir).select("listing_id", "construction_year"), PRICE, [PRE_1370_LABEL])


_FLOOR_NUM = f"CASE WHEN {num('floor')} < 0 THEN 0.0 ELSE {num('floor')} END"


@register("d14_interval_bins", with_listings(
    f"SELECT listing_id, "
    f"{interval_bin_sql('(' + _FLOOR_NUM + ')', PRICE['floor_bins'], PRICE['floor_labels'])} AS price_floor_cat, "
    f"{interval_bin_sql(_floor_text_sql('floor'), CREDIT['floor_bins'], CREDIT['floor_labels'])} AS credit_floor, "
    f"{interval_bin_sql(num('total_floors_count'), PRICE['total_floors_bins'], PRICE['total_floors_labels'])} AS price_total_floors_cat "
    "FROM listings"))
def d14(spark, sf_dir):
    L = _L(spark, sf_dir)
    return L.select(
        "listing_id",
        interval_bin(S.clamp_negative(S.to_number("floor")), PRICE["floor_bins"], PRICE["floor_labels"]).alias("price_floor_cat"),
        interval_bin(S.clean_floor_text("floor"), CREDIT["floor_bins"], CREDIT["floor_labels"]).alias("credit_floor"),
        interval_bin(S.to_number("total_floors_count"), PRICE["total_floors_bins"], PRICE["total_floors_labels"]).alias("price_total_floors_cat"))


@register("d14a_include_lowest", with_listings(
    f"SELECT listing_id, {interval_bin_sql(_unit_sql('unit_per_floor'), CREDIT['unit_bins'], CREDIT['unit_labels'], include_lowest=True)} AS unit_bin, "
    f"{interval_bin_sql('CAST(listing_id % 10 AS DOUBLE) / 2', CREDIT['unit_bins'], CREDIT['unit_labels'], include_lowest=True)} AS half_unit_bin "
    "FROM listings"))
def d14a(spark, sf_dir):
    L = _L(spark, sf_dir)
    return L.select(
        "listing_id",
        interval_bin(S.clean_unit_per_floor("unit_per_floor"), CREDIT["unit_bins"], CREDIT["unit_labels"], include_lowest=True).alias("unit_bin"),
        interval_bin((F.col("listing_id") % 10).cast("double") / 2, CREDIT["unit_bins"], CREDIT["unit_labels"], include_lowest=True).alias("half_unit_bin"))


@register("d14b_missing_label", with_listings(
    f"SELECT listing_id, {interval_bin_sql(_floor_text_sql('floor'), CREDIT['floor_bins'], CREDIT['floor_labels'], missing='unselect')} AS floor, "
    f"{interval_bin_sql(_floor_text_sql('total_floors_count'), CREDIT['total_floors_bins'], CREDIT['total_floors_labels'], missing='unselect')} AS total_floors_count "
    "FROM listings"))
def d14b(spark, sf_dir):
    L = _L(spark, sf_dir)
    return L.select(
        "listing_id",
        interval_bin(S.clean_floor_text("floor"), CREDIT["floor_bins"], CREDIT["floor_labels"], missing="unselect").alias("floor"),
        interval_bin(S.clean_floor_text("total_floors_count"), CREDIT["total_floors_bins"], CREDIT["total_floors_labels"], missing="unselect").alias("total_floors_count"))


def _money_sql(x):
    return (f"CASE WHEN {x} >= 1e12 THEN format('{{:,.2f}}', {x} / 1e12) || 'T IRR' "
            f"WHEN {x} >= 1e9 THEN format('{{:,.2f}}', {x} / 1e9) || 'B IRR' "
            f"WHEN {x} >= 1e6 THEN format('{{:,.1f}}', {x} / 1e6) || 'M IRR' "
            f"ELSE format('{{:,.0f}}', {x}) || ' IRR' END")


@register("d15_format_money", with_listings(
    f"SELECT listing_id, {_money_sql('price_value')} AS price_text, {_money_sql('credit_value')} AS credit_text, "
    f"{_money_sql('rent_value')} AS rent_text FROM listings"))
def d15(spark, sf_dir):
    return _L(spark, sf_dir).select(
        "listing_id", S.format_money("price_value").alias("price_text"), S.format_money("credit_value").alias("credit_text"),
        S.format_money("rent_value").alias("rent_text"))


@register("d16_percent_error", with_listings(
    "SELECT listing_id, CASE WHEN land_size - 50 IS NULL THEN NULL WHEN land_size - 50 = 0 THEN 0.0 "
    "ELSE 100.0 * (building_size - (land_size - 50)) / (land_size - 50) END AS pct_error FROM listings"))
def d16(spark, sf_dir):
    return _L(spark, sf_dir).select(
        "listing_id", S.percent_error("building_size", F.col("land_size") - 50).alias("pct_error"))


@register("d17_coerce_number", with_listings(
    f"SELECT listing_id, coalesce({num('floor')}, -1.0) AS floor_num, coalesce({num('unit_per_floor')}, 0.0) AS unit_num FROM listings"))
def d17(spark, sf_dir):
    return _L(spark, sf_dir).select(
        "listing_id", S.coerce_number("floor", -1.0).alias("floor_num"), S.coerce_number("unit_per_floor").alias("unit_num"))
