"""Split, imputation, rare-level and dataset queries (groups J, E1-E4, F, G1, P2-P4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from abode.catalog import register
from abode.catalog.sqltext import (credit_dataset_sql, credit_features_sql, hash_u, price_dataset_sql,
                                   price_features_sql, with_listings)
from abode.config import CREDIT, PRICE
from abode.operators import impute as I
from abode.operators import split as J
from abode.plans.credit import prepare_credit_dataset, prepare_credit_features
from abode.plans.price import prepare_price_dataset, prepare_price_features
from abode.sources.listing_view import listing_view

_LOC = ("location_latitude", "location_longitude")


def _round_loc(df):
    return df.withColumns({c: F.round(c, 5) for c in _LOC})


@register("j01_hash_split", with_listings(
    f"SELECT listing_id, CASE WHEN {hash_u('listing_id', 42)} < 0.2 THEN 'val' ELSE 'train' END AS split FROM listings"))
def j01(spark, sf_dir):
    return J.two_way_split(listing_view(spark, sf_dir).select("listing_id"), "listing_id", 0.2, 42)


@register("j02_three_way_split", with_listings(
    f"SELECT listing_id, CASE WHEN {hash_u('listing_id', 42)} < 0.15 THEN 'test' "
    f"WHEN {hash_u('listing_id', 43)} < 0.1275 THEN 'val' ELSE 'train' END AS split FROM listings"))
def j02(spark, sf_dir):
    return J.three_way_split(listing_view(spark, sf_dir).select("listing_id"), "listing_id", 0.15, 0.1275, 42)


@register("j03_exact_split", with_listings(
    f"SELECT listing_id, CASE WHEN row_number() OVER (ORDER BY {hash_u('listing_id', 42)}, listing_id) "
    f"<= ceil(count(*) OVER () * 0.2) THEN 'val' ELSE 'train' END AS split FROM listings"))
def j03(spark, sf_dir):
    return J.exact_two_way_split(listing_view(spark, sf_dir).select("listing_id"), "listing_id", 0.2, 42)


@register("j03_exact_three_way_split", with_listings(
    f""", t AS (SELECT listing_id, row_number() OVER (ORDER BY {hash_u('listing_id', 42)}, listing_id)
        <= ceil(count(*) OVER () * 0.15) AS is_test FROM listings),
r AS (SELECT listing_id, row_number() OVER (ORDER BY {hash_u('listing_id', 43)}, listing_id)
        <= ceil(count(*) OVER () * 0.1275) AS is_val FROM t WHERE NOT is_test)
SELECT listing_id, 'test' AS split FROM t WHERE is_test
UNION ALL SELECT listing_id, CASE WHEN is_val THEN 'val' ELSE 'train' END AS split FROM r""".replace("\n, t AS", ", t AS")))
def j03b(spark, sf_dir):
    return J.exact_three_way_split(listing_view(spark, sf_dir).select("listing_id"), "listing_id", 0.15, 0.1275, 42)


@register("e01_rare_levels", with_listings(
    """, r AS (SELECT listing_id, cat2_slug, cat3_slug FROM listings
           WHERE price_value IS NULL AND rent_value IS NOT NULL AND credit_value IS NOT NULL),
k3 AS (SELECT cat3_slug AS lvl FROM r WHERE cat3_slug IS NOT NULL GROUP BY cat3_slug
       HAVING count(*) / (SELECT count(*) FROM r WHERE cat3_slug IS NOT NULL) >= CAST(0.01 AS DOUBLE)),
k2 AS (SELECT cat2_slug AS lvl FROM r WHERE cat2_slug IS NOT NULL GROUP BY cat2_slug
       HAVING count(*) / (SELECT count(*) FROM r WHERE cat2_slug IS NOT NULL) >= CAST(0.01 AS DOUBLE))
SELECT listing_id,
  CASE WHEN cat3_slug IS NULL THEN NULL WHEN cat3_slug IN (SELECT lvl FROM k3) THEN cat3_slug ELSE 'Other' END AS cat3_slug,
  CASE WHEN cat2_slug IS NULL THEN NULL WHEN cat2_slug IN (SELECT lvl FROM k2) THEN cat2_slug ELSE 'Other' END AS cat2_slug
FROM r"""))
def e01(spark, sf_dir):
    from abode.operators.projections import rent_rows
    r = rent_rows(listing_view(spark, sf_dir)).select("listing_id", "cat2_slug", "cat3_slug")
    return I.collapse_rare(r, I.frequent_levels(r, ["cat3_slug", "cat2_slug"], 0.01), "Other")




@register("e02_mode_fill", with_listings(
    """, f AS (SELECT listing_id, CASE WHEN fl < 0 THEN 0.0 ELSE fl END AS floor FROM (
    SELECT listing_id, CASE WHEN regexp_matches(floor, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
                THEN TRY_CAST(trim(floor) AS DOUBLE) END AS fl FROM listings) x),
m AS (SELECT floor AS m FROM f WHERE floor IS NOT NULL GROUP BY floor ORDER BY count(*) DESC, floor LIMIT 1)
SELECT listing_id, CAST(trunc(coalesce(floor, (SELECT m FROM m))) AS INTEGER) AS floor FROM f""".replace("\\\\", "\\")))
def e02(spark, sf_dir):
    from abode.functions import scalars as S
    L = listing_view(spark, sf_dir).select("listing_id", S.clamp_negative(S.to_number("floor")).alias("floor"))
    return I.fill_mode(L, "floor", L)


@register("e03_global_mean", with_listings(
    "SELECT round(avg(location_latitude), 4) AS mean_latitude, round(avg(building_size), 4) AS mean_building_size FROM listings"))
def e03(spark, sf_dir):
    L = listing_view(spark, sf_dir)
    return L.agg(F.round(F.avg("location_latitude"), 4).alias("mean_latitude"),
                 F.round(F.avg("building_size"), 4).alias("mean_building_size"))


@register("e04_group_mean", with_listings(
    "SELECT city_slug, round(avg(location_latitude), 6) AS location_latitude_mean, "
    "round(avg(location_longitude), 6) AS location_longitude_mean FROM listings GROUP BY city_slug"))
def e04(spark, sf_dir):
    g = I.group_mean(listing_view(spark, sf_dir), "city_slug", list(_LOC))
    return g.select("city_slug", *[F.round(f"{c}_mean", 6).alias(f"{c}_mean") for c in _LOC])


@register("g01_group_mean_window", with_listings(
    "SELECT listing_id, round(coalesce(location_latitude, avg(location_latitude) OVER (PARTITION BY city_slug)), 4) "
    "AS location_latitude FROM listings"))
def g01(spark, sf_dir):
    L = listing_view(spark, sf_dir).select("listing_id", "city_slug", "location_latitude")
    return I.fill_group_mean(L, "city_slug", "location_latitude").select(
        "listing_id", F.round("location_latitude", 4).alias("location_latitude"))


@register("p2_price_dataset", price_dataset_sql())
def p2(spark, sf_dir):
    d = prepare_price_dataset(listing_view(spark, sf_dir))
    return _round_loc(d.select("listing_id", *PRICE["inference_columns"], "price_value", "split"))


@register("p3_credit_features", with_listings(credit_features_sql() + "\nSELECT * FROM cf"))
def p3(spark, sf_dir):
    return prepare_credit_features(listing_view(spark, sf_dir))


@register("p4_credit_dataset", credit_dataset_sql())
def p4(spark, sf_dir):
    return _round_loc(prepare_credit_dataset(listing_view(spark, sf_dir)))


@register("f01_f02_location_price", f"""WITH d AS ({price_dataset_sql()})
SELECT listing_id, split, location_latitude, location_longitude FROM d""")
def f01(spark, sf_dir):
    d = _round_loc(prepare_price_dataset(listing_view(spark, sf_dir)))
    return d.select("listing_id", "split", *_LOC)


@register("f02a_location_credit_three_way", f"""WITH d AS ({credit_dataset_sql()})
SELECT listing_id, split, location_latitude, location_longitude FROM d""")
def f02a(spark, sf_dir):
    d = _round_loc(prepare_credit_dataset(listing_view(spark, sf_dir)))
    return d.select("listing_id", "split", *_LOC)
