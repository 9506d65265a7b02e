"""SQL text helpers for the oracle side: the listing view and feature expressions in SQL."""

from __future__ import annotations

from abode.config import PRICE, ROOM_COUNT_MAP
from abode.functions.bins import interval_bin_sql
from abode.sources.listing_view import listing_view_sql

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def with_listings(body: str) -> str:
    """Prefix a query with the listing view as a CTE named ``listings``."""
    return f"WITH listings AS (\n{listing_view_sql()}\n)\n{body}"


def num(x: str) -> str:
    return f"(CASE WHEN regexp_matches(CAST({x} AS VARCHAR), '{NUM_RE}') THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END)"


def digits(x: str) -> str:
    return f"translate({x}, '۰۱۲۳۴۵۶۷۸۹', '0123456789')"


def rooms(x: str) -> str:
    whens = " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in ROOM_COUNT_MAP.items())
    return f"(CASE {whens} ELSE 'unselect' END)"


def lux_label(n: str) -> str:
    return f"(CASE WHEN {n} IS NULL THEN 'unselect' WHEN {n} = 0 THEN 'none' WHEN {n} <= 2 THEN 'low' WHEN {n} <= 4 THEN 'medium' ELSE 'high' END)"


def tri(x: str) -> str:
    return f"(CASE WHEN {x} = 'true' THEN TRUE WHEN {x} IN ('false','unselect') THEN FALSE END)"


def flag_sum(cols) -> str:
    return "(" + " + ".join(f"coalesce(CAST({c} AS INTEGER), 0)" for c in cols) + ")"


def age_years(x: str, pre_labels=()) -> str:
    y = digits(x)
    if pre_labels:
        lst = ", ".join(f"'{p}'" for p in pre_labels)
        y = f"(CASE WHEN {y} IN ({lst}) THEN '1370' ELSE {y} END)"
    return f"(1404.0 - {num(y)})"


def age_bin(x: str, cfg=PRICE, pre_labels=()) -> str:
    ba = cfg["building_age"]
    edges = [0.0, *[float(b) for b in ba["bins"][1:]], float("inf")]
    return interval_bin_sql(age_years(x, pre_labels), edges, ba["labels"], missing="unselect")


def price_features_sql(pre_labels=()) -> str:
    """P1 as one SELECT over ``listings``."""
    cfg = PRICE
    o = cfg["outliers"]
    sells = ", ".join(f"'{s}'" for s in cfg["sell_cat2_slugs"])
    lux = lux_label(flag_sum(cfg["luxury_cols"]))
    non_cols = [tri("has_balcony") if c == "has_balcony" else c for c in cfg["non_luxury_cols"]]
    non = lux_label(flag_sum(non_cols))
    return f"""
SELECT listing_id, coalesce(cat2_slug, 'unselect') AS cat2_slug, coalesce(cat3_slug, 'unselect') AS cat3_slug,
       city_slug, building_size, coalesce(deed_type, 'unselect') AS deed_type, has_business_deed, floor,
       {rooms('rooms_count')} AS rooms_count, is_rebuilt, coalesce(floor_material, 'unselect') AS floor_material,
       total_floors_count, location_latitude, location_longitude, neighborhood_slug, price_value,
       {age_bin('construction_year', cfg, pre_labels)} AS building_age,
       {lux} AS luxury_score, {non} AS non_luxury_score
FROM listings
WHERE price_value IS NOT NULL AND cat2_slug IN ({sells})
  AND NOT coalesce(cat3_slug LIKE '%-rent%', FALSE)
  AND building_size IS NOT NULL AND city_slug IS NOT NULL
  AND building_size BETWEEN {o['building_size_min']} AND {o['building_size_max']}
  AND price_value BETWEEN {o['price_value_min']} AND {o['price_value_max']}
"""


def hash_u(key: str, seed: int) -> str:
    from abode.operators.split import hash_uniform_sql
    return hash_uniform_sql(key, seed)


def _floor_n(x: str) -> str:
    return f"(CASE WHEN {num(x)} < 0 THEN 0.0 ELSE {num(x)} END)"


def _mode_cte(name: str, src: str, col: str) -> str:
    return (f"{name} AS (SELECT {col} AS m FROM {src} WHERE split = 'train' AND {col} IS NOT NULL "
            f"GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)")


LOC = ("location_latitude", "location_longitude")


def _loc_ctes(src: str, fallback_test: bool) -> str:
    ctes = [
        f"tr AS (SELECT * FROM {src} WHERE split = 'train')",
        "cs AS (SELECT city_slug AS cs_city, TRUE AS known, avg(location_latitude) AS cm0, avg(location_longitude) AS cm1 "
        "FROM tr WHERE city_slug IS NOT NULL GROUP BY city_slug)",
        "g AS (SELECT avg(location_latitude) AS g0, avg(location_longitude) AS g1 FROM tr)",
    ]
    if fallback_test:
        ctes.append(
            "gi AS (SELECT avg(CASE WHEN tr.city_slug IS NULL THEN g0 ELSE coalesce(location_latitude, cm0, g0) END) AS i0, "
            "avg(CASE WHEN tr.city_slug IS NULL THEN g1 ELSE coalesce(location_longitude, cm1, g1) END) AS i1 "
            "FROM tr LEFT JOIN cs ON tr.city_slug = cs.cs_city CROSS JOIN g)")
    return ",\n".join(ctes)


def _loc_expr(i: int, col: str, fallback_test: bool) -> str:
    train = f"CASE WHEN city_slug IS NULL THEN g{i} ELSE coalesce({col}, cm{i}, g{i}) END"
    other = f"coalesce({col}, cm{i}, g{i})"
    expr = f"CASE WHEN split = 'train' THEN {train} ELSE {other} END"
    if fallback_test:
        test = f"coalesce({col}, CASE WHEN known THEN coalesce(cm{i}, g{i}) END, i{i})"
        expr = f"CASE WHEN split = 'test' THEN {test} ELSE {expr} END"
    return f"round({expr}, 5)"


def price_dataset_sql() -> str:
    from abode.config import PRICE as P
    fb = interval_bin_sql("floor", P["floor_bins"], P["floor_labels"])
    tb = interval_bin_sql("total_floors_count", P["total_floors_bins"], P["total_floors_labels"])
    cols = [c for c in P["inference_columns"] if c not in LOC + ("floor_cat", "total_floors_cat")]
    return with_listings(f""", f AS ({price_features_sql()}),
s AS (SELECT *, CASE WHEN {hash_u('listing_id', 42)} < 0.2 THEN 'val' ELSE 'train' END AS split FROM f),
s2 AS (SELECT * FROM s WHERE split <> 'train' OR (location_latitude IS NOT NULL AND location_longitude IS NOT NULL)),
fl AS (SELECT * REPLACE ({_floor_n('floor')} AS floor, {_floor_n('total_floors_count')} AS total_floors_count) FROM s2),
{_mode_cte('mf', 'fl', 'floor')},
{_mode_cte('mt', 'fl', 'total_floors_count')},
ff AS (SELECT * REPLACE (CAST(trunc(coalesce(floor, (SELECT m FROM mf))) AS INTEGER) AS floor,
                         CAST(trunc(coalesce(total_floors_count, (SELECT m FROM mt))) AS INTEGER) AS total_floors_count) FROM fl),
{_loc_ctes('ff', False)}
SELECT listing_id, {', '.join(cols)}, {_loc_expr(0, 'location_latitude', False)} AS location_latitude,
       {_loc_expr(1, 'location_longitude', False)} AS location_longitude, {fb} AS floor_cat, {tb} AS total_floors_cat,
       price_value, split
FROM ff LEFT JOIN cs ON ff.city_slug = cs.cs_city CROSS JOIN g""").replace("WITH listings AS (\n", "WITH listings AS (\n", 1).replace(")\n, f AS", "), f AS", 1)


def _floor_text(x: str) -> str:
    s = f"trim({x})"
    inner = f"(CASE WHEN ends_with({s}, '+') THEN replace({s}, '+', '') ELSE {s} END)"
    return f"(CASE WHEN {x} IS NULL OR {s} = 'unselect' THEN NULL ELSE {num(inner)} END)"


def _unit(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR trim({x}) = 'unselect' THEN NULL WHEN trim({x}) = 'more_than_8' THEN 9.0 "
            f"ELSE {num(x)} END)")


def credit_features_sql() -> str:
    """P3 as CTEs over ``listings``; ends with a CTE named ``cf``."""
    from abode.config import CREDIT as C
    o = C["outliers"]
    fb = interval_bin_sql(_floor_text("floor"), C["floor_bins"], C["floor_labels"], missing="unselect")
    tb = interval_bin_sql(_floor_text("total_floors_count"), C["total_floors_bins"], C["total_floors_labels"], missing="unselect")
    ub = interval_bin_sql(_unit("unit_per_floor"), C["unit_bins"], C["unit_labels"], include_lowest=True, missing="unselect")
    lux = lux_label(flag_sum(C["luxury_cols"]))
    non = lux_label(flag_sum([tri("has_balcony") if c == "has_balcony" else c for c in C["non_luxury_cols"]]))
    f = C["rare_category"]["min_freq"]
    return f""", r AS (SELECT * FROM listings WHERE price_value IS NULL AND rent_value IS NOT NULL AND credit_value IS NOT NULL),
c1 AS (SELECT listing_id, cat2_slug, cat3_slug, city_slug, neighborhood_slug, building_size, is_rebuilt,
              location_latitude, location_longitude, has_warm_water_provider, has_heating_system, has_cooling_system,
              has_restroom, building_direction, floor_material,
              CASE WHEN rent_value < 0 OR credit_value < 0 THEN 0.0 ELSE (credit_value + (rent_value * 100) / 3) * 6 END AS total_credit,
              {fb} AS floor, {tb} AS total_floors_count, {rooms('rooms_count')} AS rooms_count, {ub} AS unit_per_floor,
              {age_bin('construction_year', C)} AS building_age, {lux} AS luxury_items, {non} AS non_luxury_items
       FROM r),
k3 AS (SELECT cat3_slug AS lvl FROM c1 WHERE cat3_slug IS NOT NULL GROUP BY cat3_slug
       HAVING count(*) / (SELECT count(*) FROM c1 WHERE cat3_slug IS NOT NULL) >= CAST({f} AS DOUBLE)),
k2 AS (SELECT cat2_slug AS lvl FROM c1 WHERE cat2_slug IS NOT NULL GROUP BY cat2_slug
       HAVING count(*) / (SELECT count(*) FROM c1 WHERE cat2_slug IS NOT NULL) >= CAST({f} AS DOUBLE)),
cf AS (SELECT * REPLACE (
         CASE WHEN cat3_slug IS NULL THEN NULL WHEN cat3_slug IN (SELECT lvl FROM k3) THEN cat3_slug ELSE 'Other' END AS cat3_slug,
         CASE WHEN cat2_slug IS NULL THEN NULL WHEN cat2_slug IN (SELECT lvl FROM k2) THEN cat2_slug ELSE 'Other' END AS cat2_slug)
       FROM c1
       WHERE total_credit BETWEEN {o['total_credit_min']} AND {o['total_credit_max']}
         AND building_size BETWEEN {o['building_size_min']} AND {o['building_size_max']})"""


def credit_dataset_sql() -> str:
    from abode.config import CREDIT as C
    sp = C["split"]
    fill = C["fill_unselect_cols"]
    cols = []
    for c in C["inference_columns"]:
        if c in LOC:
            i = LOC.index(c)
            cols.append(f"{_loc_expr(i, c, True)} AS {c}")
        elif c in fill:
            cols.append(f"coalesce({c}, 'unselect') AS {c}")
        else:
            cols.append(c)
    return with_listings(f"""{credit_features_sql()},
s AS (SELECT *, CASE WHEN {hash_u('listing_id', sp['random_state'])} < {sp['test_size']} THEN 'test'
                     WHEN {hash_u('listing_id', sp['random_state'] + 1)} < {sp['val_size']} THEN 'val' ELSE 'train' END AS split
      FROM cf WHERE building_size IS NOT NULL),
{_loc_ctes('s', True)}
SELECT listing_id, {', '.join(cols)}, total_credit, split
FROM s LEFT JOIN cs ON s.city_slug = cs.cs_city CROSS JOIN g CROSS JOIN gi
WHERE s.city_slug IS NOT NULL""").replace(")\n, r AS", "), r AS", 1)
