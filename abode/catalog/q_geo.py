"""Geography and statistics queries (group M) over the sale-listing features."""

from __future__ import annotations

from pyspark.sql import functions as F

from abode.catalog import register
from abode.catalog.sqltext import price_features_sql, with_listings
from abode.operators import geo as G
from abode.operators.dbscan import dbscan
from abode.plans.price import prepare_price_features
from abode.sources.listing_view import listing_view
from abode.sources.tables import read_table

TARGETS = ["NATION_0-0", "NATION_3-3", "NATION_12-5"]


def _features(spark, sf_dir):
    return prepare_price_features(listing_view(spark, sf_dir))


def _with_class(spark, sf_dir):
    f = _features(spark, sf_dir)
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    # nation (25 rows) x region (5 rows) is a fixed-size lookup: broadcast.
    cls = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("city_slug"), F.col("r_name").alias("city_class"))
    return f.join(F.broadcast(cls), "city_slug", "left").withColumn(
        "price_per_m2", F.col("price_value") / F.col("building_size"))


_F_SQL = f", f AS ({price_features_sql()})"
_CLS_SQL = (_F_SQL + ",\nfc AS (SELECT f.*, r_name AS city_class, price_value / building_size AS price_per_m2 FROM f "
            "LEFT JOIN nation ON f.city_slug = nation.n_name LEFT JOIN region ON nation.n_regionkey = region.r_regionkey)")


@register("m01_kmeans_clusters")
def m01(spark, sf_dir):
    clusters, sil = G.kmeans_clusters(listing_view(spark, sf_dir), k=8, seed=42)
    return clusters.withColumn("silhouette", F.lit(sil))


# M2 parameters (fixed values of this query): radius in coordinate degrees and the minimum
# number of rows within it for a core listing.
DBSCAN_EPS, DBSCAN_MIN_SAMPLES = 0.01, 4


@register("m02_dbscan_clusters")
def m02(spark, sf_dir):
    # Rows-only at the driver: the exact result is checked against a brute-force DBSCAN in
    # tests/test_dbscan.py (SQL has no practical form for the connected components).
    return dbscan(listing_view(spark, sf_dir), DBSCAN_EPS, DBSCAN_MIN_SAMPLES,
                  G.LAT, G.LON, key="listing_id")


_PROF_SQL = _F_SQL + """,
p AS (SELECT neighborhood_slug, city_slug, count(*) AS n_listings, avg(price_value / building_size) AS price_per_m2,
             avg(building_size) AS mean_size, avg(location_latitude) AS lat, avg(location_longitude) AS lon
      FROM f WHERE neighborhood_slug IS NOT NULL GROUP BY neighborhood_slug, city_slug),
st AS (SELECT avg(price_per_m2) AS m1, stddev_samp(price_per_m2) AS s1, avg(mean_size) AS m2, stddev_samp(mean_size) AS s2,
              avg(lat) AS m3, stddev_samp(lat) AS s3, avg(lon) AS m4, stddev_samp(lon) AS s4 FROM p),
z AS (SELECT neighborhood_slug, (price_per_m2 - m1) / s1 AS a, (mean_size - m2) / s2 AS b, (lat - m3) / s3 AS c,
             (lon - m4) / s4 AS d FROM p, st
      WHERE price_per_m2 IS NOT NULL AND mean_size IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL)"""


@register("m03_similar_neighbourhoods", with_listings(_PROF_SQL + """,
d AS (SELECT t.neighborhood_slug AS target, z.neighborhood_slug AS neighbour,
             sqrt(0.0 + (z.a - t.a) * (z.a - t.a) + (z.b - t.b) * (z.b - t.b) + (z.c - t.c) * (z.c - t.c) + (z.d - t.d) * (z.d - t.d)) AS distance
      FROM z JOIN z t ON z.neighborhood_slug <> t.neighborhood_slug
      WHERE t.neighborhood_slug IN (""" + ", ".join(f"'{t}'" for t in TARGETS) + """)),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, neighbour) AS rank FROM d)
SELECT target, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""))
def m03(spark, sf_dir):
    prof = G.neighbourhood_profiles(_features(spark, sf_dir))
    out = G.similar_neighbourhoods(prof, TARGETS, k=5)
    return out.select("target", "neighbour", F.round("distance", 6).alias("distance"), "rank")


@register("m03b_similar_neighbourhoods_by_city", with_listings(_PROF_SQL.replace("z AS (SELECT neighborhood_slug,", "z AS (SELECT city_slug, neighborhood_slug,") + """,
d AS (SELECT t.city_slug AS target_city, t.neighborhood_slug AS target, z.city_slug AS neighbour_city, z.neighborhood_slug AS neighbour,
             sqrt(0.0 + (z.a - t.a) * (z.a - t.a) + (z.b - t.b) * (z.b - t.b) + (z.c - t.c) * (z.c - t.c) + (z.d - t.d) * (z.d - t.d)) AS distance
      FROM z JOIN z t ON z.neighborhood_slug <> t.neighborhood_slug OR z.city_slug IS DISTINCT FROM t.city_slug
      WHERE t.neighborhood_slug IN (""" + ", ".join(f"'{t}'" for t in TARGETS) + """)),
r AS (SELECT *, row_number() OVER (PARTITION BY target_city, target ORDER BY distance, neighbour, neighbour_city NULLS FIRST) AS rank FROM d)
SELECT target_city, target, neighbour_city, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""))
def m03b(spark, sf_dir):
    out = G.similar_neighbourhoods(G.neighbourhood_profiles(_features(spark, sf_dir)), TARGETS, k=5)
    return out.select("target_city", "target", "neighbour_city", "neighbour", F.round("distance", 6).alias("distance"), "rank")


@register("m04_summaries_by_city_class", with_listings(_CLS_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT city_class, '{c}' AS column_name, count({c}) AS count, round(avg({c}), 1) AS mean, "
    f"round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 1) AS std FROM fc "
    f"WHERE city_class IS NOT NULL AND {c} IS NOT NULL GROUP BY city_class" for c in ("price_value", "building_size"))))
def m04(spark, sf_dir):
    s = G.summaries_by_group(_with_class(spark, sf_dir), "city_class", ["price_value", "building_size"])
    return s.select("city_class", "column_name", "count", F.round("mean", 1).alias("mean"),
                    F.round("median", 4).alias("median"), F.round("std", 1).alias("std"))


@register("m05_welch_t", with_listings(_CLS_SQL + """,
g AS (SELECT cat2_slug, count(*) AS n, avg(price_per_m2) AS m, var_samp(price_per_m2) AS v FROM fc
      WHERE cat2_slug IN ('residential-sell', 'commercial-sell') AND price_per_m2 IS NOT NULL GROUP BY cat2_slug)
SELECT 'residential-sell' AS group_a, 'commercial-sell' AS group_b, a.n AS n_0, b.n AS n_1,
       round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 8) AS t
FROM g a, g b WHERE a.cat2_slug = 'residential-sell' AND b.cat2_slug = 'commercial-sell'"""))
def m05(spark, sf_dir):
    t = G.welch_t(_with_class(spark, sf_dir), "cat2_slug", "price_per_m2", "residential-sell", "commercial-sell")
    return t.select("group_a", "group_b", "n_0", "n_1", F.round("t", 8).alias("t"))


@register("m05b_anova_f", with_listings(_CLS_SQL + """,
d AS (SELECT * FROM fc WHERE city_class IS NOT NULL AND price_per_m2 IS NOT NULL),
g AS (SELECT city_class, count(*) AS n, avg(price_per_m2) AS m, var_samp(price_per_m2) AS v FROM d GROUP BY city_class),
gm AS (SELECT avg(price_per_m2) AS grand FROM d)
SELECT count(*) AS k, sum(n) AS n_total,
       round((sum(n * (m - grand) * (m - grand)) / (count(*) - 1)) / (sum((n - 1) * coalesce(v, 0.0)) / (sum(n) - count(*))), 8) AS f
FROM g, gm"""))
def m05b(spark, sf_dir):
    a = G.anova_f(_with_class(spark, sf_dir), "city_class", "price_per_m2")
    return a.select("k", "n_total", F.round("f", 8).alias("f"))


@register("m05c_chi_square", with_listings(_F_SQL + """,
d AS (SELECT * FROM f WHERE cat2_slug IS NOT NULL AND building_age IS NOT NULL),
r AS (SELECT cat2_slug, count(*) AS rt FROM d GROUP BY 1), c AS (SELECT building_age, count(*) AS ct FROM d GROUP BY 1),
o AS (SELECT cat2_slug, building_age, count(*) AS o FROM d GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM d)
SELECT round(sum((coalesce(o.o, 0) - rt * ct / n) * (coalesce(o.o, 0) - rt * ct / n) / (rt * ct / n)), 8) AS chi2,
       CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS BIGINT) AS dof
FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o ON o.cat2_slug = r.cat2_slug AND o.building_age = c.building_age"""))
def m05c(spark, sf_dir):
    ch = G.chi_square(_features(spark, sf_dir), "cat2_slug", "building_age")
    return ch.select(F.round("chi2", 8).alias("chi2"), F.col("dof").cast("long").alias("dof"))
