"""Drift queries (group L): train versus validation listings, early versus late lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from abode.catalog import register
from abode.catalog.sqltext import hash_u, price_features_sql, with_listings
from abode.operators import drift as L
from abode.operators.contracts import column_counts
from abode.operators.split import two_way_split
from abode.plans.price import prepare_price_features
from abode.session import scratch_path
from abode.sources.listing_view import listing_view
from abode.sources.tables import read_table

P_NUM = ["building_size", "location_latitude", "location_longitude"]
P_CAT = ["cat2_slug", "building_age", "rooms_count", "luxury_score", "is_rebuilt"]
P_SUBSET = P_NUM + P_CAT + ["price_value", "not_in_frames"]

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
LI_CAT = ["l_returnflag", "l_linestatus"]
LI_CUT = "1995-06-17"


def drift_sql(num_cols, cat_cols, threshold=0.1, max_cat=5) -> str:
    """Body (CTEs after ``ref``/``cur``) computing the per-column drift report in SQL."""
    def lng(cols, t):
        return "\nUNION ALL\n".join(
            f"SELECT '{c}' AS column_name, CAST({c} AS {t}) AS value, '{side}' AS side FROM {side} WHERE {c} IS NOT NULL"
            + ("" if t == "VARCHAR" else f" AND NOT isnan(CAST({c} AS DOUBLE))")
            for side in ("ref", "cur") for c in cols)
    js = lambda src: f"""SELECT column_name, sqrt(greatest(0.0, 0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0.0 END)
                                   + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0.0 END))) AS js
      FROM (SELECT column_name, p, q, (p + q) / 2 AS m FROM (
              SELECT column_name, c_ref / sum(c_ref) OVER (PARTITION BY column_name) AS p,
                     c_cur / sum(c_cur) OVER (PARTITION BY column_name) AS q
              FROM (SELECT column_name, value, count(*) FILTER (WHERE side = 'ref') AS c_ref,
                           count(*) FILTER (WHERE side = 'cur') AS c_cur FROM {src} GROUP BY column_name, value) c) x) y
      GROUP BY column_name"""
    parts = []
    ctes = []
    if num_cols:
        ctes.append(f"ln AS ({lng(num_cols, 'DOUBLE')})")
        ctes.append(f"ls AS ({lng(num_cols, 'VARCHAR')})")
        ctes.append("""cnt AS (SELECT column_name, value, count(*) FILTER (WHERE side = 'ref') AS c_ref,
                    count(*) FILTER (WHERE side = 'cur') AS c_cur FROM ln GROUP BY column_name, value)""")
        ctes.append("""cdf AS (SELECT *, sum(c_ref) OVER w AS cum_ref, sum(c_cur) OVER w AS cum_cur,
                    lead(value) OVER (PARTITION BY column_name ORDER BY value) AS next_value,
                    sum(c_ref) OVER (PARTITION BY column_name) AS n_ref, sum(c_cur) OVER (PARTITION BY column_name) AS n_cur,
                    count(*) OVER (PARTITION BY column_name) AS n_distinct
             FROM cnt WINDOW w AS (PARTITION BY column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
        ctes.append("""nm AS (SELECT column_name, coalesce(sum(abs(cum_ref / n_ref - cum_cur / n_cur) * (next_value - value)), 0.0) AS w,
                   max(abs(cum_ref / n_ref - cum_cur / n_cur)) AS ks, max(n_distinct) AS nd FROM cdf GROUP BY column_name)""")
        ctes.append("sd AS (SELECT column_name, stddev_samp(value) AS s FROM ln WHERE side = 'ref' GROUP BY column_name)")
        ctes.append(f"jn AS ({js('ls')})")
        parts.append(f"""SELECT nm.column_name, CASE WHEN nd <= {max_cat} THEN 'categorical' ELSE 'numeric' END AS kind,
       CASE WHEN nd <= {max_cat} THEN 'jensen_shannon' ELSE 'wasserstein_norm' END AS stat,
       CASE WHEN nd <= {max_cat} THEN js ELSE w / s END AS score,
       CASE WHEN nd <= {max_cat} THEN NULL ELSE ks END AS ks
FROM nm LEFT JOIN sd USING (column_name) LEFT JOIN jn USING (column_name)""")
    if cat_cols:
        ctes.append(f"lc AS ({lng(cat_cols, 'VARCHAR')})")
        ctes.append(f"jc AS ({js('lc')})")
        parts.append("SELECT column_name, 'categorical' AS kind, 'jensen_shannon' AS stat, js AS score, "
                     "CAST(NULL AS DOUBLE) AS ks FROM jc")
    body = ",\n".join(ctes) + ",\nrep AS (" + "\nUNION ALL\n".join(parts) + ")"
    return body + (f"\nSELECT column_name, kind, stat, round(score, 8) AS score, round(ks, 8) AS ks, "
                   f"coalesce(score >= {threshold}, FALSE) AS drift FROM rep")


def _round(rep):
    return rep.select("column_name", "kind", "stat", F.round("score", 8).alias("score"), F.round("ks", 8).alias("ks"), "drift")


def _price_sides(spark, sf_dir):
    d = two_way_split(prepare_price_features(listing_view(spark, sf_dir)), "listing_id", 0.2, 42)
    return d.where(F.col("split") == "train").drop("split"), d.where(F.col("split") == "val").drop("split")


_PRICE_SIDES_SQL = (f", f AS ({price_features_sql()}),\n"
                    f"s AS (SELECT *, CASE WHEN {hash_u('listing_id', 42)} < 0.2 THEN 'val' ELSE 'train' END AS split FROM f),\n"
                    "ref AS (SELECT * FROM s WHERE split = 'train'), cur AS (SELECT * FROM s WHERE split = 'val'),\n")


@register("l02_drift_report_listings", with_listings(_PRICE_SIDES_SQL + drift_sql(P_NUM, P_CAT)))
def l02(spark, sf_dir):
    ref, cur = _price_sides(spark, sf_dir)
    return _round(L.drift_report(ref, cur, subset=P_SUBSET))


def _li_sides(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return (li.where(F.col("l_shipdate") < F.lit(LI_CUT).cast("timestamp_ntz")),
            li.where(F.col("l_shipdate") >= F.lit(LI_CUT).cast("timestamp_ntz")))


_LI_SIDES_SQL = (f"WITH ref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{LI_CUT}'),\n"
                 f"cur AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{LI_CUT}'),\n")


@register("l03_drift_report_lineitem", _LI_SIDES_SQL + drift_sql(LI_NUM, LI_CAT))
def l03(spark, sf_dir):
    ref, cur = _li_sides(spark, sf_dir)
    return _round(L.drift_report(ref.drop("l_shipdate"), cur.drop("l_shipdate"), subset=LI_NUM + LI_CAT))


@register("l01_common_columns", with_listings(
    "SELECT column_name FROM (VALUES " + ", ".join(f"('{c}')" for c in P_SUBSET) + ") v(column_name)"
    f" WHERE column_name IN (SELECT column_name FROM (DESCRIBE SELECT * FROM ({price_features_sql()}) f))"
    " AND column_name NOT IN ('price_value', 'total_credit')"))
def l01(spark, sf_dir):
    ref, cur = _price_sides(spark, sf_dir)
    cols = L.common_columns(ref, cur, P_SUBSET)
    return spark.createDataFrame([(c,) for c in cols], "column_name string")


@register("l01b_common_column_counts", with_listings(_PRICE_SIDES_SQL.rstrip(",\n") + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{side}' AS side, count({c}) AS n_rows FROM {side}" for c in P_NUM + P_CAT for side in ("ref", "cur"))))
def l01b(spark, sf_dir):
    ref, cur = _price_sides(spark, sf_dir)
    cols = L.common_columns(ref, cur, P_SUBSET)
    ref, cur = (column_counts(d, cols).select("column_name", F.lit(side).alias("side"), "n_rows") for side, d in (("ref", ref), ("cur", cur)))
    return ref.unionByName(cur)


@register("l05_dataset_drift", _LI_SIDES_SQL + drift_sql(LI_NUM, LI_CAT).replace(
    "\nSELECT column_name, kind, stat, round(score, 8) AS score", ",\nfin AS (SELECT column_name, kind, stat, round(score, 8) AS score", 1)
    + ")\nSELECT count(*) AS n_columns, count_if(drift) AS n_drifted, count_if(drift) / count(*) AS share_drifted, "
      "count_if(drift) / count(*) >= 0.5 AS dataset_drift FROM fin")
def l05(spark, sf_dir):
    ref, cur = _li_sides(spark, sf_dir)
    return L.dataset_drift(L.drift_report(ref.drop("l_shipdate"), cur.drop("l_shipdate"), subset=LI_NUM + LI_CAT))


@register("l06_drift_report_sink", _LI_SIDES_SQL + drift_sql(LI_NUM, LI_CAT))
def l06(spark, sf_dir):
    ref, cur = _li_sides(spark, sf_dir)
    rep = _round(L.drift_report(ref.drop("l_shipdate"), cur.drop("l_shipdate"), subset=LI_NUM + LI_CAT))
    return L.save_report(rep, scratch_path(spark, "drift-report"), "json")
