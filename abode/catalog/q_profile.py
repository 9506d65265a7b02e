"""Profiling queries (group E5-E14, E17, E18) over driver tables and the listing view."""

from __future__ import annotations

from pyspark.sql import functions as F

from abode.catalog import register
from abode.catalog.sqltext import with_listings
from abode.operators import profile as P
from abode.sources.listing_view import listing_view
from abode.sources.tables import read_table

LISTING_OBJ = ["cat2_slug", "cat3_slug", "city_slug", "deed_type", "has_balcony", "has_elevator", "rooms_count"]
LISTING_NUM = ["building_size", "land_size", "price_value", "rent_value", "credit_value",
               "location_latitude", "location_longitude"]
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
ORDERS_OBJ = ["o_orderstatus", "o_orderpriority"]


def _union(cols, select_fn):
    return "\nUNION ALL\n".join(select_fn(c) for c in cols)


def _r(c, nd=6):
    return F.round(F.col(c), nd).alias(c)


@register("e05_value_counts", with_listings(
    "SELECT column_name, value, count(*) AS count FROM (\n"
    + _union(LISTING_OBJ, lambda c: f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM listings")
    + "\n) u WHERE value IS NOT NULL GROUP BY column_name, value"))
def e05(spark, sf_dir):
    return P.value_counts(listing_view(spark, sf_dir), LISTING_OBJ)


def _describe_sql(table, cols, nd=4):
    return _union(cols, lambda c: (
        f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), {nd}) AS mean, round(stddev_samp({c}), {nd}) AS std, "
        f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, "
        f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, "
        f"round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {table}"))


def _round_describe(df, nd=4):
    # means and standard deviations are sums in engine-specific order: compare them at a
    # precision their summation error cannot reach
    return df.select("column_name", "count", _r("mean", nd), _r("std", nd),
                     *[_r(c) for c in ("min", "p25", "p50", "p75", "max")])


@register("e06_describe_numeric", _describe_sql("lineitem", LINE_NUM))
def e06(spark, sf_dir):
    return _round_describe(P.describe_numeric(read_table(spark, sf_dir, "lineitem"), LINE_NUM))


@register("e06_describe_numeric_listings", with_listings(_describe_sql("listings", LISTING_NUM, 2)))
def e06b(spark, sf_dir):
    return _round_describe(P.describe_numeric(listing_view(spark, sf_dir), LISTING_NUM), 2)


def _describe_obj_sql(src, cols):
    vc = ("SELECT column_name, value, count(*) AS cnt FROM (\n"
          + _union(cols, lambda c: f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {src}")
          + "\n) u WHERE value IS NOT NULL GROUP BY column_name, value")
    return (f"SELECT column_name, sum(cnt) AS count, count(*) AS unique, "
            f"max(CASE WHEN rn = 1 THEN value END) AS top, max(cnt) AS freq FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn FROM ({vc}) v) t "
            f"GROUP BY column_name")


@register("e07_describe_object", with_listings(
    _describe_obj_sql("listings", LISTING_OBJ) + "\nUNION ALL\n" + _describe_obj_sql("orders", ORDERS_OBJ)))
def e07(spark, sf_dir):
    a = P.describe_object(listing_view(spark, sf_dir), LISTING_OBJ)
    b = P.describe_object(read_table(spark, sf_dir, "orders"), ORDERS_OBJ)
    return a.unionByName(b).select("column_name", F.col("count").cast("long").alias("count"),
                                   "unique", "top", F.col("freq").cast("long").alias("freq"))




def _listing_cols():
    from abode.sources.listing_view import LISTING_COLUMNS
    return [n for n, _ in LISTING_COLUMNS]


@register("e08_missing_share", with_listings(
    "SELECT column_name, n_missing, round(missing_pct, 6) AS missing_pct, "
    "CASE WHEN missing_pct > 90 THEN '>90' WHEN missing_pct > 75 THEN '>75' WHEN missing_pct > 50 THEN '>50' ELSE '<=50' END AS band "
    "FROM (\n" + _union(_listing_cols(), lambda c: (
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, "
        f"100.0 * (count(*) - count({c})) / count(*) AS missing_pct FROM listings")) + "\n) m"))
def e08(spark, sf_dir):
    m = P.missing_share(listing_view(spark, sf_dir))
    return m.select("column_name", "n_missing", F.round("missing_pct", 6).alias("missing_pct"),
                    P.missing_band().alias("band"))


@register("e08_columns_missing_above_50", with_listings(
    "SELECT column_name, n_missing, round(missing_pct, 6) AS missing_pct FROM (\n" + _union(_listing_cols(), lambda c: (
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, "
        f"100.0 * (count(*) - count({c})) / count(*) AS missing_pct FROM listings")) + "\n) m WHERE missing_pct > 50"))
def e08b(spark, sf_dir):
    m = P.columns_missing_above(listing_view(spark, sf_dir), 50)
    return m.select("column_name", "n_missing", F.round("missing_pct", 6).alias("missing_pct"))


_DUP = ["cat2_slug", "city_slug", "rooms_count", "has_balcony", "deed_type", "is_rebuilt"]


@register("e09_duplicate_rows", with_listings(
    f"SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates, count(*) AS n_distinct_rows "
    f"FROM (SELECT count(*) AS c FROM listings GROUP BY {', '.join(_DUP)}) g"))
def e09(spark, sf_dir):
    return P.duplicate_rows(listing_view(spark, sf_dir).select(*_DUP))


@register("e09_duplicate_rows_lineitem",
          "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates, count(*) AS n_distinct_rows "
          "FROM (SELECT count(*) AS c FROM lineitem GROUP BY ALL) g".replace(
              "GROUP BY ALL", "GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
              "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"))
def e09b(spark, sf_dir):
    return P.duplicate_rows(read_table(spark, sf_dir, "lineitem"))


_HIST = [("part", "p_size"), ("part", "p_retailprice")]


def _hist_sql(table, c, bins=30):
    return (f"SELECT '{c}' AS column_name, bin, round(lo_all + (hi_all - lo_all) * (bin - 1) / {bins}, 6) AS lo, "
            f"round(lo_all + (hi_all - lo_all) * bin / {bins}, 6) AS hi, count(*) AS count FROM ("
            f"SELECT lo_all, hi_all, CAST(CASE WHEN hi_all - lo_all = 0 THEN 1 ELSE "
            f"least(floor((v - lo_all) / (hi_all - lo_all) * {bins}) + 1, {bins}) END AS INTEGER) AS bin FROM "
            f"(SELECT CAST({c} AS DOUBLE) AS v FROM {table} WHERE {c} IS NOT NULL) x, "
            f"(SELECT CAST(min({c}) AS DOUBLE) AS lo_all, CAST(max({c}) AS DOUBLE) AS hi_all FROM {table}) r) b "
            f"GROUP BY bin, lo_all, hi_all")


@register("e10_histogram", "\nUNION ALL\n".join(_hist_sql(t, c) for t, c in _HIST + [("lineitem", "l_quantity"), ("lineitem", "l_discount")]))
def e10(spark, sf_dir):
    part = P.histogram(read_table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    li = P.histogram(read_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return part.unionByName(li).select("column_name", "bin", _r("lo"), _r("hi"), "count")


def _box_sql(table, c):
    return (f"SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
            f"round(q3 - q1, 6) AS iqr, "
            f"round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), 6) AS whisker_lo, "
            f"round(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_hi, "
            f"count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers "
            f"FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {table} WHERE {c} IS NOT NULL) x, "
            f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM {table}) q "
            f"GROUP BY q1, median, q3")


@register("e11_box_stats", "\nUNION ALL\n".join(_box_sql("lineitem", c) for c in LINE_NUM))
def e11(spark, sf_dir):
    b = P.box_stats(read_table(spark, sf_dir, "lineitem"), LINE_NUM)
    return b.select("column_name", *[_r(c) for c in ("q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi")], "n_outliers")


_CORR = ["building_size", "land_size", "price_value", "credit_value", "location_latitude", "location_longitude"]
_CORR_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:] if {a, b} != {"price_value", "credit_value"}]


@register("e12_correlation", with_listings("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM listings" for a, b in _CORR_PAIRS)))
def e12(spark, sf_dir):
    cm = P.correlation_matrix(listing_view(spark, sf_dir), _CORR)
    keep = F.lit(False)
    for a, b in _CORR_PAIRS:
        keep = keep | ((F.col("col_a") == a) & (F.col("col_b") == b))
    return cm.where(keep).select("col_a", "col_b", _r("corr"))


@register("e12_correlation_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(LINE_NUM) for b in LINE_NUM[i + 1:]))
def e12b(spark, sf_dir):
    return P.correlation_matrix(read_table(spark, sf_dir, "lineitem"), LINE_NUM).select("col_a", "col_b", _r("corr"))


@register("e13_distinct_sorted", "SELECT DISTINCT CAST(p_type AS VARCHAR) AS value FROM part WHERE p_type IS NOT NULL")
def e13(spark, sf_dir):
    return P.distinct_sorted(read_table(spark, sf_dir, "part"), "p_type")


_ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_TYPE_MAP = ("CASE t WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
             "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(t) END")


@register("e14_table_info", "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS column_name, {_TYPE_MAP.replace('t ', f'typeof(any_value({c})) ', 1).replace('lower(t)', f'lower(typeof(any_value({c})))')} AS dtype, "
    f"count({c}) AS non_null, count(*) AS n_rows FROM orders" for i, c in enumerate(_ORD)))
def e14(spark, sf_dir):
    return P.table_info(read_table(spark, sf_dir, "orders"))


_NARROW = [("part", "p_size", True), ("part", "p_retailprice", False), ("orders", "o_orderkey", True),
           ("orders", "o_totalprice", False), ("lineitem", "l_linenumber", True), ("lineitem", "l_discount", False)]


def _narrow_sql(table, c, integral):
    lo, hi = f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)"
    if integral:
        np_t = (f"CASE WHEN {lo} > -128 AND {hi} < 127 THEN 'int8' WHEN {lo} > -32768 AND {hi} < 32767 THEN 'int16' "
                f"WHEN {lo} > -2147483648 AND {hi} < 2147483647 THEN 'int32' ELSE 'int64' END")
        sp_t = (f"CASE WHEN {lo} > -128 AND {hi} < 127 THEN 'tinyint' WHEN {lo} > -32768 AND {hi} < 32767 THEN 'smallint' "
                f"WHEN {lo} > -2147483648 AND {hi} < 2147483647 THEN 'int' ELSE 'bigint' END")
    else:
        np_t = (f"CASE WHEN {lo} > -65504.0 AND {hi} < 65504.0 THEN 'float16' "
                f"WHEN {lo} > -3.4028234663852886e38 AND {hi} < 3.4028234663852886e38 THEN 'float32' ELSE 'float64' END")
        sp_t = f"CASE WHEN {lo} > -3.4028234663852886e38 AND {hi} < 3.4028234663852886e38 THEN 'float' ELSE 'double' END"
    return (f"SELECT '{c}' AS column_name, {lo} AS min, {hi} AS max, {np_t} AS numpy_type, {sp_t} AS spark_type "
            f"FROM {table}")


@register("e17_narrowest_types", "\nUNION ALL\n".join(_narrow_sql(*x) for x in _NARROW))
def e17(spark, sf_dir):
    out = None
    for t in ("part", "orders", "lineitem"):
        cols = [c for tt, c, _ in _NARROW if tt == t]
        r = P.narrowest_types(read_table(spark, sf_dir, t), cols)
        out = r if out is None else out.unionByName(r)
    return out


@register("e18_geo_density", with_listings(
    "SELECT CAST(floor(location_latitude / 0.1) AS BIGINT) AS lat_cell, CAST(floor(location_longitude / 0.1) AS BIGINT) AS lon_cell, "
    "cat2_slug, count(*) AS n_points FROM listings WHERE location_latitude IS NOT NULL AND location_longitude IS NOT NULL "
    "GROUP BY ALL"))
def e18(spark, sf_dir):
    return P.geo_density(listing_view(spark, sf_dir), step=0.1, hue="cat2_slug")
