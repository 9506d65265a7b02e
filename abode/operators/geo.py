"""Geography and statistics over listings (group M; the reference only documents them).

* M1 KMeans over coordinates (Spark ML), with the silhouette score.
* M3 similar neighbourhoods: per-neighbourhood profiles, nearest ``k`` to all requested
  neighbourhoods at once by grids of growing width (no all-pairs candidate table).
* M4 summaries by city class: count, mean, exact median, std.
* M5 tests from sufficient statistics: Welch t, one-way ANOVA F, chi-square, with their p-values (``functions.special``).
"""

from __future__ import annotations

import itertools
import math
from typing import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abode.functions.special import chi2_upper, f_upper, t_two_sided
from abode.operators.ordered import moments_of_counts, quantiles_of_counts, value_counts_long
from abode.session import materialize

LAT, LON = "location_latitude", "location_longitude"


def kmeans_clusters(df: DataFrame, k: int = 8, seed: int = 42, lat: str = LAT, lon: str = LON,
                    key: str = "listing_id"):
    """M1: cluster id per located listing, plus the silhouette of the clustering."""
    pts = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(key, lat, lon)
    feats = VectorAssembler(inputCols=[lat, lon], outputCol="features").transform(pts)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(feats)
    out = model.transform(feats)
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(out)
    return out.select(key, lat, lon, "cluster"), silhouette


def neighbourhood_profiles(df: DataFrame, key: str = "neighborhood_slug") -> DataFrame:
    """M3 profile per neighbourhood: listings, mean price per m2, mean size, centroid."""
    return (df.where(F.col(key).isNotNull()).groupBy(key, "city_slug").agg(
        F.count(F.lit(1)).alias("n_listings"),
        F.avg(F.col("price_value") / F.col("building_size")).alias("price_per_m2"),
        F.avg("building_size").alias("mean_size"), F.avg(LAT).alias("lat"), F.avg(LON).alias("lon")))


def similar_neighbourhoods(profiles: DataFrame, targets: Sequence | None, k: int = 5,
                           key: str = "neighborhood_slug", city: str = "city_slug") -> DataFrame:
    """M3: the ``k`` nearest neighbourhoods to each requested one (standardised profile distance).

    A neighbourhood is a (city, slug); profiles without a city column are told apart by slug alone.
    A target is a ``(city, slug)`` pair or a slug, which asks for that slug in each of its cities; ``None`` asks for all.

    All targets are searched at once. Profiles lie in the cells of a grid; a target meets those of its own
    and the neighbouring cells, which hold everything within one cell width. Once its k-th distance is within that
    width it is answered; the others search again on a grid twice as wide, until the cells hold all profiles.
    """
    feats = ["price_per_m2", "mean_size", "lat", "lon"]
    by = {"city": city, "": key} if city in profiles.columns else {"": key}
    stats = profiles.agg(*[F.avg(c).alias(f"_m_{c}") for c in feats], *[F.stddev_samp(c).alias(f"_s_{c}") for c in feats]).first()
    # only complete profiles can be compared (a neighbourhood without coordinates is skipped)
    # and a constant feature separates none: its score is 0
    z = materialize(profiles.select(*by.values(), *[((F.col(c) - stats[f"_m_{c}"]) / (stats[f"_s_{c}"] or 1.0)).alias(c) for c in feats]).na.drop(
        "any", subset=feats), "profiles")
    spread = F.greatest(*[F.coalesce(F.max(c) - F.min(c), F.lit(0.0)) for c in feats])
    n, reach = z.agg(F.count(F.lit(1)), spread).first()
    asked = F.lit(targets is None)
    for t in targets or ():
        asked = asked | ((F.col(key) == t) if isinstance(t, str) else F.col(city).eqNullSafe(t[0]) & (F.col(key) == t[1]))
    named = {"city": "target_city", "": "target"}, {"city": "neighbour_city", "": "neighbour"}
    mine, other = [named[0][i] for i in by], [named[1][i] for i in by]
    left = materialize(z.where(asked).select(*[F.col(c).alias(named[0][i]) for i, c in by.items()], *[F.col(c).alias(f"t_{c}") for c in feats]), "open-targets")
    right = z.select(*[F.col(c).alias(named[1][i]) for i, c in by.items()], *feats)
    width, out = max(reach, 1e-9) / math.ceil(max(1.0, n / (k + 1)) ** 0.25), []
    around = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(offsets)]) for offsets in itertools.product((-1, 0, 1), repeat=len(feats))])
    while True:
        cells = [F.floor(F.col(c) / width).alias(f"_c{i}") for i, c in enumerate(feats)]
        probes = left.select("*", F.explode(around).alias("_o"))
        probes = probes.select(*left.columns, *[(F.floor(F.col(f"t_{c}") / width) + F.col(f"_o.o{i}")).alias(f"_c{i}") for i, c in enumerate(feats)])
        itself = F.lit(True)
        for a, b in zip(mine, other):
            itself = itself & F.col(a).eqNullSafe(F.col(b))
        dist = F.sqrt(sum(((F.col(c) - F.col(f"t_{c}")) ** 2 for c in feats), F.lit(0.0)))
        met = probes.join(right.select("*", *cells), [f"_c{i}" for i in range(len(feats))]).where(~itself)
        order = Window.partitionBy(*mine).orderBy("distance", "neighbour", *[c for c in other if c != "neighbour"])
        top = met.select(*mine, *other, dist.alias("distance")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = materialize(top, "nearest")
        if width >= reach:  # neighbouring cells hold all profiles
            out.append(top)
            break
        closed = materialize(top.groupBy(*mine).agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_n"))
                             .where((F.col("_n") == k) & (F.col("_far") <= width)).select(*[F.col(c).alias(f"_{c}") for c in mine]), "answered")
        same = F.lit(True)
        for c in mine:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out.append(top.join(closed, same, "left_semi"))
        left = materialize(left.join(closed, same, "left_anti"), "open-targets")
        if left.isEmpty():
            break
        width *= 2
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.select(*mine, *other, "distance", "rank")


def summaries_by_group(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """M4: per group and column: count, mean, exact median, sample std."""
    longdf = df.select(group, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [group], list(cols), "column_name", "value").where(F.col("value").isNotNull() & F.col(group).isNotNull())
    keyed = longdf.select(F.struct(F.col(group).alias("group"), "column_name").alias("_k"), "value")
    counts = value_counts_long(keyed, "_k")  # the source is read once
    out = moments_of_counts(counts, "_k").join(quantiles_of_counts(counts, [0.5], ["median"], "_k"), "_k")
    return out.select(F.col("_k.group").alias(group), "_k.column_name", "count", "mean", "median", "std")


def welch_t(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """M5: Welch two-sample t test (statistic, degrees of freedom, two-sided p) of ``value`` between groups ``a`` and ``b``."""
    s = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    wide = s.agg(*[F.max(F.when(F.col(group) == g, F.col(c))).alias(f"{c}_{i}")
                   for i, g in enumerate((a, b)) for c in ("n", "m", "v")])
    e_0, e_1 = F.try_divide("v_0", "n_0"), F.try_divide("v_1", "n_1")
    df = F.try_divide((e_0 + e_1) * (e_0 + e_1), F.try_divide(e_0 * e_0, F.col("n_0") - 1) + F.try_divide(e_1 * e_1, F.col("n_1") - 1))
    out = wide.select(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), "n_0", "n_1",
                      F.try_divide(F.col("m_0") - F.col("m_1"), F.sqrt(e_0 + e_1)).alias("t"), df.alias("df"))
    return out.withColumn("p_value", t_two_sided(F.col("t"), F.col("df")))


def anova_f(df: DataFrame, group: str, value: str) -> DataFrame:
    """M5: one-way ANOVA F and its p-value from per-group count, mean and variance (one aggregate); null with one group or no spread."""
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    grand = d.agg(F.avg(value)).scalar()
    agg = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_total"),
                F.sum(F.col("n") * (F.col("m") - grand) * (F.col("m") - grand)).alias("ssb"),
                F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("ssw"))
    out = agg.select("k", "n_total", F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n_total") - F.col("k"))).alias("f"))
    return out.withColumn("p_value", F.when(F.col("f").isNotNull(), f_upper(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n_total") - F.col("k")).cast("double"))))


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """M5: chi-square test of the ``row x col`` contingency table (nulls excluded)."""
    d = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    cells = d.groupBy(row, col).agg(F.count(F.lit(1)).alias("o"))
    rt = cells.groupBy(row).agg(F.sum("o").alias("r_tot"))
    ct = cells.groupBy(col).agg(F.sum("o").alias("c_tot"))
    n = d.agg(F.count(F.lit(1))).scalar()
    # expected counts need every (row level, col level) pair; margins are joined by key and
    # the missing cells (o = 0) add their expected count E to the statistic.
    obs = cells.join(rt, row).join(ct, col).withColumn("e", F.col("r_tot") * F.col("c_tot") / n)
    part = obs.agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("s_obs"), F.sum("e").alias("e_obs"))
    # sum over all cells of E is n, so empty cells contribute n - sum(E over observed cells).
    out = part.select((F.col("s_obs") + (n - F.col("e_obs"))).alias("chi2"),
                      ((rt.agg(F.count(F.lit(1))).scalar() - 1) * (ct.agg(F.count(F.lit(1))).scalar() - 1)).alias("dof"))
    return out.withColumn("p_value", F.when(F.col("dof") > 0, chi2_upper(F.col("chi2"), F.col("dof").cast("double"))))
