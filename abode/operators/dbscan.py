"""M2: exact DBSCAN over listing coordinates, distributed without all-pairs work.

Semantics (those of the usual library DBSCAN on raw coordinates): the neighbourhood of a
point is every point at Euclidean distance ``<= eps``, itself included; a point is *core*
when its neighbourhood holds at least ``min_samples`` rows; core points within ``eps`` of
each other share a cluster; a non-core point within ``eps`` of a core point is a *border*
point; every other point is noise (``-1``). Two choices make the result deterministic:
a cluster is labelled by the smallest key among its core rows, and a border point joins the
cluster with the smallest label among the core points that reach it.

Plan, designed for a hot location or cell holding a large share of all rows:

1. Rows at the same coordinates are one weighted *location* (a hot location collapses in
   the map-side partial aggregation).
2. Locations fall into square cells of side just under ``eps / sqrt(2)``, so any two
   locations of one cell are neighbours. A cell whose weight reaches ``min_samples`` is
   *dense*: all its locations are core and no pair inside it is ever formed.
3. Locations of *sparse* cells (fewer than ``min_samples`` rows, hence fewer locations) are
   paired with the locations of the 24 surrounding cells. Every emitted pair has a sparse
   end, so at most ``24 * (min_samples - 1)`` partners per location: linear work. These
   pairs give the neighbour weights of sparse locations, core-to-core links and border
   candidates.
4. Two neighbouring dense cells are linked when some pair of their locations is within
   ``eps``. Sub-cell pairs are refined level by level (a quadtree): pairs whose boxes are
   farther than ``eps`` are dropped, pairs whose boxes are wholly within ``eps`` link the
   cells, pairs where one side has fewer than ``light`` locations are checked point by
   point (bounded), and only heavy-heavy pairs are split further. Cell pairs already linked
   leave the search.
5. Cells with core locations form a graph; its connected components come from alternating
   large-star / small-star rounds (Kiveris et al., 2014), each round written to the shared
   checkpoint folder.

Every intermediate that is reused is written once under ``spark.checkpoint.dir``
(``session.materialize``) so a lost executor re-reads files instead of re-running joins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.operators.spread import hot_keys, spread_join
from abode.session import cut_lineage, materialize

# Cells are a hair smaller than eps / sqrt(2) so rounding in x / side can never place two
# locations farther apart than eps into one cell.
_SHRINK = 1.0 - 1e-9
# Relative tolerance for box-level decisions; anything closer to the boundary is decided
# by exact point distances.
_TOL = 1e-7
# Offsets of the cells that can hold a neighbour: the 5x5 block without the centre.
_OFFSETS = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) != (0, 0)]
# Half of them (one direction per unordered cell pair).
_HALF = [(dx, dy) for dx, dy in _OFFSETS if dx > 0 or (dx == 0 and dy > 0)]


def _offsets(pairs) -> F.Column:
    return F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in pairs]))


def _dist_ok(ax, ay, bx, by, eps: float) -> F.Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by) <= F.lit(eps * eps)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """Component (smallest vertex id) of every vertex that has an edge: ``(id, component)``.

    Alternating large-star and small-star rounds; O(log^2 n) rounds, each a few shuffles
    over the edge list, with the edge list checkpointed per round (no lineage growth).
    """
    e = (edges.where(F.col(src) != F.col(dst))
         .select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct())
    e = cut_lineage(e)
    n_prev = e.count()
    for _ in range(max_rounds):
        # Large-star: every larger neighbour of u is linked to the minimum of u's closed neighbourhood.
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(m, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        # Small-star: u and its smaller neighbours are linked to the smallest of them.
        ms = large.groupBy("hi").agg(F.min("lo").alias("m"))
        j = large.join(ms, "hi")
        small = (j.select(F.col("lo").alias("x"), "m").unionByName(j.select(F.col("hi").alias("x"), "m"))
                 .where(F.col("x") != F.col("m"))
                 .select(F.col("x").alias("hi"), F.col("m").alias("lo")).distinct())
        small = cut_lineage(small)
        n_new = small.count()
        same = n_new == n_prev and small.join(e, ["hi", "lo"], "left_anti").isEmpty()
        e, n_prev = small, n_new
        if same:
            break
    else:
        raise RuntimeError("connected components did not converge")
    # A converged edge list is a set of stars centred on each component's smallest vertex.
    leaves = e.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "id")
    roots = e.select(F.col("lo").alias("id")).distinct().join(leaves, "id", "left_anti").withColumn(
        "component", F.col("id"))
    return leaves.unionByName(roots)


def dbscan(df: DataFrame, eps: float, min_samples: int, x: str, y: str, key: str = "listing_id",
           light: int = 64, max_levels: int = 64) -> DataFrame:
    """Cluster label per located row: ``key, x, y, is_core, cluster`` (-1 = noise)."""
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be > 0 and min_samples >= 1")
    side = eps / math.sqrt(2.0) * _SHRINK
    pts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y)

    # 1-2. Weighted locations in cells; u, v are coordinates in cell units (sub-cells of
    # level L are floor(u * 2^L): scaling by a power of two is exact, so levels nest).
    loc = (pts.groupBy(x, y).agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("pid"))
           .withColumn("u", F.col(x) / F.lit(side)).withColumn("v", F.col(y) / F.lit(side))
           .withColumn("cx", F.floor("u")).withColumn("cy", F.floor("v")))
    cells = materialize(loc.groupBy("cx", "cy").agg(F.sum("w").alias("cw"), F.count(F.lit(1)).alias("cn")), "dbscan-cells")
    hot = hot_keys(cells, ["cx", "cy"], "cn")  # cells of very many locations: their rows are dealt out in every join
    loc = spread_join(loc, cells, ["cx", "cy"], hot, ["pid"])
    loc = materialize(loc.withColumn("dense", F.col("cw") >= min_samples), "dbscan-loc")

    # 3. Pairs with a sparse end: sparse location -> locations of the 24 surrounding cells.
    sp = loc.where(~F.col("dense")).select(
        F.col("pid").alias("p"), F.col(x).alias("px"), F.col(y).alias("py"),
        F.col("cx").alias("pcx"), F.col("cy").alias("pcy"), F.col("cw").alias("pcw"), _offsets(_OFFSETS).alias("o"))
    sp = sp.select("*", (F.col("pcx") + F.col("o.dx")).alias("cx"), (F.col("pcy") + F.col("o.dy")).alias("cy")).drop("o")
    q = loc.select("cx", "cy", F.col("pid").alias("q"), F.col(x).alias("qx"), F.col(y).alias("qy"),
                   F.col("w").alias("qw"), F.col("dense").alias("q_dense"))
    pairs = (spread_join(q, sp, ["cx", "cy"], hot, ["q"]).where(_dist_ok(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"), eps))
             .select("p", "pcx", "pcy", "pcw", "q", "cx", "cy", "qw", "q_dense"))
    pairs = materialize(pairs, "dbscan-pairs")

    # Core flags: dense cells are all core; a sparse location adds its own cell's weight
    # (all within eps) to the weights of its partners.
    nbr = pairs.groupBy("p").agg(F.sum("qw").alias("ow"))
    loc = loc.join(nbr.withColumnRenamed("p", "pid"), "pid", "left").withColumn(
        "is_core", F.col("dense") | ((F.col("cw") + F.coalesce("ow", F.lit(0))) >= min_samples)).drop("ow")
    loc = materialize(loc, "dbscan-core")
    core = loc.where("is_core")
    # Vertex of a cell: the smallest location id among its core locations.
    vert = core.groupBy("cx", "cy").agg(F.min("pid").alias("vid"), F.first("dense").alias("dense"),
                                        F.first("cn").alias("cn"))
    vert = materialize(vert, "dbscan-vert")

    is_core = core.select(F.col("pid").alias("q"), F.lit(True).alias("q_core"))
    pc = pairs.join(is_core.withColumnRenamed("q", "p").withColumnRenamed("q_core", "p_core"), "p", "left") \
              .join(is_core, "q", "left")
    # Links between cells from core-core pairs with a sparse end.
    v_p = vert.select(F.col("cx").alias("pcx"), F.col("cy").alias("pcy"), F.col("vid").alias("src"))
    v_q = vert.select("cx", "cy", F.col("vid").alias("dst"))
    links = (pc.where(F.col("p_core") & F.col("q_core") & ((F.col("pcx") != F.col("cx")) | (F.col("pcy") != F.col("cy"))))
             .select("pcx", "pcy", "cx", "cy").distinct().join(v_p, ["pcx", "pcy"]).join(v_q, ["cx", "cy"])
             .select("src", "dst"))

    # 4. Links between neighbouring dense cells by quadtree refinement of sub-cell pairs.
    dense_links = _dense_links(loc.where("dense"), vert.where("dense"), eps, side, light, max_levels, x, y)

    # 5. Components over the cell graph; unlinked vertices are their own component.
    comp = connected_components(links.unionByName(dense_links))
    cell_comp = vert.join(comp.withColumnRenamed("id", "vid"), "vid", "left").select(
        "cx", "cy", F.coalesce("component", "vid").alias("component"))
    cell_comp = materialize(cell_comp, "dbscan-comp")

    core_lab = spread_join(core, cell_comp, ["cx", "cy"], hot, ["pid"]).select("pid", F.col("component").alias("cluster"))
    # Border labels: smallest component among core neighbours, in the own cell (all within
    # eps) or through a pair with a sparse end.
    noncore = loc.where(~F.col("is_core")).select("pid", "cx", "cy")
    own = noncore.join(cell_comp, ["cx", "cy"]).select("pid", "component")
    via = (pc.where(~F.coalesce("p_core", F.lit(False)) & F.col("q_core"))
           .join(cell_comp, ["cx", "cy"]).select(F.col("p").alias("pid"), "component"))
    border = own.unionByName(via).groupBy("pid").agg(F.min("component").alias("cluster"))
    labels = core_lab.unionByName(border)
    lab = materialize(loc.select("pid", x, y, "w", "is_core").join(labels, "pid", "left")
                      .select(x, y, "w", "is_core", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster")), "dbscan-labels")
    # Back to rows: one label row per location, joined on the exact coordinates; a location of very many rows is dealt out.
    return spread_join(pts, lab, [x, y], hot_keys(lab, [x, y], "w"), [key]).select(key, x, y, "is_core", "cluster")


def _dense_links(dloc: DataFrame, dvert: DataFrame, eps: float, side: float, light: int, max_levels: int,
                 x: str, y: str) -> DataFrame:
    """Links ``(src, dst)`` between neighbouring dense cells with some pair within ``eps``."""
    # Level 0 candidates: neighbouring dense cells (one direction per pair).
    a = dvert.select(F.col("cx").alias("ai"), F.col("cy").alias("aj"), F.col("vid").alias("src"),
                     _offsets(_HALF).alias("o"))
    a = a.select("ai", "aj", "src", (F.col("ai") + F.col("o.dx")).alias("bi"), (F.col("aj") + F.col("o.dy")).alias("bj"))
    b = dvert.select(F.col("cx").alias("bi"), F.col("cy").alias("bj"), F.col("vid").alias("dst"))
    cand = a.join(b, ["bi", "bj"]).select("src", "dst", "ai", "aj", "bi", "bj")
    # Radius in cell units, squared.
    r2 = (eps / side) ** 2
    found = None
    spark = dloc.sparkSession
    empty = spark.createDataFrame([], "src long, dst long")
    pts = dloc.select("u", "v", x, y)
    for level in range(max_levels):
        cand = cut_lineage(cand)
        if cand.isEmpty():
            break
        scale = float(2 ** level)
        h2 = r2 * scale * scale  # radius squared in level-L sub-cell units
        sub = pts.select(F.floor(F.col("u") * scale).alias("i"), F.floor(F.col("v") * scale).alias("j"))
        counts = sub.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
        ca = counts.select(F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("n").alias("na"))
        cb = counts.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("n").alias("nb"))
        c = cand.join(ca, ["ai", "aj"]).join(cb, ["bi", "bj"])
        di, dj = F.abs(F.col("ai") - F.col("bi")), F.abs(F.col("aj") - F.col("bj"))
        gi, gj = F.greatest(di - 1, F.lit(0)), F.greatest(dj - 1, F.lit(0))
        c = c.withColumn("mn", gi * gi + gj * gj).withColumn("mx", (di + 1) * (di + 1) + (dj + 1) * (dj + 1))
        c = c.where(F.col("mn") <= F.lit(h2 * (1 + _TOL)))
        c = cut_lineage(c)
        whole = c.where(F.col("mx") < F.lit(h2 * (1 - _TOL))).select("src", "dst")
        amb = c.where(F.col("mx") >= F.lit(h2 * (1 - _TOL)))
        lite = amb.where((F.col("na") < light) | (F.col("nb") < light))
        # distances have no direction: let a be the lighter side
        turned = F.col("na") > F.col("nb")
        lite = lite.select("src", "dst", *[F.when(turned, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in (
            ("ai", "bi"), ("aj", "bj"), ("bi", "ai"), ("bj", "aj"))])
        pa = pts.select(F.floor(F.col("u") * scale).alias("ai"), F.floor(F.col("v") * scale).alias("aj"),
                        F.col(x).alias("ax"), F.col(y).alias("ay"))
        pb = pts.select(F.floor(F.col("u") * scale).alias("bi"), F.floor(F.col("v") * scale).alias("bj"),
                        F.col(x).alias("bx"), F.col(y).alias("by"))
        # The light side has fewer than `light` locations: at most that many partners per location.
        hot = hot_keys(cb, ["bi", "bj"], "nb")
        checked = (spread_join(pb, lite.join(pa, ["ai", "aj"]), ["bi", "bj"], hot, ["bx", "by"])
                   .where(_dist_ok(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), eps))
                   .select("src", "dst"))
        now = whole.unionByName(checked)
        found = cut_lineage((now if found is None else found.unionByName(now)).distinct())
        heavy = amb.where((F.col("na") >= light) & (F.col("nb") >= light)).join(
            found, ["src", "dst"], "left_anti")
        kids = _offsets([(0, 0), (0, 1), (1, 0), (1, 1)])
        cand = (heavy.select("src", "dst", "ai", "aj", "bi", "bj", kids.alias("ka"))
                .select("*", kids.alias("kb"))
                .select("src", "dst", (F.col("ai") * 2 + F.col("ka.dx")).alias("ai"),
                        (F.col("aj") * 2 + F.col("ka.dy")).alias("aj"),
                        (F.col("bi") * 2 + F.col("kb.dx")).alias("bi"), (F.col("bj") * 2 + F.col("kb.dy")).alias("bj")))
        # Deeper levels only read the locations of sub-cells that are still candidates.
        nxt = float(2 ** (level + 1))
        need = cand.select(F.col("ai").alias("i"), F.col("aj").alias("j")).unionByName(
            cand.select(F.col("bi").alias("i"), F.col("bj").alias("j"))).distinct()
        pts = cut_lineage(pts.withColumn("i", F.floor(F.col("u") * nxt)).withColumn("j", F.floor(F.col("v") * nxt))
                          .join(need, ["i", "j"], "left_semi").drop("i", "j"))
    else:
        raise RuntimeError("dense-cell refinement did not finish")
    return empty if found is None else found
