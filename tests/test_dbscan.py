"""M2 DBSCAN against a brute-force reference with the same deterministic labelling rules."""

from __future__ import annotations

import numpy as np
import pytest

from abode.operators.dbscan import connected_components, dbscan

SF0001 = "/root/testdata/sf0.001"


def brute_dbscan(keys, xs, ys, eps, min_samples):
    """O(n^2) DBSCAN: core by row count within eps (self included), clusters labelled by the
    smallest key among their core rows, border rows take the smallest reachable label."""
    keys, xs, ys = np.asarray(keys), np.asarray(xs, float), np.asarray(ys, float)
    d2 = (xs[:, None] - xs[None, :]) ** 2 + (ys[:, None] - ys[None, :]) ** 2
    near = d2 <= eps * eps
    core = near.sum(axis=1) >= min_samples
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    idx = np.flatnonzero(core)
    for i in idx:
        for j in idx[near[i, idx]]:
            ri, rj = find(i), find(j)
            if ri != rj:
                parent[max(ri, rj)] = min(ri, rj)
    label_of_root = {}
    for i in idx:
        r = find(i)
        label_of_root[r] = min(label_of_root.get(r, keys[i]), keys[i])
    out = {}
    for i in range(len(keys)):
        if core[i]:
            out[int(keys[i])] = (True, int(label_of_root[find(i)]))
        else:
            cand = [label_of_root[find(j)] for j in idx[near[i, idx]]]
            out[int(keys[i])] = (False, int(min(cand)) if cand else -1)
    return out


def _run(spark, keys, xs, ys, eps, min_samples, light=64):
    df = spark.createDataFrame([(int(k), float(a), float(b)) for k, a, b in zip(keys, xs, ys)],
                               "listing_id long, lat double, lon double")
    rows = dbscan(df, eps, min_samples, "lat", "lon", light=light).collect()
    return {r.listing_id: (r.is_core, r.cluster) for r in rows}


def _fixture(seed):
    rng = np.random.default_rng(seed)
    blobs = [rng.normal(c, s, size=(n, 2)) for c, s, n in
             [((0.0, 0.0), 0.03, 120), ((0.3, 0.1), 0.02, 80), ((0.6, 0.6), 0.08, 60)]]
    noise = rng.uniform(-0.5, 1.0, size=(60, 2))
    # A chain of points about eps/2 apart: one cluster spanning many cells.
    chain = np.column_stack([np.linspace(-0.4, 0.4, 40), np.full(40, -0.3)])
    # A hot location: a third of all rows at one coordinate.
    pts = np.vstack(blobs + [noise, chain])
    hot = np.tile([[0.05, 0.02]], (len(pts) // 2, 1))
    pts = np.vstack([pts, hot])
    keys = rng.permutation(len(pts)) * 3 + 7
    return keys, pts[:, 0], pts[:, 1]


@pytest.mark.parametrize("seed,eps,min_samples,light", [(1, 0.025, 5, 64), (2, 0.04, 8, 4), (3, 0.02, 3, 2)])
def test_dbscan_matches_brute_force(spark, seed, eps, min_samples, light):
    keys, xs, ys = _fixture(seed)
    got = _run(spark, keys, xs, ys, eps, min_samples, light)
    want = brute_dbscan(keys, xs, ys, eps, min_samples)
    assert got == want
    assert len({c for _, c in got.values() if c >= 0}) > 1
    assert any(c == -1 for _, c in got.values())


def test_dbscan_boundary_distance_and_duplicates(spark):
    # Points exactly eps apart are neighbours; duplicates count towards min_samples.
    keys = [1, 2, 3, 4, 5, 6]
    xs = [0.0, 0.0, 0.5, 1.0, 3.0, 3.0]
    ys = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    got = _run(spark, keys, xs, ys, 0.5, 3)
    assert got == brute_dbscan(keys, xs, ys, 0.5, 3)
    assert got[1] == (True, 1) and got[3] == (True, 1) and got[4] == (False, 1) and got[5] == (False, -1)


def test_connected_components_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000 + i, 1001 + i) for i in range(5)],
                                  "src long, dst long")
    comp = {r.id: r.component for r in connected_components(edges).collect()}
    assert all(comp[i] == 0 for i in range(n + 1))
    assert all(comp[1000 + i] == 1000 for i in range(6))


def test_registered_query_matches_brute_force_on_driver_tables(spark):
    import __spark_entry__ as E
    from abode.catalog.q_geo import DBSCAN_EPS, DBSCAN_MIN_SAMPLES
    from abode.sources.listing_view import listing_view

    got = {r.listing_id: (r.is_core, r.cluster) for r in E.queries()["m02_dbscan_clusters"](spark, SF0001).collect()}
    pts = (listing_view(spark, SF0001).where("location_latitude IS NOT NULL AND location_longitude IS NOT NULL")
           .select("listing_id", "location_latitude", "location_longitude").toPandas())
    want = brute_dbscan(pts.listing_id.values, pts.location_latitude.values, pts.location_longitude.values,
                        DBSCAN_EPS, DBSCAN_MIN_SAMPLES)
    assert got == want
    assert any(c >= 0 for _, c in got.values())


@pytest.mark.parametrize("gap,linked", [(0.999, True), (1.001, False)])
def test_dense_cells_linked_only_through_a_deep_close_pair(spark, gap, linked):
    # Two dense clouds, every point core, each far heavier than `light`; the only pair within
    # eps is one point of each cloud at distance gap * eps, so the quadtree has to descend.
    eps, rng = 1.0, np.random.default_rng(5)
    a = rng.uniform([-1.6, 0.0], [-0.5, 0.6], size=(300, 2))
    b = rng.uniform([0.5, 0.0], [1.6, 0.6], size=(300, 2))
    pts = np.vstack([a, b, [[-gap * eps / 2, 0.3], [gap * eps / 2, 0.3]]])
    keys = np.arange(len(pts))
    got = _run(spark, keys, pts[:, 0], pts[:, 1], eps, 4, light=8)
    assert got == brute_dbscan(keys, pts[:, 0], pts[:, 1], eps, 4)
    assert (got[0][1] == got[300][1]) == linked


@pytest.mark.parametrize("hot_rows", [3, 40])
def test_hot_cells_and_locations_are_dealt_out(spark, monkeypatch, hot_rows):
    """Half of the rows at one location, most others in one cell: same labels, and no part of a join holds them all."""
    from abode.operators import dbscan as D
    from abode.operators import spread
    monkeypatch.setattr(spread, "HOT_ROWS", hot_rows)
    rng = np.random.default_rng(11)
    xy = np.concatenate([np.zeros((300, 2)), rng.uniform(0, 0.06, (200, 2)), rng.uniform(0.08, 0.5, (60, 2)), rng.uniform(0.0, 0.2, (60, 2))])
    keys = rng.permutation(len(xy)) + 1
    parts, real = [], D.spread_join

    def seen(big, small, on, hot, by, how="inner"):
        if hot is not None:
            dealt = big.join(hot, list(on), "left").selectExpr("coalesce(_parts, 1) AS parts")
            parts.append(dealt.agg({"parts": "max"}).first()[0])
        return real(big, small, on, hot, by, how)

    monkeypatch.setattr(D, "spread_join", seen)
    got = _run(spark, keys, xy[:, 0], xy[:, 1], 0.1, 5, light=8)
    assert got == brute_dbscan(keys, xy[:, 0], xy[:, 1], 0.1, 5)
    assert parts and max(parts) >= 300 // hot_rows


def test_spread_join_equals_join(spark):
    from pyspark.sql import functions as F
    from abode.operators.spread import hot_keys, spread_join
    big = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(big.groupBy("k").count(), ["k"], "count", 100)
    assert [tuple(r) for r in hot.collect()] == [(7, 11)]
    spread = spread_join(big, small, ["k"], hot, ["id"])
    assert spread.count() == 2000 and spread.exceptAll(big.join(small, "k")).isEmpty()
    assert hot_keys(big.groupBy("k").count(), ["k"], "count", 5000) is None
