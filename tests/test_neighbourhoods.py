"""Neighbourhoods are told apart by (city, slug): namesakes in other cities are targets and candidates of their own."""

from __future__ import annotations

import duckdb

import __spark_entry__ as E
from abode.operators import geo
from abode.sources.tables import TABLES, table_path
from tests.conftest import SF0001


def test_namesakes_are_neighbours_of_their_own(spark):
    rows = [("x", "centre", 1.0), ("y", "centre", 2.0), ("x", "park", 4.0), (None, "centre", 8.0), ("y", "port", 16.0)]
    p = spark.createDataFrame([(c, s, v, 5.0, 35.0, 51.0) for c, s, v in rows],
                              "city_slug string, neighborhood_slug string, price_per_m2 double, mean_size double, lat double, lon double")

    def found(targets, k):
        return sorted(((r.target_city or "", r.target, r["rank"], r.neighbour_city, r.neighbour)
                       for r in geo.similar_neighbourhoods(p, targets, k).collect()))

    assert found(["centre"], 2) == [("", "centre", 1, "x", "park"), ("", "centre", 2, "y", "centre"),
                                    ("x", "centre", 1, "y", "centre"), ("x", "centre", 2, "x", "park"),
                                    ("y", "centre", 1, "x", "centre"), ("y", "centre", 2, "x", "park")]
    assert found([("y", "centre")], 4) == [("y", "centre", 1, "x", "centre"), ("y", "centre", 2, "x", "park"),
                                           ("y", "centre", 3, None, "centre"), ("y", "centre", 4, "y", "port")]


def test_queries_match_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF0001, t)}')")
    for name in ("m03_similar_neighbourhoods", "m03b_similar_neighbourhoods_by_city"):
        got = E.queries()[name](spark, SF0001)
        want = con.execute(E.oracle_sql()[name]).df()[got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None)) and len(want)


def test_all_targets_at_once_against_all_pairs(spark):
    import math
    import random
    from abode.operators.geo import similar_neighbourhoods
    rng = random.Random(5)
    rows = [(f"n{i % 60}", f"c{i // 60}", 1, rng.gauss(0, 1) + 5 * (i % 3), rng.gauss(80, 20), 35 + rng.random() / 10, 51 + rng.random()) for i in range(150)]
    rows += [("far", "c9", 1, 900.0, 80.0, 35.0, 51.0), ("twin", "c1", 1, 1.0, 80.0, 35.0, 51.0), ("twin", "c2", 1, 1.0, 80.0, 35.0, 51.0), ("gap", "c1", 1, None, 80.0, 35.0, 51.0)]
    p = spark.createDataFrame(rows, "neighborhood_slug string, city_slug string, n_listings long, price_per_m2 double, mean_size double, lat double, lon double")
    got = {}
    for r in similar_neighbourhoods(p, None, k=4).collect():
        got.setdefault((r.target_city, r.target), []).append((r["rank"], r.neighbour, r.neighbour_city, r.distance))
    full = [r for r in rows if r[3] is not None]
    means = [sum(r[j] for r in rows if r[j] is not None) / sum(r[j] is not None for r in rows) for j in range(3, 7)]
    stds = [math.sqrt(sum((r[j] - m) ** 2 for r in rows if r[j] is not None) / (sum(r[j] is not None for r in rows) - 1)) for j, m in zip(range(3, 7), means)]
    z = [(r[1], r[0], [(r[j] - m) / s for j, m, s in zip(range(3, 7), means, stds)]) for r in full]
    assert set(got) == {(c, s) for c, s, _ in z}
    for c, s, v in z:
        near = sorted((math.dist(v, w), s2, c2) for c2, s2, w in z if (c2, s2) != (c, s))[:4]
        mine = sorted(got[c, s])
        assert [m[0] for m in mine] == [1, 2, 3, 4]
        assert all(math.isclose(m[3], d, rel_tol=1e-9, abs_tol=1e-12) for m, (d, _, _) in zip(mine, near))
    assert similar_neighbourhoods(p, ["nowhere"]).count() == 0
    few = similar_neighbourhoods(p.where("neighborhood_slug in ('far', 'twin')"), ["far"], k=5).collect()
    assert [r["rank"] for r in few] == [1, 2]
