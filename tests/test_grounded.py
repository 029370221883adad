"""Terrain rays, areas by cells, sparse assignment and stage states against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.functions import geometry
from fieldtally.operators import areas, matching, stage_states, terrain
from fieldtally.operators.numerics import assign, sparse_pairs, union_area


def first_hit(ray, heights, cell):
    """Least t at which a ray meets a triangle, over all cells."""
    ox, oy, oz, dx, dy, dz = ray
    best = None
    for (cx, cy), h00 in heights.items():
        others = [heights.get((cx + i, cy + j)) for i, j in ((1, 0), (0, 1), (1, 1))]
        if None in others:
            continue
        h10, h01, h11 = others
        u0, v0, du, dv = ox / cell - cx, oy / cell - cy, dx / cell, dy / cell
        for a, b, below in ((h10 - h00, h11 - h10, True), (h11 - h01, h01 - h00, False)):
            rate = dz - a * du - b * dv
            if abs(rate) < 1e-12:
                continue
            t = (h00 + a * u0 + b * v0 - oz) / rate
            u, v = u0 + t * du, v0 + t * dv
            inside = -1e-9 <= u <= 1 + 1e-9 and -1e-9 <= v <= 1 + 1e-9 and (v <= u + 1e-9 if below else v >= u - 1e-9)
            if t >= 0 and inside and (best is None or t < best):
                best = t
    return best


@pytest.mark.parametrize("small", [terrain.SMALL, 0])
def test_rays_meet_the_terrain_where_a_search_of_all_cells_does(spark, monkeypatch, small):
    monkeypatch.setattr(terrain, "SMALL", small)
    r = random.Random(3)
    heights = {(x, y): r.random() * 25 for x in range(-9, 21) for y in range(-3, 18) if r.random() < 0.97}
    rays = [(r.uniform(-60, 180), r.uniform(0, 150), r.uniform(-5, 90), r.gauss(0, 1), r.gauss(0, 1), r.uniform(-1, 0.3)) for _ in range(150)]
    rays += [(33.3, 41.7, 80.0, 0.0, 0.0, -1.0), (33.3, 41.7, -8.0, 0.0, 0.0, 1.0), (30.0, 40.0, 80.0, 0.0, 0.0, -1.0), (-200.0, 31.0, 12.0, 1.0, 0.0, 0.0), (5.0, 5.0, 5.0, 0.0, 0.0, 0.0)]
    v = spark.createDataFrame([(x, y, h) for (x, y), h in heights.items()], "ix long, iy long, h double")
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(rays)] + [(999, None, 1.0, 1.0, 1.0, 1.0, 1.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {x.ray: x for x in terrain.first_hits(q, v, 10.0).collect()}
    want = {i: t for i, x in enumerate(rays) if (t := first_hit(x, heights, 10.0)) is not None}
    assert set(got) == set(want) and len(want) > 60
    for i, t in want.items():
        assert got[i].t == pytest.approx(t, abs=1e-9) and got[i].z == pytest.approx(rays[i][2] + t * rays[i][5], abs=1e-6)
    assert terrain.first_hits(q, v.limit(0), 10.0).count() == 0 and terrain.first_hits(q.limit(0), v, 10.0).count() == 0


def test_areas_by_cells_are_those_of_one_sweep(spark):
    r = random.Random(5)

    def ring(x, y):
        n, turn = r.choice([3, 4, 5, 8]), r.random()
        return [(x + (r.uniform(4, 20)) * math.cos(turn + 2 * math.pi * k / n), y + (r.uniform(4, 20)) * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]

    groups = {1: [ring(r.uniform(-50, 200), r.uniform(-50, 50)) for _ in range(60)], 2: [ring(0.0, 0.0) for _ in range(90)], 3: [ring(7.0, 7.0)] * 40, None: [ring(3.0, 3.0)]}
    groups[3] += [[(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)], [(10.0, 10.0), (80.0, 10.0), (10.0, 20.0), (80.0, 40.0), (0.0, 64.0)]]
    rows = [(g, [{"x": x, "y": y} for x, y in ring_]) for g, rings in groups.items() for ring_ in rings] + [(4, [{"x": 1.0, "y": 1.0}]), (5, None)]
    f = spark.createDataFrame(rows, "g long, ring array<struct<x: double, y: double>>")
    for side in (None, 32.0):
        got = {x.g: x.area for x in areas.union_areas(f, "g", F.col("ring"), side).collect()}
        assert set(got) == {1, 2, 3, None}
        for g, rings in groups.items():
            assert got[g] == pytest.approx(union_area(rings), rel=1e-9)
    assert areas.union_areas(f.limit(0), "g", F.col("ring")).count() == 0


def test_sparse_pairs_cost_as_little_as_a_dense_assignment():
    for seed in range(200):
        r = random.Random(seed)
        n, m = r.randint(1, 8), r.randint(1, 8)
        cost = np.full((n, m), 1e6)
        candidates = [(i, j, r.choice([r.random() * 10, r.randint(0, 3)])) for i in range(n) for j in range(m) if r.random() < 0.4]
        for i, j, c in candidates:
            cost[i, j] = c
        got = sparse_pairs(candidates, 1e6)
        want = [(i, j) for i, j in assign(cost) if cost[i, j] < 1e6]
        assert len(got) == len(want) == len({i for i, _ in got}) == len({j for _, j in got})
        assert sum(cost[p] for p in got) == pytest.approx(sum(cost[p] for p in want))


def test_a_flight_of_many_tracks_is_many_groups(spark):
    n = 3000
    rows = spark.range(n).selectExpr("1L as flight_id", "id as track_t", "explode(array(id, id + 1)) as track_w").where(f"track_w < {n} and not (track_t % 5 = 4 and track_w % 5 = 0)")
    rows = rows.withColumn("median_dist", F.when(F.col("track_t") == F.col("track_w"), 2.0).otherwise(1.0))
    got = matching.one_to_one(rows, "flight_id").agg(F.count(F.lit(1)).alias("n"), F.sum("median_dist").alias("d")).first()
    assert (got.n, got.d) == (n, 2.0 * n)


def test_utm_goes_back_within_a_millimetre(spark):
    p = spark.range(4000).selectExpr("(id % 60) * 6 - 180 + (id * 7 % 59) / 10D as lon", "(id * 13 % 1640) / 10D - 80 as lat")
    u = p.select("*", geometry.to_utm(F.col("lon"), F.col("lat")).alias("u"), geometry.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))
    back = u.select("lon", "lat", geometry.from_utm(F.col("u.easting"), F.col("u.northing"), F.col("epsg")).alias("b")).collect()
    for x in back:
        off = math.hypot((x.b.lon - x.lon) * math.cos(math.radians(x.lat)), x.b.lat - x.lat) * 111_320
        assert off < 0.001
    assert spark.range(1).select(geometry.from_utm(F.lit(5e5), F.lit(5e6), F.lit(4326)).alias("b")).first().b is None


NEEDS = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("e", "d"), ("x", None)]


def states(spark, **rows):
    return spark.createDataFrame([(1, s, v, 1, 10) for s, v in rows.items()], "f long, stage string, state string, generation long, row_count long")


def test_stage_states(spark):
    needs = spark.createDataFrame(NEEDS, "stage string, needed string")
    assert {(x.root, x.stage) for x in stage_states.dependents(needs).collect()} == {("a", s) for s in "bcde"} | {("b", s) for s in "cde"} | {("c", "e"), ("d", "e")}
    s = states(spark, a="complete", b="complete", c="failed", d="stale", e="complete", x="complete")
    done = spark.createDataFrame([(1, "b", 1, 5), (1, "e", 2, 6), (1, "b", 3, 7), (1, "n", 4, 8), (2, "a", 1, 9)], "f long, stage string, at long, row_count long")
    got = {(x.f, x.stage): (x.state, x.generation, x.row_count, x.went_stale) for x in stage_states.completed(s, done, needs, ["f"]).collect()}
    assert got[1, "b"] == ("complete", 3, 7, False) and got[1, "e"] == ("stale", 2, 6, True) and got[1, "n"] == ("complete", 1, 8, False)
    assert got[1, "c"][0] == "failed" and got[1, "d"] == ("stale", 1, 10, False) and got[1, "x"][0] == "complete" and got[2, "a"] == ("complete", 1, 9, False)
    there = spark.createDataFrame([(1, c) for c in "acdex"], "f long, stage string")
    got = {x.stage: (x.state, x.changed) for x in stage_states.reconciled(s, there, needs, ["f"]).collect()}
    assert got == {"a": ("complete", False), "b": ("pending", True), "c": ("failed", False), "d": ("stale", False), "e": ("stale", False), "x": ("complete", False)}
    target = spark.createDataFrame([(1, "d")], "f long, stage string")
    for cascade, e in ((False, "stale"), (True, "pending")):
        got = {x.stage: x.state for x in stage_states.reset(s, target, needs, ["f"], cascade).collect()}
        assert got == {"a": "complete", "b": "complete", "c": "failed", "d": "pending", "e": e, "x": "complete"}
