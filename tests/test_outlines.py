"""Outlines of unions against known shapes, areas by a sweep, and membership of random points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import outlines
from fieldtally.operators.numerics import union_area

box = lambda x, y, w=10.0, h=10.0: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]

SHAPES = {
    1: ([box(0, 0)], [4], []),
    2: ([box(0, 0), box(5, 5)], [8], []),
    3: ([box(0, 0), box(10, 0), box(0, 0)], [4], []),  # side by side, one of them twice
    4: ([box(0, 0), box(10, 10)], [4, 4], []),  # touch in a corner
    5: ([box(0, 0, 30, 5), box(0, 25, 30, 5), box(0, 0, 5, 30), box(25, 0, 5, 30)], [4], [4]),  # a frame
    6: ([box(0, 0, 30, 30), box(5, 5)], [4], []),  # one inside the other
    7: ([box(0, 0), box(2, -5, 3, 20)[::-1]], [12], []),  # a cross, one ring clockwise
    8: ([box(0, 0), box(10, 3, 4, 4)], [8], []),  # ends on the middle of a side
    9: ([box(0, 0), box(50, 0)], [4, 4], []),
}


def frame(spark, groups):
    rows = [(g, [{"x": float(x), "y": float(y)} for x, y in r]) for g, rings in groups.items() for r in rings]
    return spark.createDataFrame(rows + [(99, [{"x": 1.0, "y": 1.0}]), (None, [{"x": 0.0, "y": 0.0}] * 3)], "g long, ring array<struct<x: double, y: double>>")


def test_known_shapes(spark):
    got = {}
    for x in outlines.union_outlines(frame(spark, {g: s[0] for g, s in SHAPES.items()}), "g", F.col("ring"), 7.0).collect():
        got.setdefault(x.g, ([], []))[x.hole].append(len(x.ring))
        assert (x.area < 0) == x.hole
    assert {g: (sorted(a), sorted(b)) for g, (a, b) in got.items()} == {g: (sorted(a), sorted(b)) for g, (_, a, b) in SHAPES.items()}


def test_slanted_rings(spark):
    r = random.Random(8)

    def ring():
        x, y, n, turn, size = r.uniform(0, 90), r.uniform(0, 90), r.choice([3, 4, 6]), r.random(), r.uniform(5, 18)
        return [(500_000 + x + size * math.cos(turn + 2 * math.pi * k / n), 5_300_000 + y + size * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]

    groups = {g: [ring() for _ in range(25)] for g in (1, 2)}
    found = outlines.union_outlines(frame(spark, groups), "g", F.col("ring")).collect()
    for g, rings in groups.items():
        own = [x for x in found if x.g == g]
        assert sum(x.area for x in own) == pytest.approx(union_area(rings), rel=1e-6)
        points = np.asarray([(500_000 + r.uniform(-20, 110), 5_300_000 + r.uniform(-20, 110)) for _ in range(4000)])
        want, got = np.zeros(len(points), bool), np.zeros(len(points), bool)
        for x in rings:
            want |= outlines._inside(points, np.asarray(x))
        for x in own:
            got ^= outlines._inside(points, np.asarray([(p.x, p.y) for p in x.ring]))
        assert (want == got).all() and want.any() and not want.all()
    assert outlines.union_outlines(frame(spark, groups).limit(0), "g", F.col("ring")).count() == 0


def corners(rows):
    """Rings with their least corner first, so that it doesn't matter where they begin."""
    out = []
    for x in rows:
        p = [(round(c.x / outlines.UNIT), round(c.y / outlines.UNIT)) for c in x.ring]
        k = p.index(min(p))
        out.append((x.g, p[k:] + p[:k], round(x.area, 6), x.hole))
    return sorted(out)


def test_groups_taken_whole_are_those_by_cells(spark):
    r = random.Random(11)
    at = lambda: r.randint(0, 14) * 2.5
    groups = {g: [box(at(), at(), r.choice([2.5, 5, 10]), r.choice([2.5, 5, 10])) for _ in range(r.randint(1, 12))] for g in range(60)}
    groups |= {g + 100: [[(at(), at()), (at() + 0.5, at()), (at(), at() + 0.25)] for _ in range(r.randint(1, 6))] for g in range(40)}
    groups |= {g + 200: s[0] for g, s in SHAPES.items()}
    groups[300] = [box(2 * k, 0, 3, 3) for k in range(outlines.WHOLE // 4 + 1)]  # too large to be taken whole
    f = frame(spark, groups)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go on in the next batch
    try:
        got = outlines.union_outlines(f, "g", F.col("ring")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert corners(got) == corners(outlines.union_outlines(f, "g", F.col("ring"), 7.0).collect())
    names = outlines.union_outlines(f.selectExpr("concat('g', g) as g", "ring").where("g < 'g3'"), "g", F.col("ring"))
    assert "Join " not in names._jdf.queryExecution().optimizedPlan().toString()
    assert corners(names.collect()) == [x for x in sorted((f"g{g}", *x) for g, *x in corners(got)) if x[0] < "g3"]


def test_pieces_without_one_next_piece_are_rings_too():
    g, p = np.zeros(5, int), [(0, 0), (9_000_000, 0), (9_000_000, 9_000_000), (0, 9_000_000), (5_000_000, 5_000_000)]
    px, py = (np.asarray([q[k] for q in p]) for k in (0, 1))
    found = list(outlines._loose(g, px, py, np.asarray([1, 2, 3, 0, -1])))
    assert found == [(0, p[:4])]
    assert outlines._in_order(np.asarray([2, 3, 4, 1, 0]))[0].tolist() == [0, 2, 4, 1, 3]
