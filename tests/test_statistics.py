import itertools

import numpy as np
import pytest

from fieldtally.operators import matching, numerics, statistics

# Counts and areas of two published surveys, and what they give.
LEMBACH = (
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 3, 3, 3, 5, 5],
    [1.475133, 1.521986, 1.575163, 1.577327, 1.593400, 1.679427, 1.696479, 1.698978, 1.763420, 1.827896, 1.844881, 1.845307, 1.848589, 1.861824, 1.887924, 1.923417, 1.992447, 2.017391, 2.038991, 2.071418, 2.129862, 2.166071, 2.747946, 1.768878, 1.946804, 2.157280, 2.245080, 2.087712, 1.820423, 1.907402, 2.200424, 2.181985, 2.221030],
)
STSTEFAN = (
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 4, 5],
    [1.488923, 1.599765, 1.690057, 1.714709, 1.726957, 1.757419, 1.791569, 1.808079, 1.890679, 1.948752, 2.021423, 2.021726, 2.059094, 2.065921, 2.072363, 2.088126, 2.101806, 2.123316, 2.129358, 2.158377, 2.203595, 2.264995, 2.276287, 2.448357, 2.708561, 2.731780, 1.834966, 1.949574, 1.996594, 2.132053, 2.241751, 2.628096, 2.875178, 1.778265, 1.988550, 2.199333, 2.257071, 2.149337, 2.208404, 1.845604],
)


def _table(spark):
    rows = [(name, i, c, a) for name, t in (("lembach", LEMBACH), ("ststefan", STSTEFAN)) for i, (c, a) in enumerate(zip(*t))]
    return spark.createDataFrame(rows, "project string, transect_id int, count long, area_ha double")


def test_zinb_reproduces_published_densities(spark):
    r = {x.project: x for x in statistics.population(_table(spark), "project").collect()}
    assert r["lembach"].density == pytest.approx(57.313, rel=1e-3)
    assert r["lembach"].se == pytest.approx(29.847, rel=1e-2)
    assert r["ststefan"].density == pytest.approx(32.672, rel=1e-3)
    assert r["ststefan"].se == pytest.approx(2.495, rel=1e-2)
    assert (r["ststefan"].low, r["ststefan"].high) == (pytest.approx(27.78, abs=0.05), pytest.approx(37.56, abs=0.05))


def test_naive_and_bootstrap(spark):
    n = {x.project: x.density for x in statistics.population(_table(spark), "project", "naive").collect()}
    assert n["lembach"] == pytest.approx(39.481, rel=1e-4)
    b = {x.project: x for x in statistics.population(_table(spark), "project", "bootstrap").collect()}
    assert b["lembach"].low < b["lembach"].density < b["lembach"].high


def test_half_normal_recovers_sigma(spark):
    x = np.abs(np.random.default_rng(42).normal(0, 10, 800))
    d = spark.createDataFrame([("a", float(v)) for v in x if v <= 40], "s string, distance_m double")
    r = statistics.distance_sampling(d, spark.createDataFrame([("a", 1000.0)], "s string, length_m double"), "s", 40.0).first()
    assert r.model == "half-normal" and r.sigma == pytest.approx(10, rel=0.15)
    assert r.esw == pytest.approx(r.sigma * np.sqrt(np.pi / 2), rel=0.02)
    assert r.low < r.density_ha < r.high


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        c = rng.random((rng.integers(1, 6), rng.integers(1, 6)))
        n, m = c.shape
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert sum(c[i, j] for i, j in numerics.assign(c)) == pytest.approx(best)


def test_pairs_of_overlaps_are_the_best():
    """Against all ways to pair: the most pairs, then the largest sum."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        o = rng.random((rng.integers(1, 5), rng.integers(1, 5))) * (rng.random((1, 1)) + 0.3)
        n, m = o.shape
        ways = itertools.product([None, *range(m)], repeat=n)
        value = lambda w: (sum(j is not None for j in w), sum(o[i, j] for i, j in enumerate(w) if j is not None))
        ok = lambda w: len([j for j in w if j is not None]) == len({j for j in w if j is not None}) and all(j is None or o[i, j] >= 0.3 for i, j in enumerate(w))
        best = max(value(w) for w in ways if ok(w))
        got = matching.best_pairs(o, 0.3)
        assert (len(got), sum(o[i, j] for i, j in got)) == pytest.approx(best)


def test_score_is_the_likelihoods_slope():
    m = statistics.ZeroInflated(*LEMBACH)
    for p in m.starts():
        step = 1e-6
        want = [(m.likelihood(p + step * e) - m.likelihood(p - step * e)) / (2 * step) for e in np.eye(4)]
        assert m.score(p) == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_union_area():
    sq = lambda x, y: [(x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10)]
    got = [numerics.union_area(r) for r in ([sq(0, 0)], [sq(0, 0), sq(5, 0)], [sq(0, 0)] * 2, [sq(0, 0), sq(20, 0)])]
    assert got == [100, 150, 100, 200]
