"""Registered queries that SQL can't express, against plain versions on the smallest tables."""

import itertools
import math
import os
from collections import defaultdict

import numpy as np
import pytest

from fieldtally.operators import numerics, statistics
from fieldtally.plans import domain, registry, surveyed

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1])
    return w * h / (both - w * h)


def test_tracker(spark):
    """Frame by frame, with one assignment over all boxes and tracks."""
    rows = domain.detections(spark, SF).selectExpr("flight_id", "modality", "frame", "detection_id", "x1", "y1", "x2", "y2", "detection_id % 2 as cls").collect()
    given, groups = {x.detection_id: x.track_id for x in run(spark, "w16_tracker")}, defaultdict(lambda: defaultdict(list))
    assert len(given) == len(rows)
    for r in sorted(rows, key=lambda r: (r.frame, r.detection_id)):
        groups[r.flight_id, r.modality][r.frame].append(r)
    for frames in groups.values():
        alive, following = {}, 1  # id: [box, class, age]
        for found in frames.values():
            ids = [given[r.detection_id] for r in found]
            assert len(set(ids)) == len(ids)
            names = list(alive)
            cost = np.full((len(found), len(names)), 1e6)
            for (i, r), (j, t) in itertools.product(enumerate(found), enumerate(names)):
                o = iou(r[4:8], alive[t][0]) if r.cls == alive[t][1] else 0.0
                if o >= 0.3:
                    cost[i, j] = 1 - o
            # of equally good assignments, any will do
            best = [cost[i, j] for i, j in numerics.assign(cost) if cost[i, j] < 1e6] if names else []
            mine = [cost[i, names.index(t)] for i, t in enumerate(ids) if t in alive]
            assert (len(mine), sum(mine)) == (len(best), pytest.approx(sum(best), abs=1e-9))
            for t in alive.values():
                t[2] += 1
            for r, t in zip(found, ids):
                if t not in alive:
                    assert t == following
                    following += 1
                alive[t] = [r[4:8], r.cls, 0]
            alive = {k: t for k, t in alive.items() if t[2] <= 5}


def test_one_to_one(spark):
    """No other set of admitted pairs has more pairs, or as many at a smaller sum; by exhaustion within groups that share a track."""
    admitted = surveyed.matching.gate(surveyed._candidates(spark, SF), shared=2).where("reason is null").collect()
    cost = {(x.flight_id, x.track_t, x.track_w): x.median_dist for x in admitted}
    got = {(x.flight_id, x.track_t, x.track_w): x.median_dist for x in run(spark, "g10_one_to_one")}
    assert set(got) <= set(cost)
    for f in {k[0] for k in cost}:
        own = [k for k in got if k[0] == f]
        assert len({k[1] for k in own}) == len({k[2] for k in own}) == len(own)
        edges = [k for k in cost if k[0] == f]
        tracks = sorted({k[1] for k in edges})

        def best(i, used):
            if i == len(tracks):
                return (0, 0.0)
            options = [best(i + 1, used)]
            for k in edges:
                if k[1] == tracks[i] and k[2] not in used:
                    n, s = best(i + 1, used | {k[2]})
                    options.append((n + 1, s - cost[k]))
            return max(options)

        memo = {}
        plain = best
        best = lambda i, used: memo.setdefault((i, used), None) or memo.__setitem__((i, used), plain(i, used)) or memo[i, used]
        n, s = best(0, frozenset())
        assert (len(own), -sum(cost[k] for k in own)) == (n, pytest.approx(s, abs=1e-6))


def test_registration_is_a_fit_of_all_frames(spark):
    """The stored affine is the least-squares fit of one-to-one pairs under itself or a neighbour, and its error is theirs."""
    p = surveyed._pairs(spark, SF).toPandas()
    for x in run(spark, "g11_registration"):
        own = p[p.flight_id == x.flight_id]
        m, error, used = surveyed.matching.register(own, (800.0, 512.0), (1600.0, 1024.0))
        assert used == x.pairs and error == pytest.approx(x.rmse, abs=2e-3)
        assert m.T.ravel() == pytest.approx([x.a, x.b, x.tx, x.c, x.d, x.ty], abs=2e-3)


def test_cross_modal_summary(spark):
    for x in run(spark, "g12_cross_modal_match"):
        assert 0 <= x.confirmed <= min(x.tracks_t, x.tracks_w) and x.unmatched == x.tracks_t + x.tracks_w - 2 * x.confirmed


def test_population_queries(spark):
    t = surveyed._transects(spark, SF).toPandas()
    for x in run(spark, "a27_bootstrap"):
        own = t[t.flight_id == x.flight_id].sort_values(["transect_id", "count", "area_ha"])
        y, a = own["count"].to_numpy(float), own["area_ha"].to_numpy()
        pick = np.random.default_rng(42).integers(0, len(y), size=(999, len(y)))
        d = np.asarray([y[i].sum() / a[i].sum() * 100 for i in pick])
        assert (x.density, x.se, x.low, x.high) == pytest.approx((d.mean(), d.std(ddof=1), *np.percentile(d, [2.5, 97.5])))
    t["project"] = t.flight_id // 50
    small = t.groupby(["project", "transect_id"])[["count", "area_ha"]].sum().reset_index()
    for x in run(spark, "g5_population_zinb"):
        own = small[small.project == x.project]
        model = statistics.ZeroInflated(own["count"], own["area_ha"])
        p = model.fit()
        assert x.density == pytest.approx(model.density(p)["density"], rel=1e-6)
        # no better point nearby or at other starts
        r = np.random.default_rng(1)
        assert all(model.likelihood(p + e) <= model.likelihood(p) + 1e-6 for e in r.normal(0, 0.05, (200, 4)) if (np.abs((p + e)[2:]) <= 20).all())


def test_distance_sampling_query(spark):
    """The fitted sigma is a maximum of the likelihood over the truncated distances."""
    for x in run(spark, "g1_distance_sampling"):
        ids = [r.detection_id for r in domain.detections(spark, SF).where(f"modality = '{x.modality}' and detection_id % 10 <> 0").select("detection_id").collect()]
        dist = np.asarray([math.sqrt(-2 * math.log(1 - (i % 997) / 1000)) * abs(math.cos(i)) * 10 for i in ids])
        w = np.percentile(dist, 95)
        kept = dist[dist <= w]
        assert x.n == len(kept) and x.w == pytest.approx(w, abs=1e-3)
        if x.model == "half-normal":
            grid = np.linspace(0, w, 2001)
            loss = lambda s: len(kept) * math.log(np.trapezoid(np.exp(-(grid**2) / (2 * s * s)), grid)) + (kept**2).sum() / (2 * s * s)
            assert loss(x.sigma) <= min(loss(x.sigma * k) for k in (0.97, 0.99, 1.01, 1.03))


def test_width_variation(spark):
    """Delta method by finite differences of the half-normal likelihood."""
    for x in run(spark, "g2_width_cv"):
        assert x.cv_esw > 0
        if x.model != "half-normal":
            continue
        ids = [r.detection_id for r in domain.detections(spark, SF).where(f"modality = '{x.modality}' and detection_id % 10 <> 0").select("detection_id").collect()]
        dist = np.asarray([math.sqrt(-2 * math.log(1 - (i % 997) / 1000)) * abs(math.cos(i)) * 10 for i in ids])
        kept, grid = dist[dist <= x.w], np.linspace(0, x.w, 4001)
        width = lambda t: np.trapezoid(np.exp(-(grid**2) / (2 * math.exp(2 * t))), grid)
        loss = lambda t: len(kept) * math.log(width(t)) + (kept**2).sum() / (2 * math.exp(2 * t))
        t, h = math.log(x.sigma), 1e-3
        info, slope = (loss(t + h) - 2 * loss(t) + loss(t - h)) / h**2, (width(t + h) - width(t - h)) / (2 * h)
        assert x.cv_esw == pytest.approx(abs(slope) / math.sqrt(info) / width(t), rel=0.02)


def test_zinb_fits(spark):
    small = surveyed._projects(spark, SF).toPandas()
    se = {x.project: x for x in run(spark, "g8_zinb_bounds")}
    for x in run(spark, "g7_zinb_fit"):
        own = small[small.project == x.project]
        model, p = statistics.ZeroInflated(own["count"], own["area_ha"]), np.asarray([x.a, x.b, x.log_size, x.logit_zero])
        assert model.likelihood(p) == pytest.approx(x.likelihood)
        free = [0, 1, *[i for i, held in ((2, x.size_held), (3, x.zero_held)) if not held]]
        assert np.abs(model.score(p)[free]).max() < 1e-2
        assert (se[x.project].size_held, se[x.project].zero_held) == (x.size_held, x.zero_held)
