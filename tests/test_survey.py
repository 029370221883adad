import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtally.functions import geometry
from fieldtally.operators import joins, matching, raster, select, tracks
from fieldtally.plans.stages import Flights, Stages, dependents


def test_inactive_runs_do_not_double_rows(spark):
    det = spark.createDataFrame([(1, 5), (2, 5)], "detection_id long, species_id long")
    members = spark.createDataFrame([(10, 1), (20, 1), (21, 2)], "track_id long, detection_id long")
    t = spark.createDataFrame([(10, 1, 1), (20, 2, 1), (21, 2, 1)], "track_id long, run_id long, species_id long")
    runs = spark.createDataFrame([(1, "builtin", False), (2, "boxmot", True)], "run_id long, kind string, is_active boolean")
    r = select.canonical(det, None, members, t, select.analysis_runs(runs)).orderBy("detection_id").collect()
    assert [(x.detection_id, x.track_id) for x in r] == [(1, 20), (2, 21)]


def test_gap_filling_matches_the_worked_example(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 1.0, 0.8, 1), (1, 3, 3.0, 0.0, 4.0, 1.0, 0.6, 2)], "t long, frame long, x1 double, y1 double, x2 double, y2 double, confidence double, cls int")
    r = tracks.fill_gaps(p, ["t"]).orderBy("frame").collect()
    assert [(x.frame, x.x1, round(x.confidence, 6), x.cls, x.interpolated) for x in r][1:3] == [(1, 1.0, 0.7, 1, True), (2, 2.0, 0.7, 1, True)]


@pytest.mark.parametrize(("areas", "young"), [
    ([530, 980, 1000, 1010, 1020, 1040, 1050, 1060, 1090, 1120], [1]),
    ([673, 1080, 1100, 1110, 1120, 1130, 1150], [1]),
    ([673, 1050, 1120, 1180, 1210], []),
    (list(range(900, 1251, 50)), []),
    ([820, 900, 970, 1040, 1110], []),
    ([500, 900, 1000], None),
])
def test_life_stage(spark, areas, young):
    a = spark.createDataFrame([("f", i + 1, float(v)) for i, v in enumerate(areas)], "flight string, track_id long, area double")
    r = tracks.life_stage(a, ["flight"]).collect()
    assert (None if not r else sorted(x.track_id for x in r if x.stage == "juvenile")) == young


def test_nearest_prefers_the_lowest_segment_on_a_tie(spark):
    p = spark.createDataFrame([(1, 50.0, 50.0), (2, 130.0, 5.0), (3, 50.0, 10.0)], "id long, x double, y double")
    s = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0), (2, 0.0, 100.0, 100.0, 100.0)], "seg_id long, ax double, ay double, bx double, by_ double")
    r = {x.id: x for x in joins.nearest_segment(p, s, 60.0).collect()}
    assert (r[1].seg_id, r[1].distance) == (1, 50.0)
    assert r[2].distance == pytest.approx((30**2 + 5**2) ** 0.5) and (r[2].foot_x, r[2].foot_y) == (100.0, 0.0)
    assert r[3].distance == 10.0


def test_asof_tie_goes_to_the_earlier(spark):
    a = spark.createDataFrame([(1, 10), (2, 100)], "id long, t long")
    b = spark.createDataFrame([(7, 8), (8, 12), (9, 130)], "id long, t long")
    assert [tuple(x) for x in joins.asof_nearest(a, b, "t", 30).orderBy("left_id").collect()] == [(1, 7, 2), (2, 9, 30)]


def test_tracker_keeps_ids_and_respects_classes():
    t = matching.Tracker(max_age=1)
    import numpy as np

    box = np.asarray([[0.0, 0, 10, 10], [50, 50, 60, 60]])
    assert t.step(box, np.asarray([1, 2])).tolist() == [1, 2]
    assert t.step(box + 1, np.asarray([1, 2])).tolist() == [1, 2]
    assert t.step(box + 1, np.asarray([1, 1])).tolist() == [1, 3]


def test_registration_from_herd_frames_only():
    rows = []
    for f in range(12):
        w = [(100 + 40 * k + 9 * f * ((-1) ** k), 80 + 55 * k + 4 * f) for k in range(3)]
        for i, (xw, yw) in enumerate(w):
            for j, (a, b) in enumerate(w):
                rows.append((f, j, i, 0.8 * a + 0.05 * b + 3, -0.05 * a + 0.8 * b - 2, xw, yw))
    pairs = pd.DataFrame(rows, columns=["frame_t", "id_t", "id_w", "xt", "yt", "xw", "yw"])
    m, error, _ = matching.register(pairs, (80, 80), (100, 100))
    assert error < 1e-6 and m[0, 0] == pytest.approx(0.8) and m[2, 0] == pytest.approx(3)


def test_registration_uses_all_frames(spark):
    """Frames after the first 2000 count: those with one box on either side come last."""
    rows = []
    for f in range(2100):
        w = [(100 + 40 * k + 9 * (f % 50) * ((-1) ** k), 80 + 55 * k + 4 * (f % 70)) for k in range(1 if f >= 2050 else 2)]
        for flight, noise in ((1, 0), (2, 3))[f < 1990 :]:
            for i, (xw, yw) in enumerate(w):
                for j, (a, b) in enumerate(w):
                    rows.append((flight, f, j, i, 0.8 * a + 0.05 * b + 3 + noise * (f * 7 % 5), -0.05 * a + 0.8 * b - 2 - noise * (f % 3 if f < 2050 else f % 11), float(xw), float(yw)))
    pairs = pd.DataFrame(rows, columns=["flight_id", "frame_t", "id_t", "id_w", "xt", "yt", "xw", "yw"])
    got = {r.flight_id: r for r in matching.registrations(spark.createDataFrame(pairs), "flight_id", (80, 80), (100, 100)).collect()}
    assert set(got) == {1, 2}
    for flight, g in pairs.groupby("flight_id"):
        m, error, used = matching.register(g, (80, 80), (100, 100))
        r = got[flight]
        assert (r.a, r.b, r.tx, r.c, r.d, r.ty) == pytest.approx(tuple(m.T.ravel()), abs=1e-6)
        assert r.pairs == used and r.rmse == pytest.approx(error, abs=1e-6)


def test_boundary_is_inside_for_covers_only(spark):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (10, 0), (10, 10), (0, 10))])
    r = spark.range(1).select(geometry.covers(F.lit(10.0), F.lit(5.0), ring), geometry.in_polygon(F.lit(10.0), F.lit(5.0), ring), geometry.in_polygon(F.lit(5.0), F.lit(5.0), ring)).first()
    assert tuple(r) == (True, False, True)


def test_utm_of_a_known_place(spark):
    r = spark.range(1).select(geometry.to_utm(F.lit(14.0), F.lit(48.0)).alias("u")).first().u
    assert r.easting == pytest.approx(425420.0, abs=40) and r.northing == pytest.approx(5316900.0, abs=400)


def test_average_rounds_half_to_even(spark):
    p = spark.createDataFrame([(1, 0, 0, 1.0), (2, 0, 0, 2.0), (1, 0, 1, 2.0), (2, 0, 1, 3.0)], "frame long, row long, col long, v double")
    assert sorted((x.col, x.v) for x in raster.merge(p, "average").collect()) == [(0, 2.0), (1, 2.0)]


def test_staleness_reaches_both_cameras():
    s = Stages()
    for stage, m in (("detections", "t"), ("georeferenced", "t"), ("tracks", "t"), ("tracks", "w"), ("matches", "tw")):
        s.complete(stage, m)
    assert set(s.complete("tracks", "t")) == {("matches", "tw")}
    assert "population" in dependents("detections")
    assert s.reconcile(lambda a, b: (a, b) != ("detections", "t")) == [("detections", "t")]
    assert s.rows["georeferenced", "t"]["state"] == "stale"


def test_flights_are_unique():
    f = Flights()
    f.add("a", "/x", video="v", gsd=3)
    f.add("b", "/y")
    with pytest.raises(ValueError):
        f.add("A", "/z")
    f.remove(1)
    assert f.active == 0 and f.defaults() == {"gsd": 3}
