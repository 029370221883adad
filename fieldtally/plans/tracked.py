"""Queries in time and space: windows, as-of and range joins, nearest segments, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, raster, tracks
from . import domain as d
from .domain import sql

Q: dict = {}


def query(body: str | None = None):
    def put(f):
        Q[f.__name__] = (f, sql(body) if body else None)
        return f

    return put


OBJECT = ["flight_id", "modality", "obj"]


def _points(spark, sf, deal=lambda rows, *by: rows):
    """One box a frame of each object, with a numeric class; the detections are dealt by object before."""
    p = d.detections(spark, sf, deal, ("user_id div 15", "case when event_id % 2 = 0 then 't' else 'w' end", "user_id % 15")).groupBy(*OBJECT, "frame").agg(
        F.min_by(F.struct("x1", "y1", "x2", "y2", "confidence", (F.col("detection_id") % 4).alias("cls")), "detection_id").alias("b")
    )
    return p.select("flight_id", "modality", "obj", "frame", "b.*")


PTS = "pts as (select flight_id, modality, obj, frame, x1, y1, x2, y2, confidence, detection_id % 4 as cls from (select *, row_number() over (partition by flight_id, modality, obj, frame order by detection_id) as r from det) where r = 1)"


@query(f"with {PTS}, n as (select *, lead(frame) over w as nf, lead(x1) over w as nx1, lead(y2) over w as ny2, lead(confidence) over w as nc from pts window w as (partition by flight_id, modality, obj order by frame)) select flight_id, modality, obj, frame, round(x1, 6) as x1, round(y2, 6) as y2, round(confidence, 6) as confidence, cls, false as interpolated from pts union all select flight_id, modality, obj, f, round(x1 + (nx1 - x1) * (f - frame) / (nf - frame), 6), round(y2 + (ny2 - y2) * (f - frame) / (nf - frame), 6), round((confidence + nc) / 2, 6), cls, true from (select *, unnest(range(frame + 1, nf)) as f from n where nf > frame + 1)")
def w1_fill_gaps(spark, sf):
    r = tracks.fill_gaps(_points(spark, sf, tracks.dealt), OBJECT, deal=False)
    return r.select("flight_id", "modality", "obj", "frame", *[d.rounded(F.col(c), 6).alias(c) for c in ("x1", "y2", "confidence")], "cls", "interpolated")


KEYS = "with n as (select *, lead(frame) over w as nf, lead(x1) over w as nx1 from keyframes window w as (partition by label_track_id order by frame)), e as (select *, unnest(range(frame, case when stop or nf is null then frame + 1 else nf end)) as f from n)"


@query(KEYS + " select label_track_id, f as frame, round(case when f = frame then x1 else x1 + (nx1 - x1) * (f - frame) / (nf - frame) end, 6) as x1, f = frame as is_key from e")
def w2_keyframe_boxes(spark, sf):
    return tracks.between_keyframes(d.keyframes(spark, sf, tracks.dealt), deal=False).select("label_track_id", "frame", d.rounded(F.col("x1"), 6).alias("x1"), "is_key")


STEPS = "with s as (select flight_id, frame, x, y, last_value(x ignore nulls) over w as px, last_value(y ignore nulls) over w as py from poses window w as (partition by flight_id order by frame rows between unbounded preceding and 1 preceding)), c as (select flight_id, frame, sum(coalesce(sqrt((x-px)*(x-px) + (y-py)*(y-py)), 0)) over (partition by flight_id order by frame) as cum from s)"


@query(STEPS + " select flight_id, frame, round(cum, 4) as cum from c")
def w3_path_length(spark, sf):
    return tracks.path_lengths(d.poses(spark, sf), ["flight_id"]).select("flight_id", "frame", F.round("cum", 4).alias("cum"))


@query(STEPS + ", q as (select flight_id, frame as start, cum + 100 as target from c where frame % 10 = 0) select q.flight_id, start, min(c.frame) as reached from q left join c on c.flight_id = q.flight_id and c.frame >= start and cum >= target group by 1, 2")
def w5_frame_at_distance(spark, sf):
    """From every tenth frame, the first one a hundred metres further along the flight's path."""
    c = tracks.path_lengths(d.poses(spark, sf), ["flight_id"]).select("flight_id", "frame", "cum")
    q = c.where("frame % 10 = 0").selectExpr("flight_id", "frame as start", "cum + 100 as target")
    return tracks.frame_reached(c, q, "flight_id").select("flight_id", "start", "reached")


@query("select track_id, frame, detection_id, x1 from (select *, row_number() over (partition by track_id order by frame desc, detection_id) as r from members join det using (detection_id)) where r = 1")
def w7_last_box(spark, sf):
    r = d.members(spark, sf).join(d.detections(spark, sf), "detection_id")
    return tracks.last_box(r.select("track_id", "frame", "detection_id", "x1"))


AREAS = "areas as (select flight_id, track_id, median(a) as area, count(*) as frames from (select flight_id, obj * 2 + (modality = 'w')::int as track_id, (x2 - x1) * (y2 - y1) + case when obj % 7 = 3 then -180 else obj * 3 end as a from det) where a > 0 group by 1, 2)"


def _areas(spark, sf):
    x = d.detections(spark, sf).selectExpr("flight_id", "obj * 2 + cast(modality = 'w' as int) as track_id", "0D as x1", "0D as y1", "1D as x2", "(x2 - x1) * (y2 - y1) + case when obj % 7 = 3 then -180 else obj * 3 end as y2")
    m = tracks.median_areas(x.withColumn("k", F.struct("flight_id", "track_id")), "k")
    return m.select("k.flight_id", "k.track_id", "area", "frames")


@query(f"with {AREAS} select flight_id, track_id, round(area, 6) as area, frames from areas")
def a14_median_areas(spark, sf):
    return _areas(spark, sf).select("flight_id", "track_id", F.round("area", 6).alias("area"), "frames")


STATS = AREAS + ", v as (select flight_id, list(area order by area) as v, median(area) as m, count(*) as n from areas group by 1), s as (select flight_id, n, m, list_median(list_transform(v, lambda a: abs(a - m))) as mad, list_median(v[(n - n // 2 + 1)::int:n::int]) - list_median(v[1:(n // 2)::int]) as iqr from v)"
STATS = STATS.replace("list_median(", "list_aggregate(").replace("lambda a: abs(a - m)))", "lambda a: abs(a - m)), 'median')").replace("v[(n - n // 2 + 1)::int:n::int])", "v[(n - n // 2 + 1)::int:n::int], 'median')").replace("v[1:(n // 2)::int])", "v[1:(n // 2)::int], 'median')")


@query(f"with {STATS} select flight_id, n, round(m, 6) as median, round(mad, 6) as mad, round(iqr, 6) as iqr from s")
def a15_cohort_stats(spark, sf):
    s = tracks.cohort_stats(_areas(spark, sf), ["flight_id"])
    return s.select("flight_id", "n", *[F.round(c, 6).alias(c) for c in ("median", "mad", "iqr")])


@query(f"with {STATS}, g as (select areas.*, lead(area) over (partition by flight_id order by area, track_id) - area as gap from areas), z as (select g.*, m, iqr, case when mad > 0 then 0.6745::double * (area - m) / mad else 0 end as z from g join s using (flight_id) where n >= 4) select flight_id, track_id, round(z, 6) as z, round(area / m, 6) as ratio, case when z < -2 and coalesce(gap > 2 * iqr, false) then 'juvenile' else 'adult' end as stage, z < -2 and not coalesce(gap > 2 * iqr, false) as low_outlier from z")
def w8_life_stage(spark, sf):
    r = tracks.life_stage(_areas(spark, sf), ["flight_id"])
    return r.select("flight_id", "track_id", F.round("z", 6).alias("z"), F.round("ratio", 6).alias("ratio"), "stage", "low_outlier")


@query("with c as (select *, coalesce(sum(stop::int) over (partition by label_track_id order by frame rows between unbounded preceding and 1 preceding), 0) as segment from keyframes) select label_track_id, cast(segment as bigint) as segment, min(frame) as first_frame, max(frame) as last_frame, count(*) as keys from c group by 1, 2")
def w10_segments_at_stops(spark, sf):
    return tracks.segments_at_stops(d.keyframes(spark, sf))


@query(f"with {PTS}, f as (select distinct flight_id, modality, obj, frame from (select flight_id, modality, obj, unnest([5, 17, 29, 41]) as frame from (select distinct flight_id, modality, obj from pts))), b as (select f.*, (select max(frame) from pts p where p.flight_id = f.flight_id and p.modality = f.modality and p.obj = f.obj and p.frame <= f.frame) as pf, (select min(frame) from pts p where p.flight_id = f.flight_id and p.modality = f.modality and p.obj = f.obj and p.frame >= f.frame) as nf from f) select b.flight_id, b.modality, b.obj, b.frame, round(case when p.x1 is null then n.x1 when n.x1 is null or pf = nf then p.x1 else p.x1 + (n.x1 - p.x1) * (b.frame - pf) / (nf - pf) end, 6) as x1 from b left join pts p on p.flight_id = b.flight_id and p.modality = b.modality and p.obj = b.obj and p.frame = pf left join pts n on n.flight_id = b.flight_id and n.modality = b.modality and n.obj = b.obj and n.frame = nf")
def w11_nearest_fill(spark, sf):
    by = ["flight_id", "modality", "obj"]
    p = _points(spark, sf)
    want = p.select(*by).distinct().withColumn("frame", F.explode(F.array(*[F.lit(x).cast("long") for x in (5, 17, 29, 41)])))
    return tracks.nearest_fill(want, p, by).select(*by, "frame", F.round("x1", 6).alias("x1"))


@query("select detection_id, row_number() over (partition by frame order by detection_id) - 1 as idx from det")
def w12_index_in_frame(spark, sf):
    return tracks.running_index(d.detections(spark, sf), ["detection_id"], ["frame"]).select("detection_id", F.col("idx").cast("long").alias("idx"))


@query("with m as (select coalesce(case when label_track_id % 5 = 1 then label_track_id - 1 end, label_track_id) as label_track_id, frame, x1, stop, label_track_id as origin from keyframes), o as (select * from (select *, row_number() over (partition by label_track_id, frame order by origin) as r from m) where r = 1) select label_track_id, frame, x1, stop or coalesce(lead(origin) over w <> origin and lead(frame) over w > frame + 1, false) as stop from o window w as (partition by label_track_id order by frame)")
def w14_merge_tracks(spark, sf):
    k = d.keyframes(spark, sf)
    merges = k.where("label_track_id % 5 = 1").select("label_track_id").distinct().selectExpr("label_track_id as track_id", "label_track_id - 1 as into")
    return tracks.merge_tracks(k, merges).select("label_track_id", "frame", "x1", "stop")


@query("select detection_id, greatest(0, least(800, (x1+x2)/2 + 5 - (x2-x1)/2*1.5::double)) as x1, greatest(0, least(512, (y1+y2)/2 - 3 + (y2-y1)/2*1.5::double)) as y2 from det")
def w17_scale_track(spark, sf):
    return tracks.scale_track(d.detections(spark, sf), 5.0, -3.0, 1.5, 800, 512).select("detection_id", "x1", "y2")


@query("with a as (select frame, detection_id, row_number() over (partition by frame order by detection_id) as n, count(*) over (partition by frame) as c from det where modality = 't'), b as (select frame, detection_id, row_number() over (partition by frame order by detection_id) as n, count(*) over (partition by frame) as c from det where modality = 'w' and detection_id % 60 <> 1) select frame, a.detection_id as left_detection_id, b.detection_id as right_detection_id from a join b using (frame, n, c)")
def j5_positional_link(spark, sf):
    x = d.detections(spark, sf).select("frame", "modality", "detection_id")
    a, b = x.where("modality = 't'").drop("modality"), x.where("modality = 'w' and detection_id % 60 <> 1").drop("modality")
    return joins.positional(a, b, "frame", "detection_id", "detection_id")


@query("with b as (select frame, round(x1 + 0.0001, 3) as a, round(y1, 3) as c, round(x2, 3) as e, round(y2, 3) as g, min(detection_id) as right_id from det group by all) select detection_id as left_id, right_id from det join b on det.frame = b.frame and round(x1, 3) = a and round(y1, 3) = c and round(x2, 3) = e and round(y2, 3) = g")
def j6_rounded_box_link(spark, sf):
    x = d.detections(spark, sf).selectExpr("detection_id as id", "frame", "x1", "y1", "x2", "y2")
    return joins.by_rounded_box(x, x.withColumn("x1", F.col("x1") + 0.0001))


@query("with r as (select det.detection_id, c.pos, c.tx, c.rz, row_number() over (partition by detection_id order by c.pos) as k from det left join corrections c on det.frame between start_frame and end_frame) select detection_id, coalesce(tx, 0.5::double) as tx, coalesce(rz, 0.0::double) as rz from r where k = 1")
def j8_first_correction(spark, sf):
    r = joins.first_range(d.detections(spark, sf), d.corrections(spark, sf))
    return r.select("detection_id", F.coalesce("range.tx", F.lit(0.5)).alias("tx"), F.coalesce("range.rz", F.lit(0.0)).alias("rz"))


@query("with t as (select detection_id as id, flight_id, t_us from det where modality = 't'), w as (select min(detection_id) as id, flight_id, t_us from det where modality = 'w' group by 2, 3), c as (select t.flight_id, t.id as left_id, w.id as right_id, abs(t.t_us - w.t_us) as gap, row_number() over (partition by t.flight_id, t.id order by abs(t.t_us - w.t_us), w.t_us) as r from t join w on t.flight_id = w.flight_id and w.t_us between t.t_us - 60000000 and t.t_us + 60000000) select flight_id, left_id, right_id, gap from c where r = 1")
def j9_asof_nearest(spark, sf):
    x = d.detections(spark, sf).select(F.col("detection_id").alias("id"), "flight_id", "t_us", "modality")
    return joins.asof_nearest(x.where("modality = 't'"), x.where("modality = 'w'"), "t_us", 60_000_000, ["flight_id"])


@query("with t as (select frame, detection_id as id, (x1+x2)/2 as x, (y1+y2)/2 as y from det where modality = 't'), w as (select frame, detection_id as id, (x1+x2)/2 as x, (y1+y2)/2 as y from det where modality = 'w') select t.frame as frame_t, t.id as id_t, w.id as id_w, round(sqrt((t.x-w.x)*(t.x-w.x) + (t.y-w.y)*(t.y-w.y)), 6) as distance from t join w on w.frame = t.frame + 1")
def j10_frame_pairs(spark, sf):
    x = d.detections(spark, sf).selectExpr("modality", "frame", "detection_id as id", "(x1+x2)/2 as x", "(y1+y2)/2 as y")
    frames = x.select(F.col("frame").alias("frame_t")).distinct().withColumn("frame_w", F.col("frame_t") + 1)
    r = joins.frame_pairs(x.where("modality = 't'"), x.where("modality = 'w'"), frames)
    return r.withColumn("distance", F.round("distance", 6))


@query("select v.detection_id as id, min(s.detection_id) as detection_id from det v join det s on v.frame = s.frame and v.source_class = s.source_class and abs(v.confidence - s.confidence) < 0.0015 group by 1")
def j22_same_box(spark, sf):
    x = d.detections(spark, sf).select("detection_id", "frame", "source_class", "confidence")
    return joins.same_box(x.withColumnRenamed("detection_id", "id"), x)


NEAR = "f as (select detection_id as id, transect_id, ax + t*(bx-ax) as fx, ay + t*(by_-ay) as fy, x, y from (select detection_id, (x1+x2)/2/4 as x, (y1+y2)/2 as y from det) p, (select * from lines) l, lateral (select greatest(0.0::double, least(1.0::double, ((x-ax)*(bx-ax) + (y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay)))) as t))"


@query(f"with {NEAR}, g as (select *, sqrt((x-fx)*(x-fx) + (y-fy)*(y-fy)) as d from f) select id, transect_id as seg_id, round(d, 6) as distance, round(fx, 4) as foot_x, round(fy, 4) as foot_y from (select *, row_number() over (partition by id order by d, transect_id) as r from g) where r = 1 and d <= 60")
def j23_nearest_segment(spark, sf):
    p = d.detections(spark, sf).selectExpr("detection_id as id", "(x1+x2)/2/4 as x", "(y1+y2)/2 as y")
    s = d.lines(spark, sf).withColumnRenamed("transect_id", "seg_id").drop("seq")
    r = joins.nearest_segment(p, s, 60.0)
    return r.select("id", "seg_id", F.round("distance", 6).alias("distance"), F.round("foot_x", 4).alias("foot_x"), F.round("foot_y", 4).alias("foot_y"))


@query(f"with {NEAR}, g as (select *, sqrt((x-fx)*(x-fx) + (y-fy)*(y-fy)) as d from f join (select transect_id, least(ax,bx) - 10 as lx, ay - 30 as ly, greatest(ax,bx) - 20 as hx, ay + 30 as hy from lines) a using (transect_id) where x between lx and hx and y between ly and hy), b as (select *, row_number() over (partition by id order by d, transect_id) as r from g) select p.detection_id as id, case when d <= 15 then transect_id end as transect_id, round(d, 6) as distance, d is null as outside, coalesce(d > 15, false) as truncated from (select detection_id from det) p left join (select * from b where r = 1) b on b.id = p.detection_id")
def j26_assign_transects(spark, sf):
    p = d.detections(spark, sf).selectExpr("detection_id as id", "(x1+x2)/2/4 as x", "(y1+y2)/2 as y")
    lines = d.lines(spark, sf).drop("seq")
    areas = lines.selectExpr("transect_id", "least(ax,bx) - 10 as lx", "ay - 30 as ly", "greatest(ax,bx) - 20 as hx", "ay + 30 as hy")
    return joins.assign_transects(p, lines, areas, 15.0).withColumn("distance", F.round("distance", 6))


@query("with p as (select flight_id * 15 + obj as track_id, frame, x1 as x, y1 as y from det) select a.track_id as a, b.track_id as b, round(min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))), 6) as nearest from p a join p b on a.track_id < b.track_id and abs(a.frame - b.frame) <= 2 and sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 60 group by 1, 2")
def j27_near_tracks(spark, sf):
    p = d.detections(spark, sf).selectExpr("flight_id * 15 + obj as track_id", "frame", "x1 as x", "y1 as y")
    return joins.near_tracks(p, 60.0, 2).withColumn("nearest", F.round("nearest", 6))


@query("with v as (select confidence * 40 as dist from det), w as (select quantile_cont(dist, 0.95) as w, count(*) as n from v), b as (select least(20, greatest(5, n // 5)) as b, w from w), h as (select least(floor(dist / w * b), b - 1)::bigint as bin, count(*) as n from v, b where dist <= w group by 1) select r.i as bin, coalesce(n, 0) as n from (select unnest(range(b)) as i from b) r left join h on h.bin = r.i")
def a20_distance_histogram(spark, sf):
    v = d.detections(spark, sf).select((F.col("confidence") * 40).alias("dist"))
    facts = v.agg(F.expr("percentile(dist, 0.95)").alias("w"), F.count(F.lit(1)).alias("n"))
    top, n = facts.select("w").scalar(), facts.select("n").scalar()
    return raster.histogram(v, "dist", top, F.least(F.lit(20), F.greatest(F.lit(5), F.floor(n / 5))))


@query("select modality, round(quantile_cont(confidence, 0.95), 6) as p95, min(confidence) as low, max(confidence) as high, round(avg(confidence), 6) as mean from det group by 1")
def a21_percentiles(spark, sf):
    return d.detections(spark, sf).groupBy("modality").agg(F.round(F.expr("percentile(confidence, 0.95)"), 6).alias("p95"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.round(F.avg("confidence"), 6).alias("mean"))


@query("with h as (select floor(confidence * 50 / 0.25) as b, count(*) as n from det group by 1), c as (select b, sum(n) over (order by b) as c, sum(n) over () as t from h) select (min(b) + 0.5) * 0.25 as value from c where c >= 0.9 * t")
def a22_binned_percentile(spark, sf):
    return raster.binned_percentile(d.detections(spark, sf).select((F.col("confidence") * 50).alias("v")), "v", 0.9)


@query("select floor((y1+y2)/2/25)::bigint as row, floor((x1+x2)/2/25)::bigint as col, count(*) as n from det group by 1, 2")
def a23_grid_counts(spark, sf):
    return raster.cells(d.detections(spark, sf).selectExpr("(x1+x2)/2 as x", "(y1+y2)/2 as y"), 25.0)


COVER = "with f as (select frame, x - 15 as lx, y - 15 as ly, x + 15 as hx, y + 15 as hy from poses where x is not null), c as (select frame, unnest(range(ceil(ly/5 - 0.5)::bigint, floor(hy/5 - 0.5)::bigint + 1)) as row, lx, hx from f), e as (select frame, row, unnest(range(ceil(lx/5 - 0.5)::bigint, floor(hx/5 - 0.5)::bigint + 1)) as col from c), g as (select row, col, count(distinct frame) as frames from e group by 1, 2)"


@query(COVER + " select count(*) * 25.0::double as covered, count(*) filter (frames > 1) * 25.0::double as multi_covered, max(frames) as most, round(avg(frames), 6) as mean from g")
def a24_coverage(spark, sf):
    f = d.poses(spark, sf).where("x is not null").selectExpr("frame", "x - 15 as lx", "y - 15 as ly", "x + 15 as hx", "y + 15 as hy")
    return raster.coverage_summary(raster.coverage(f, 5.0), 5.0).withColumn("mean", F.round("mean", 6))


@query("with p as (select frame, obj as row, detection_id % 5 as col, confidence * 100 as v from (select *, row_number() over (partition by frame, obj, detection_id % 5 order by detection_id) as k from det) where k = 1) select row, col, arg_min(v, frame) as first, arg_max(v, frame) as last, min(v) as low, max(v) as high from p group by 1, 2")
def a25_raster_merge(spark, sf):
    x = d.detections(spark, sf).groupBy("frame", F.col("obj").alias("row"), (F.col("detection_id") % 5).alias("col")).agg((F.min_by("confidence", "detection_id") * 100).alias("v"))
    out = None
    for how, name in (("first", "first"), ("last", "last"), ("min", "low"), ("max", "high")):
        m = raster.merge(x, how).withColumnRenamed("v", name)
        out = m if out is None else out.join(m, ["row", "col"])
    return out


@query("with c as (select floor((y1+y2)/2/25)::bigint as row, floor((x1+x2)/2/25)::bigint as col, count(*)::double as n from det group by 1, 2), k as (select i as k, exp(-0.5 * (i / 2.0::double) * (i / 2.0::double)) as w from range(-8, 9) r(i)), w as (select k, w / (select sum(w) from k) as w from k), a as (select row + k as row, col, sum(n * w) as v from c, w group by 1, 2), b as (select row, col + k as col, sum(v * w) as v from a, w group by 1, 2) select row, col, round(v * 16, 4) as density from b where v >= 1e-4 * (select max(w) * max(w) from w)")
def g9_kernel_density(spark, sf):
    c = raster.cells(d.detections(spark, sf).selectExpr("(x1+x2)/2 as x", "(y1+y2)/2 as y"), 25.0)
    return raster.density(c, 25.0, 50.0).withColumn("density", F.round("density", 4))


@query("with m as (select distinct floor(y1/25)::bigint as row, floor(x1/25)::bigint as col from det), e as (select * from m where (row + 1, col) in (select (row, col) from m) and (row - 1, col) in (select (row, col) from m) and (row, col + 1) in (select (row, col) from m) and (row, col - 1) in (select (row, col) from m)) select row, col from e")
def r30_erode_mask(spark, sf):
    return raster.erode(d.detections(spark, sf).selectExpr("floor(y1/25) as row", "floor(x1/25) as col"), 1)


@query("select min(floor(y1/25)::bigint) as min_row, max(floor(y1/25)::bigint) as max_row, min(floor(x1/25)::bigint) as min_col, max(floor(x1/25)::bigint) as max_col from det")
def r29_raster_bounds(spark, sf):
    return raster.bounds(d.detections(spark, sf).selectExpr("floor(y1/25) as row", "floor(x1/25) as col"))


@query("""
with t as (select flight_id, detection_id, to_timestamp(t_us // 1000000) at time zone 'UTC' as ts from det),
h as (
  select flight_id, detection_id, hour(ts) + minute(ts) / 60.0::double + second(ts) / 3600.0::double as utc,
    hour(ts + to_hours(flight_id % 5)) + minute(ts) / 60.0::double + second(ts) / 3600.0::double as loc from t),
m as (
  select flight_id, degrees(atan2(avg(sin(radians(15 * loc))) filter (detection_id % 2 = 0), avg(cos(radians(15 * loc))) filter (detection_id % 2 = 0))) / 15
    - degrees(atan2(avg(sin(radians(15 * utc))) filter (detection_id % 2 = 0), avg(cos(radians(15 * utc))) filter (detection_id % 2 = 0))) / 15 as off
  from h group by 1)
select flight_id, round_even(off - 24 * floor((off + 12) / 24), 0) + 0.0 as offset_hours from m""")
def a29_timezone_offset(spark, sf):
    """Hours that the local clock of each flight's subtitles is ahead of its log: difference of mean hours, over midnight as well."""
    ts = F.timestamp_seconds(F.floor(F.col("t_us") / 1_000_000))
    x = d.detections(spark, sf).where("detection_id % 2 = 0")
    local = text.hour_of_day(F.timestamp_seconds(F.unix_timestamp(ts) + F.col("flight_id") % 5 * 3600))
    hours = x.groupBy("flight_id").agg(text.mean_hour(local).alias("loc"), text.mean_hour(text.hour_of_day(ts)).alias("utc"))
    off = F.col("loc") - F.col("utc")
    return hours.select("flight_id", (F.bround(off - 24 * F.floor((off + 12) / 24), 0) + 0.0).alias("offset_hours"))
