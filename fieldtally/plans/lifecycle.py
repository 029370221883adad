"""Queries over labels, stores and runs as they change, cameras, distances and outputs of a survey project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import correction, joins, labels, matching, mutate, select, statistics, survey, tracks, vocabulary
from ..sources import exports, stores
from ..sources.scratch import fresh
from . import domain as d
from .domain import sql
from .relational import CAN, RES, RUNS, resolved, rows
from .surveyed import CAND, _candidates, _pairs

Q: dict = {}


def query(body: str | None = None):
    def put(f):
        Q[f.__name__] = (f, sql(body) if body else None)
        return f

    return put


@query(CAN + " select detection_id, species_id from can where species_id <> -2")
def f1_no_false_positives(spark, sf):
    return select.countable(rows(spark, sf), geo=False).select("detection_id", "species_id")


@query(CAN + " select detection_id, species_id, gx1 from can where species_id <> -2 and gx1 is not null")
def f2_positioned(spark, sf):
    return select.countable(rows(spark, sf)).select("detection_id", "species_id", "gx1")


@query("select flight_id, count(*) filter (detection_id % 5 >= 3) as usable, count(*) as n from det group by 1")
def f5_usable_footprints(spark, sf):
    ring = F.transform(F.sequence(F.lit(1), (F.col("detection_id") % 5).cast("int") + 1), lambda i: F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    x = d.detections(spark, sf).withColumn("ring", F.slice(ring, F.lit(1), (F.col("detection_id") % 5).cast("int")))
    return x.groupBy("flight_id").agg(F.sum(statistics.usable_ring(F.col("ring")).cast("long")).alias("usable"), F.count(F.lit(1)).alias("n"))


def _distances(spark, sf) -> DataFrame:
    return d.detections(spark, sf).selectExpr("detection_id", "flight_id", "case when detection_id % 10 = 0 then double('nan') when detection_id % 11 = 0 then double('infinity') when detection_id % 13 = 0 then -1D else x1 / 10D end as distance_m")


DIST = "with v as (select detection_id, flight_id, x1 / 10.0::double as distance_m from det where detection_id % 10 <> 0 and detection_id % 11 <> 0 and detection_id % 13 <> 0)"


@query(DIST + " select detection_id, distance_m from v")
def f6_valid_distances(spark, sf):
    return statistics.valid(_distances(spark, sf)).select("detection_id", "distance_m")


@query(DIST + ", w as (select flight_id, quantile_cont(distance_m, 0.95) as w from v group by 1) select detection_id, distance_m, round(w, 6) as w from v join w using (flight_id) where distance_m <= w")
def f7_truncated_distances(spark, sf):
    r = statistics.truncated(statistics.valid(_distances(spark, sf)), "flight_id")
    return r.select("detection_id", "distance_m", F.round("w", 6).alias("w"))


@query(CAND + " select flight_id, track_t, track_w from c where shared >= 2 and median_dist < 28 and conf_t >= 0.2 and conf_w >= 0.2")
def f11_match_gates(spark, sf):
    return matching.gate(_candidates(spark, sf), shared=2).where("reason is null").select("flight_id", "track_t", "track_w")


@query(CAN + ", f as (select * from can where species_id <> -2 and gx1 is not null) select track_id, min(species_id) as species_id, count(*) as n, round(avg((gx1+gx2)/2), 4) as cx, round(avg((gy1+gy2)/2), 4) as cy from f where track_id is not null group by 1 union all select null, null, count(*), null, null from f where track_id is null")
def a3_track_centroids(spark, sf):
    r = select.countable(rows(spark, sf))
    c = select.centroids(r).select("track_id", "species_id", "n", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))
    alone = r.where("track_id is null").agg(F.count(F.lit(1)).alias("n")).selectExpr("cast(null as long) as track_id", "cast(null as long) as species_id", "n", "cast(null as double) as cx", "cast(null as double) as cy")
    return c.unionByName(alone)


@query(CAND + ", m as (select flight_id, count(*) as confirmed from c where shared >= 2 and median_dist < 28 and conf_t >= 0.2 and conf_w >= 0.2 and track_t = track_w group by 1) select flight_id, count(distinct track_t) as tracks_t, count(distinct track_w) as tracks_w, coalesce(max(confirmed), 0) as confirmed, count(distinct track_t) + count(distinct track_w) - 2 * coalesce(max(confirmed), 0) as unmatched from c left join m using (flight_id) group by 1")
def a6_match_summary(spark, sf):
    found = _candidates(spark, sf)
    matched = matching.gate(found, shared=2).where("reason is null and track_t = track_w")
    return matching.match_summary(found, matched, "flight_id")


PATH = "with p as (select flight_id, frame, arg_min(x1, detection_id) as x, arg_min(y1, detection_id) as y from det group by 1, 2), s as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as step from p window w as (partition by flight_id order by frame)), k as (select flight_id, frame, sum(coalesce(step, 0)) over (partition by flight_id order by frame) as cum from s)"


def _paths(spark, sf) -> DataFrame:
    p = d.detections(spark, sf).groupBy("flight_id", "frame").agg(F.min_by(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), "detection_id").alias("p"))
    return tracks.path_lengths(p.select("flight_id", "frame", "p.*"), ["flight_id"])


@query(PATH + " select flight_id, frame, round(abs(cum - first_value(cum) over (partition by flight_id order by frame desc)), 4) as length_m from k")
def w4_path_between(spark, sf):
    """Length of the path between each frame and the flight's last one."""
    c = _paths(spark, sf)
    pairs = c.join(c.groupBy("flight_id").agg(F.max("frame").alias("b")), "flight_id").select("flight_id", F.col("b").alias("a"), F.col("frame").alias("b"))
    r = tracks.path_between(c, pairs, "flight_id")
    return r.select("flight_id", F.col("b").alias("frame"), F.round("length_m", 4).alias("length_m"))


@query(PATH + " select flight_id, round(max(cum), 4) as length_m, count(*) as points from k group by 1")
def w6_polyline_length(spark, sf):
    return _paths(spark, sf).groupBy("flight_id").agg(F.round(F.max("cum"), 4).alias("length_m"), F.count(F.lit(1)).alias("points"))


@query("with a as (select flight_id, obj, median((x2-x1)*(y2-y1)) as area from det group by 1, 2), m as (select flight_id, median(area) as m from a group by 1) select flight_id, obj as track_id, round(area / m, 6) as ratio from a join m using (flight_id)")
def w9_cohort_ratio(spark, sf):
    a = d.detections(spark, sf).groupBy("flight_id", F.col("obj").alias("track_id")).agg(F.expr("percentile((x2-x1)*(y2-y1), 0.5)").alias("area"))
    return tracks.cohort_ratio(a, "flight_id").select("flight_id", "track_id", F.round("ratio", 6).alias("ratio"))


@query("select detection_id, frame, source_id from det where source_id <> 1 union all select detection_id + 10000000, frame + 1, 1 from det where source_id = 1 and detection_id % 3 = 0")
def u6_replace_by_producer(spark, sf):
    x = d.detections(spark, sf).select("detection_id", "frame", "source_id")
    new = x.where("source_id = 1 and detection_id % 3 = 0").selectExpr("detection_id + 10000000 as detection_id", "frame + 1 as frame", "source_id")
    return mutate.replace_where(x, new, "source_id", 1)


@query(CAND + " select flight_id, round(sqrt(avg(dist * dist)), 6) as rmse, count(*) as pairs from p where track_t = track_w group by 1")
def m4_affine_rmse(spark, sf):
    p = _pairs(spark, sf).where("track_t = track_w")
    return matching.rmse(p, (0.5, 0.0, -15.0, 0.0, 0.5, 6.0), "flight_id").withColumn("rmse", F.round("rmse", 6))


@query("select detection_id, (epoch(timezone('Europe/Vienna', to_timestamp(t_us // 1000000))) - t_us // 1000000) / 3600.0::double as hours from det")
def t6_zone_offset(spark, sf):
    ts = F.timestamp_seconds(F.floor(F.col("t_us") / 1_000_000))
    return d.detections(spark, sf).select("detection_id", text.zone_offset(ts, "Europe/Vienna").alias("hours"))


FITS = "with f as (select flight_id, count(*) as n, 10 + flight_id % 7 * 1.0::double as esw, 40.0::double as w, 0.1::double as cv_esw, 1000.0::double + flight_id as length_m from det group by 1)"


def _fits(spark, sf) -> tuple[DataFrame, DataFrame]:
    f = d.detections(spark, sf).groupBy("flight_id").agg(F.count(F.lit(1)).alias("n"))
    return f.selectExpr("flight_id", "n", "10 + flight_id % 7 * 1D as esw", "40D as w", "0.1D as cv_esw"), f.selectExpr("flight_id", "1000D + flight_id as length_m")


@query(FITS + ", c as (select *, n / (2 * esw * length_m) * 10000 as dens, sqrt(1.0::double / n + cv_esw * cv_esw) as cv from f) select flight_id, round(esw / w, 6) as p, round(dens, 6) as density_ha, round(cv, 6) as cv, round(dens / exp(1.96 * sqrt(ln(1 + cv * cv))), 6) as low, round(dens * exp(1.96 * sqrt(ln(1 + cv * cv))), 6) as high from c")
def g3_distance_summary(spark, sf):
    r = statistics.density_summary(*_fits(spark, sf), "flight_id")
    return r.select("flight_id", *[F.round(c, 6).alias(c) for c in ("p", "density_ha", "cv", "low", "high")])


@query(FITS + ", p as (select flight_id // 3 as project, sum(n) as n, sum(length_m) as length_m from f group by 1) select project, n::bigint as n, round(length_m, 4) as length_m from p")
def g4_pooled_projects(spark, sf):
    """Distances and line lengths of several flights pooled into projects, as the input of one fit."""
    fits, lengths = _fits(spark, sf)
    own = d.detections(spark, sf).select("flight_id", F.col("x1").alias("distance_m"))
    dist, line = statistics.pooled(own, lengths, "flight_id", F.expr("flight_id div 3"))
    n = dist.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    return n.join(line, "project").select("project", "n", F.round("length_m", 4).alias("length_m"))


TRACKED = "with p as (select flight_id * 100 + obj as id, arg_max(x1, frame * 1000000000 + detection_id) / 4 as x, arg_max(y1, frame * 1000000000 + detection_id) as y, (flight_id * 100 + obj) % 180 * 1.0::double as cx, (flight_id * 100 + obj) * 7 % 450 * 1.0::double as cy from det group by flight_id, obj), c as (select id, transect_id, sqrt((cx - greatest(0, least(190, cx)))^2 + (cy - ay)^2) as d, row_number() over (partition by id order by sqrt((cx - greatest(0, least(190, cx)))^2 + (cy - ay)^2), transect_id) as r from p, lines)"


@query(TRACKED + " select p.id, c.transect_id as seg_id, round(abs(p.y - l.ay), 6) as distance_m from c join p using (id) join lines l using (transect_id) where r = 1 and d <= 80")
def g18_perpendicular_tracks(spark, sf):
    """Perpendicular distance of each track's last box to the segment nearest to its camera."""
    p = d.detections(spark, sf).groupBy("flight_id", "obj").agg(F.max_by(F.struct("x1", "y1"), F.struct("frame", "detection_id")).alias("b"))
    p = p.selectExpr("flight_id * 100 + obj as id", "b.x1 / 4 as x", "b.y1 as y", "(flight_id * 100 + obj) % 180 * 1D as cam_x", "(flight_id * 100 + obj) * 7 % 450 * 1D as cam_y")
    r = survey.perpendicular(p, d.lines(spark, sf).withColumnRenamed("transect_id", "seg_id").drop("seq"), 80.0)
    return r.select("id", "seg_id", F.round("distance_m", 6).alias("distance_m"))


TABLE = "with s as (select distinct flight_id, obj, x1 as x from det), a as (select flight_id, obj, sum(case when nxt is null then 900 else 900 - greatest(0, 30 - (nxt - x)) * 30 end) as area from (select *, lead(x) over (partition by flight_id, obj order by x) as nxt from s) group by 1, 2), n as (select flight_id, obj, count(*) as count, count(distinct frame) as frames, count(*) filter (source_class = 'click') as clicks from det group by 1, 2)"


@query(TABLE + " select flight_id, obj as transect_id, count, frames, clicks, round(area / 10000, 6) as area_ha from a join n using (flight_id, obj)")
def g19_project_table(spark, sf):
    """Counts, tallies and covered area of each flight's transects, as one table."""
    x = d.detections(spark, sf)
    key = F.concat_ws(":", "flight_id", "obj").alias("key")
    pt = lambda a, b: F.struct((F.col("x1") + a).alias("x"), F.lit(b).alias("y"))
    ring = F.array(pt(-15.0, -15.0), pt(15.0, -15.0), pt(15.0, 15.0), pt(-15.0, 15.0)).alias("ring")
    area = statistics.union_areas(x.select("flight_id", "obj", "x1").distinct().select(key, ring), "key")
    n = x.groupBy("flight_id", "obj").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("frame").alias("frames"), F.sum((F.col("source_class") == "click").cast("long")).alias("clicks"))
    r = n.withColumn("key", key).join(area, "key")
    return r.select("flight_id", F.col("obj").alias("transect_id"), "count", "frames", "clicks", F.round(F.col("area") / 10_000, 6).alias("area_ha"))


def _surveyed(spark, sf) -> DataFrame:
    x = d.detections(spark, sf).groupBy("flight_id", "source_class", "obj").agg(F.count(F.lit(1)).alias("count"))
    return x.select("flight_id", "source_class", F.col("obj").alias("transect_id"), "count", (1.0 + F.col("obj") / 10.0).alias("area_ha"))


@query("with t as (select flight_id, source_class, obj, count(*) as c, 1 + obj / 10.0::double as a from det group by 1, 2, 3), s as (select flight_id, sum(a) as study from (select distinct flight_id, obj, 1 + obj / 10.0::double as a from det) group by 1) select flight_id, source_class, round(sum(c) / sum(a) * 100, 6) as density, round(sum(c) / sum(a) * 100 * study * 5 / 100, 6) as abundance from t join s using (flight_id) group by flight_id, source_class, study")
def g20_population_strata(spark, sf):
    """Density of every species in every flight, and its abundance on a study area five times what was flown."""
    t = _surveyed(spark, sf)
    study = t.select("flight_id", "transect_id", "area_ha").distinct().groupBy("flight_id").agg((F.sum("area_ha") * 5).alias("study_ha"))
    r = statistics.abundance(t, ["flight_id", "source_class"], study, "flight_id")
    return r.select("flight_id", "source_class", F.round("density", 6).alias("density"), F.round("abundance", 6).alias("abundance"))


@query(CAN + ", f as (select * from can join species using (species_id) where species_id <> -2 and gx1 is not null) select coalesce(name, '(all)') as stratum, count(*) as points, round(avg((gx1+gx2)/2), 4) as cx from f group by grouping sets ((name), ())")
def g21_analytics_strata(spark, sf):
    """All species and each of them as one stratum of points; strata without a point don't appear."""
    r = select.countable(rows(spark, sf)).join(d.species(spark, sf).withColumnRenamed("name", "stratum"), "species_id")
    g = r.rollup("stratum").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg((F.col("gx1") + F.col("gx2")) / 2), 4).alias("cx"))
    return g.select(F.coalesce("stratum", F.lit("(all)")).alias("stratum"), "points", "cx")


@query("select detection_id as segment_id, 'Polygon' as kind, 4 as points, x1 as x from det where detection_id % 4 <> 0")
def e5_segment_features(spark, sf):
    pt = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    ring = F.when(F.col("detection_id") % 4 != 0, F.array(pt("x1", "y1"), pt("x2", "y1"), pt("x2", "y2")))
    v = exports.polygons_geojson(d.detections(spark, sf).select(F.col("detection_id").alias("segment_id"), ring.alias("ring")))
    c = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<array<array<double>>>")[0]
    return v.select("segment_id", F.get_json_object("value", "$.geometry.type").alias("kind"), F.size(c).alias("points"), F.get(F.get(c, F.lit(3)), F.lit(0)).alias("x"))


@query(f"with {RES} select f, count(*) as n from res, (values ('coco'), ('yolo'), ('mot'), ('geojson_points'), ('camtrap'), ('dwca')) t(f) where species_id <> -2 or f in ('geojson_points', 'camtrap') group by 1")
def e9_rows_by_format(spark, sf):
    r, out = resolved(spark, sf), None
    for f in ("coco", "yolo", "mot", "geojson_points", "camtrap", "dwca"):
        one = exports.rows_for(f, r).agg(F.lit(f).alias("f"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select flight_id, source_class, obj as transect_id, count(*) as count, 1 + obj / 10.0::double as area_ha from det group by all")
def e10_population_csv(spark, sf):
    """The transect table as CSV, read back."""
    t, path = _surveyed(spark, sf), fresh(spark, "population")
    t.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(t.schema).csv(path)


@query("select flight_id, case when obj = 0 then 'route' else 'transect' end as kind, case when obj = 0 then 0 else row_number() over (partition by flight_id, obj > 0 order by obj) end as number, obj, count(*) as points from det group by flight_id, obj")
def e13_planned_routes(spark, sf):
    """Features of a flight plan split into the whole route and numbered transects."""
    f = d.detections(spark, sf).groupBy("flight_id", "obj").agg(F.count(F.lit(1)).alias("points")).withColumn("name", F.when(F.col("obj") == 0, "Total-Route").otherwise(F.concat(F.lit("t"), F.col("obj").cast("string"))))
    r = exports.split_plan(f, "flight_id", "obj")
    return r.select("flight_id", "kind", "number", "obj", "points")


@query("select flight_id, count(*) as points, '<kml xmlns=\"http://www.opengis.net/kml/2.2\"><Placemark><LineString><coordinates>' || string_agg(x1 || ',' || y1 || ',0', ' ' order by detection_id) || '</coordinates></LineString></Placemark></kml>' as value from det where modality = 'w' group by 1")
def e14_route_kml(spark, sf):
    p = d.detections(spark, sf).where("modality = 'w'").selectExpr("flight_id", "detection_id as seq", "x1 as lon", "y1 as lat")
    return exports.route_kml(p, "flight_id")


@query("select detection_id, 'resolved' as state, null as reason from geo where detection_id % 2 = 0 union all select detection_id, 'failed', reason from failures where detection_id not in (select detection_id from geo where detection_id % 2 = 0)")
def k3_replace_geo(spark, sf):
    """Positions and failures of a new run replace all old ones; a detection is in one of the two tables."""
    return mutate.replace_geo(d.geo(spark, sf).where("detection_id % 2 = 0"), d.failures(spark, sf)).select("detection_id", "state", "reason")


@query(CAND + " select 1 + coalesce((select max(run_id) from track_runs), 0) as run_id, flight_id, track_t, track_w from c where track_t = track_w")
def k6_append_matches(spark, sf):
    m = _candidates(spark, sf).where("track_t = track_w")
    top = d.track_runs(spark, sf).agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("m")).scalar()
    one = stores.assert_unique(stores.assert_unique(m, "flight_id", "track_t"), "flight_id", "track_w")
    return one.select((top + 1).alias("run_id"), "flight_id", "track_t", "track_w")


@query("select source_class as model, source_id as layer, max(detection_id) as run_id, count(*) as runs from det group by 1, 2")
def k7_embedding_runs(spark, sf):
    r = d.detections(spark, sf).selectExpr("detection_id as run_id", "source_class as model", "source_id as layer")
    return labels.usable_run(r, ["model", "layer"]).join(r.groupBy("model", "layer").agg(F.count(F.lit(1)).alias("runs")), ["model", "layer"])


@query("select detection_id, source_class as task, confidence from det where source_class <> 'view'")
def k10_clear_task(spark, sf):
    p = d.detections(spark, sf).select("detection_id", F.col("source_class").alias("task"), "confidence")
    return mutate.without(p, p.where("task = 'view'").select("task").distinct(), "task")


@query("select label_track_id, species_id from label_tracks where label_track_id % 2 <> 0 union all select label_track_id, 9 from label_tracks where label_track_id % 2 = 0 union all select track_id + 1000000, 7 from tracks where run_id = 3")
def k11_upsert_label_tracks(spark, sf):
    t = d.label_tracks(spark, sf).select("label_track_id", "species_id")
    new = t.where("label_track_id % 2 = 0").selectExpr("label_track_id", "9L as species_id")
    new = new.unionByName(d.tracks(spark, sf).where("run_id = 3").selectExpr("track_id + 1000000 as label_track_id", "7L as species_id"))
    return mutate.replace_keys(t, new, "label_track_id")


@query("select distinct k.label_track_id as track_id, detection_id from keyframes k join det using (frame, x1, y1, x2, y2)")
def k14_manual_run(spark, sf):
    return labels.manual_members(d.keyframes(spark, sf), d.detections(spark, sf))


@query("select 'kept' as what, count(*) as n, max(x1) as right_most from det where not exists (select 1 from keyframes k where k.frame = det.frame and k.x1 = det.x1 and k.y1 = det.y1) union all select 'manual', count(*), max(x1) from det where exists (select 1 from keyframes k where k.frame = det.frame and k.x1 = det.x1 and k.y1 = det.y1)")
def k15_clear_materialised(spark, sf):
    x, k = d.detections(spark, sf), d.keyframes(spark, sf)
    one = lambda df, what: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"), F.max("x1").alias("right_most"))
    keys = ["frame", "x1", "y1"]
    return one(mutate.without(x, k, *keys), "kept").unionByName(one(x.join(k.select(*keys).distinct(), keys, "left_semi"), "manual"))


@query("with s as (select flight_id, modality, 'complete' as state, count(*) as generation from det where flight_id % 2 = 0 group by 1, 2), c as (select distinct flight_id, modality from det where modality = 't') select coalesce(s.flight_id, c.flight_id) as flight_id, coalesce(s.modality, c.modality) as modality, case when c.flight_id is not null then 'stale' else s.state end as state, coalesce(generation, 0) + (c.flight_id is not null)::int as generation from s full join c on s.flight_id = c.flight_id and s.modality = c.modality")
def k16_stage_state(spark, sf):
    x = d.detections(spark, sf)
    s = x.where("flight_id % 2 = 0").groupBy("flight_id", "modality").agg(F.lit("complete").alias("state"), F.count(F.lit(1)).alias("generation"))
    return labels.upsert_state(s, x.where("modality = 't'").select("flight_id", "modality", F.lit("stale").alias("state")).distinct(), "flight_id", "modality")


@query("select species_id, case when species_id = 6 then 'red fox' else name end as name from species where species_id <> 7 union all select 10, 'lynx'")
def k17_edit_vocabulary(spark, sf):
    s = d.species(spark, sf).withColumn("protected", F.col("species_id") <= 0)
    s = vocabulary.rename_species(vocabulary.add_species(s, "lynx"), 6, "red fox")
    return vocabulary.delete_species(s, 7, {"tracks": d.tracks(spark, sf)}).select("species_id", "name")


@query("select detection_id, case detection_id % 4 when 0 then case when detection_id % 8 <> 0 then '1' else '0' end when 1 then (detection_id % 8)::varchar when 2 then (detection_id % 8)::double::varchar else 'v' || detection_id % 8 end as value from det")
def k19_save_settings(spark, sf):
    i = F.col("detection_id")
    kind = F.element_at(F.array(F.lit("bool01"), F.lit("int_str"), F.lit("double"), F.lit("str")), (i % 4 + 1).cast("int"))
    raw = F.when(i % 4 == 3, F.concat(F.lit("v"), (i % 8).cast("string"))).otherwise((i % 8).cast("double").cast("string"))
    return d.detections(spark, sf).select("detection_id", labels.encoded(raw, kind).alias("value"))


@query("select detection_id, 1 + row_number() over (partition by flight_id order by frame, detection_id) as n from det")
def l1_ordered_reads(spark, sf):
    r = tracks.running_index(d.detections(spark, sf), ["frame", "detection_id"], ["flight_id"])
    return r.select("detection_id", (F.col("idx") + 2).cast("long").alias("n"))


@query("select flight_id, obj as value_id, row_number() over (partition by flight_id order by obj * 7 % 11, obj) as place from (select distinct flight_id, obj from det)")
def l6_enum_order(spark, sf):
    v = d.detections(spark, sf).selectExpr("flight_id", "obj as value_id", "obj * 7 % 11 as ordinal").distinct()
    return tracks.running_index(v, ["ordinal", "value_id"], ["flight_id"]).select("flight_id", "value_id", (F.col("idx") + 1).cast("long").alias("place"))


@query(CAND + ", m as (select flight_id, track_t, track_w from c where shared >= 2 and median_dist < 28) select p.flight_id, p.frame, p.track_t, p.track_w, round(p.dist, 4) as dist from p join m using (flight_id, track_t, track_w)")
def j18_frame_pairs_of_run(spark, sf):
    m = _candidates(spark, sf).where("shared >= 2 and median_dist < 28").select("flight_id", "track_t", "track_w")
    dx, dy = F.col("xw") / 2 - 15 - F.col("xt"), F.col("yw") / 2 + 6 - F.col("yt")
    return _pairs(spark, sf).join(m, ["flight_id", "track_t", "track_w"]).select("flight_id", F.col("frame_t").alias("frame"), "track_t", "track_w", F.round(F.sqrt(dx * dx + dy * dy), 4).alias("dist"))


SYNC = "with s as (select detection_id, detection_id % 3 as species_id, case when detection_id % 2 = 0 then 'male' end as sex from det where modality = 't'), t as (select detection_id, case when detection_id % 4 = 1 then 0 else 5 end as species_id, detection_id % 7 = 0 as manual from det where modality = 'w')"


@query(SYNC + " select t.detection_id as id, case when not manual and t.species_id = 0 and s.detection_id is not null then s.species_id else t.species_id end as species_id, case when not manual then s.sex end as sex, manual from t left join s on s.detection_id = t.detection_id - 1")
def j20_sync_detections(spark, sf):
    return joins.fill_only(*_sync(spark, sf)).drop("age")


def _sync(spark, sf):
    x = d.detections(spark, sf)
    source = x.where("modality = 't'").selectExpr("detection_id as id", "detection_id % 3 as species_id", "case when detection_id % 2 = 0 then 'male' end as sex", "cast(null as string) as age")
    target = x.where("modality = 'w'").selectExpr("detection_id as id", "case when detection_id % 4 = 1 then 0L else 5L end as species_id", "cast(null as string) as sex", "cast(null as string) as age", "detection_id % 7 = 0 as manual")
    return source, target, x.where("modality = 't'").selectExpr("detection_id as source_id", "detection_id + 1 as target_id")


@query(SYNC + " select 'w' as modality, count(*) as n, count(*) filter (not manual and t.species_id = 0 and s.species_id > 0) as species_filled, count(*) filter (not manual and s.sex is not null) as sex_filled from t left join s on s.detection_id = t.detection_id - 1")
def r31_sync_report(spark, sf):
    """A sync in one direction, and what it filled; the target must be of the other camera."""
    return joins.sync_report(*_sync(spark, sf), "t", "w")


@query("select detection_id, round(-(radians(detection_id % 400 - 360 * floor(detection_id % 400 / 360.0)) - 0.1), 6) as ez, x1 + 2 as x, round(y1 + case when flight_id % 2 = 0 then 1.5 else 0 end, 6) as y from det")
def m14_corrected_camera(spark, sf):
    xyz = lambda a, b, c: F.struct(a.alias("x"), b.alias("y"), c.alias("z"))
    zero = F.lit(0.0)
    c = labels.camera(
        xyz(zero, zero, (F.col("detection_id") % 400).cast("double")), xyz(F.col("x1"), F.col("y1"), F.lit(100.0)), xyz(zero, zero, F.lit(0.1)),
        xyz(F.lit(2.0), F.when(F.col("flight_id") % 2 == 0, 1.5).otherwise(0.0), zero),
    )
    return d.detections(spark, sf).select("detection_id", c.alias("c")).select("detection_id", F.round("c.ez", 6).alias("ez"), "c.x", F.round("c.y", 6).alias("y"))


@query("select detection_id, round(100 + (x1 + 32) * 0.5, 6) as x, round(700 - (y1 + 16) * 0.6, 6) as y, 32.0::double as w, round(19.2::double, 6) as h from det")
def m24_tile_window(spark, sf):
    n = lambda v: F.lit(float(v))
    c = labels.tile_window(n(100), n(100), n(600), n(700), n(1000), n(1000), F.col("x1"), F.col("y1"), n(64), n(32))
    return d.detections(spark, sf).select("detection_id", c.alias("c")).select("detection_id", *[F.round(f"c.{k}", 6).alias(k) for k in "xywh"])


HUE = "with h as (select detection_id, ('0x' || substr(sha256(detection_id::varchar), 1, 8))::bigint / 4294967296.0::double as h from det), t as (select detection_id, unnest([1, 2, 3]) as k, unnest([h + 1 / 3.0::double, h, h - 1 / 3.0::double]) as t from h), f as (select detection_id, k, t - floor(t) as t from t), v as (select detection_id, k, floor(255 * case when t < 1 / 6.0::double then 0.175::double + 0.65::double * 6 * t when t < 0.5 then 0.825::double when t < 2 / 3.0::double then 0.175::double + 0.65::double * 6 * (2 / 3.0::double - t) else 0.175::double end)::bigint as c from f)"


@query(HUE + " select detection_id, max(c) filter (k = 1) as r, max(c) filter (k = 2) as g, max(c) filter (k = 3) as b from v group by 1")
def t16_colours(spark, sf):
    return d.detections(spark, sf).select("detection_id", labels.colour(F.col("detection_id")).alias("c")).select("detection_id", "c.*")


@query("with k as (select detection_id, unnest(range(floor(x1 / 20)::bigint, floor(x2 / 20)::bigint + 1)) as cx, y1, y2 from det), c as (select detection_id, cx, unnest(range(floor(y1 / 20)::bigint, floor(y2 / 20)::bigint + 1)) as cy from k) select detection_id as id from c group by 1 having bool_and((cx + cy) % 9 <> 0)")
def f15_boxes_in_mask(spark, sf):
    x = d.detections(spark, sf)
    valid = spark.range(200).crossJoin(spark.range(200).withColumnRenamed("id", "cy")).select(F.col("id").alias("cx"), "cy").where("(cx + cy) % 9 <> 0")
    return labels.inside_mask(x.select(F.col("detection_id").alias("id"), "x1", "y1", "x2", "y2"), valid, 20.0)


@query("select t.track_id, coalesce(p.label, s.name) as name from tracks t left join (select track_id * 10 + 2 as track_id, min(label) as label from predictions where track_id % 3 = 0 group by 1) p using (track_id) left join species s using (species_id)")
def r3_track_names(spark, sf):
    c = d.predictions(spark, sf).where("track_id % 3 = 0").groupBy((F.col("track_id") * 10 + 2).alias("track_id")).agg(F.min("label").alias("label"))
    return labels.track_names(d.tracks(spark, sf), c, d.species(spark, sf))


@query("select w.detection_id, round((t.x2 - t.x1) * 2, 4) as width, round((t.y2 - t.y1) * 2, 4) as height from det w join det t on t.detection_id = w.detection_id - 1 where w.modality = 'w'")
def r5_crop_sizes(spark, sf):
    """Crop sizes of colour boxes from their thermal partners' boxes, by the inverse scale of the registration."""
    x = d.detections(spark, sf)
    t = x.where("modality = 't'").selectExpr("detection_id + 1 as detection_id", "x2 - x1 as tw", "y2 - y1 as th")
    a = (F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0.5))
    s = matching.inverse_scale(*a)
    return x.where("modality = 'w'").select("detection_id").join(t, "detection_id").select("detection_id", F.round(F.col("tw") * s["x"], 4).alias("width"), F.round(F.col("th") * s["y"], 4).alias("height"))


@query("select detection_id, flight_id from det where flight_id % 2 = 0 union all select detection_id + 10000000, flight_id from det where flight_id % 2 = 1 and source_id = 1")
def r6_adopt_legacy(spark, sf):
    """Legacy rows are taken over for flights whose store is empty, those of the detector alone."""
    x = d.detections(spark, sf)
    legacy = x.withColumn("detection_id", F.col("detection_id") + 10000000)
    return mutate.adopt(x.where("flight_id % 2 = 0"), legacy.where("source_id = 1"), "flight_id").select("detection_id", "flight_id")


@query("select l.label_track_id, n.name, coalesce(s.species_id, 0) as species_id from label_tracks l join (select label_track_id, case label_track_id % 3 when 0 then ' Fox ' when 1 then 'HARE' else 'lynx' end as name from label_tracks) n using (label_track_id) left join species s on s.name = lower(trim(n.name))")
def r8_label_rows(spark, sf):
    t = d.label_tracks(spark, sf).selectExpr("label_track_id", "case label_track_id % 3 when 0 then ' Fox ' when 1 then 'HARE' else 'lynx' end as name")
    return labels.stored_rows(t, d.species(spark, sf))


@query("select label_track_id, count(*) as n, min(frame) as first, max(frame) as last, arg_max(x2, frame) as x2 from keyframes group by 1")
def r9_nested_labels(spark, sf):
    k = labels.nested_keys(d.keyframes(spark, sf))
    last = F.element_at("keys", -1)
    return k.select("label_track_id", F.size("keys").cast("long").alias("n"), F.get("keys", F.lit(0))["frame"].alias("first"), last["frame"].alias("last"), last["x2"].alias("x2"))


@query("select detection_id, frame, x1 from det where detection_id % 7 <> 0 union all select 20000000 + label_track_id * 10000 + frame, frame, x1 from keyframes where frame % 5 <> 0")
def r10_replace_label_block(spark, sf):
    """The label block of the detections is replaced by what the key frames now say; detector rows stay."""
    x = d.detections(spark, sf).withColumn("block", F.when(F.col("detection_id") % 7 == 0, "label").otherwise("detector")).select("detection_id", "frame", "x1", "block")
    new = d.keyframes(spark, sf).where("frame % 5 <> 0").selectExpr("20000000 + label_track_id * 10000 + frame as detection_id", "frame", "x1", "'label' as block")
    return mutate.replace_where(x, new, "block", "label").drop("block")


@query("with n as (select distinct lower(trim(coalesce(case when detection_id % 9 = 0 then null when detection_id % 5 = 0 then ' Roe Deer' else 'kind ' || obj end, 'unknown'))) as name from det), c as (select name, case name when 'roe deer' then 0 when 'red deer' then 1 end as k from n) select name, k as class_id from c where k is not null union all select name, 1 + row_number() over (order by name) from c where k is null")
def r11_class_numbers(spark, sf):
    x = d.detections(spark, sf).selectExpr("case when detection_id % 9 = 0 then null when detection_id % 5 = 0 then ' Roe Deer' else 'kind ' || obj end as name")
    return labels.class_numbers(x, ["roe deer", "red deer"])


@query("select detection_id, case when detection_id % 2 = 0 then to_json({'k': attributes->>'$.k'}) else '{}' end as attributes from det")
def r12_prune_fields(spark, sf):
    x = d.detections(spark, sf).select("detection_id", F.when(F.col("detection_id") % 2 == 0, F.col("attributes")).otherwise('{"gone": 1}').alias("attributes"))
    fields = spark.createDataFrame([("k", "detection", "int", None)], "name string, scope string, type string, enum_id long")
    return vocabulary.prune(x, fields, "detection")


@query("with k as (select *, case when frame % 2 = 0 then 'occluded' else 'clear' end as occ from keyframes where frame % 3 <> 0), e as (select label_track_id, frame, x1 + 1 as x1 from keyframes where frame % 4 = 0), b as (select coalesce(k.label_track_id, e.label_track_id) as label_track_id, coalesce(k.frame, e.frame) as frame, coalesce(e.x1, k.x1) as x1, occ, coalesce(stop, false) as stop from k full join e on k.label_track_id = e.label_track_id and k.frame = e.frame) select label_track_id, frame, x1, stop, coalesce(occ, last_value(occ ignore nulls) over (partition by label_track_id order by frame), 'clear') as occlusion from b")
def r13_set_key_frames(spark, sf):
    k = d.keyframes(spark, sf)
    own = k.where("frame % 3 <> 0").withColumn("occlusion", F.expr("case when frame % 2 = 0 then 'occluded' else 'clear' end"))
    return labels.set_keys(own, k.where("frame % 4 = 0").withColumn("x1", F.col("x1") + 1)).select("label_track_id", "frame", "x1", "stop", "occlusion")


@query("select k.label_track_id, count(*) as n, round(avg((gx1 + gx2) / 2), 4) as x, round(avg((gy1 + gy2) / 2), 4) as y from (select distinct label_track_id, frame, detection_id from keyframes k join det using (frame, x1, y1, x2, y2)) k join geo using (detection_id) group by 1")
def r14_track_positions(spark, sf):
    """World position of each label track: the mean over its key frames' ground boxes; frames without one are skipped."""
    keys = ["frame", "x1", "y1", "x2", "y2"]
    k = d.keyframes(spark, sf).join(d.detections(spark, sf).select("detection_id", *keys), keys).select("label_track_id", "frame", "detection_id").distinct()
    r = k.join(d.geo(spark, sf), "detection_id").groupBy("label_track_id")
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gx1") + F.col("gx2")) / 2), 4).alias("x"), F.round(F.avg((F.col("gy1") + F.col("gy2")) / 2), 4).alias("y"))


T25 = "tan(radians(25))"


def _camera_pixel(x, y, cx, cy):
    return geometry.project(x, y, F.lit(0.0), cx, cy, F.lit(100.0), F.lit(50.0), F.lit(0.0), F.lit(0.0), 800.0, 512.0)


@query(f"select detection_id, round(((x1 + 5 - x1) / 100 / {T25} + 1) * 400, 4) as px from det where detection_id % 2 = 0")
def r15_propagated_boxes(spark, sf):
    """A box's ground corner seen from a camera that moved on by five metres."""
    p = _camera_pixel(F.col("x1") + 5, F.col("y1"), F.col("x1"), F.col("y1"))
    return d.detections(spark, sf).where("detection_id % 2 = 0").select("detection_id", F.round(p["px"], 4).alias("px"))


@query(f"select detection_id, round(((gx1 - 500020) / 100 / {T25} + 1) * 400, 4) as px1, round(((gx2 - 500020) / 100 / {T25} + 1) * 400, 4) as px2 from geo")
def r16_boxes_in_other_camera(spark, sf):
    """Ground boxes projected into the pixels of the other camera's frame."""
    p = lambda c: F.round(_camera_pixel(F.col(c), F.col("gy1"), F.lit(500020.0), F.lit(5300000.0))["px"], 4)
    return d.geo(spark, sf).select("detection_id", p("gx1").alias("px1"), p("gx2").alias("px2"))


@query(f"with p as (select detection_id, ((gx1 - 500020) / 100 / {T25} + 1) * 400 as px, (1 - (gy1 - 5300000) / 100 / {T25}) * 256 as py from geo) select detection_id, round(px, 4) as px, round(py, 4) as py from p where px between 0 and 800 and py between 0 and 512")
def r17_map_points(spark, sf):
    """Map points that a frame's picture shows, as pixels; what is outside of it is left out."""
    p = _camera_pixel(F.col("gx1"), F.col("gy1"), F.lit(500020.0), F.lit(5300000.0))
    r = d.geo(spark, sf).select("detection_id", p.alias("p")).where("p.px between 0 and 800 and p.py between 0 and 512")
    return r.select("detection_id", F.round("p.px", 4).alias("px"), F.round("p.py", 4).alias("py"))


@query("with f as (select distinct flight_id, frame from det), t as (select distinct flight_id, frame from det where modality = 't'), w as (select distinct flight_id, frame from det where modality = 'w') select flight_id, f.frame, case when t.frame is not null then printf('t/frame_%06d.jpg', f.frame) end as thermal, case when w.frame is not null then printf('w/frame_%06d.jpg', f.frame) end as colour from f left join t using (flight_id, frame) left join w using (flight_id, frame)")
def r19_image_paths(spark, sf):
    x = d.detections(spark, sf).groupBy("flight_id", "frame").agg(F.max((F.col("modality") == "t").cast("int")).alias("t"), F.max((F.col("modality") == "w").cast("int")).alias("w"))
    name = lambda c: F.when(F.col(c) == 1, F.concat(F.lit(f"{c}/"), F.format_string("frame_%06d.jpg", "frame")))
    return x.select("flight_id", "frame", name("t").alias("thermal"), name("w").alias("colour"))


@query("with p as (select flight_id, frame, arg_min(x1, detection_id) as x from det where frame % 7 <> 0 group by 1, 2), t as (select flight_id, obj, min(frame) as a, max(frame) as b from det group by 1, 2) select t.flight_id, t.obj as transect_id, count(*) as points, arg_min(x, frame) + 500000 as first_x, arg_max(x, frame) + 500000 as last_x from t join p on p.flight_id = t.flight_id and p.frame between a and b group by 1, 2")
def r20_centre_lines(spark, sf):
    """Centre line of each transect: the positions of its frame range in order, moved to the terrain's origin."""
    x = d.detections(spark, sf)
    p = x.where("frame % 7 <> 0").groupBy("flight_id", "frame").agg(F.min_by("x1", "detection_id").alias("x"))
    t = x.groupBy("flight_id", F.col("obj").alias("transect_id")).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    return survey.centre_lines(p, t, "flight_id", 500_000.0)


@query("select flight_id, case when flight_id % 3 = 0 then 100.0::double when flight_id % 3 = 1 then 7.0::double end as x, flight_id % 3 = 2 as missing from det group by all")
def r21_origins(spark, sf):
    f = d.detections(spark, sf).select("flight_id").distinct()
    x = F.coalesce(F.when(F.col("flight_id") % 3 == 0, 100.0), F.when(F.col("flight_id") % 3 == 1, 7.0))
    return f.select("flight_id", x.alias("x"), x.isNull().alias("missing"))


@query("select flight_id, coalesce(case when flight_id % 2 = 0 then 640.0::double end, max(x2)) as width from det group by 1")
def r24_frame_sizes(spark, sf):
    """Explicit frame width, else the one that its boxes need."""
    x = d.detections(spark, sf).groupBy("flight_id").agg(F.max("x2").alias("seen"))
    return x.select("flight_id", F.coalesce(F.when(F.col("flight_id") % 2 == 0, 640.0), "seen").alias("width"))


@query(f"with {RUNS}, m as (select distinct detection_id from members m join tracks t using (track_id) join runs using (run_id)), g as (select flight_id, frame, count(m.detection_id) as members, case when frame % 4 = 0 then 0 else 2 end as runs from det left join m using (detection_id) group by 1, 2) select flight_id, frame, case when runs = 0 then 'no tracking run is recorded for this modality' when members = 0 then 'a tracking run exists but none of these detections belong to it' end as hint from g")
def r26_why_empty(spark, sf):
    own = select.run_members(d.members(spark, sf), d.tracks(spark, sf), select.analysis_runs(d.track_runs(spark, sf))).select("detection_id", F.lit(1).alias("m")).distinct()
    g = d.detections(spark, sf).join(own, "detection_id", "left").groupBy("flight_id", "frame").agg(F.count("m").alias("members"))
    return g.select("flight_id", "frame", labels.no_tracks_hint(F.when(F.col("frame") % 4 == 0, 0).otherwise(2), F.col("members")).alias("hint"))


@query("with v as (select flight_id, obj as track_id, (min(detection_id) % 50) / 10.0::double - 3 as z from det group by 1, 2), g as (select flight_id, count(*) as n, count(*) filter (z < -2) as j, string_agg(printf('track %d (z=%.1f)', track_id, z), ', ' order by printf('track %d (z=%.1f)', track_id, z)) filter (z < -2) as named from v group by 1) select flight_id, case when j > 0 then printf('%d juvenile(s) of %d individual(s): ', j, n) || named else printf('no juvenile found among %d individual(s)', n) end as line from g")
def r36_life_stage_lines(spark, sf):
    v = d.detections(spark, sf).groupBy("flight_id", F.col("obj").alias("track_id")).agg((F.min("detection_id") % 50 / 10.0 - 3).alias("z"))
    v = v.withColumns({"juvenile": F.col("z") < -2, "low_outlier": F.lit(False)})
    return labels.life_stage_line(v, "flight_id")


@query("select d.detection_id, d.frame, g.gx1 is not null as resolved, l.track_id from det d left join geo g using (detection_id) left join (select detection_id, max(track_id) as track_id from members where track_id % 10 = 1 group by 1) l using (detection_id) where d.detection_id % 13 <> 0")
def k20_migrated_project(spark, sf):
    """A legacy project taken over as a whole: detections from text, positions and tracks by frame and rounded box."""
    from .files import _detections_file, flight
    from ..sources import legacy

    x = d.detections(spark, sf)
    read = legacy.detections_text(spark, _detections_file(spark, sf)).where("block = 'detector'").select(flight(), "line", "frame", "x1", "y1", "x2", "y2")
    # lines are in the order of the stored ids, and broken lines are left out on either side
    own = x.where("detection_id % 13 <> 0").withColumn("n", F.row_number().over(Window.partitionBy("flight_id").orderBy("detection_id"))).select("flight_id", "n", "detection_id")
    text_ = read.withColumn("n", F.row_number().over(Window.partitionBy("flight_id").orderBy("line"))).join(own, ["flight_id", "n"])
    member = d.members(spark, sf).where("track_id % 10 = 1").groupBy("detection_id").agg(F.max("track_id").alias("track_id"))
    r = text_.join(d.geo(spark, sf).select("detection_id", F.lit(True).alias("g")), "detection_id", "left").join(member, "detection_id", "left")
    return r.select("detection_id", "frame", F.coalesce("g", F.lit(False)).alias("resolved"), "track_id")


OFFSETS = "with p as (select flight_id, (x1 - 300) * 1.0::double as dx, (y1 - 200) * 1.0::double as dy, detection_id % 5 / 10.0::double as e from det), t as (select flight_id, dx, dy, 1.05::double * (cos(0.3) * dx - sin(0.3) * dy) + e as tx, 1.05::double * (sin(0.3) * dx + cos(0.3) * dy) - e as ty from p), s as (select flight_id, sum(dx * tx + dy * ty) as re, sum(dx * ty - dy * tx) as im, sum(dx * dx + dy * dy) as dd, sum(tx * tx + ty * ty) as tt, count(*) as n from t group by 1)"


@query(OFFSETS + " select flight_id, round(80 * (sqrt(re * re + im * im) / dd - 1), 6) as tz, round(atan2(im, re), 6) as rz, round(sqrt((tt - (re * re + im * im) / dd) / n), 6) as residual from s")
def g13_height_and_yaw(spark, sf):
    e = F.col("detection_id") % 5 / 10.0
    p = d.detections(spark, sf).selectExpr("flight_id", "detection_id", "x1 - 300 as dx", "y1 - 200 as dy")
    c, s = F.cos(F.lit(0.3)), F.sin(F.lit(0.3))
    p = p.withColumn("tx", 1.05 * (c * F.col("dx") - s * F.col("dy")) + e).withColumn("ty", 1.05 * (s * F.col("dx") + c * F.col("dy")) - e)
    r = correction.height_and_yaw(p, "flight_id", 80.0)
    return r.select("flight_id", *[F.round(k, 6).alias(k) for k in ("tz", "rz", "residual")])


def _utm_sql() -> str:
    f = 1 / 298.257223563
    n = f / (2 - f)
    a, e = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996, 2 * n**0.5 / (1 + n)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    east = " + ".join(f"{v!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(al, 1))
    north = " + ".join(f"{v!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(al, 1))
    return (
        "with p as (select detection_id, detection_id % 3590 / 10.0::double - 179.5 as lon, detection_id % 1600 / 10.0::double - 80 as lat from det),"
        " z as (select *, greatest(1, least(60, floor((lon + 180) / 6) + 1)) as zone from p),"
        f" r as (select *, radians(lon - (zone * 6 - 183)) as lam, sinh(atanh(sin(radians(lat))) - {e!r}::double * atanh({e!r}::double * sin(radians(lat)))) as t from z),"
        " x as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from r)"
        f" select detection_id, round(500000 + {a!r}::double * (eta + {east}), 3) as easting, round({a!r}::double * (xi + {north}) + case when lat < 0 then 10000000 else 0 end, 3) as northing from x"
    )


@query(_utm_sql())
def m16_to_utm(spark, sf):
    i = F.col("detection_id")
    u = geometry.to_utm(i % 3590 / 10.0 - 179.5, i % 1600 / 10.0 - 80)
    return d.detections(spark, sf).select("detection_id", u.alias("u")).select("detection_id", F.round("u.easting", 3).alias("easting"), F.round("u.northing", 3).alias("northing"))


LIKE = "with t as (select flight_id, obj, count(*) filter (confidence > 0.9) as y, 1.0::double + (obj * 7 % 11) / 10.0::double + flight_id % 3 / 100.0::double as x from det group by 1, 2), m as (select flight_id, y, exp(0.2::double + 0.1 * x) as mu, exp(0.5::double) as th, 1 / (1 + exp(1.0::double)) as z from t), l as (select flight_id, y, z, lgamma(y + th) - lgamma(th) - lgamma(y + 1) + th * ln(th / (th + mu)) + y * ln(mu / (th + mu)) as lp from m)"


@query(LIKE + " select flight_id, round(-sum(case when y = 0 then ln(z + (1 - z) * exp(lp)) else ln(1 - z) + lp end), 6) as loss from l group by 1")
def g6_zinb_likelihood(spark, sf):
    """Negative log-likelihood of one set of parameters for each flight's transects."""
    from .surveyed import _transects

    r = statistics.likelihoods(_transects(spark, sf), "flight_id", (0.2, 0.1, 0.5, -1.0))
    return r.select("flight_id", F.round(-F.col("likelihood"), 6).alias("loss"))


def _geojson_plan(spark, sf) -> str:
    from .files import documents

    pt = lambda a, b: F.array(F.col(a), F.col(b))
    x = d.detections(spark, sf).withColumns({"lon": 14 + F.col("detection_id") % 1000 / 1000.0, "lat": 48 + F.col("detection_id") % 997 / 1000.0})
    one = F.struct(F.struct(F.lit("Point").alias("type"), pt("lon", "lat").alias("coordinates")).alias("geometry"))
    return documents(x, F.struct(F.transform(F.array_sort(F.collect_list(F.struct("detection_id", one.alias("f")))), lambda v: v["f"]).alias("features")), "plan")


@query("select flight_id, row_number() over (partition by flight_id order by detection_id) - 1 as seq, round(14 + detection_id % 1000 / 1000.0::double, 6) as lon, 32633 as epsg, true as placed from det")
def r34_planner_inputs(spark, sf):
    """Start points of a GeoJSON file with the zone that they are planned in, and their place in it."""
    from ..sources import legacy
    from .files import flight

    p = legacy.points_geojson(spark, _geojson_plan(spark, sf)).withColumn("u", geometry.to_utm(F.col("x"), F.col("y")))
    return p.select(flight(), F.col("seq").cast("long").alias("seq"), F.round("x", 6).alias("lon"), geometry.utm_epsg(F.col("x"), F.col("y")).alias("epsg"), F.col("u.easting").between(100_000, 900_000).alias("placed"))
