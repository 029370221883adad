"""Queries over further operators: perpendicular distances, predictions, vocabulary edits, runs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutate, survey, tracks
from . import domain as d
from .domain import sql
from .relational import CAN, RES, resolved, rows

Q: dict = {}


def query(text: str | None = None):
    def put(f):
        Q[f.__name__] = (f, sql(text) if text else None)
        return f

    return put


PERP = "with p as (select detection_id as id, (x1+x2)/2/4 as x, (y1+y2)/2 as y, (detection_id % 180)::double as cx, (detection_id % 450)::double as cy from det), c as (select id, transect_id, sqrt((cx - greatest(0, least(190, cx)))^2 + (cy - ay)^2) as d, row_number() over (partition by id order by sqrt((cx - greatest(0, least(190, cx)))^2 + (cy - ay)^2), transect_id) as r from p, lines)"


@query(PERP + " select p.id, c.transect_id as seg_id, round(abs(p.y - l.ay), 6) as distance_m from c join p using (id) join lines l using (transect_id) where r = 1 and d <= 80")
def j24_perpendicular(spark, sf):
    p = d.detections(spark, sf).selectExpr("detection_id as id", "(x1+x2)/2/4 as x", "(y1+y2)/2 as y", "cast(detection_id % 180 as double) as cam_x", "cast(detection_id % 450 as double) as cam_y")
    r = survey.perpendicular(p, d.lines(spark, sf).withColumnRenamed("transect_id", "seg_id").drop("seq"), 80.0)
    return r.select("id", "seg_id", F.round("distance_m", 6).alias("distance_m"))


@query("with p as (select detection_id as id, (x1+x2)/2/4 as x, (y1+y2)/2 as y from det), s as (select id, x, transect_id, abs(y - ay) as d, row_number() over (partition by id order by (x < 0 or x > 190)::int, abs(y - ay), transect_id) as r from p, lines where ay > y - 40 and ay < y + 40 and x + 50 > 0 and x - 50 < 190) select id, transect_id as seg_id, round(d, 6) as distance_m, x between 0 and 190 as interior from s where r = 1")
def j25_visible_segments(spark, sf):
    p = d.detections(spark, sf).selectExpr("detection_id as id", "(x1+x2)/2/4 as x", "(y1+y2)/2 as y")
    c = lambda i, j: F.struct((F.col("x") + 50 * i).alias("x"), (F.col("y") + 40 * j).alias("y"))
    p = p.withColumn("ring", F.array(c(-1, -1), c(1, -1), c(1, 1), c(-1, 1)))
    r = survey.visible_perpendicular(p, d.lines(spark, sf).withColumnRenamed("transect_id", "seg_id").drop("seq"))
    return r.withColumn("distance_m", F.round("distance_m", 6))


@query("select l.transect_id, coalesce(n, 0) as count, coalesce(f, 0) as frames, coalesce(s, 0) as frames_with_fov from lines l left join (select obj + 1 as transect_id, count(*) as n from det group by 1) a using (transect_id) left join (select frame // 20 + 1 as transect_id, count(*) as f, count(x) as s from poses group by 1) p using (transect_id)")
def a17_transect_table(spark, sf):
    a = d.detections(spark, sf).select((F.col("obj") + 1).alias("transect_id"))
    f = d.poses(spark, sf).selectExpr("frame div 20 + 1 as transect_id", "x is not null as seen")
    return survey.transect_table(d.lines(spark, sf), a, f)


@query("select flight_id, min(confidence) as low, max(confidence) as high, round(avg(confidence), 6) as mean from det where confidence <= 0.9 group by 1")
def a19_distance_range(spark, sf):
    return d.detections(spark, sf).where("confidence <= 0.9").groupBy("flight_id").agg(F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.round(F.avg("confidence"), 6).alias("mean"))


@query("with v as (select track_id, case detection_id % 3 when 0 then 'species' when 1 then 'sex' else 'age' end as task, detection_id % 4 // 3 as class_index, case when detection_id % 4 // 3 = 1 then 'b' else 'a' end as label from predictions), n as (select track_id, task, class_index, min(label) as label, count(*) as v from v group by all), r as (select *, row_number() over (partition by track_id, task order by v desc, class_index) as k, sum(v) over (partition by track_id, task) as f from n), w as (select track_id, task, label from r where k = 1 and v / f::double > 0.7) select * from w where task = 'species' or track_id in (select track_id from w where task = 'species')")
def g15_staged_votes(spark, sf):
    p = d.predictions(spark, sf).selectExpr("track_id", "case detection_id % 3 when 0 then 'species' when 1 then 'sex' else 'age' end as task", "detection_id % 4 div 3 as class_index", "case when detection_id % 4 div 3 = 1 then 'b' else 'a' end as label")
    return survey.voted(p, 0.7)


@query("select t.track_id, case when t.track_id % 4 = 0 then 'juvenile' when t.track_id % 3 = 0 then 'adult' else case when t.track_id % 7 = 0 then 'juvenile' else 'adult' end end as age, case when t.track_id % 4 = 0 then 'model' when t.track_id % 3 = 0 then 'male' else 'size' end as source from tracks t where run_id = 2")
def g14_life_stage_verdicts(spark, sf):
    t = d.tracks(spark, sf)
    sized = t.selectExpr("track_id", "case when track_id % 7 = 0 then 'juvenile' else 'adult' end as stage")
    return survey.stage_verdicts(sized, t.where("run_id = 2"), t.where("track_id % 4 = 0").selectExpr("track_id", "'juvenile' as age"), t.where("track_id % 3 = 0"))


@query("select track_id, case when run_id <> 3 and species_id = 0 and track_id % 2 = 0 then 9 else species_id end as species_id, run_id = 3 as manual from tracks")
def g16_apply_predictions(spark, sf):
    t = d.tracks(spark, sf).selectExpr("track_id", "species_id", "run_id = 3 as manual")
    return survey.apply_predictions(t, t.where("track_id % 2 = 0").selectExpr("track_id", "9L as species_id"))


@query("select flight_id, case when flight_id % 2 = 0 then 'half-normal' else 'hazard-rate' end as model from det group by all")
def l3_best_model(spark, sf):
    f = d.detections(spark, sf).select("flight_id").distinct()
    fits = f.selectExpr("flight_id", "'half-normal' as model", "0 as pos", "10D as aic").unionByName(f.selectExpr("flight_id", "'hazard-rate' as model", "1 as pos", "10D - flight_id % 2 as aic"))
    return survey.best_model(fits, "flight_id")


@query("select transect_id, least(ax, bx) as first from lines order by least(ax, bx), transect_id")
def l5_transect_order(spark, sf):
    return d.lines(spark, sf).select("transect_id", F.least("ax", "bx").alias("first")).orderBy("first", "transect_id")


@query("select frame, arg_max(detection_id, (x2-x1)*(y2-y1) * 100000000 - detection_id) as detection_id from det group by frame")
def l7_largest_box(spark, sf):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return d.detections(spark, sf).groupBy("frame").agg(F.max_by("detection_id", F.struct(area, -F.col("detection_id"))).alias("detection_id"))


@query("select event_id as detection_id from events where event_id % 2 = 0 except select vec_id from embeddings")
def u5_vanished_vectors(spark, sf):
    recorded = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 2 = 0").select(F.col("event_id").alias("detection_id"))
    return recorded.subtract(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id"))


@query("select detection_id, row_number() over (partition by flight_id order by frame, detection_id) - 1 as idx from det join geo using (detection_id)")
def w13_running_index(spark, sf):
    g = d.detections(spark, sf).join(d.geo(spark, sf).select("detection_id"), "detection_id")
    return tracks.running_index(g, ["frame", "detection_id"], ["flight_id"]).select("detection_id", F.col("idx").cast("long").alias("idx"))


SPLIT = "with n as (select *, lead(frame) over w as nf, lead(x1) over w as nx1 from keyframes window w as (partition by label_track_id order by frame)), c as (select case when frame = 20 then x1 else x1 + (nx1 - x1) * (20 - frame) / (nf - frame) end as x1 from n where label_track_id = 1 and (frame = 20 or (not stop and frame < 20 and nf > 20)))"


@query(SPLIT + " select label_track_id, frame, x1, stop from keyframes where label_track_id <> 1 or frame < 20 union all select 9001, frame, x1, stop from keyframes where label_track_id = 1 and frame > 20 union all select 1, 20, x1, true from c union all select 9001, 20, x1, false from c")
def w15_split_track(spark, sf):
    return tracks.split_track(d.keyframes(spark, sf), 1, 20, 9001).select("label_track_id", "frame", "x1", "stop")


@query("select detection_id, unnest(list_distinct(list_concat(range(frame + 3, frame + (detection_id % 9) + 1, 3), [frame + detection_id % 9]))) as f from det")
def w18_propagation_frames(spark, sf):
    x = d.detections(spark, sf)
    return x.select("detection_id", F.explode(survey.propagation_frames(F.col("frame"), F.col("frame") + F.col("detection_id") % 9, 3)).alias("f"))


# slopes of the curve through (0, 0), (0.25, 0.4), (0.5, 0.5), (1, 1), by harmonic means of the rises 1.6, 0.4 and 1
TONE = "with v as (select detection_id, least(1.0::double, detection_id % 120 / 100.0::double) as v from det), s as (select *, case when v < 0.25 then 0.0::double when v < 0.5 then 0.25 else 0.5 end as a, case when v < 0.5 then 0.25::double else 0.5 end as h, case when v < 0.25 then 0.0::double when v < 0.5 then 0.4 else 0.5 end as y0, case when v < 0.25 then 0.4::double when v < 0.5 then 0.5 else 1.0 end as y1, case when v < 0.25 then 1.6::double when v < 0.5 then 1.5::double / (0.75::double / 1.6 + 0.75::double / 0.4) else 2.25::double / (1.25::double / 0.4 + 1) end as m0, case when v < 0.25 then 1.5::double / (0.75::double / 1.6 + 0.75::double / 0.4) when v < 0.5 then 2.25::double / (1.25::double / 0.4 + 1) else 1.0 end as m1 from v), t as (select *, (v - a) / h as t from s)"


@query(TONE + " select detection_id, round((1 + 2 * t) * (1 - t) * (1 - t) * y0 + t * (1 - t) * (1 - t) * h * m0 + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * h * m1, 6) as v from t")
def m25_tone_curve(spark, sf):
    v = F.col("detection_id") % 120 / 100.0
    return d.detections(spark, sf).select("detection_id", F.round(survey.tone_curve([(0.0, 0.0), (0.25, 0.4), (0.5, 0.5), (1.0, 1.0)], v), 6).alias("v"))


@query("with p as (select detection_id, 'species' as task, label from predictions where detection_id % 2 = 0 union all select detection_id, 'sex', 'male' from predictions where detection_id % 5 = 0) select detection_id, task, label from p where task <> 'sex' union all select detection_id, 'sex', 'female' from predictions where detection_id % 7 = 0")
def k9_replace_task(spark, sf):
    x = d.predictions(spark, sf)
    old = x.where("detection_id % 2 = 0").selectExpr("detection_id", "'species' as task", "label").unionByName(x.where("detection_id % 5 = 0").selectExpr("detection_id", "'sex' as task", "'male' as label"))
    return mutate.replace_where(old, x.where("detection_id % 7 = 0").selectExpr("detection_id", "'sex' as task", "'female' as label"), "task", "sex")


@query("select event_id as detection_id, event_id % 2 as run_id from events union select event_id, 1 from events where event_id % 3 = 0 except select event_id, event_id % 2 from events where event_id % 10 = 3")
def k8_membership(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    old = e.selectExpr("event_id as detection_id", "event_id % 2 as run_id")
    added = old.unionByName(e.where("event_id % 3 = 0").selectExpr("event_id as detection_id", "1L as run_id")).distinct()
    return mutate.without(added, e.where("event_id % 10 = 3").selectExpr("event_id as detection_id", "event_id % 2 as run_id"), "detection_id", "run_id")


@query("select vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::double * x)), 4) as norm from embeddings")
def s20_vectors(spark, sf):
    n = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.round(n, 4).alias("norm"))


@query("select frame, count(*) as n, list_transform(list(detection_id order by detection_id), lambda x: x)[1] as first from det where modality = 't' group by 1")
def s28_grouped_scan(spark, sf):
    g = d.detections(spark, sf).where("modality = 't'").groupBy("frame").agg(F.array_sort(F.collect_list("detection_id")).alias("v"))
    return g.select("frame", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).alias("first"))


@query(CAN + " select species_id, count(*) as n from can where species_id > 0 and gx1 is not null and confidence >= 0.2 and x2 - x1 >= 20 group by 1")
def f10_publishable(spark, sf):
    r = rows(spark, sf).where("species_id > 0 and gx1 is not null and confidence >= 0.2 and x2 - x1 >= 20")
    return r.groupBy("species_id").agg(F.count(F.lit(1)).alias("n"))


@query("with k as (select *, row_number() over w as i, count(*) over (partition by label_track_id) as n from keyframes window w as (partition by label_track_id order by frame)), c as (select label_track_id, arg_min(i, abs(frame - 30) * 100000 + frame) as c from k group by 1) select label_track_id, frame, i, n from k join c using (label_track_id) where i = 1 or i = n or abs(i - c) <= 1")
def f17_key_window(spark, sf):
    return survey.key_window(d.keyframes(spark, sf), "label_track_id", 30, 1).withColumn("i", F.col("i").cast("long"))


@query(f"with {RES}, h as (select detection_id, species_id, modality from res where confidence > 0.95), a as (select detection_id, species_id, modality from res where confidence > 0.9) select modality, case when (select count(*) from h h2 where h2.modality = m.modality) > 0 then 'head' else 'all' end as source, (select count(*) from h h2 where h2.modality = m.modality) as frames from (select distinct modality from det) m")
def f18_visible_frames(spark, sf):
    r = resolved(spark, sf)
    g = r.groupBy("modality").agg(F.sum((F.col("confidence") > 0.95).cast("long")).alias("frames"))
    return g.select("modality", F.when(F.col("frames") > 0, "head").otherwise("all").alias("source"), "frames")


@query("select d.detection_id, d.modality, e.n as partners from det d join (select frame, modality, count(*) as n from det group by all) e on e.frame = d.frame and e.modality <> d.modality")
def j17_partner_direction(spark, sf):
    x = d.detections(spark, sf)
    n = x.groupBy("frame", F.when(F.col("modality") == "t", "w").otherwise("t").alias("modality")).agg(F.count(F.lit(1)).alias("partners"))
    return x.join(n, ["frame", "modality"]).select("detection_id", "modality", "partners")


@query("select detection_id, attributes->>'$.k' as occlusion from det where try_cast(attributes->>'$.k' as int) > 50")
def r4_stored_attribute(spark, sf):
    k = F.get_json_object("attributes", "$.k")
    return d.detections(spark, sf).where(k.try_cast("int") > 50).select("detection_id", k.alias("occlusion"))


@query("select reason, count(*) as n, quantile_cont(detection_id::double, 0.5) as median, round(quantile_cont(detection_id::double, 0.9), 4) as p90 from failures group by reason")
def r35_miss_summary(spark, sf):
    f = d.failures(spark, sf).withColumn("r", F.col("detection_id").cast("double"))
    return f.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(r, 0.5)").alias("median"), F.round(F.expr("percentile(r, 0.9)"), 4).alias("p90"))


@query(CAN + " select count(*) filter (track_id is not null) as tracked, count(*) filter (track_id is null) as untracked, count(distinct track_id) as tracks from can")
def r23_track_groups(spark, sf):
    r = rows(spark, sf)
    return r.agg(F.count("track_id").alias("tracked"), F.sum(F.col("track_id").isNull().cast("long")).alias("untracked"), F.count_distinct("track_id").alias("tracks"))
