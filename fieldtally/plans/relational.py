"""Queries over selection, relational joins, aggregation and table mutation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, mutate, select, tracks
from . import domain as d
from .domain import sql

Q: dict = {}


def query(text: str | None = None):
    """Register a query with its SQL over the derived tables (or without any)."""

    def put(f):
        Q[f.__name__] = (f, sql(text) if text else None)
        return f

    return put


def resolved(spark, sf):
    return select.resolve_species(d.detections(spark, sf), d.class_mapping(spark, sf))


def rows(spark, sf, manual=True):
    runs = select.analysis_runs(d.track_runs(spark, sf), manual)
    return select.canonical(resolved(spark, sf), d.geo(spark, sf), d.members(spark, sf), d.tracks(spark, sf), runs, d.label_tracks(spark, sf))


RES = "res as (select det.*, coalesce(m.species_id, 0) as species_id from det left join class_mapping m using (source_id, source_class))"
RUNS = "runs as (select max(run_id) as run_id from track_runs where kind <> 'manual' and is_active union all select max(run_id) from track_runs where kind = 'manual')"
GONE = "gone as (select distinct origin_track_id as track_id from label_tracks where origin_track_id is not null and track_id is not null)"
OWN = "own as (select detection_id, case when g.track_id is null then m.track_id end as track_id, case when g.track_id is null then t.species_id end as track_species_id from members m join tracks t using (track_id) join runs using (run_id) left join gone g using (track_id))"
CAN = f"with {RES}, {RUNS}, {GONE}, {OWN}, can as (select res.*, gx1, gy1, gx2, gy2, own.track_id, own.track_species_id from res left join geo using (detection_id) left join own using (detection_id))"


@query(CAN + ", f as (select * from can where species_id <> -2 and gx1 is not null and track_id is not null), c as (select track_id, min(species_id) as species_id, count(*) as n, round(avg((gx1+gx2)/2), 4) as cx, round(avg((gy1+gy2)/2), 4) as cy from f group by track_id) select c.*, name, (select count(*) from can where species_id = -2) as excluded from c left join species using (species_id)")
def flagship_species_tracks(spark, sf):
    r = rows(spark, sf)
    c = select.centroids(select.countable(r)).join(F.broadcast(d.species(spark, sf)), "species_id", "left")
    out = r.where("species_id = -2").agg(F.count(F.lit(1)).alias("n")).scalar()
    return c.select("track_id", "species_id", "n", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "name", out.alias("excluded"))


@query("select detection_id, frame, modality, source_class, confidence from det where confidence >= 0.5 and frame between 5 and 20")
def s4_scan_detections(spark, sf):
    return d.detections(spark, sf).where("confidence >= 0.5 and frame between 5 and 20").select("detection_id", "frame", "modality", "source_class", "confidence")


@query(f"with {RES} select detection_id, source_class, species_id from res")
def j15_class_mapping(spark, sf):
    return resolved(spark, sf).select("detection_id", "source_class", "species_id")


@query("with m2 as (select source_id, source_class, case when source_class = 'view' then 2 else species_id end as species_id from class_mapping) select det.source_class, coalesce(m.species_id, 0) as old, coalesce(m2.species_id, 0) as new, count(*) as changed from det left join class_mapping m using (source_id, source_class) left join m2 on det.source_id = m2.source_id and det.source_class = m2.source_class where coalesce(m.species_id, 0) <> coalesce(m2.species_id, 0) group by all")
def j16_reapply_mapping(spark, sf):
    m = d.class_mapping(spark, sf)
    changed = m.withColumn("species_id", F.when(F.col("source_class") == "view", 2).otherwise(F.col("species_id")).cast("long"))
    old = resolved(spark, sf).select("detection_id", "source_id", "source_class", F.col("species_id").alias("old"))
    new = select.resolve_species(old, changed)
    return new.where("old <> species_id").groupBy("source_class", "old", F.col("species_id").alias("new")).agg(F.count(F.lit(1)).alias("changed"))


@query("select detection_id, frame, gx1, gy1 from det join geo using (detection_id)")
def j1_geo_join(spark, sf):
    return d.detections(spark, sf).join(d.geo(spark, sf), "detection_id").select("detection_id", "frame", "gx1", "gy1")


@query(CAN + " select detection_id, frame, species_id, gx1, track_id, track_species_id from can")
def j2_canonical_rows(spark, sf):
    return rows(spark, sf).select("detection_id", "frame", "species_id", "gx1", "track_id", "track_species_id")


@query(f"with {RUNS}, {GONE} select m.track_id, m.detection_id, det.frame, det.x1, det.y1 from members m join tracks t using (track_id) join runs using (run_id) join det using (detection_id) where m.track_id not in (select track_id from gone)")
def j3_pixel_tracks(spark, sf):
    own = select.run_members(d.members(spark, sf), d.tracks(spark, sf), select.analysis_runs(d.track_runs(spark, sf)))
    own = own.join(select.superseded(d.label_tracks(spark, sf)), "track_id", "left_anti")
    return own.join(d.detections(spark, sf), "detection_id").select("track_id", "detection_id", "frame", "x1", "y1")


@query(f"with {RUNS} select m.track_id, det.frame, gx1, gy1 from members m join tracks t using (track_id) join runs using (run_id) join det using (detection_id) join geo using (detection_id)")
def j4_geo_tracks(spark, sf):
    own = select.run_members(d.members(spark, sf), d.tracks(spark, sf), select.analysis_runs(d.track_runs(spark, sf)))
    return own.join(d.detections(spark, sf), "detection_id").join(d.geo(spark, sf), "detection_id").select("track_id", "frame", "gx1", "gy1")


@query("select distinct m.track_id from members m where not exists (select 1 from geo where geo.detection_id = m.detection_id)")
def j11_orphan_members(spark, sf):
    return d.members(spark, sf).join(d.geo(spark, sf), "detection_id", "left_anti").select("track_id").distinct()


@query("select vec_id as detection_id from embeddings where vec_id not in (select event_id from events where event_id % 3 = 0)")
def j12_pending_embeddings(spark, sf):
    done = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 3 = 0").select("event_id")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("detection_id"))
    return e.join(done, e.detection_id == done.event_id, "left_anti")


@query("select count(*) as total, count(g.detection_id) as resolved, count(f.detection_id) as failed, count(*) filter (g.detection_id is null and f.detection_id is null) as unaccounted, count(*) filter (g.detection_id is not null and f.detection_id is not null) as \"both\" from det left join geo g using (detection_id) left join failures f using (detection_id)")
def j13_accounting(spark, sf):
    return select.accounting(d.detections(spark, sf), d.geo(spark, sf), d.failures(spark, sf))


@query(f"with {GONE} select track_id from gone")
def j14_superseded_tracks(spark, sf):
    return select.superseded(d.label_tracks(spark, sf))


@query("with s as (select track_id, case when track_id % 3 = 0 then 0 else species_id end as species_id, case when track_id % 2 = 0 then 'male' end as sex from tracks), p as (select track_id as source_id, track_id + 1 as target_id from tracks where run_id = 1) select t.track_id as id, case when t.track_id % 5 <> 0 and t.species_id = 0 and s.track_id is not null then s.species_id else t.species_id end as species_id, case when t.track_id % 5 <> 0 then coalesce(null, s.sex) end as sex, t.track_id % 5 = 0 as manual from tracks t left join p on p.target_id = t.track_id left join s on s.track_id = p.source_id where t.run_id = 2")
def j19_fill_only_sync(spark, sf):
    t = d.tracks(spark, sf)
    source = t.selectExpr("track_id as id", "case when track_id % 3 = 0 then 0 else species_id end as species_id", "case when track_id % 2 = 0 then 'male' end as sex", "cast(null as string) as age")
    target = t.where("run_id = 2").selectExpr("track_id as id", "species_id", "cast(null as string) as sex", "cast(null as string) as age", "track_id % 5 = 0 as manual")
    pairs = t.where("run_id = 1").selectExpr("track_id as source_id", "track_id + 1 as target_id")
    return joins.fill_only(source, target, pairs).drop("age")


@query("with a as (select vec_id // 2 as pair, embedding, label from embeddings where vec_id % 2 = 0), b as (select vec_id // 2 as pair, embedding from embeddings where vec_id % 2 = 1 and vec_id % 3 <> 0) select a.pair, case when b.pair is null then 'rgb' else 'both' end as kind, len(list_concat(a.embedding, coalesce(b.embedding, a.embedding))) as dims, round(list_sum(list_transform(list_concat(a.embedding, coalesce(b.embedding, a.embedding)), lambda x: x::double)), 4) as total from a left join b using (pair)")
def j21_matched_features(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    a = e.where("vec_id % 2 = 0").selectExpr("vec_id div 2 as pair", "embedding as rgb")
    b = e.where("vec_id % 2 = 1 and vec_id % 3 <> 0").selectExpr("vec_id div 2 as pair", "embedding as thermal")
    both = a.join(b, "pair", "left").withColumn("v", F.concat("rgb", F.coalesce("thermal", "rgb")))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return both.select("pair", F.when(F.col("thermal").isNull(), "rgb").otherwise("both").alias("kind"), F.size("v").cast("long").alias("dims"), F.round(total, 4).alias("total"))


@query("select flight_id, det.frame, coalesce('IMG_' || p.frame || '.jpg', printf('frame_%06d.jpg', det.frame)) as image, count(*) as n from det left join (select flight_id, frame from poses where x is not null) p using (flight_id, frame) group by all")
def j28_frame_images(spark, sf):
    p = d.poses(spark, sf).where("x is not null").select("flight_id", "frame", F.concat(F.lit("IMG_"), F.col("frame").cast("string"), F.lit(".jpg")).alias("file"))
    r = d.detections(spark, sf).join(p, ["flight_id", "frame"], "left")
    return r.groupBy("flight_id", "frame", F.coalesce("file", F.format_string("frame_%06d.jpg", "frame")).alias("image")).agg(F.count(F.lit(1)).alias("n"))


@query("select coalesce(case source_id when 1 then 'yolo' end, 'unknown') as kind, count(*) as n from det group by all")
def a1_by_producer(spark, sf):
    s = spark.createDataFrame([(1, "yolo")], "source_id long, kind string")
    r = d.detections(spark, sf).join(F.broadcast(s), "source_id", "left")
    return r.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("select reason, count(*) as n from failures group by reason")
def a2_failure_reasons(spark, sf):
    return d.failures(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(CAN + " select name as species, count(*) as n, count(distinct track_id) as n_tracks from can join species using (species_id) where species_id <> -2 and gx1 is not null group by grouping sets ((name), ())")
def a4_species_strata(spark, sf):
    return select.strata(select.countable(rows(spark, sf)), d.species(spark, sf))


@query("select track_id, min(frame) as first_frame, arg_min(gx1, frame * 1000000000 + detection_id) as gx1, count(*) as n from members join det using (detection_id) join geo using (detection_id) group by track_id")
def a7_track_summary(spark, sf):
    r = d.members(spark, sf).join(d.detections(spark, sf), "detection_id").join(d.geo(spark, sf), "detection_id")
    return r.groupBy("track_id").agg(F.min("frame").alias("first_frame"), F.min_by("gx1", F.struct("frame", "detection_id")).alias("gx1"), F.count(F.lit(1)).alias("n"))


@query("select 'detections' as tbl, species_id, count(*) as n from (select coalesce(m.species_id, 0) as species_id from det left join class_mapping m using (source_id, source_class)) group by species_id union all select 'tracks', species_id, count(*) from tracks group by species_id union all select 'labels', species_id, count(*) from label_tracks group by species_id")
def a8_species_usage(spark, sf):
    one = lambda df, name: df.groupBy("species_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "species_id", "n")
    return one(resolved(spark, sf), "detections").unionByName(one(d.tracks(spark, sf), "tracks")).unionByName(one(d.label_tracks(spark, sf), "labels"))


@query("with c as (select source_class, count(*) as n from det where source_class <> 'signup' group by 1), m as (select distinct source_class, species_id from class_mapping), b as (select coalesce(c.source_class, m.source_class) as source_class, coalesce(n, 0) as n, species_id from c full join m using (source_class)) select *, row_number() over (order by try_cast(source_class as int) is null, try_cast(source_class as int), source_class) as rank from b")
def a9_observed_classes(spark, sf):
    return mutate.observed_classes(d.detections(spark, sf).where("source_class <> 'signup'"), d.class_mapping(spark, sf))


@query("select distinct source_class as task from det")
def a10_tasks(spark, sf):
    return d.detections(spark, sf).select(F.col("source_class").alias("task")).distinct()


@query(f"with {RES} select species_id, dense_rank() over (order by species_id) - 1 as class_index, coalesce(name, 'species_' || species_id) as name from (select distinct species_id from res) left join species using (species_id)")
def a11_class_map(spark, sf):
    return mutate.class_map(resolved(spark, sf), d.species(spark, sf))


@query("with v as (select attributes->>'$.k' as raw from det) select 'int' as kind, count(try_cast(try_cast(raw as double) as bigint)) as ok, count(*) as n from v union all select 'bool', count(*) filter (lower(trim(raw)) in ('1','true','yes','y','on','0','false','no','n','off')), count(*) from v union all select 'float', count(try_cast(raw as double)), count(*) from v")
def a12_field_coercion(spark, sf):
    return mutate.coercible(d.detections(spark, sf), "k", ["int", "bool", "float"])


VOTE = "with n as (select track_id, class_index, min(label) as label, count(*) as v from predictions group by 1, 2), r as (select *, row_number() over (partition by track_id order by v desc, class_index) as k, sum(v) over (partition by track_id) as frames from n)"


@query(VOTE + " select track_id, class_index, label, cast(frames as bigint) as frames, round(v / frames::double, 6) as share from r where k = 1 and v / frames::double > 0.34 and frames >= 3")
def a13_quorum_vote(spark, sf):
    v = tracks.quorum_vote(d.predictions(spark, sf), 0.34, 3)
    return v.select("track_id", "class_index", "label", "frames", F.round("share", 6).alias("share"))


@query("select flight_id, modality, count(*) as n, count(distinct obj) as objects from det group by grouping sets ((flight_id, modality), (flight_id), ())")
def a18_pooled_tallies(spark, sf):
    return d.detections(spark, sf).rollup("flight_id", "modality").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("obj").alias("objects"))


@query("select label, count(*) as n from predictions group by label")
def a30_label_counts(spark, sf):
    return d.predictions(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("with old as (select detection_id, frame, source_id, x1 from det), new as (select detection_id + 10000000 as detection_id, frame, 2::bigint as source_id, x1 + 1 as x1 from det where source_id = 2 and detection_id % 4 = 1) select * from old where source_id <> 2 union all select * from new")
def k1_replace_producer(spark, sf):
    old = d.detections(spark, sf).select("detection_id", "frame", "source_id", "x1")
    new = old.where("source_id = 2 and detection_id % 4 = 1").selectExpr("detection_id + 10000000 as detection_id", "frame", "source_id", "x1 + 1 as x1")
    return mutate.replace_where(old, new, "source_id", 2)


@query("with m as (select flight_id * 15 + obj as legacy, detection_id from det where detection_id % 2 = 0 union all select flight_id * 15 + obj, detection_id from det where detection_id % 4 = 0), f as (select legacy, min(detection_id) as first from m group by 1), k as (select legacy, 1000 + dense_rank() over (order by first) as track_id from f) select distinct track_id, detection_id from m join k using (legacy)")
def k4_append_track_run(spark, sf):
    d0 = d.detections(spark, sf)
    m = d0.where("detection_id % 2 = 0").unionByName(d0.where("detection_id % 4 = 0")).selectExpr("flight_id * 15 + obj as legacy", "detection_id")
    return mutate.rekey_tracks(m, 1000)


@query("with old as (select distinct flight_id, frame, 0 as v from det where frame % 4 <> 3), new as (select distinct flight_id, frame, frame as v from det where frame % 5 < 2) select flight_id, frame, v, false as empty from new where frame % 7 <> 0 union all select flight_id, frame, v, false from old where (flight_id, frame) not in (select (flight_id, frame) from new)")
def k5_replace_frames(spark, sf):
    f = d.detections(spark, sf).select("flight_id", "frame").distinct()
    old = f.where("frame % 4 <> 3").selectExpr("flight_id", "frame", "0L as v", "false as empty")
    new = f.where("frame % 5 < 2").selectExpr("flight_id", "frame", "frame as v", "frame % 7 = 0 as empty")
    return mutate.replace_keys(old, new, "flight_id", "frame").where("not empty")


@query("with old as (select * from keyframes where frame % 3 <> 0), new as (select label_track_id, frame, case when frame % 4 = 0 then x1 + 1 else x1 end as x1, y1, x2, y2 from keyframes where frame % 5 <> 0) select coalesce(o.label_track_id, n.label_track_id) as label_track_id, case when o.frame is null then 'added' when n.frame is null then 'removed' when abs(o.x1 - n.x1) > 1e-6 or abs(o.y1 - n.y1) > 1e-6 or abs(o.x2 - n.x2) > 1e-6 or abs(o.y2 - n.y2) > 1e-6 then 'moved' else 'kept' end as change, count(*) as n from old o full join new n on o.label_track_id = n.label_track_id and o.frame = n.frame group by all")
def k12_materialise_diff(spark, sf):
    k = d.keyframes(spark, sf)
    new = k.where("frame % 5 <> 0").withColumn("x1", F.expr("case when frame % 4 = 0 then x1 + 1 else x1 end"))
    return mutate.diff_boxes(k.where("frame % 3 <> 0"), new, ["label_track_id", "frame"]).groupBy("label_track_id", "change").agg(F.count(F.lit(1)).alias("n"))


@query("select g.detection_id, gx1 from geo g where g.detection_id not in (select detection_id from det where frame % 2 = 0)")
def k13_invalidate_geo(spark, sf):
    moved = d.detections(spark, sf).where("frame % 2 = 0").select("detection_id")
    return mutate.without(d.geo(spark, sf), moved, "detection_id").select("detection_id", "gx1")


@query("select detection_id, to_json({'renamed': cast(attributes->>'$.k' as varchar)}) as attributes from det")
def k18_rename_attribute(spark, sf):
    r = mutate.rename_key(d.detections(spark, sf).select("detection_id", "attributes"), "k", "renamed")
    return r


@query("select detection_id, frame from (select detection_id, frame, dense_rank() over (order by frame) - 1 as i from det where frame between 3 and 33) where i % 4 = 0")
def f8_range_and_stride(spark, sf):
    return select.stride(d.detections(spark, sf), 3, 33, 4).select("detection_id", "frame")


@query(f"with {RES} select 'none' as f, count(*) as n from res union all select 'empty', 0 union all select 'some', count(*) from res where species_id in (1, 5)")
def f3_species_in_list(spark, sf):
    r = resolved(spark, sf)
    one = lambda ids, name: r.where(select.species_filter(ids)).agg(F.lit(name).alias("f"), F.count(F.lit(1)).alias("n"))
    return one(None, "none").unionByName(one([], "empty")).unionByName(one([1, 5], "some"))


@query(CAN + " select count(*) as detections, count(*) filter (species_id = -2) as excluded_not_an_animal, count(*) filter (gx1 is null) as without_position, count(*) filter (species_id <> -2 and gx1 is not null) as counted, count(*) filter (species_id <> -2 and gx1 is not null and track_id is null) as untracked, (select string_agg(run_id::varchar, ',' order by run_id::varchar) from runs) as runs from can")
def g22_provenance(spark, sf):
    return select.provenance(rows(spark, sf), select.analysis_runs(d.track_runs(spark, sf)))


@query(f"with {RUNS}, {GONE} select track_id, species_id from tracks join runs using (run_id) where species_id <> 0 and track_id not in (select track_id from gone)")
def r2_track_species(spark, sf):
    t = d.tracks(spark, sf).join(F.broadcast(select.analysis_runs(d.track_runs(spark, sf))), "run_id", "left_semi")
    return t.join(select.superseded(d.label_tracks(spark, sf)), "track_id", "left_anti").where("species_id <> 0").select("track_id", "species_id")


@query("with a as (select row_number() over (partition by frame order by detection_id) as n, frame, x1 as ax from det where modality = 't'), b as (select row_number() over (partition by frame order by detection_id desc) as n, frame, x1 as bx from det where modality = 'w'), j as (select frame, n, ax, bx from a join b using (frame, n)) select frame, min(n) filter (abs(ax - bx) > 1e-6) as first_mismatch, count(*) as compared from j group by frame")
def r7_parity_check(spark, sf):
    x = d.detections(spark, sf)
    a = x.where("modality = 't'").select("frame", "detection_id", "x1")
    b = x.where("modality = 'w'").select("frame", F.col("detection_id").alias("other_id"), F.col("x1").alias("bx"), (-F.col("detection_id")).alias("down"))
    return mutate.parity(a, b, "frame", "detection_id", "down", "x1", "bx")


@query("select a.track_id as track_id, count(*) as others from members a join det da using (detection_id) join members b on true join det db on b.detection_id = db.detection_id and da.frame = db.frame and da.modality = db.modality where a.track_id <> b.track_id and a.track_id % 10 = 2 and b.track_id % 10 = 2 group by 1")
def r18_other_boxes_on_frame(spark, sf):
    m = d.members(spark, sf).where("track_id % 10 = 2").join(d.detections(spark, sf), "detection_id")
    own = m.groupBy("track_id", "frame", "modality").agg(F.count(F.lit(1)).alias("own"))
    own = own.withColumn("n", F.sum("own").over(Window.partitionBy("frame", "modality")))
    return own.groupBy("track_id").agg(F.sum(F.col("own") * (F.col("n") - F.col("own"))).alias("others")).where("others > 0")


@query("select frame, cast(count(*) as bigint) as boxes, min(x1) as left_most from det group by frame order by frame")
def r27_overlay_by_frame(spark, sf):
    g = d.detections(spark, sf).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("detection_id", "x1", "y1", "x2", "y2"))).alias("b"))
    return g.select("frame", F.size("b").cast("long").alias("boxes"), F.array_min(F.col("b.x1")).alias("left_most")).orderBy("frame")


@query("select 'all' as s, count(*) as n from det union all select 'geo', count(*) from det where detection_id in (select detection_id from geo) union all select 'neither', count(*) from det where detection_id not in (select detection_id from geo) and detection_id not in (select detection_id from failures)")
def u2_set_accounting(spark, sf):
    a, g, f = d.detections(spark, sf).select("detection_id"), d.geo(spark, sf).select("detection_id"), d.failures(spark, sf).select("detection_id")
    one = lambda df, n: df.agg(F.lit(n).alias("s"), F.count(F.lit(1)).alias("n"))
    return one(a, "all").unionByName(one(a.intersect(g), "geo")).unionByName(one(a.subtract(g).subtract(f), "neither"))


@query("select 'north' as project, source_class, count(*) as n from det where flight_id = 0 group by all union all select 'south', source_class, count(*) from det where flight_id <> 0 group by all")
def u4_pool_projects(spark, sf):
    x = d.detections(spark, sf)
    pooled = x.where("flight_id = 0").withColumn("project", F.lit("north")).unionByName(x.where("flight_id <> 0").withColumn("project", F.lit("south")))
    return pooled.groupBy("project", "source_class").agg(F.count(F.lit(1)).alias("n"))


@query("select frame, detection_id, confidence from det order by confidence desc, detection_id limit 25")
def l4_closest_first(spark, sf):
    return d.detections(spark, sf).select("frame", "detection_id", "confidence").orderBy(F.desc("confidence"), "detection_id").limit(25)
