"""Queries over export formats, streaming extensions and the stage graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select, tracks
from ..sources import exports
from ..streaming import windows
from . import domain as d
from .domain import sql
from .relational import CAN, rows

Q: dict = {}


def query(text: str | None = None):
    def put(f):
        Q[f.__name__] = (f, sql(text) if text else None)
        return f

    return put


def _classes(spark, sf):
    from ..operators import mutate

    return mutate.class_map(exports.rows_for("coco", rows(spark, sf)), d.species(spark, sf))


EXP = CAN + ", k as (select species_id, dense_rank() over (order by species_id) - 1 as class_index from (select distinct species_id from can where species_id <> -2))"


@query(EXP + " select detection_id, 'frame=' || frame || ';cat=' || class_index || ';area=' || ((x2-x1)*(y2-y1))::bigint as v from can join k using (species_id)")
def e1_coco_annotations(spark, sf):
    r = exports.rows_for("coco", rows(spark, sf))
    a = exports.coco(r, _classes(spark, sf), 800, 512)["annotations"]
    j = F.from_json("value", "id long, image_id long, category_id long, area double")
    return a.select(j.alias("j")).select(F.col("j.id").alias("detection_id"), F.concat(F.lit("frame="), F.col("j.image_id").cast("string"), F.lit(";cat="), F.col("j.category_id").cast("string"), F.lit(";area="), F.col("j.area").cast("long").cast("string")).alias("v"))


@query(EXP + " select frame, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_index, (x1+x2)/2/800, (y1+y2)/2/512, (x2-x1)/800, (y2-y1)/512), chr(10) order by detection_id) as value from can join k using (species_id) group by frame")
def e2_yolo(spark, sf):
    return exports.yolo(exports.rows_for("yolo", rows(spark, sf)), _classes(spark, sf), 800.0, 512.0)


@query(CAN + " select frame, track_id, detection_id, printf('%d,%d,%.2f,%.2f,%.2f,%.2f,%.4f,-1,-1,-1', frame + 1, track_id, x1, y1, x2-x1, y2-y1, confidence) as value from can where track_id is not null and species_id <> -2")
def e3_mot(spark, sf):
    return exports.mot(exports.rows_for("mot", rows(spark, sf)))


@query("select ['k'] as keys")
def t11_attribute_columns(spark, sf):
    return exports.attribute_columns(d.detections(spark, sf))


@query(CAN + " select detection_id, round((gx1+gx2)/2, 4) as x, round((gy1+gy2)/2, 4) as y from can where gx1 is not null and species_id <> -2")
def e4_points_geojson(spark, sf):
    p = exports.points_geojson(select.countable(rows(spark, sf)))
    j = F.from_json("value", "geometry struct<type:string,coordinates:array<double>>")
    return p.select("detection_id", F.round(F.get(j["geometry"]["coordinates"], F.lit(0)), 4).alias("x"), F.round(F.get(j["geometry"]["coordinates"], F.lit(1)), 4).alias("y"))


@query(CAN + " select track_id, count(*) as points from can where gx1 is not null and track_id is not null group by 1 having count(*) >= 2")
def e4_track_lines(spark, sf):
    return exports.lines_geojson(rows(spark, sf)).select("track_id", "points")


@query(CAN + " select track_id, count(*) as n, sum(frame)::bigint as frames from can where track_id is not null group by 1")
def e6_track_arrays(spark, sf):
    a = exports.track_arrays(rows(spark, sf))
    return a.select("track_id", F.size("frame").cast("long").alias("n"), F.aggregate("frame", F.lit(0).cast("long"), lambda s, x: s + x).alias("frames"))


@query(CAN + " select case when species_id = -2 then 'blank' when species_id = -1 then 'unknown' else 'animal' end as observation_type, case when species_id > 0 then name end as vernacular, count(*) as n from can left join species using (species_id) group by 1, 2")
def e7_camtrap(spark, sf):
    o = exports.camtrap(exports.rows_for("camtrap", rows(spark, sf)), d.species(spark, sf), "flight-1")["observations"]
    return o.groupBy(F.col("observationType").alias("observation_type"), F.col("vernacularName").alias("vernacular")).agg(F.count(F.lit(1)).alias("n"))


@query(CAN + ", f as (select track_id, min(frame) as first_frame, count(*) as n, arg_min(species_id, frame * 1000000000 + detection_id) as species_id from can where gx1 is not null and track_id is not null and species_id <> -2 group by 1) select track_id, first_frame, n, species_id > 0 and species_id <> 5 as published from f")
def e8_occurrences(spark, sf):
    s = d.species(spark, sf).withColumn("scientific_name", F.when(F.col("species_id") != 5, F.concat(F.lit("S. "), F.col("name"))))
    o = exports.occurrences(exports.rows_for("dwca", rows(spark, sf)), s)
    return o.select("track_id", "first_frame", F.col("individual_frames").alias("n"), "published")


@query("with n as (select *, lead(frame) over w as nf, lead(x1) over w as nx1 from keyframes window w as (partition by label_track_id order by frame)), e as (select *, unnest(range(frame, case when stop or nf is null then frame + 1 else nf end)) as f from n) select label_track_id, count(*) as boxes, count(*) filter (f = frame) as keys from e group by 1")
def e11_labels_csv(spark, sf):
    c = exports.labels_csv(tracks.between_keyframes(d.keyframes(spark, sf, tracks.dealt), deal=False))
    return c.groupBy("label_track_id").agg(F.count(F.lit(1)).alias("boxes"), F.sum(F.substring_index("value", ",", -1).cast("long")).alias("keys"))


@query("select flight_id, count(*) as points from poses where x is not null and not (x = 0 and y = 0) group by 1")
def e12_flight_route(spark, sf):
    return exports.route_line(d.poses(spark, sf), "flight_id").select("flight_id", "points")


@query("select time_bucket(interval 10 minute, ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def x1_windowed_counts(spark, sf):
    w = windows.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def x2_sessions(spark, sf):
    s = windows.sessions(spark.read.parquet(f"{sf}/events.parquet"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
