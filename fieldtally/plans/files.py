"""Queries over the readers of legacy files and over stores: files are written from the survey tables, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import exports, legacy, stores
from ..sources.scratch import binary_files, fresh, spread, text_files
from . import domain as d
from .domain import sql

Q: dict = {}


def query(body: str | None = None):
    def put(f):
        Q[f.__name__] = (f, sql(body) if body else None)
        return f

    return put


def flight() -> Column:
    """The flight in a file's path."""
    return F.regexp_extract("file", r"flight_id=(\d+)", 1).cast("long").alias("flight_id")


def line(*parts) -> Column:
    """Blank-separated text of some columns."""
    return F.concat_ws(" ", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).alias("value")


def heads(rows: DataFrame, value: str, ord_: int = -1) -> DataFrame:
    """One more line for each flight."""
    return rows.select("flight_id").distinct().select("flight_id", F.lit(ord_).cast("long").alias("ord"), F.lit(value).alias("value"))


def documents(rows: DataFrame, body: Column, name: str) -> str:
    """One JSON document a flight from an aggregate of its rows."""
    return text_files(rows.groupBy("flight_id").agg(F.to_json(body).alias("value")).withColumn("ord", F.lit(0)), name)


def _detections_file(spark, sf) -> str:
    x = d.detections(spark, sf)
    whole = line("frame", "x1", "y1", "x2", "y2", "confidence", F.lit("5"))
    value = F.when(F.col("detection_id") % 13 == 0, "no number here at all").when(F.col("detection_id") % 11 == 0, line("frame", "x1", "y1", "x2", "y2")).otherwise(whole)
    own = x.select("flight_id", F.col("detection_id").alias("ord"), value.alias("value"))
    labels = x.where("detection_id % 17 = 0").select("flight_id", (F.col("detection_id") + 10**12 + 1).alias("ord"), line("frame", "x1", "y1", "x2", "y2", F.lit("0.5"), F.lit("7")))
    return text_files(own.unionByName(heads(x, "# frame x1 y1 x2 y2 conf cls")).unionByName(heads(x, "# LABELS", 10**12)).unionByName(labels), "detections")


@query("select flight_id, frame, x1, y1, x2, y2, case when detection_id % 11 = 0 then 1.0 else confidence end as confidence, case when detection_id % 11 = 0 then '0' else '5' end as source_class from det where detection_id % 13 <> 0")
def s5_detections_text(spark, sf):
    r = legacy.detections_text(spark, _detections_file(spark, sf)).where("block = 'detector'")
    return r.select(flight(), "frame", "x1", "y1", "x2", "y2", "confidence", "source_class")


@query("select flight_id, 'detector' as block, count(*) as n, min(frame) as first from det where detection_id % 13 <> 0 group by 1 union all select flight_id, 'label', count(*), min(frame) from det where detection_id % 17 = 0 group by 1")
def s6_both_blocks(spark, sf):
    r = legacy.detections_text(spark, _detections_file(spark, sf)).select(flight(), "block", "frame")
    return r.groupBy("flight_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"))


@query("select flight_id, detection_id as idx, frame, case when detection_id % 9 = 0 then -1.0 else gx1 end as gx1, gy2, detection_id % 9 = 0 as failed from det join geo using (detection_id)")
def s7_georeferenced_text(spark, sf):
    x = d.detections(spark, sf).join(d.geo(spark, sf), "detection_id").withColumn("gx1", F.expr("case when detection_id % 9 = 0 then -1D else gx1 end"))
    zero = F.lit("0")
    lines = x.select("flight_id", F.col("detection_id").alias("ord"), line("detection_id", "frame", "gx1", "gy1", zero, "gx2", "gy2", zero, "confidence", F.lit("1")))
    return legacy.georeferenced_text(spark, text_files(lines, "georeferenced")).select(flight(), "idx", "frame", "gx1", "gy2", "failed")


@query("select flight_id, frame, detection_id as track_id, x1, case when detection_id % 6 = 0 then 1.0 else confidence end as confidence, detection_id % 4 = 0 as interpolated from det where detection_id % 8 <> 1")
def s8_tracks_csv(spark, sf):
    x = d.detections(spark, sf)
    conf = F.when(F.col("detection_id") % 6 != 0, F.col("confidence")).cast("string")
    own = F.concat_ws(",", "frame", F.when(F.col("detection_id") % 8 == 1, "?").otherwise(F.col("detection_id").cast("string")), "x1", "y1", "x2", "y2", F.coalesce(conf, F.lit("")), F.lit("5"), (F.col("detection_id") % 4 == 0).cast("int"))
    lines = heads(x, "frame,track_id,x1,y1,x2,y2,conf,cls,interpolated").unionByName(x.select("flight_id", F.col("detection_id").alias("ord"), own.alias("value")))
    return legacy.tracks_csv(spark, text_files(lines, "tracks")).select(flight(), "frame", "track_id", "x1", "confidence", "interpolated")


@query("select flight_id, detection_id as frame, detection_id % 5 as points, case when detection_id % 5 > 0 then x1 + detection_id % 5 - 1 end as last_x from det")
def s9_fov_text(spark, sf):
    points = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat_ws(" ", F.col("x1") + i - 1, F.col("y1"), F.lit("0")))
    x = d.detections(spark, sf).withColumn("n", (F.col("detection_id") % 5).cast("int"))
    value = line("detection_id", "n", F.when(F.col("n") > 0, F.array_join(points, " ")).otherwise(""))
    r = legacy.fov_text(spark, text_files(x.select("flight_id", F.col("detection_id").alias("ord"), value), "fov"))
    return r.select(flight(), "frame", F.size("ring").cast("long").alias("points"), F.get("ring", F.size("ring") - 1)["x"].alias("last_x"))


@query("select label_track_id // 15 as flight_id, label_track_id, frame, x1, y1, x2, y2, stop from keyframes")
def s10_labels_json(spark, sf):
    k = d.keyframes(spark, sf).withColumn("flight_id", F.expr("label_track_id div 15"))
    own = k.groupBy("flight_id", F.col("label_track_id").cast("string").alias("t")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), F.struct(F.array("x1", "y1", "x2", "y2").alias("box"), F.when(F.col("stop"), True).alias("stop"))))).alias("keyframes")
    )
    path = documents(own, F.struct(F.map_from_entries(F.collect_list(F.struct("t", F.struct("keyframes")))).alias("tracks")), "labels")
    return legacy.labels_json(spark, path).select(flight(), "label_track_id", "frame", "x1", "y1", "x2", "y2", "stop")


@query("select flight_id, detection_id as frame, source_class as prompt, confidence as score, 3 as points, x2 as x from det where detection_id % 3 = 0")
def s11_segmentation_json(spark, sf):
    x = d.detections(spark, sf).where("detection_id % 3 = 0")
    ring = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"))
    one = F.array(F.struct(F.col("source_class").alias("prompt"), F.array(F.struct(F.col("confidence").alias("score"), F.array(ring).alias("polygons"))).alias("predictions")))
    path = documents(x, F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("detection_id").cast("string"), one))).alias("frames")), "segments")
    r = legacy.segmentation_json(spark, path)
    return r.select(flight(), "frame", "prompt", "score", F.size("ring").alias("points"), F.get("ring", F.lit(1))["x"].alias("x"))


@query("select flight_id, row_number() over (partition by flight_id order by detection_id) - 1 as frame, 'IMG_' || detection_id || '.jpg' as imagefile, case when detection_id % 37 <> 0 then x1 end as x, 50.0::double as fovy, t_us // 1000000 as epoch from det where modality = 't'")
def s12_poses_json(spark, sf):
    x = d.detections(spark, sf).where("modality = 't'")
    second = F.floor(F.col("t_us") / 1_000_000)
    stamp = F.when(F.col("detection_id") % 4 == 0, second.cast("string")).otherwise(F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    image = F.struct(
        F.concat(F.lit("IMG_"), F.col("detection_id").cast("string"), F.lit(".jpg")).alias("imagefile"), F.when(F.col("detection_id") % 37 != 0, F.array("x1", "y1", F.lit(100.0))).alias("location"),
        F.array(F.lit(0.0), F.lit(0.0), (F.col("detection_id") % 360).cast("double")).alias("rotation"), F.array(F.lit(50.0)).alias("fovy"), stamp.alias("timestamp"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("detection_id", image.alias("i")))), lambda v: v["i"])
    r = legacy.poses_json(spark, documents(x, F.struct(listed.alias("images")), "poses"))
    return r.select(flight(), "frame", "imagefile", "x", "fovy", F.unix_timestamp("ts").alias("epoch"))


@query("select flight_id, case when flight_id % 3 = 0 then 0.0::double else flight_id * 10.0::double end as x, case when flight_id % 3 = 0 then 0.0::double else 5.0::double end as y from det group by all")
def s13_dem_origin(spark, sf):
    x = d.detections(spark, sf)
    body = F.struct(F.when(F.first("flight_id") % 3 != 0, F.array(F.first("flight_id") * 10.0, F.lit(5.0), F.lit(0.0))).alias("origin"))
    return legacy.dem_origin(spark, documents(x, body, "terrain")).select(flight(), "x", "y")


@query("select flight_id, row_number() over (partition by flight_id order by detection_id) - 1 as seq, gx1 as x, gy1 as y from det join geo using (detection_id) where modality = 'w'")
def s14_route_geojson(spark, sf):
    x = d.detections(spark, sf).join(d.geo(spark, sf), "detection_id").where("modality = 'w'")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("detection_id", "gx1", "gy1"))), lambda v: F.array(v["gx1"], v["gy1"]))
    feature = lambda kind, c: F.struct(F.struct(F.lit(kind).alias("type"), c.alias("coordinates")).alias("geometry"))
    body = F.struct(F.array(feature("LineString", listed)).alias("features"))
    return legacy.route_geojson(spark, documents(x, body, "route")).select(flight(), F.col("seq").cast("long").alias("seq"), "x", "y")


def _log(spark, sf) -> DataFrame:
    x = d.detections(spark, sf)
    ts, i = F.timestamp_seconds(F.floor(F.col("t_us") / 1_000_000)), F.col("detection_id")
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]
    when = F.coalesce(*[F.when(i % 5 == k, F.date_format(ts, f)) for k, f in enumerate(formats)])
    lat = F.when(i % 50 == 0, "0").when(i % 51 == 0, "").otherwise((48 + i % 1000 / 1000.0).cast("string"))
    lon = F.when(i % 50 == 0, "0").otherwise((14 + i % 997 / 1000.0).cast("string"))
    lines = heads(x, "datetime(utc),latitude,longitude,isVideo").unionByName(x.select("flight_id", i.alias("ord"), F.concat_ws(",", when, lat, lon, (i % 3 == 0).cast("int").cast("string")).alias("value")))
    return legacy.flight_log(spark, text_files(lines, "airdata")).select(flight(), "lat", "lon", "ts", "flag")


LOG = "with a as (select flight_id, detection_id as i, 48 + detection_id % 1000 / 1000.0::double as lat, 14 + detection_id % 997 / 1000.0::double as lon, to_timestamp(t_us // 1000000) at time zone 'UTC' as ts from det where detection_id % 50 <> 0 and detection_id % 51 <> 0)"


@query(LOG + " select flight_id, round(lat, 6) as lat, round(lon, 6) as lon, epoch(ts)::bigint as epoch from a")
def s15_flight_log(spark, sf):
    return _log(spark, sf).select("flight_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.unix_timestamp("ts").alias("epoch"))


@query(LOG + " select flight_id, round(min(lat), 6) as south, round(max(lat), 6) as north, round(min(lon), 6) as west, round(max(lon), 6) as east from a group by 1")
def s16_gps_bounds(spark, sf):
    b = legacy.gps_bounds(_log(spark, sf), "flight_id")
    return b.select("flight_id", *[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")])


@query(LOG + " select flight_id, count(*) as n, round(avg(hour(ts) + minute(ts) / 60.0::double + second(ts) / 3600.0::double), 6) as hour from a where i % 3 = 0 group by 1")
def s17_recording_hours(spark, sf):
    x = _log(spark, sf).where(text.truthy(F.col("flag"), "eq1"))
    return x.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(text.hour_of_day(F.col("ts"))), 6).alias("hour"))


@query("select flight_id, count(*) as n, round(avg(hour(ts) + minute(ts) / 60.0::double + second(ts) / 3600.0::double), 6) as hour from (select flight_id, to_timestamp(t_us // 1000000) at time zone 'UTC' as ts from det where detection_id % 2 = 0) group by 1")
def s18_subtitle_hours(spark, sf):
    x, ts = d.detections(spark, sf), F.timestamp_seconds(F.floor(F.col("t_us") / 1_000_000))
    value = F.when(F.col("detection_id") % 2 == 0, F.concat(F.lit("<font> "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(".123"))).otherwise("00:00:01,000 --> 00:00:02,000")
    r = legacy.subtitle_hours(spark, text_files(x.select("flight_id", F.col("detection_id").alias("ord"), value.alias("value")), "subtitles"))
    return r.groupBy(flight()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hour"), 6).alias("hour"))


@query("select flight_id, frame, min(least(x1, x2)) as x1, max(greatest(y1, y2)) as y2 from (select distinct on (flight_id, frame) * from det order by flight_id, frame, detection_id) group by all")
def s21_tracklet_boxes(spark, sf):
    import io

    import numpy as np

    own = F.min_by(F.struct("x1", "y1", "x2", "y2"), "detection_id").alias("b")
    x = d.detections(spark, sf).groupBy("flight_id", "frame").agg(own).select("flight_id", "frame", "b.*")

    def pack(g):
        out = io.BytesIO()
        g = g.sort_values("frame")
        nan = np.full(len(g), np.nan)
        np.savez(out, frame=g["frame"].to_numpy(), poseX0=g["x1"].to_numpy(), poseX1=g["x2"].to_numpy(), poseX2=nan, poseY0=g["y1"].to_numpy(), poseY1=g["y2"].to_numpy(), poseY2=nan)
        return g.head(1).assign(path=f"flight_id={g['flight_id'].iloc[0]}/t.npz", content=out.getvalue())[["path", "content"]]

    folder = binary_files(x.groupBy("flight_id").applyInPandas(pack, "path string, content binary"), "tracklets")
    return legacy.tracklets_npz(spark, f"{folder}/*/*.npz").select(flight(), "frame", "x1", "y2")


@query("select flight_id, k as transect_id, 'T' || k as name, min(frame) as first_frame, max(frame) as last_frame from (select flight_id, obj + 1 as k, frame from det) group by all")
def s22_transects_json(spark, sf):
    t = d.detections(spark, sf).groupBy("flight_id", (F.col("obj") + 1).alias("id")).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
    one = F.struct("id", F.concat(F.lit("T"), F.col("id").cast("string")).alias("name"), "start_frame", "end_frame")
    return legacy.transects_json(spark, documents(t, F.struct(F.array_sort(F.collect_list(one)).alias("transects")), "transects")).select(flight(), "transect_id", "name", "first_frame", "last_frame")


@query("select flight_id, row_number() over (partition by flight_id order by obj) - 1 as pos, obj * 100 as start_frame, obj * 100 + 50 as end_frame, case when obj % 2 = 0 then obj * 1.0::double else -1.0::double end as tz from (select distinct flight_id, obj from det) union all select distinct flight_id, 2147483647, -4611686018427387904, 4611686018427387904, -1.0::double from det")
def s23_corrections_json(spark, sf):
    x = d.detections(spark, sf).select("flight_id", "obj").distinct()
    xyz = lambda z: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), z.alias("z"))
    one = F.struct((F.col("obj") * 100).alias("start"), (F.col("obj") * 100 + 50).alias("end"), F.when(F.col("obj") % 2 == 0, xyz(F.col("obj") * 1.0)).alias("translation"))
    default = F.struct(xyz(F.lit(-1.0)).alias("translation"), xyz(F.lit(0.0)).alias("rotation"))
    path = documents(x, F.struct(default.alias("default"), F.array_sort(F.collect_list(one)).alias("corrections")), "corrections")
    return legacy.corrections_json(spark, path).select(flight(), F.col("pos").cast("long").alias("pos"), "start_frame", "end_frame", F.col("translation.z").alias("tz"))


@query("select distinct flight_id, frame from det where frame >= 3")
def s24_frame_images(spark, sf):
    x = d.detections(spark, sf).select("flight_id", "frame").repartition(spread(spark), "flight_id").distinct()
    folder = binary_files(x.select(F.format_string("flight_id=%d/%08d.tiff", "flight_id", "frame").alias("path"), F.encode(F.lit("II*"), "utf-8").alias("content")), "frames")
    r = legacy.frame_images(spark, f"{folder}/*", 3, 10**8 - 1)
    return r.select(F.regexp_extract("path", r"flight_id=(\d+)", 1).cast("long").alias("flight_id"), "frame")


@query("with b as (select detection_id, (400000 + detection_id % 7 * 40000)::bigint as lx, (400000 + detection_id % 7 * 40000 + detection_id % 3 * 50000)::bigint as hx, (5200000 + detection_id % 5 * 30000)::bigint as ly, (5200000 + detection_id % 5 * 30000 + detection_id % 2 * 50000)::bigint as hy from det), r as (select *, unnest(range(ly // 50000 * 50000, hy + 1, 50000)) as n from b), c as (select detection_id, n, unnest(range(lx // 50000 * 50000, hx + 1, 50000)) as e from r) select detection_id, 'N' || n // 1000 || 'E' || e // 1000 as tile from c")
def s27_required_tiles(spark, sf):
    i = F.col("detection_id")
    lx, ly = 400000 + i % 7 * 40000, 5200000 + i % 5 * 30000
    return d.detections(spark, sf).select("detection_id", F.explode(legacy.required_tiles(lx, ly, lx + i % 3 * 50000, ly + i % 2 * 50000)).alias("tile"))


@query("select d.detection_id, s.name as species, ['unknown','female','male'][(detection_id % 3 + 1)::int] as sex from det d left join class_mapping m using (source_id, source_class) left join species s using (species_id)")
def s29_vocabulary_scan(spark, sf):
    from ..schema import ENUMS

    enums = spark.createDataFrame([(e, i, v) for e, vs in ENUMS.items() for i, v in enumerate(vs)], "enum string, value_id int, label string")
    values = enums.where("enum = 'sex'").agg(F.map_from_entries(F.collect_list(F.struct("value_id", "label"))).alias("m")).scalar()
    x = d.detections(spark, sf).join(d.class_mapping(spark, sf), ["source_id", "source_class"], "left").join(d.species(spark, sf), "species_id", "left")
    return x.select("detection_id", F.col("name").alias("species"), F.try_element_at(values, (F.col("detection_id") % 3).cast("int")).alias("sex"))


@query("select flight_id, modality, count(*) as n, max(x2) as right_most from det group by all")
def s1_typed_store(spark, sf):
    root = fresh(spark, "store")
    x = d.detections(spark, sf).select("detection_id", "frame", "x1", "y1", "x2", "y2", "confidence", "source_id", "source_class", "attributes", "flight_id", "modality")
    stores.write_table(x, root, "detections")
    return stores.read_table(spark, root, "detections").groupBy("flight_id", "modality").agg(F.count(F.lit(1)).alias("n"), F.max("x2").alias("right_most"))


@query("select frame // 20 as bucket, detection_id, x1 + y1 as total, 4 as dims from det where modality = 't'")
def k21_vectors_npz(spark, sf):
    import io

    import numpy as np

    x = d.detections(spark, sf).where("modality = 't'").select(F.expr("frame div 20").alias("bucket"), "detection_id", "x1", "y1")

    def pack(g):
        out = io.BytesIO()
        np.savez(out, **{f"det_{i}": np.asarray([a, b, 0, 0], "float32") for i, a, b in zip(g["detection_id"], g["x1"], g["y1"])})
        return g.head(1).assign(path=f"bucket={g['bucket'].iloc[0]}/v.npz", content=out.getvalue())[["path", "content"]]

    folder = binary_files(x.groupBy("bucket").applyInPandas(pack, "path string, content binary"), "vectors")
    r = legacy.vectors_npz(spark, f"{folder}/*/*.npz")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    back = r.select("detection_id", total.alias("total"), F.size("embedding").alias("dims"))
    return back.join(x.select("detection_id", "bucket"), "detection_id").select("bucket", "detection_id", "total", "dims")


@query("with t as (select flight_id, obj as transect_id, frame, x1, y1, row_number() over (partition by flight_id, obj order by frame, detection_id) as r from det), s as (select *, sqrt((x1 - lag(x1) over w) ** 2 + (y1 - lag(y1) over w) ** 2) as step from t window w as (partition by flight_id, transect_id order by r)) select flight_id, transect_id, min(frame) as first_frame, max(frame) as last_frame, round(coalesce(sum(step), 0), 2) as length_m from s group by all")
def k22_transects_with_lengths(spark, sf):
    """Transects enriched by their path length, written as CSV and read back."""
    w = Window.partitionBy("flight_id", "obj").orderBy("frame", "detection_id")
    x = d.detections(spark, sf).withColumn("p", F.lag(F.struct("x1", "y1")).over(w))
    step = F.sqrt((F.col("x1") - F.col("p.x1")) ** 2 + (F.col("y1") - F.col("p.y1")) ** 2)
    t = x.groupBy("flight_id", F.col("obj").alias("transect_id")).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.round(F.coalesce(F.sum(step), F.lit(0.0)), 2).alias("length_m"))
    path = fresh(spark, "transects")
    t.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(t.schema).csv(path)


@query("with g as (select flight_id, min(gx1) as left_, max(gy2) as top from det join geo using (detection_id) group by 1) select flight_id, i, round(v, 4) as v from (select flight_id, unnest([1, 2, 3, 4, 5, 6]) as i, unnest([0.5::double, 0.0, 0.0, -0.5, left_ + 0.25, top - 0.25]) as v from g)")
def k23_world_files(spark, sf):
    """The placement of each flight's raster, written as a world file and read back line by line."""
    g = d.detections(spark, sf).join(d.geo(spark, sf), "detection_id").groupBy("flight_id").agg(F.min("gx1").alias("left"), F.max("gy2").alias("top"))
    lines = g.select("flight_id", F.posexplode(exports.world_lines(F.lit(0.5), F.col("left"), F.col("top"))).alias("ord", "value"))
    r = legacy.numbered_lines(spark, text_files(lines, "world")).where("value <> ''")
    return r.select(flight(), (F.col("line") + 1).alias("i"), F.round(F.col("value").cast("double"), 4).alias("v"))
