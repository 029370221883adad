"""Readers of text, CSV and JSON files that survey projects keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import listed_files

#: Fixed value: marker line before the label block of a detections text.
LABEL_MARKER = "# labels"


def _file() -> Column:
    """The file that a row was read from."""
    return F.input_file_name().alias("file")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of small text files with their file and 0-based line number."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return whole


def _parts(value: str = "value") -> Column:
    return F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != "")


def _number(i: int, kind: str = "double") -> Column:
    return F.get(F.col("p"), F.lit(i)).try_cast(kind)


def detections_text(spark: SparkSession, path: str, marker: str = LABEL_MARKER) -> DataFrame:
    """``frame x1 y1 x2 y2 [conf] [cls]`` lines; ``block`` says detector or label (behind the marker line).

    Comments and lines that don't parse are left out; confidence defaults to 1.0 and class to "0".
    """
    w = Window.partitionBy("file").orderBy("line")
    is_marker = F.startswith(F.lower(F.trim("value")), F.lit(marker)).cast("int")
    x = numbered_lines(spark, path).withColumn("labels", F.max(is_marker).over(w))
    x = x.where(~F.startswith(F.trim("value"), F.lit("#"))).withColumn("p", _parts()).where(F.size("p") >= 5)
    out = x.select(
        "file", "line", _number(0, "long").alias("frame"), *[_number(i + 1).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        F.coalesce(_number(5), F.lit(1.0)).alias("confidence"), F.coalesce(F.get("p", F.lit(6)), F.lit("0")).alias("source_class"),
        F.when(F.col("labels") == 1, "label").otherwise("detector").alias("block"),
    )
    return out.where("frame is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null")


def georeferenced_text(spark: SparkSession, path: str) -> DataFrame:
    """``idx frame x1 y1 z1 x2 y2 z2 conf cls``; ``failed`` where a corner is negative."""
    x = numbered_lines(spark, path).where(~F.startswith(F.trim("value"), F.lit("#"))).withColumn("p", _parts()).where(F.size("p") >= 10)
    cols = ["gx1", "gy1", "gz1", "gx2", "gy2", "gz2"]
    out = x.select("file", _number(0, "long").alias("idx"), _number(1, "long").alias("frame"), *[_number(i + 2).alias(c) for i, c in enumerate(cols)], _number(8).alias("confidence"), F.get("p", F.lit(9)).alias("source_class"))
    return out.withColumn("failed", (F.col("gx1") < 0) | (F.col("gy1") < 0) | (F.col("gx2") < 0) | (F.col("gy2") < 0))


def fov_text(spark: SparkSession, path: str) -> DataFrame:
    """``frame n x y z ...``: frame and ring (array of x, y, z); n may be 0."""
    x = numbered_lines(spark, path).withColumn("p", _parts()).where(F.size("p") >= 2)
    x = x.withColumn("frame", _number(0, "long")).withColumn("n", _number(1, "int")).where("frame is not null and n is not null")
    at = lambda i, k: F.get(F.col("p"), (i * 3 + 2 + k).cast("int")).try_cast("double")
    index = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return x.select("file", "frame", F.transform(index, lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).alias("z"))).alias("ring"))


def tracks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pixel tracks: frame, track_id, box, confidence, class and ``interpolated`` (missing: 0)."""
    raw = spark.read.option("header", True).csv(path)
    get = lambda c, kind, default=None: (F.col(c).try_cast(kind) if c in raw.columns else F.lit(default).cast(kind)).alias(c)
    out = raw.select(_file(), get("frame", "long"), get("track_id", "long"), *[get(c, "double") for c in ("x1", "y1", "x2", "y2")], F.coalesce(get("conf", "double"), F.lit(1.0)).alias("confidence"), get("cls", "string"), get("interpolated", "int", 0))
    return out.withColumn("interpolated", F.coalesce("interpolated", F.lit(0)) == 1).where("frame is not null and track_id is not null")


def poses_json(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a poses file by their place in it: frame, imagefile, x, y, z, rotation, fovy, ts."""
    schema = "images array<struct<imagefile:string,location:array<double>,rotation:array<double>,fovy:array<double>,timestamp:string>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path).select(_file(), F.posexplode("images").alias("frame", "i"))
    xyz = [F.get("i.location", F.lit(k)).alias(c) for k, c in enumerate("xyz")]
    ts = F.coalesce(F.try_to_timestamp("i.timestamp"), F.timestamp_seconds(F.col("i.timestamp").try_cast("double")))
    return x.select("file", F.col("frame").cast("long").alias("frame"), "i.imagefile", *xyz, "i.rotation", F.get("i.fovy", F.lit(0)).alias("fovy"), ts.alias("ts"))


def labels_json(spark: SparkSession, path: str) -> DataFrame:
    """Key frames of a labels file (track id to frame to box): label_track_id, frame, x1..y2, stop."""
    schema = "tracks map<string,struct<keyframes:map<string,struct<box:array<double>,stop:boolean>>>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path).select(_file(), F.explode("tracks").alias("t", "v"))
    x = x.select("file", F.col("t").try_cast("long").alias("label_track_id"), F.explode("v.keyframes").alias("f", "k"))
    return x.select("file", "label_track_id", F.col("f").try_cast("long").alias("frame"), *[F.get("k.box", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.coalesce("k.stop", F.lit(False)).alias("stop"))


def segmentation_json(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a segmentation file: frame, prompt, score, ring."""
    schema = "frames map<string,array<struct<prompt:string,predictions:array<struct<score:double,polygons:array<array<array<double>>>>>>>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path).select(_file(), F.explode("frames").alias("f", "ps"))
    x = x.select("file", F.col("f").try_cast("long").alias("frame"), F.explode("ps").alias("p")).select("file", "frame", "p.prompt", F.explode("p.predictions").alias("q"))
    x = x.select("file", "frame", "prompt", "q.score", F.explode("q.polygons").alias("r"))
    return x.select("file", "frame", "prompt", "score", F.transform("r", lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))).alias("ring"))


def route_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Points of the first LineString of a GeoJSON file: seq, x, y."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path)
    lines = F.filter("features", lambda f: f["geometry"]["type"] == "LineString")
    c = F.from_json(F.get(lines, F.lit(0))["geometry"]["coordinates"], "array<array<double>>")
    return x.select(_file(), F.posexplode(c).alias("seq", "c")).select("file", "seq", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"))


def points_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Points of a GeoJSON file, in order: seq, x, y."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path)
    points = F.filter("features", lambda f: f["geometry"]["type"] == "Point")
    c = F.from_json("p.geometry.coordinates", "array<double>")
    return x.select(_file(), F.posexplode(points).alias("seq", "p")).select("file", "seq", F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))


def corrections_json(spark: SparkSession, path: str) -> DataFrame:
    """Frame ranges of a corrections file in their order, the default last (over all frames)."""
    part = "struct<translation:struct<x:double,y:double,z:double>,rotation:struct<x:double,y:double,z:double>>"
    ranges = "array<struct<start:long,end:long,translation:struct<x:double,y:double,z:double>,rotation:struct<x:double,y:double,z:double>>>"
    x = spark.read.schema(f"default {part}, corrections {ranges}").option("multiLine", True).json(path).select(_file(), "default", "corrections")
    listed = x.select("file", F.posexplode("corrections").alias("pos", "r"), "default")
    own = listed.select("file", "pos", F.col("r.start").alias("start_frame"), F.col("r.end").alias("end_frame"), F.coalesce("r.translation", "default.translation").alias("translation"), F.coalesce("r.rotation", "default.rotation").alias("rotation"))
    last = x.select("file", F.lit(2**31 - 1).alias("pos"), F.lit(-(2**62)).alias("start_frame"), F.lit(2**62).alias("end_frame"), "default.translation", "default.rotation")
    return own.unionByName(last)


def dem_origin(spark: SparkSession, path: str) -> DataFrame:
    """Origin of a terrain's metadata: x, y (0 where it has none)."""
    x = spark.read.schema("origin array<double>").option("multiLine", True).json(path)
    return x.select(_file(), *[F.coalesce(F.get("origin", F.lit(k)), F.lit(0.0)).alias(c) for k, c in enumerate("xy")])


def flight_log(spark: SparkSession, path: str) -> DataFrame:
    """Flight log CSV with columns found by their names: lat, lon, ts, flag. Rows without position, or at 0, 0, go."""
    raw = spark.read.option("header", True).csv(path)

    def find(*words: str) -> Column:
        for c in raw.columns:
            if any(w in c.lower() for w in words):
                return F.col(f"`{c}`")
        return F.lit(None).cast("string")

    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]
    when = find("datetime", "time(utc)", "timestamp")
    out = raw.select(_file(), find("latitude", "lat").try_cast("double").alias("lat"), find("longitude", "lon").try_cast("double").alias("lon"), F.coalesce(*[F.try_to_timestamp(when, F.lit(f)) for f in formats]).alias("ts"), find("isvideo", "isphoto", "flag").alias("flag"))
    return out.where("lat is not null and lon is not null and not (lat = 0 and lon = 0)")


def gps_bounds(log: DataFrame, *by: str) -> DataFrame:
    """Bounding box of a flight log's positions, or of each group's."""
    return log.groupBy(*by).agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


def subtitle_hours(spark: SparkSession, path: str) -> DataFrame:
    """Local hours of day found in subtitle files."""
    x = spark.read.text(path).select(_file(), F.regexp_extract("value", r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1).alias("t")).where("t <> ''")
    ts = F.to_timestamp("t", "yyyy-MM-dd HH:mm:ss")
    return x.select("file", (F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0).alias("hour"))


def required_tiles(lx: Column, ly: Column, hx: Column, hy: Column, size: int = 50_000) -> Column:
    """Names of the terrain tiles that a box touches, as N<row>E<col> in kilometres."""
    start = lambda v: (F.floor(v / size) * size).cast("long")
    rows, cols = F.sequence(start(ly), start(hy), F.lit(size).cast("long")), F.sequence(start(lx), start(hx), F.lit(size).cast("long"))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.format_string("N%dE%d", (r / 1000).cast("long"), (c / 1000).cast("long")))))


def frame_images(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rendered frames (``{frame:08d}.tiff``) of a folder within a range: frame, path."""
    files = listed_files(spark, path, ("*.tif*",))
    return files.select(F.regexp_extract("path", r"(\d+)\.tiff?$", 1).try_cast("long").alias("frame"), "path").where(F.col("frame").between(first, last))


def vectors_npz(spark: SparkSession, path: str) -> DataFrame:
    """Embedding vectors of npz files (arrays ``det_<id>``): detection_id, embedding."""
    import io

    import numpy as np
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select("content")

    def read(batches):
        for b in batches:
            for content in b["content"]:
                with np.load(io.BytesIO(content)) as z:
                    names = [n for n in z.files if n.startswith("det_")]
                    yield pd.DataFrame({"detection_id": [int(n[4:]) for n in names], "embedding": [z[n].astype("float32").ravel() for n in names]})

    return files.mapInPandas(read, "detection_id long, embedding array<float>")


def tracklets_npz(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of tracklet files: least and greatest finite pose point of each frame."""
    import io

    import numpy as np
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches):
        for b in batches:
            for name, content in b[["path", "content"]].itertuples(index=False):
                with np.load(io.BytesIO(content)) as z:
                    xs = np.stack([z[n] for n in sorted(z.files) if n.startswith("poseX")])
                    ys = np.stack([z[n] for n in sorted(z.files) if n.startswith("poseY")])
                    xs, ys = np.where(np.isfinite(xs), xs, np.nan), np.where(np.isfinite(ys), ys, np.nan)
                    ok = ~np.isnan(xs).all(axis=0) & ~np.isnan(ys).all(axis=0)
                    f = np.asarray(z["frame"], "int64")[ok]
                    yield pd.DataFrame({"file": name, "frame": f, "x1": np.nanmin(xs[:, ok], 0), "y1": np.nanmin(ys[:, ok], 0), "x2": np.nanmax(xs[:, ok], 0), "y2": np.nanmax(ys[:, ok], 0)})

    return files.mapInPandas(read, "file string, frame long, x1 double, y1 double, x2 double, y2 double")


def transects_json(spark: SparkSession, path: str) -> DataFrame:
    """Transects of a project's file: transect_id, name, first_frame, last_frame."""
    schema = "transects array<struct<id:long,name:string,start_frame:long,end_frame:long>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path).select(_file(), F.explode("transects").alias("t"))
    return x.select("file", F.col("t.id").alias("transect_id"), "t.name", F.col("t.start_frame").alias("first_frame"), F.col("t.end_frame").alias("last_frame"))
