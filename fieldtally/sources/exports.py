"""Exchange formats: each is a query that gives rows ready to be written, and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..schema import NOT_AN_ANIMAL


#: Formats that drop false positives by default; biodiversity occurrences always do, surveys keep them.
TRAINING = ("coco", "yolo", "mot")


def rows_for(fmt: str, rows: DataFrame, drop: bool | None = None) -> DataFrame:
    """Rows that a format publishes."""
    drop = True if fmt == "dwca" else (fmt in TRAINING if drop is None else drop)
    return rows.where(F.col("species_id") != NOT_AN_ANIMAL) if drop else rows


def coco(rows: DataFrame, classes: DataFrame, width: int, height: int) -> dict[str, DataFrame]:
    """images, annotations and categories as JSON lines."""
    r = rows.join(F.broadcast(classes.select("species_id", "class_index")), "species_id")
    name = F.format_string("frame_%06d.jpg", "frame")
    images = rows.select("frame").distinct().select(F.to_json(F.struct(F.col("frame").alias("id"), name.alias("file_name"), F.lit(width).alias("width"), F.lit(height).alias("height"))).alias("value"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    box = F.array("x1", "y1", w, h)
    annotations = r.select(F.to_json(F.struct(F.col("detection_id").alias("id"), F.col("frame").alias("image_id"), F.col("class_index").alias("category_id"), box.alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"), F.col("confidence").alias("score"), F.col("track_id"))).alias("value"))
    categories = classes.select(F.to_json(F.struct(F.col("class_index").alias("id"), "name")).alias("value"))
    return {"images": images, "annotations": annotations, "categories": categories}


def yolo(rows: DataFrame, classes: DataFrame, width: float, height: float) -> DataFrame:
    """One text for each frame: lines of class and unit box."""
    r = rows.join(F.broadcast(classes.select("species_id", "class_index")), "species_id")
    u = geometry.unit_box([F.col(c) for c in ("x1", "y1", "x2", "y2")], width, height)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_index", *[F.bround(u[c], 6) for c in ("cx", "cy", "w", "h")])
    one = r.select("frame", F.struct("detection_id", line.alias("line")).alias("l"))
    return one.groupBy("frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("value"))


def mot(rows: DataFrame) -> DataFrame:
    """Tracked rows as MOT lines with 1-based frames."""
    t = rows.where("track_id is not null")
    two = lambda c: F.bround(c, 2)
    line = F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,%.4f,-1,-1,-1", F.col("frame") + 1, "track_id", two(F.col("x1")), two(F.col("y1")), two(F.col("x2") - F.col("x1")), two(F.col("y2") - F.col("y1")), F.bround("confidence", 4))
    return t.select("frame", "track_id", "detection_id", line.alias("value"))


def attribute_columns(rows: DataFrame) -> DataFrame:
    """Names of all attribute keys, sorted, as one array."""
    m = F.from_json("attributes", "map<string,string>")
    return rows.select(F.explode(F.map_keys(m)).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("keys"))


def points_geojson(rows: DataFrame) -> DataFrame:
    """A GeoJSON point feature for each positioned row."""
    x, y = (F.col("gx1") + F.col("gx2")) / 2, (F.col("gy1") + F.col("gy2")) / 2
    geometry_ = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    properties = F.struct("detection_id", "frame", "species_id", "track_id", "confidence")
    return rows.where("gx1 is not null").select("detection_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry_.alias("geometry"), properties.alias("properties"))).alias("value"))


def lines_geojson(rows: DataFrame) -> DataFrame:
    """A LineString feature for each track of two positions or more."""
    x, y = (F.col("gx1") + F.col("gx2")) / 2, (F.col("gy1") + F.col("gy2")) / 2
    t = rows.where("gx1 is not null and track_id is not null").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("frame", "detection_id", x.alias("x"), y.alias("y"), "species_id"))).alias("p"))
    c = F.transform("p", lambda p: F.array(p["x"], p["y"]))
    geometry_ = F.struct(F.lit("LineString").alias("type"), c.alias("coordinates"))
    return t.where(F.size("p") >= 2).select("track_id", F.size("p").cast("long").alias("points"), F.to_json(F.struct(F.lit("Feature").alias("type"), geometry_.alias("geometry"), F.struct("track_id", F.get("p", F.lit(0))["species_id"].alias("species_id")).alias("properties"))).alias("value"))


def polygons_geojson(segments: DataFrame) -> DataFrame:
    """A Polygon feature for each segment (segment_id, ring) with a usable ring."""
    ring = text.closed_ring(F.col("ring"))
    c = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return segments.where(ring.isNotNull()).select("segment_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), c.alias("coordinates")).alias("geometry"))).alias("value"))


def track_arrays(rows: DataFrame) -> DataFrame:
    """One row a track with arrays of frames, centres and confidences, for array files."""
    t = rows.where("track_id is not null").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("frame", "detection_id", ((F.col("x1") + F.col("x2")) / 2).alias("X"), ((F.col("y1") + F.col("y2")) / 2).alias("Y"), "confidence"))).alias("p"))
    return t.select("track_id", F.col("p.frame").alias("frame"), F.col("p.X").alias("X"), F.col("p.Y").alias("Y"), F.col("p.confidence").alias("conf"))


def camtrap(rows: DataFrame, species: DataFrame, deployment: str) -> dict[str, DataFrame]:
    """deployments, media and observations of a camera-trap package; false positives are blanks."""
    dep = rows.agg(F.lit(deployment).alias("deploymentID"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    name = F.format_string("frame_%06d.jpg", "frame")
    media = rows.select(name.alias("mediaID"), F.lit(deployment).alias("deploymentID"), "frame").distinct()
    kind = F.when(F.col("species_id") == NOT_AN_ANIMAL, "blank").when(F.col("species_id") == -1, "unknown").otherwise("animal")
    obs = rows.join(F.broadcast(species.select("species_id", F.col("name").alias("vernacular"))), "species_id", "left")
    obs = obs.select(F.concat(F.lit(f"{deployment}:"), F.col("detection_id").cast("string")).alias("observationID"), name.alias("mediaID"), kind.alias("observationType"), F.when(F.col("species_id") > 0, F.col("vernacular")).alias("vernacularName"), "confidence")
    return {"deployments": dep, "media": media, "observations": obs}


def occurrences(rows: DataFrame, species: DataFrame) -> DataFrame:
    """One occurrence a track at its first positioned frame; only species with a scientific name are published.

    species: species_id, name, scientific_name. ``published`` is false for what is held back.
    """
    p = F.struct("gx1", "gy1", "species_id")
    t = rows.where("gx1 is not null and track_id is not null").groupBy("track_id").agg(F.min_by(p, F.struct("frame", "detection_id")).alias("f"), F.min("frame").alias("first_frame"), F.count(F.lit(1)).alias("individual_frames"))
    t = t.select("track_id", "f.*", "first_frame", "individual_frames").join(F.broadcast(species), "species_id", "left")
    ok = (F.col("species_id") > 0) & (F.coalesce("scientific_name", F.lit("")) != "")
    return t.withColumn("published", ok).withColumn("occurrenceID", F.concat(F.lit("track:"), F.col("track_id").cast("string")))


def two_digits(c: Column) -> Column:
    """A number as text with two digits, ties to even. Those of common size that are not near a tie go by whole hundredths."""
    hundred = c * 100
    cents = F.rint(hundred).cast("long")
    plain = c.between(0.0, 1e7) & (F.abs(hundred - F.floor(hundred) - 0.5) > 1e-4)
    fast = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(plain, fast).otherwise(F.format_string("%.2f", F.bround(c, 2)))


def labels_csv(boxes: DataFrame) -> DataFrame:
    """Interpolated label boxes as CSV lines.

    A line is put together at once, from pieces out of two tables (whole pixels up to 999, hundredths with their comma), so
    that a box costs no texts of its own; a line with a number that ``two_digits`` would not write by hundredths is formatted.
    """
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    table = lambda texts: F.split(F.lit(" ".join(texts)), " ")
    pixels, rest = table(str(k) for k in range(1000)), table(f".{k:02d}," for k in range(100))

    def pieces(c: Column) -> list[Column]:
        cents = F.rint(c * 100).cast("int")
        whole = F.call_function("div", cents, F.lit(100))
        return [F.coalesce(F.get(pixels, whole), whole.cast("string")), F.get(rest, cents % 100)]

    plain = F.col("label_track_id").isNotNull() & F.col("frame").isNotNull() & F.col("is_key").isNotNull()
    for c in box:
        plain = plain & c.between(0.0, 1e7) & (F.abs(c * 100 - F.rint(c * 100)) < 0.4999)
    head = [F.col("label_track_id").cast("string"), F.lit(","), F.col("frame").cast("string"), F.lit(",")]
    fast = F.concat(*head, *[p for c in box for p in pieces(c)], F.when(F.col("is_key"), "1").otherwise("0"))
    other = F.concat_ws(",", "label_track_id", "frame", F.format_string("%.2f,%.2f,%.2f,%.2f", *[F.bround(c, 2) for c in box]), F.col("is_key").cast("int"))
    return boxes.select("label_track_id", "frame", F.when(plain, fast).otherwise(other).alias("value"))


def route_line(poses: DataFrame, *by: str) -> DataFrame:
    """Each flight's route as one LineString feature of the positions there are, in frame order."""
    p = poses.where("x is not null and y is not null and not (x = 0 and y = 0)").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))).alias("p"))
    c = F.transform("p", lambda q: F.array(q["x"], q["y"]))
    return p.select(*by, F.size("p").cast("long").alias("points"), F.to_json(F.struct(F.lit("LineString").alias("type"), c.alias("coordinates"))).alias("value"))


def split_plan(features: DataFrame, by: str, order: str) -> DataFrame:
    """Features (name) of a flight plan as ``kind`` route or transect; transects are numbered from 1 in order."""
    route = F.lower("name").startswith("total")
    number = F.row_number().over(Window.partitionBy(by, route).orderBy(order))
    return features.withColumn("kind", F.when(route, "route").otherwise("transect")).withColumn("number", F.when(route, 0).otherwise(number).cast("long"))


def route_kml(points: DataFrame, *by: str) -> DataFrame:
    """KML text of each ordered route (seq, lon, lat)."""
    p = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("p"))
    c = F.array_join(F.transform("p", lambda q: F.concat_ws(",", q["lon"].cast("string"), q["lat"].cast("string"), F.lit("0"))), " ")
    return p.select(*by, F.size("p").cast("long").alias("points"), F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><LineString><coordinates>'), c, F.lit("</coordinates></LineString></Placemark></kml>")).alias("value"))


def world_lines(pixel: Column, left: Column, top: Column) -> Column:
    """The six lines that place a north-up raster, as an array."""
    return F.transform(F.array(pixel, F.lit(0.0), F.lit(0.0), -pixel, left + pixel / 2, top - pixel / 2), lambda v: F.format_string("%.10f", v))


def world_file(pixel: float, left: float, top: float) -> str:
    """The six lines that place a north-up raster."""
    return "\n".join(f"{v:.10f}" for v in (pixel, 0.0, 0.0, -pixel, left + pixel / 2, top - pixel / 2))


#: Format name to its query; the dispatcher of ``export``.
FORMATS = {"coco": coco, "yolo": yolo, "mot": mot, "geojson_points": points_geojson, "geojson_tracks": lines_geojson, "geojson_segments": polygons_geojson, "arrays": track_arrays, "camtrap": camtrap, "dwca": occurrences}


def export(fmt: str, rows: DataFrame, path: str, *more, drop: bool | None = None) -> list[str]:
    """Write a format below ``path``; returns the folders written."""
    made = FORMATS[fmt](rows_for(fmt, rows, drop), *more)
    parts = made if isinstance(made, dict) else {fmt: made}
    for name, df in parts.items():
        if df.columns == ["value"] or "value" in df.columns:
            df.select("value").write.mode("overwrite").text(f"{path}/{name}")
        elif any(t.startswith("array") for _, t in df.dtypes):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return [f"{path}/{name}" for name in parts]
