"""Label tracks: key frames, species names, the manual run that they are turned into, colours and short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Saturation and lightness of an id's colour.
SATURATION, LIGHTNESS = 0.65, 0.5


def class_numbers(names: DataFrame, listed: list[str]) -> DataFrame:
    """(name, class_id): listed names keep their place, all other names follow in code point order; null is ``unknown``."""
    clean = F.lower(F.trim(F.coalesce("name", F.lit("unknown"))))
    present = names.select(clean.alias("name")).distinct()
    known = F.create_map(*[F.lit(x) for i, n in enumerate(listed) for x in (n, i)])
    own = present.withColumn("place", F.try_element_at(known, F.col("name")))
    # the names of a vocabulary: tens of rows, so that one ordered pass is no burden
    custom = own.where("place is null").withColumn("place", F.row_number().over(Window.orderBy("name")) + len(listed) - 1)
    return own.where("place is not null").unionByName(custom).select("name", F.col("place").cast("long").alias("class_id"))


def nested_keys(keys: DataFrame, track: str = "label_track_id") -> DataFrame:
    """One row a track with its key frames as an ordered array of structs."""
    return keys.groupBy(track).agg(F.array_sort(F.collect_list(F.struct("frame", "x1", "y1", "x2", "y2", "stop"))).alias("keys"))


def set_keys(keys: DataFrame, edits: DataFrame, track: str = "label_track_id") -> DataFrame:
    """Key frames set to new boxes (track, frame, x1..y2).

    A key frame that is there keeps its stop flag and occlusion; a new one takes the occlusion in force at its frame (of
    the last key frame before it) and does not stop.
    """
    new = edits.select(track, "frame", F.struct("x1", "y1", "x2", "y2").alias("new"))
    both = keys.join(new, [track, "frame"], "full_outer")
    before = F.last("occlusion", True).over(Window.partitionBy(track).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("occlusion", F.coalesce("occlusion", before, F.lit("clear")))
    box = [F.coalesce(f"new.{c}", c).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return both.select(track, "frame", *box, "occlusion", F.coalesce("stop", F.lit(False)).alias("stop"))


def manual_members(keys: DataFrame, detections: DataFrame, track: str = "label_track_id") -> DataFrame:
    """Members of the one manual run: detections on a key frame with its very box; track_id is the label's."""
    box = ["frame", "x1", "y1", "x2", "y2"]
    return keys.select(track, *box).join(detections.select("detection_id", *box), box).select(F.col(track).alias("track_id"), "detection_id").distinct()


def stored_rows(tracks: DataFrame, species: DataFrame) -> DataFrame:
    """Label tracks (label_track_id, species name) with the species_id of that name, whatever its case; 0 without one."""
    known = species.select(F.lower(F.trim("name")).alias("_n"), F.col("species_id").alias("_s"))
    out = tracks.join(known, F.lower(F.trim(F.col("name"))) == F.col("_n"), "left")
    return out.select(*tracks.columns, F.coalesce("_s", F.lit(0).cast("long")).alias("species_id"))


def track_names(tracks: DataFrame, classified: DataFrame, species: DataFrame) -> DataFrame:
    """(track_id, name): a classifier's label first, else the name of the track's species."""
    out = tracks.join(classified.select("track_id", "label"), "track_id", "left").join(species.select("species_id", "name"), "species_id", "left")
    return out.select("track_id", F.coalesce("label", "name").alias("name"))


def colour(identifier: Column) -> Column:
    """Struct (r, g, b) of an id: hue from the first four bytes of its SHA-256, fixed saturation and lightness."""
    hue = F.conv(F.substring(F.sha2(F.encode(identifier.cast("string"), "utf-8"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    high = LIGHTNESS + SATURATION - LIGHTNESS * SATURATION
    low = 2 * LIGHTNESS - high

    def channel(h: Column) -> Column:
        t = h - F.floor(h)
        v = F.when(t < 1 / 6, low + (high - low) * 6 * t).when(t < 0.5, high).when(t < 2 / 3, low + (high - low) * 6 * (2 / 3 - t)).otherwise(low)
        return F.floor(v * 255).cast("long")

    return F.struct(channel(hue + 1 / 3).alias("r"), channel(hue).alias("g"), channel(hue - 1 / 3).alias("b"))


def inside_mask(boxes: DataFrame, valid: DataFrame, cell: float) -> DataFrame:
    """Ids of boxes all of whose cells are valid; ``valid``: cx, cy of the cells of a mask. Equi-join on cells."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    cells = boxes.select("id", F.explode(span("x1", "x2")).alias("cx"), "y1", "y2").select("id", "cx", F.explode(span("y1", "y2")).alias("cy"))
    hit = cells.join(valid.select("cx", "cy").distinct().withColumn("ok", F.lit(1)), ["cx", "cy"], "left")
    return hit.groupBy("id").agg(F.min(F.coalesce("ok", F.lit(0))).alias("ok")).where("ok = 1").select("id")


def camera(rotation: Column, location: Column, turn: Column, shift: Column) -> Column:
    """Struct (ex, ey, ez, x, y, z): Euler angles in radians, corrected and negated, and the shifted position.

    rotation: degrees; turn: radians; all are structs (x, y, z).
    """
    angle = lambda c: -(F.radians(F.pmod(rotation[c], F.lit(360.0))) - turn[c])
    return F.struct(*[angle(c).alias(f"e{c}") for c in "xyz"], *[(location[c] + shift[c]).alias(c) for c in "xyz"])


def tile_window(left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column, tx: Column, ty: Column, tw: Column, th: Column) -> Column:
    """Struct (x, y, w, h): centre and world size of a tile of a mosaic, from its place and size in pixels."""
    px, py = (right - left) / width, (top - bottom) / height
    return F.struct((left + (tx + tw / 2) * px).alias("x"), (top - (ty + th / 2) * py).alias("y"), (tw * px).alias("w"), (th * py).alias("h"))


def no_tracks_hint(runs: Column, members: Column) -> Column:
    """Why an export by tracks has no row: no run, or a run without these detections; null if it has some."""
    return F.when(runs == 0, "no tracking run is recorded for this modality").when(members == 0, "a tracking run exists but none of these detections belong to it")


def life_stage_line(verdicts: DataFrame, by: str) -> DataFrame:
    """One line a group on its juveniles. verdicts: by, track_id, z, juvenile, low_outlier."""
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.format_string("track %d (z=%.1f)", "track_id", "z")))), ", ")
    g = verdicts.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("juvenile").cast("long")).alias("j"), names("juvenile").alias("named"), names("low_outlier").alias("near"))
    text = F.when(F.col("j") > 0, F.format_string("%d juvenile(s) of %d individual(s): %s", "j", "n", "named")).when(
        F.col("near") != "", F.format_string("no juvenile called among %d individual(s), though %s is small", "n", "near")
    ).otherwise(F.format_string("no juvenile found among %d individual(s)", "n"))
    return g.select(by, text.alias("line"))


def upsert_state(states: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """Stage states with changes (keys, state) put in under the next generation of their key."""
    c = changes.select(*keys, F.col("state").alias("_state"))
    both = states.join(c, list(keys), "full_outer")
    moved = F.col("_state").isNotNull()
    return both.select(*keys, F.coalesce("_state", "state").alias("state"), (F.coalesce("generation", F.lit(0)) + moved.cast("long")).alias("generation"))


def usable_run(runs: DataFrame, settings: list[str]) -> DataFrame:
    """The latest run of each combination of settings, which a new embedding run with these settings would reuse."""
    return runs.groupBy(*settings).agg(F.max("run_id").alias("run_id"))


def encoded(value: Column, kind: Column) -> Column:
    """A setting as it is stored: booleans 1 and 0, whole numbers without a point, numbers, else the text."""
    return (
        F.when(kind == "bool01", F.when(value.try_cast("double") != 0, "1").otherwise("0"))
        .when(kind == "int_str", value.try_cast("double").cast("long").cast("string"))
        .when(kind == "double", value.try_cast("double").cast("string"))
        .otherwise(value)
    )
