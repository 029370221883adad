"""Operators along tracks: gaps, key frames, paths, votes, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import spread

BOX = ("x1", "y1", "x2", "y2")


def _between(a: Column, b: Column, f: Column, fa: Column, fb: Column) -> Column:
    return a + (b - a) * (f - fa) / (fb - fa)


def dealt(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Rows dealt by track to a fixed number of tasks: few bytes become many rows, so their size must not decide how many tasks there are.

    What is grouped or put in order by track after this needs no other shuffle.
    """
    return rows.repartition(spread(rows.sparkSession), *by)


def fill_gaps(points: DataFrame, keys: list[str], class_from: str = "previous", deal: bool = True) -> DataFrame:
    """Rows for the frames missing inside each track: linear boxes, mean confidence, class of one neighbour.

    points: keys, frame, x1..y2, confidence, cls. Returns all rows with ``interpolated``; filled rows carry no id.
    Without ``deal``, the points come from rows that were ``dealt`` by the keys.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    cols = ["frame", *BOX, "confidence", "cls"]
    # a row and those that follow it up to the next one come from one pass
    nxt = (dealt(points, *keys) if deal else points).withColumn("n", F.lead(F.struct(*cols)).over(w))
    each = nxt.withColumn("f", F.explode(F.sequence(F.col("frame"), F.greatest(F.col("frame"), F.coalesce(F.col("n.frame") - 1, F.col("frame"))))))
    made = F.col("f") > F.col("frame")
    pick = lambda new, old: F.when(made, new).otherwise(old)
    return each.select(
        *keys, F.col("f").alias("frame"), *[pick(_between(F.col(c), F.col(f"n.{c}"), F.col("f"), F.col("frame"), F.col("n.frame")), F.col(c)).alias(c) for c in BOX],
        pick((F.col("confidence") + F.col("n.confidence")) / 2, F.col("confidence")).alias("confidence"),
        (F.col("cls") if class_from == "previous" else pick(F.col("n.cls"), F.col("cls"))).alias("cls"), made.alias("interpolated"),
    )


def between_keyframes(keys: DataFrame, track: str = "label_track_id", deal: bool = True) -> DataFrame:
    """Boxes of every frame between key frames; none after a key frame that stops its track.

    Without ``deal``, the key frames come from rows that were ``dealt`` by the track.
    """
    w = Window.partitionBy(track).orderBy("frame")
    n = (dealt(keys, track) if deal else keys).withColumn("n", F.lead(F.struct("frame", *BOX)).over(w))
    last = F.when(F.col("stop") | F.col("n").isNull(), F.col("frame")).otherwise(F.col("n.frame") - 1)
    n = n.withColumn("f", F.explode(F.sequence("frame", last)))
    at = lambda c: F.when(F.col("f") == F.col("frame"), F.col(c)).otherwise(_between(F.col(c), F.col(f"n.{c}"), F.col("f"), F.col("frame"), F.col("n.frame")))
    return n.select(track, F.col("f").alias("frame"), *[at(c).alias(c) for c in BOX], (F.col("f") == F.col("frame")).alias("is_key"))


def segments_at_stops(keys: DataFrame, track: str = "label_track_id") -> DataFrame:
    """Visible segments of each track: split behind every stop. (track, segment, first_frame, last_frame, keys)."""
    w = Window.partitionBy(track).orderBy("frame")
    cut = F.sum(F.coalesce(F.lag(F.col("stop").cast("int")).over(w), F.lit(0))).over(w)
    return keys.withColumn("segment", cut).groupBy(track, "segment").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("keys"))


def nearest_fill(frames: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Wanted frames with the last box before and the first after: interpolated, or one side copied."""
    both = frames.select(*by, "frame").distinct().join(boxes.select(*by, "frame", F.struct("frame", *BOX).alias("b")), [*by, "frame"], "full_outer")
    w = Window.partitionBy(*by).orderBy("frame")
    p = F.last("b", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.first("b", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    f = both.withColumn("p", p).withColumn("n", n).join(frames.select(*by, "frame").distinct(), [*by, "frame"], "left_semi")
    same = F.col("p.frame") == F.col("n.frame")
    at = lambda c: F.when(F.col("p").isNull(), F.col(f"n.{c}")).when(F.col("n").isNull() | same, F.col(f"p.{c}")).otherwise(_between(F.col(f"p.{c}"), F.col(f"n.{c}"), F.col("frame"), F.col("p.frame"), F.when(~same, F.col("n.frame"))))
    return f.select(*by, "frame", *[at(c).alias(c) for c in BOX])


def path_lengths(poses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``cum``: length of the path up to each frame. A missing position adds nothing and keeps the last one known."""
    w = Window.partitionBy(*(by or [])).orderBy("frame")
    last = F.last(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.sqrt((F.col("x") - F.col("last.x")) ** 2 + (F.col("y") - F.col("last.y")) ** 2)
    return poses.withColumn("last", last).withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("cum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("last", "step")


def path_between(lengths: DataFrame, pairs: DataFrame, by: str) -> DataFrame:
    """Length of the path between two frames (by, a, b) of ``path_lengths``, in either order: ``length_m``."""
    at = lambda c: lengths.select(by, F.col("frame").alias(c), F.col("cum").alias(f"_{c}"))
    return pairs.join(at("a"), [by, "a"]).join(at("b"), [by, "b"]).select(by, "a", "b", F.abs(F.col("_a") - F.col("_b")).alias("length_m"))


def frame_reached(lengths: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """targets (by, start, target) with ``reached``: the first frame from start on at which the path is that long.

    Lengths never fall along a path, so that the next length in order belongs to the first such frame: a union and one
    window by path, no pair of rows.
    """
    both = lengths.select(by, F.col("cum").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("start"), "frame")
    both = both.unionByName(targets.select(by, F.col("target").alias("at"), F.lit(0).alias("kind"), "start", F.lit(None).cast("long").alias("frame")))
    w = Window.partitionBy(by).orderBy("at", "kind", "frame").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("reached", F.first("frame", True).over(w)).where("kind = 0").select(by, "start", F.col("at").alias("target"), "reached")


def cohort_ratio(areas: DataFrame, by: str) -> DataFrame:
    """Areas with their ratio to the median of their cohort."""
    middle = areas.groupBy(by).agg(F.expr("percentile(area, 0.5)").alias("_m"))
    return areas.join(middle, by).withColumn("ratio", F.try_divide(F.col("area"), F.col("_m"))).drop("_m")


def last_box(rows: DataFrame, track: str = "track_id") -> DataFrame:
    """The row of each track's last frame, the first one by detection_id."""
    others = [c for c in rows.columns if c != track]
    best = rows.groupBy(track).agg(F.max_by(F.struct(*others), F.struct("frame", -F.col("detection_id"))).alias("r"))
    return best.select(track, "r.*")


def running_index(rows: DataFrame, order: list[str], by: list[str], name: str = "idx") -> DataFrame:
    """0-based index of each row within ``by`` in an order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def quorum_vote(votes: DataFrame, quorum: float = 0.5, min_frames: int = 1) -> DataFrame:
    """The most frequent class of each track, if more than ``quorum`` of its votes agree; a tie goes to the lowest class."""
    n = votes.groupBy("track_id", "class_index").agg(F.count(F.lit(1)).alias("v"), F.min("label").alias("label"))
    top = n.groupBy("track_id").agg(F.max_by(F.struct("class_index", "label", "v"), F.struct("v", -F.col("class_index"))).alias("b"), F.sum("v").alias("frames"))
    share = F.col("b.v") / F.col("frames")
    return top.where((share > quorum) & (F.col("frames") >= min_frames)).select("track_id", "b.class_index", "b.label", "frames", share.alias("share"))


def median_areas(boxes: DataFrame, track: str = "track_id") -> DataFrame:
    """Median box area of each track; boxes without area don't count."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return boxes.withColumn("a", area).where("a > 0").groupBy(track).agg(F.expr("percentile(a, 0.5)").alias("area"), F.count(F.lit(1)).alias("frames"))


def halves(sorted_values: Column, upper: bool) -> Column:
    """Median of the lower or upper half of a sorted array; of an odd number, the middle one is in neither."""
    n = F.size(sorted_values)
    half = F.floor(n / 2).cast("int")
    part = F.slice(sorted_values, n - half + 1, half) if upper else F.slice(sorted_values, F.lit(1), half)
    m = F.size(part)
    return (F.get(part, F.floor((m - 1) / 2).cast("int")) + F.get(part, F.floor(m / 2).cast("int"))) / 2


def cohort_stats(areas: DataFrame, by: list[str]) -> DataFrame:
    """Median, MAD and quartile range of the track sizes of a cohort (a flight's animals)."""
    c = areas.groupBy(*by).agg(F.expr("percentile(area, 0.5)").alias("median"), F.array_sort(F.collect_list("area")).alias("v"), F.count(F.lit(1)).alias("n"))
    d = F.array_sort(F.transform("v", lambda a: F.abs(a - F.col("median"))))
    mid = lambda a: (F.get(a, F.floor((F.col("n") - 1) / 2).cast("int")) + F.get(a, F.floor(F.col("n") / 2).cast("int"))) / 2
    return c.select(*by, "n", "median", mid(d).alias("mad"), (halves(F.col("v"), True) - halves(F.col("v"), False)).alias("iqr"))


def life_stage(areas: DataFrame, by: list[str], z_limit: float = -2.0, gap_factor: float = 2.0, least: int = 4) -> DataFrame:
    """Juvenile or adult by size within a cohort: far below the median and well apart from the next larger one.

    Cohorts of fewer than ``least`` give no row. ``ratio`` is to the whole cohort's median; ``low_outlier`` is far
    below without the gap.
    """
    s = cohort_stats(areas, by).where(F.col("n") >= least)
    nxt = F.lead("area").over(Window.partitionBy(*by).orderBy("area", "track_id"))
    a = areas.withColumn("gap", nxt - F.col("area")).join(s, by)
    z = F.when(F.col("mad") > 0, 0.6745 * (F.col("area") - F.col("median")) / F.col("mad")).otherwise(F.lit(0.0))
    a = a.withColumn("z", z).withColumn("ratio", F.col("area") / F.col("median"))
    young = (F.col("z") < z_limit) & F.coalesce(F.col("gap") > gap_factor * F.col("iqr"), F.lit(False))
    return a.select(*by, "track_id", "area", "z", "gap", "ratio", F.when(young, "juvenile").otherwise("adult").alias("stage"), ((F.col("z") < z_limit) & ~young).alias("low_outlier"))


def merge_tracks(keys: DataFrame, merges: DataFrame) -> DataFrame:
    """Key frames after merges (track_id, into): the lowest source id wins a frame; the track stops where the source changes over a gap."""
    moved = keys.join(merges.withColumnRenamed("track_id", "label_track_id"), "label_track_id", "left").withColumn("origin", F.col("label_track_id")).withColumn("label_track_id", F.coalesce("into", "label_track_id"))
    one = moved.groupBy("label_track_id", "frame").agg(F.min_by(F.struct(*BOX, "stop", "origin"), "origin").alias("k")).select("label_track_id", "frame", "k.*")
    w = Window.partitionBy("label_track_id").orderBy("frame")
    cut = (F.lead("origin").over(w) != F.col("origin")) & (F.lead("frame").over(w) > F.col("frame") + 1)
    return one.withColumn("stop", F.col("stop") | F.coalesce(cut, F.lit(False)))


def split_track(keys: DataFrame, track: int, frame: int, new: int) -> DataFrame:
    """Key frames with one track cut at a frame: an interpolated box closes the old part and opens the new one."""
    own = keys.where(F.col("label_track_id") == track)
    cut = between_keyframes(own).where(F.col("frame") == frame)
    rest = keys.where(F.col("label_track_id") != track)
    before = own.where(F.col("frame") < frame).select("label_track_id", "frame", *BOX, "stop")
    after = own.where(F.col("frame") > frame).select(F.lit(new).cast("long").alias("label_track_id"), "frame", *BOX, "stop")
    close = cut.select("label_track_id", "frame", *BOX, F.lit(True).alias("stop"))
    start = cut.select(F.lit(new).cast("long").alias("label_track_id"), "frame", *BOX, F.lit(False).alias("stop"))
    out = rest.select("label_track_id", "frame", *BOX, "stop")
    for part in (before, close, start, after):
        out = out.unionByName(part)
    return out


def scale_track(rows: DataFrame, dx: float, dy: float, factor: float, width: float, height: float) -> DataFrame:
    """Boxes moved and scaled about their centre, clamped to the image."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2 + dx, (F.col("y1") + F.col("y2")) / 2 + dy
    hw, hh = (F.col("x2") - F.col("x1")) / 2 * factor, (F.col("y2") - F.col("y1")) / 2 * factor
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), v))
    return rows.withColumns({"x1": clamp(cx - hw, width), "x2": clamp(cx + hw, width), "y1": clamp(cy - hh, height), "y2": clamp(cy + hh, height)})
