"""Perpendicular distances, transect tables, life stages over flights, predictions onto fields, class votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from .joins import foot


def perpendicular(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """Distance of each point (id, x, y, cam_x, cam_y) to the route segment nearest to its camera.

    The camera picks the segment by its clamped foot, lowest seg_id on a tie; the point's distance is to that
    segment's line, unclamped. Cameras without a segment within ``reach`` give no row.
    """
    from .joins import nearest_segment

    cams = points.select("id", F.col("cam_x").alias("x"), F.col("cam_y").alias("y"))
    near = nearest_segment(cams, segments, reach).select("id", "seg_id")
    both = points.join(near, "id").join(segments, "seg_id")
    f = foot(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"), clamp=False)
    return both.withColumn("f", f).select("id", "seg_id", F.col("f.d").alias("distance_m"), F.col("f.t").alias("t"))


def visible_perpendicular(points: DataFrame, segments: DataFrame, cell: float = 50.0) -> DataFrame:
    """As ``perpendicular``, but over the segments that a point's footprint (ring) sees: an interior foot first, else any seen segment.

    points: id, x, y, ring. Footprints and segments are entered into the grid cells that their boxes touch and meet there.
    """
    span = lambda low, high: F.sequence(F.floor(low / cell), F.floor(high / cell))
    edge = lambda c, f: f(F.transform("ring", lambda p: p[c]))
    p = points.withColumn("cx", F.explode(span(edge("x", F.array_min), edge("x", F.array_max)))).withColumn("cy", F.explode(span(edge("y", F.array_min), edge("y", F.array_max))))
    s = segments.withColumn("cx", F.explode(span(F.least("ax", "bx"), F.greatest("ax", "bx")))).withColumn("cy", F.explode(span(F.least("ay", "by_"), F.greatest("ay", "by_"))))
    f = foot(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"), clamp=False)
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by_").alias("y"))
    near = p.join(s, ["cx", "cy"]).where(geometry.segment_touches(a, b, F.col("ring"))).withColumn("f", f)
    best = near.groupBy("id").agg(F.min(F.struct((~F.col("f.t").between(0, 1)).cast("int").alias("outside"), F.col("f.d").alias("d"), "seg_id")).alias("b"))
    return best.select("id", "b.seg_id", F.col("b.d").alias("distance_m"), (F.col("b.outside") == 0).alias("interior"))


def transect_table(transects: DataFrame, assigned: DataFrame, footprints: DataFrame) -> DataFrame:
    """Count of animals, frames and frames with a footprint of each transect, zeros included."""
    n = assigned.where("transect_id is not null").groupBy("transect_id").agg(F.count(F.lit(1)).alias("count"))
    f = footprints.groupBy("transect_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("seen").cast("long")).alias("frames_with_fov"))
    out = transects.select("transect_id").join(n, "transect_id", "left").join(f, "transect_id", "left")
    return out.select("transect_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("count", "frames", "frames_with_fov")])


def centre_lines(positions: DataFrame, transects: DataFrame, by: str, origin: float) -> DataFrame:
    """Points, first and last x of each transect's line: the positions (by, frame, x) in its frame range.

    A flight has few transects, so they are joined by flight and cut by range.
    """
    inside = transects.join(positions, by).where("frame between first_frame and last_frame")
    x = F.col("x") + origin
    return inside.groupBy(by, "transect_id").agg(F.count(F.lit(1)).alias("points"), F.min_by(x, "frame").alias("first_x"), F.max_by(x, "frame").alias("last_x"))


def voted(predictions: DataFrame, quorum: float = 0.5) -> DataFrame:
    """Class of each track by stages: species first, then sex and age among tracks of a voted species."""
    from .tracks import quorum_vote

    first = quorum_vote(predictions.where("task = 'species'"), quorum).select("track_id", F.lit("species").alias("task"), "label")
    rest = predictions.where("task <> 'species'").join(first.select("track_id"), "track_id", "left_semi")
    out = first
    for task in ("sex", "age"):
        out = out.unionByName(quorum_vote(rest.where(F.col("task") == task), quorum).select("track_id", F.lit(task).alias("task"), "label"))
    return out


def stage_verdicts(sized: DataFrame, selected: DataFrame, modelled: DataFrame, males: DataFrame) -> DataFrame:
    """Age of the selected tracks: a model's call wins over size, and males are adults.

    sized: track_id, stage; selected and males: track_id; modelled: track_id, age.
    """
    out = sized.join(selected.select("track_id"), "track_id", "left_semi").join(modelled, "track_id", "left")
    out = out.join(males.select("track_id", F.lit(True).alias("male")), "track_id", "left")
    age = F.when(F.col("age").isNotNull(), F.col("age")).when(F.col("male"), "adult").otherwise(F.col("stage"))
    return out.select("track_id", age.alias("age"), F.when(F.col("age").isNotNull(), "model").when(F.col("male"), "male").otherwise("size").alias("source"))


def apply_predictions(tracks: DataFrame, verdicts: DataFrame, overwrite: bool = False) -> DataFrame:
    """Track species from verdicts (track_id, species_id): where it is the fallback 0, or all with ``overwrite``; manual tracks never change."""
    t = tracks.join(verdicts.select("track_id", F.col("species_id").alias("_v")), "track_id", "left")
    may = ~F.col("manual") & F.col("_v").isNotNull() & (F.lit(overwrite) | (F.col("species_id") == 0))
    return t.withColumn("species_id", F.when(may, F.col("_v")).otherwise(F.col("species_id"))).drop("_v")


def best_model(fits: DataFrame, by: str) -> DataFrame:
    """The fit of least AIC of each stratum, the first listed on a tie."""
    return fits.groupBy(by).agg(F.min_by("model", F.struct("aic", "pos")).alias("model"))


def tone_curve(points: list[tuple[float, float]], value: Column) -> Column:
    """Monotone cubic through a few control points, clamped at both ends."""
    pts = sorted(points)
    n = len(pts)
    width = [pts[i + 1][0] - pts[i][0] for i in range(n - 1)]
    rise = [(pts[i + 1][1] - pts[i][1]) / width[i] for i in range(n - 1)]
    slope = [rise[0], *[0.0] * (n - 2), rise[-1]]
    for i in range(1, n - 1):
        if rise[i - 1] * rise[i] > 0:  # weighted harmonic mean of the neighbouring slopes
            near, far = 2 * width[i] + width[i - 1], width[i] + 2 * width[i - 1]
            slope[i] = (near + far) / (near / rise[i - 1] + far / rise[i])
    v = F.greatest(F.lit(float(pts[0][0])), F.least(F.lit(float(pts[-1][0])), value))
    out = F.lit(float(pts[-1][1]))
    for i in reversed(range(n - 1)):
        t = (v - pts[i][0]) / width[i]
        cubic = (
            pts[i][1] + width[i] * slope[i] * t
            + (3 * (pts[i + 1][1] - pts[i][1]) - width[i] * (2 * slope[i] + slope[i + 1])) * t * t
            + (2 * (pts[i][1] - pts[i + 1][1]) + width[i] * (slope[i] + slope[i + 1])) * t * t * t
        )
        out = F.when(v < pts[i + 1][0], cubic).otherwise(out)
    return out


def propagation_frames(source: Column, target: Column, step: int) -> Column:
    """Frames on the way from one frame to a later one, every ``step``, the target included."""
    on = F.when(source + step <= target, F.sequence(source + step, target, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.array_union(on, F.array(target))


def grid_points(lx: Column, ly: Column, hx: Column, hy: Column, spacing: float) -> Column:
    """Points of a planning grid over a box."""
    axis = lambda a, b: F.sequence(F.lit(0), F.floor((b - a) / spacing).cast("int"))
    return F.flatten(F.transform(axis(ly, hy), lambda r: F.transform(axis(lx, hx), lambda c: F.struct((lx + c * spacing).alias("x"), (ly + r * spacing).alias("y")))))


def key_window(keys: DataFrame, track: str, centre: int, reach: int) -> DataFrame:
    """Key frames to show of each track: the first, the last and those within ``reach`` places of the one nearest to ``centre``."""
    w = Window.partitionBy(track)
    k = keys.withColumn("i", F.row_number().over(w.orderBy("frame"))).withColumn("n", F.count(F.lit(1)).over(w))
    k = k.withColumn("c", F.min_by("i", F.struct(F.abs(F.col("frame") - centre), "frame")).over(w))
    return k.where((F.col("i") == 1) | (F.col("i") == F.col("n")) | (F.abs(F.col("i") - F.col("c")) <= reach)).select(track, "frame", "i", "n")
