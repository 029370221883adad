"""Joins in time and space, and joins by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, time: str, tolerance: int, by: list[str] | None = None) -> DataFrame:
    """Each left row with the right row nearest in time, within ``tolerance`` (included); a tie goes to the earlier one.

    left: id, time, by; right: id, time, by -> by, left_id, right_id, gap. One sort of both sides together and two
    ignore-null windows, so no pair is ever expanded. Of right rows of one time, the smallest id is meant. Without
    ``by`` all rows share one window: give one for large inputs.
    """
    by = by or []
    a = left.select(*by, F.col(time).alias("t"), F.col("id").alias("left_id"), F.lit(None).cast("long").alias("right_id"))
    r = right.groupBy(*by, time).agg(F.min("id").alias("right_id"))
    b = r.select(*by, F.col(time).alias("t"), F.lit(None).cast("long").alias("left_id"), "right_id")
    both = a.unionByName(b)
    hit = F.when(F.col("right_id").isNotNull(), F.struct("t", "right_id"))
    before = Window.partitionBy(*by).orderBy("t", F.col("left_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy("t", F.col("left_id").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumn("p", F.last(hit, True).over(before)).withColumn("n", F.first(hit, True).over(after)).where("left_id is not null")
    gp, gn = F.col("t") - F.col("p.t"), F.col("n.t") - F.col("t")
    first = F.coalesce(gp <= gn, gp.isNotNull())
    near = near.select(*by, "left_id", F.when(first, F.col("p.right_id")).otherwise(F.col("n.right_id")).alias("right_id"), F.when(first, gp).otherwise(gn).alias("gap"))
    return near.where(F.col("gap") <= tolerance)


def first_range(rows: DataFrame, ranges: DataFrame, frame: str = "frame", by: str | None = None) -> DataFrame:
    """Each row with the first listed range (start_frame, end_frame, pos) that holds its frame: column ``range`` or null.

    With ``by``, rows meet the ranges of their own flight (or whatever it names) by an equi-join, as one array a flight.
    Without, ``ranges`` are a project's handful and come as one array of the row's plan. Rows are never multiplied.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", *[c for c in ranges.columns if c not in ("pos", by)]))).alias("_ranges")
    if by is None:
        rows = rows.withColumn("_ranges", ranges.agg(listed).scalar())
    else:
        rows = rows.join(ranges.groupBy(by).agg(listed), by, "left")
    fit = F.filter("_ranges", lambda r: F.col(frame).between(r["start_frame"], r["end_frame"]))
    return rows.withColumn("range", F.get(fit, F.lit(0))).drop("_ranges")


def positional(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of a group zipped by position, only where both sides have as many: (group, left_*, right_*)."""

    def numbered(df: DataFrame, order: str, side: str) -> DataFrame:
        w = Window.partitionBy(group)
        out = df.withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn("_all", F.count(F.lit(1)).over(w))
        return out.select(group, "_n", "_all", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != group])

    return numbered(left, left_order, "left").join(numbered(right, right_order, "right"), [group, "_n", "_all"]).drop("_n", "_all")


def by_rounded_box(left: DataFrame, right: DataFrame, digits: int = 3) -> DataFrame:
    """Each left row linked to the first (least id) right row of equal frame and rounded box: (left_id, right_id)."""
    box = ["x1", "y1", "x2", "y2"]
    key = [F.round(c, digits).alias(f"_{c}") for c in box]
    r = right.select("frame", *key, "id").groupBy("frame", *[f"_{c}" for c in box]).agg(F.min("id").alias("right_id"))
    return left.select("frame", *key, F.col("id").alias("left_id")).join(r, ["frame", *[f"_{c}" for c in box]]).select("left_id", "right_id")


def foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, clamp: bool = True) -> Column:
    """Struct (d, t, fx, fy): distance to a segment's (or line's) nearest point, and that point."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(((px - ax) * dx + (py - ay) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length))
    if clamp:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    fx, fy = ax + t * dx, ay + t * dy
    return F.struct(F.sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy)).alias("d"), t.alias("t"), fx.alias("fx"), fy.alias("fy"))


def along_cells(segments: DataFrame, reach: float, cell: float) -> DataFrame:
    """``segments`` (ax, ay, bx, by_) entered into the grid cells (cx, cy) that their way, grown by ``reach``, passes.

    Column by column: within a column of cells a segment has a piece of its own, and only that piece's rows of cells are
    entered. So a diagonal has as many entries as its length asks for, and not those of its box.
    """
    span = lambda low, high: F.sequence(F.floor(low / cell), F.floor(high / cell))
    s = segments.withColumn("cx", F.explode(span(F.least("ax", "bx") - reach, F.greatest("ax", "bx") + reach)))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    share = lambda x: F.when(dx == 0, None).otherwise((x - F.col("ax")) / F.when(dx != 0, dx))
    in_, out = share(F.col("cx") * cell - reach), share((F.col("cx") + 1) * cell + reach)
    cut = lambda t, whole: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(whole))
    start, end = F.when(dx == 0, 0.0).otherwise(cut(F.least(in_, out), 0.0)), F.when(dx == 0, 1.0).otherwise(cut(F.greatest(in_, out), 1.0))
    y0, y1 = F.col("ay") + start * dy, F.col("ay") + end * dy
    return s.withColumn("cy", F.explode(span(F.least(y0, y1) - reach, F.greatest(y0, y1) + reach)))


def nearest_segment(points: DataFrame, segments: DataFrame, reach: float, cell: float | None = None) -> DataFrame:
    """Each point (id, x, y) with the nearest segment (seg_id, ax, ay, bx, by_) within ``reach``; a tie goes to the lowest seg_id.

    Segments are entered into the cells along their way, points are looked up in their own cell. So points meet the few
    segments near them only, and both sides are dealt by cell; a hot cell's points are split by the join. Points of one
    place are looked up once, and of segments that are equal, the lowest seg_id is entered alone. An id names a point.
    """
    cell = cell or reach
    ends = ["ax", "ay", "bx", "by_"]
    s = along_cells(segments.groupBy(*ends).agg(F.min("seg_id").alias("seg_id")), reach, cell).hint("merge")
    places = points.select("x", "y").distinct().withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    f = foot(F.col("x"), F.col("y"), *[F.col(c) for c in ends])
    near = places.join(s, ["cx", "cy"]).withColumn("f", f).where(F.col("f.d") <= reach)
    best = near.groupBy("cx", "cy", "x", "y").agg(F.min(F.struct(F.col("f.d").alias("d"), "seg_id", F.col("f.t").alias("t"), F.col("f.fx").alias("fx"), F.col("f.fy").alias("fy"))).alias("b"))
    found = points.select("id", "x", "y").join(best.select("x", "y", "b").hint("merge"), ["x", "y"])
    return found.select("id", "b.seg_id", F.col("b.d").alias("distance"), F.col("b.fx").alias("foot_x"), F.col("b.fy").alias("foot_y"), F.col("b.t").alias("t"))


def assign_transects(tracks: DataFrame, centre_lines: DataFrame, areas: DataFrame, truncation: float | None, cell: float = 100.0) -> DataFrame:
    """Tracks (id, x, y) to the nearest centre line (transect_id, ax, ay, bx, by_) among the transects whose area holds them.

    areas: transect_id and an axis-parallel box lx, ly, hx, hy (bounds included). Returns id, transect_id, distance,
    outside (in no area) and truncated (nearest, but too far: transect_id is null). Lowest transect_id on a tie. Areas are
    entered into the grid cells that they touch, tracks are looked up in their own.
    """
    span = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
    a = areas.where("lx <= hx and ly <= hy").join(centre_lines, "transect_id").withColumn("cx", F.explode(span("lx", "hx"))).withColumn("cy", F.explode(span("ly", "hy")))
    own = tracks.select("id", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    held = own.join(a, ["cx", "cy"]).where("x between lx and hx and y between ly and hy")
    f = foot(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"))
    best = held.groupBy("id").agg(F.min(F.struct(f["d"].alias("d"), "transect_id")).alias("b"))
    far = F.col("b.d") > truncation if truncation is not None else F.lit(False)
    return tracks.select("id").join(best, "id", "left").select(
        "id", F.when(~far, F.col("b.transect_id")).alias("transect_id"), F.col("b.d").alias("distance"),
        F.col("b").isNull().alias("outside"), F.coalesce(far, F.lit(False)).alias("truncated"),
    )


def near_tracks(points: DataFrame, distance: float, gap: int) -> DataFrame:
    """Pairs of tracks that come within ``distance`` of each other, at frames at most ``gap`` apart: a, b, nearest.

    points: track_id, frame, x, y. Equi-join on cells of space and time instead of all pairs: a point meets those of its
    own cell and of that half of the cells around it which comes later, so each pair of cells is met once.
    """
    gap = max(gap, 1)
    own = points.withColumn("cx", F.floor(F.col("x") / distance)).withColumn("cy", F.floor(F.col("y") / distance)).withColumn("ct", F.floor(F.col("frame") / gap))
    ways = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in ways])
    moved = own.withColumn("_w", F.explode(around))
    p = own.select("cx", "cy", "ct", F.col("track_id").alias("p"), F.col("frame").alias("fp"), F.col("x").alias("xp"), F.col("y").alias("yp"))
    q = moved.select(
        *[(F.col(c) + F.col(f"_w.{w}")).alias(c) for c, w in zip(("cx", "cy", "ct"), "ijk")], F.col("track_id").alias("q"), F.col("frame").alias("fq"),
        F.col("x").alias("xq"), F.col("y").alias("yq"), ((F.col("_w.i") == 0) & (F.col("_w.j") == 0) & (F.col("_w.k") == 0)).alias("own"),
    )
    d = F.sqrt((F.col("xp") - F.col("xq")) ** 2 + (F.col("yp") - F.col("yq")) ** 2)
    once = F.when(F.col("own"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q"))
    both = p.join(q.hint("merge"), ["cx", "cy", "ct"]).where(once & (F.abs(F.col("fp") - F.col("fq")) <= gap)).withColumn("d", d)
    both = both.where(F.col("d") <= distance).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "d")
    return both.groupBy("a", "b").agg(F.min("d").alias("nearest"))


def same_box(viewer: DataFrame, stored: DataFrame, within: float = 0.0015) -> DataFrame:
    """Viewer boxes to the first stored detection of equal frame and class and nearly equal confidence: (id, detection_id)."""
    both = viewer.alias("v").join(stored.alias("s"), ["frame", "source_class"]).where(F.abs(F.col("v.confidence") - F.col("s.confidence")) < within)
    return both.groupBy("v.id").agg(F.min("s.detection_id").alias("detection_id"))


def fill_only(source: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """Target rows (id, species_id, sex, age, manual) filled from their partner where they have nothing yet.

    pairs: source_id, target_id. Species is filled where it is 0, sex and age where null; manual rows never change.
    """
    s = pairs.join(source.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"s_{c}") for c in ("species_id", "sex", "age")]), "source_id")
    s = s.select(F.col("target_id").alias("id"), "s_species_id", "s_sex", "s_age")
    t = target.join(s, "id", "left")
    may = ~F.col("manual")
    species = F.when(may & (F.col("species_id") == 0) & F.col("s_species_id").isNotNull(), F.col("s_species_id")).otherwise(F.col("species_id"))
    fill = lambda c: F.when(may, F.coalesce(F.col(c), F.col(f"s_{c}"))).otherwise(F.col(c)).alias(c)
    return t.select("id", species.alias("species_id"), fill("sex"), fill("age"), "manual")


def sync_report(source: DataFrame, target: DataFrame, pairs: DataFrame, source_modality: str, target_modality: str) -> DataFrame:
    """What ``fill_only`` fills: rows, species and sexes. Refused where both sides are of one camera."""
    if source_modality == target_modality:
        raise ValueError("a sync needs two cameras")
    old = target.select("id", F.col("species_id").alias("_s"), F.col("sex").alias("_x"))
    both = fill_only(source, target, pairs).join(old, "id")
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return both.agg(F.lit(target_modality).alias("modality"), F.count(F.lit(1)).alias("n"), one(F.col("species_id") != F.col("_s")).alias("species_filled"), one(F.col("_x").isNull() & F.col("sex").isNotNull()).alias("sex_filled"))


def frame_pairs(thermal: DataFrame, colour: DataFrame, frames: DataFrame) -> DataFrame:
    """All boxes of two cameras on mapped frames: frame_t, id_t, id_w and the distance of their centres."""
    t = thermal.select(F.col("frame").alias("frame_t"), F.col("id").alias("id_t"), F.col("x").alias("xt"), F.col("y").alias("yt"))
    w = colour.select(F.col("frame").alias("frame_w"), F.col("id").alias("id_w"), F.col("x").alias("xw"), F.col("y").alias("yw"))
    both = frames.join(t, "frame_t").join(w, "frame_w")
    d = F.sqrt((F.col("xt") - F.col("xw")) ** 2 + (F.col("yt") - F.col("yw")) ** 2)
    return both.select("frame_t", "id_t", "id_w", d.alias("distance"))


def by_name(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Wanted names with their id in a project, matched by name alone: name, species_id (null: missing there)."""
    return names.join(F.broadcast(vocabulary.select("name", "species_id")), "name", "left")
