"""Rays on a terrain grid: a pyramid of lowest and highest heights, and a descent of rays through its tiles.

The terrain is a grid of heights; two triangles span each cell. Tiles of 16 x 16 cells, then of 16 x 16 tiles, keep the lowest
and the highest height below them, level by level. A ray begins at the top and goes on to those tiles that lie along its way,
and there to the time in which its heights meet the tile's: an equi-join by tile for each level, so that what a ray flies
over or has passed beneath is skipped in large pieces. A tile of the lowest level brings the heights of its 256 cells as one
array, so that the cells along a ray's way need no join; each is met triangle by triangle, and the first meeting counts. The
number of joins grows with the logarithm of the terrain's width, and rows are dealt by ray and tile, never by ray and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .graphs import cut

#: Tiles of a level along one side of a tile of the next, as a power of two.
STEP = 4
#: Tiles of a level up to which its table is sent to all tasks.
SMALL = 4096
#: Tolerance inside of a cell, and of tiles, in cells.
INSIDE, BORDER = 1e-9, 1e-6


def cells(vertices: DataFrame) -> DataFrame:
    """(cx, cy, h00, h10, h01, h11, lo, hi) of all cells whose four corners (ix, iy, h) are there; of repeated corners the highest counts."""
    corner = F.array(*[F.struct((F.col("ix") - i).alias("cx"), (F.col("iy") - j).alias("cy"), F.lit(f"h{i}{j}").alias("c"), F.col("h").cast("double").alias("h")) for i in (0, 1) for j in (0, 1)])
    names = ["h00", "h10", "h01", "h11"]
    by = vertices.where("h is not null").select(F.inline(corner)).groupBy("cx", "cy").agg(*[F.max(F.when(F.col("c") == n, F.col("h"))).alias(n) for n in names])
    return by.dropna().withColumns({"lo": F.least(*names), "hi": F.greatest(*names)})


def _tiles(ground: DataFrame, level: int) -> DataFrame:
    """(tx, ty, lo, hi) of a level's tiles."""
    up = lambda c: F.shiftright(c, STEP * level)
    return ground.groupBy(up("cx").alias("tx"), up("cy").alias("ty")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _slab(o: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """From when to when a ray is between two values of one coordinate; from infinity on if never."""
    inf = float("inf")
    a, b = (lo - o) / F.when(d != 0, d), (hi - o) / F.when(d != 0, d)
    inside = o.between(lo, hi)
    return (
        F.when(d != 0, F.least(a, b)).when(inside, F.lit(-inf)).otherwise(F.lit(inf)),
        F.when(d != 0, F.greatest(a, b)).when(inside, F.lit(inf)).otherwise(F.lit(-inf)),
    )


def _along(here: DataFrame, axis: str, place: str, low: Column, high: Column, origin: float, size: float, border: float) -> DataFrame:
    """Rays, entered into those of the tiles low to high of one axis that they pass from a to b: column ``place``; a and b become that part."""
    o, d = F.col(f"o{axis}"), F.col(f"d{axis}")
    at = lambda t: F.when(d == 0, o).otherwise(o + F.col(t) * d)
    first = F.greatest(low, F.floor((F.least(at("a"), at("b")) - 2 * border - origin) / size))
    last = F.least(high, F.floor((F.greatest(at("a"), at("b")) + 2 * border - origin) / size))
    here = here.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn(place, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    return _during(here, *_slab(o, d, origin + F.col(place) * size - border, origin + (F.col(place) + 1) * size + border))


def _during(here: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rays with a and b narrowed to another time; without those for which nothing is left."""
    return here.withColumns({"a": F.greatest("a", a), "b": F.least("b", b)}).where("a <= b")


def _heights(ground: DataFrame) -> DataFrame:
    """(tx, ty, lo, hi, heights) of the tiles of the lowest level: four heights for each of their cells, null for a hole."""
    side = 1 << STEP
    within = F.col("cy").bitwiseAND(side - 1) * side + F.col("cx").bitwiseAND(side - 1)
    listed = F.map_from_entries(F.collect_list(F.struct(within.cast("int"), F.array("h00", "h10", "h01", "h11"))))
    by = ground.groupBy(F.shiftright("cx", STEP).alias("tx"), F.shiftright("cy", STEP).alias("ty")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), listed.alias("m"))
    hole = F.array_repeat(F.lit(None).cast("double"), 4)
    return by.select("tx", "ty", "lo", "hi", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.coalesce(F.try_element_at("m", i), hole))).alias("heights"))


def _meetings(cell: float, x0: float, y0: float) -> Column:
    """Array of the times at which a ray meets the two triangles of a cell."""
    u0, v0 = (F.col("ox") - x0) / cell - F.col("cx"), (F.col("oy") - y0) / cell - F.col("cy")
    du, dv = F.col("dx") / cell, F.col("dy") / cell

    def meeting(a: Column, b: Column, below: bool) -> Column:
        # on the plane z = h00 + a u + b v
        rate = F.col("dz") - a * du - b * dv
        t = (F.col("h00") + a * u0 + b * v0 - F.col("oz")) / F.when(F.abs(rate) > 1e-12, rate)
        u, v = u0 + t * du, v0 + t * dv
        side = v <= u + INSIDE if below else v >= u - INSIDE
        return F.when((t >= 0) & u.between(-INSIDE, 1 + INSIDE) & v.between(-INSIDE, 1 + INSIDE) & side, t)

    low = meeting(F.col("h10") - F.col("h00"), F.col("h11") - F.col("h10"), True)
    high = meeting(F.col("h11") - F.col("h01"), F.col("h01") - F.col("h00"), False)
    return F.least(low, high)


def first_hits(rays: DataFrame, vertices: DataFrame, cell: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(ray, t, x, y, z): where each ray (ray, ox, oy, oz, dx, dy, dz) first meets the terrain; no row for one that doesn't.

    ``ray`` names a ray. Vertices (ix, iy, h) lie ``cell`` apart from (x0, y0) on; a cell with a missing corner is a hole.
    Rays with a null are left out, and so is all if there is no terrain.
    """
    ground = cut(cells(vertices))
    span = ground.agg(*[f(c).alias(f"{n}_{c}") for c in ("cx", "cy") for n, f in (("a", F.min), ("b", F.max))], F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    rays = rays.select("ray", *[F.col(c).cast("double").alias(c) for c in ("ox", "oy", "oz", "dx", "dy", "dz")]).dropna()
    if span.lo is None:
        return rays.limit(0).select("ray", *[F.lit(0.0).alias(c) for c in ("t", "x", "y", "z")])
    side = max(span.b_cx - span.a_cx, span.b_cy - span.a_cy) + 1
    top = 1
    while side > 1 << (STEP * top):
        top += 1
    # from when to when a ray is in the box of the whole terrain
    border = BORDER * cell
    box = [
        _slab(F.col("ox"), F.col("dx"), F.lit(x0 + span.a_cx * cell - border), F.lit(x0 + (span.b_cx + 1) * cell + border)),
        _slab(F.col("oy"), F.col("dy"), F.lit(y0 + span.a_cy * cell - border), F.lit(y0 + (span.b_cy + 1) * cell + border)),
        _slab(F.col("oz"), F.col("dz"), F.lit(span.lo - border), F.lit(span.hi + border)),
    ]
    here = rays.withColumn("a", F.greatest(F.lit(0.0), *[a for a, _ in box])).withColumn("b", F.least(*[b for _, b in box])).where("a <= b")
    own = ["ray", "ox", "oy", "oz", "dx", "dy", "dz", "a", "b"]
    for level in range(top, -1, -1):
        size = cell * (1 << STEP * level)
        for axis, origin, least, most in (("x", x0, span.a_cx, span.b_cx), ("y", y0, span.a_cy, span.b_cy)):
            low, high = F.lit(least >> STEP * level), F.lit(most >> STEP * level)
            if level < top:
                low, high = F.greatest(low, F.col(f"t{axis}") * (1 << STEP)), F.least(high, F.col(f"t{axis}") * (1 << STEP) + ((1 << STEP) - 1))
            here = _along(here, axis, f"c{axis}", low.cast("long"), high.cast("long"), origin, size, border)
        if level:
            n = ((span.b_cx >> STEP * level) - (span.a_cx >> STEP * level) + 1) * ((span.b_cy >> STEP * level) - (span.a_cy >> STEP * level) + 1)
            table = _tiles(ground, level) if level > 1 else _heights(ground)
            here = here.select(*own, F.col("cx").alias("tx"), F.col("cy").alias("ty")).join(F.broadcast(table) if n <= SMALL else table.hint("merge"), ["tx", "ty"])
            here = _during(here, *_slab(F.col("oz"), F.col("dz"), F.col("lo") - border, F.col("hi") + border))
    # the cell's place in its tile's heights
    k = ((F.col("cy") - F.col("ty") * (1 << STEP)) * (1 << STEP) + F.col("cx") - F.col("tx") * (1 << STEP)).cast("int") * 4
    here = here.select(*own, "cx", "cy", *[F.get("heights", k + i).alias(n) for i, n in enumerate(("h00", "h10", "h01", "h11"))])
    here = here.withColumn("t", _meetings(cell, x0, y0)).where("t is not null")
    spot = F.struct("t", *[(F.col(f"o{c}") + F.col("t") * F.col(f"d{c}")).alias(c) for c in "xyz"])
    return here.groupBy("ray").agg(F.min(spot).alias("spot")).select("ray", "spot.*")


def ground_boxes(boxes: DataFrame, vertices: DataFrame, cell: float, width: float, height: float, aspect: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``boxes`` with gx1, gy1, gz1, gx2, gy2, gz2, hits and reason: where a box's corner rays meet the terrain.

    Needs detection_id, x1, y1, x2, y2 and the camera's x, y, z, fovy, yaw, pitch; detection_id names a row. ``reason``
    is null where a corner hits; else no_pose, beyond_mesh or above_horizon by the plane of the mean height, or other.
    """
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    angles = [F.col(c) for c in ("fovy", "yaw", "pitch")]
    ray = [g.pixel_ray(F.col(a), F.col(b), width, height, *angles, aspect) for a, b in corners]
    boxes = boxes.withColumn("_rays", F.array(*ray))
    rays = boxes.select("detection_id", *[F.col(c).alias(f"o{c}") for c in "xyz"], F.posexplode("_rays").alias("corner", "d"))
    rays = rays.select(F.struct("detection_id", "corner").alias("ray"), "ox", "oy", "oz", "d.dx", "d.dy", "d.dz")
    hits = first_hits(rays, vertices, cell, x0, y0)
    found = hits.groupBy(F.col("ray.detection_id").alias("detection_id")).agg(
        *[f(c).alias(f"g{c}{i}") for i, f in ((1, F.min), (2, F.max)) for c in "xyz"], F.count(F.lit(1)).alias("hits")
    )
    whole = vertices.agg((F.min("ix") * cell + x0).alias("lx"), (F.max("ix") * cell + x0).alias("hx"), (F.min("iy") * cell + y0).alias("ly"), (F.max("iy") * cell + y0).alias("hy"), F.avg("h").alias("mean")).first()
    both = boxes.join(found.hint("merge"), "detection_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    if whole.mean is None:
        return both.withColumn("reason", F.when(F.col("x").isNull(), "no_pose").otherwise("other")).drop("_rays")
    plane = F.transform("_rays", lambda d: g.on_plane(d, F.col("x"), F.col("y"), F.col("z"), F.lit(whole.mean)))
    reason = g.miss_reason(plane, whole.lx, whole.hx, whole.ly, whole.hy)
    return both.withColumn("reason", F.when(F.col("x").isNull() | F.col("y").isNull(), "no_pose").when(F.col("hits") == 0, reason)).drop("_rays")
