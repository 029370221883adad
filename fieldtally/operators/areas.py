"""Areas of unions of many footprints, cell by cell.

Rings are clipped to the cells of a grid, and the union of what lies in a cell is swept there: areas of cells add up to the
group's, so a group with a third of all footprints is many tasks. Pieces that are equal count once, and a cell that one
piece covers as a whole needs no sweep. Crowded cells are cut into quarters and their pieces clipped again, round by round;
what is still crowded after ROUNDS (many edges through one spot) is swept as it is, so that no piece is lost. Tasks clip and
sweep all rows of an Arrow batch at once, on flat arrays of points, so that a cell costs no call of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import cut
from .numerics import union_area

#: Pieces that a cell is swept with at once, and how often a crowded cell is quartered.
CROWDED, ROUNDS = 24, 8
#: Pairs of edges that are held at once; a cell of more is swept edge by edge.
PAIRS = 1 << 20


def following(of: np.ndarray) -> np.ndarray:
    """Index of each point's successor in its ring; ``of`` names the rings of points that lie ring by ring."""
    after = np.arange(1, len(of) + 1)
    last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else after
    after[last] = np.append(0, last[:-1] + 1) if len(of) else last
    return after


def clipped(points: np.ndarray, of: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of rings inside their boxes (x0, y0, x1, y1), cut by one side after the other: points, and the ring of each."""
    for axis, side, sign in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        bound = boxes[of, side]
        inside = sign * (points[:, axis] - bound) >= 0
        if inside.all():
            continue
        after = following(of)
        crosses = inside != inside[after]
        step = points[after] - points
        with np.errstate(divide="ignore", invalid="ignore"):
            spots = points + ((bound - points[:, axis]) / step[:, axis])[:, None] * step
        spots[:, axis] = bound
        # a vertex that is inside, then the crossing behind it
        keep = np.stack([inside, crosses], axis=1).reshape(-1)
        points, of = np.stack([points, spots], axis=1).reshape(-1, 2)[keep], np.repeat(of, 2)[keep]
    return points, of


def _rings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points of binary rings, and the ring of each point."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    points = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view("<f8").reshape(-1, 2) if data is not None else np.empty((0, 2))
    return points, np.repeat(np.arange(len(column)), np.diff(offsets) // 16)


def _binary(points: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary rings of so many points each."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32) * np.int32(16)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(points, "<f8").tobytes())])


def _clip(dealt: DataFrame, side: float, kind: str) -> DataFrame:
    """Pieces (g, cx, cy, piece, full) of rows (g, cx, cy, ring as bytes), without empty and repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cx, cy = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy"))
            boxes = np.stack([cx * side, cy * side, (cx + 1) * side, (cy + 1) * side], axis=1)
            points, of = clipped(*_rings(b.column("ring")), boxes)
            sizes = np.bincount(of, minlength=len(b))
            low, high = np.full((len(b), 2), np.inf), np.full((len(b), 2), -np.inf)
            np.minimum.at(low, of, points)
            np.maximum.at(high, of, points)
            good = (sizes >= 3) & (high > low).all(axis=1)
            # a piece of four points, one in each corner, is the cell itself
            east, north = points[:, 0] == boxes[of, 2], points[:, 1] == boxes[of, 3]
            corner = (east | (points[:, 0] == boxes[of, 0])) & (north | (points[:, 1] == boxes[of, 1]))
            full = (sizes == 4) & (np.bincount(of, np.where(corner, 1 << (2 * east + north), 0), len(b)) == 15)
            rest = b.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([rest.column("g"), rest.column("cx"), rest.column("cy"), _binary(points[good[of]], sizes[good]), pa.array(full[good])], ["g", "cx", "cy", "piece", "full"])

    return dealt.mapInArrow(run, f"g {kind}, cx long, cy long, piece binary, full boolean").dropDuplicates(["g", "cx", "cy", "piece"])


def within(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many members: the group of each, and its place in it."""
    group = np.repeat(np.arange(len(size)), size)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)


def swept(points: np.ndarray, ring: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """What the rings of each cell cover together (even-odd within a ring): ``union_area`` of many cells at once.

    ``ring`` and ``cell`` are those of each point, in order.
    """
    a, b = points, points[following(ring)] if len(points) else points
    swap = a[:, 0] > b[:, 0]
    a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
    wide = a[:, 0] < b[:, 0]
    (ax, ay), (bx, by), ring, cell = a[wide].T, b[wide].T, ring[wide], cell[wide]
    slope = (by - ay) / (bx - ax)
    # crossings of edges of one cell
    many = np.bincount(cell, minlength=cells)
    start = np.cumsum(many) - many
    i, k = within(many[cell])
    j = start[cell[i]] + k
    use = (j > i) & (slope[i] != slope[j])
    i, j = i[use], j[use]
    x = (ay[j] - slope[j] * ax[j] - ay[i] + slope[i] * ax[i]) / (slope[i] - slope[j])
    hit = (x > np.maximum(ax[i], ax[j])) & (x < np.minimum(bx[i], bx[j]))
    # slabs between all ends and crossings of a cell
    xs, of = np.concatenate([ax, bx, x[hit]]), np.concatenate([cell, cell, cell[i[hit]]])
    order = np.lexsort((xs, of))
    new = np.append(True, (xs[order][1:] != xs[order][:-1]) | (of[order][1:] != of[order][:-1]))[: len(xs)]
    rank = np.empty(len(xs), np.int64)
    rank[order] = np.cumsum(new) - 1
    cuts = xs[order][new]
    first, last = rank[: len(ax)], rank[len(ax) : 2 * len(ax)]
    e, k = within(last - first)
    slab = first[e] + k
    middle = (cuts[slab] + cuts[slab + 1]) / 2
    height = ay[e] + slope[e] * (middle - ax[e])
    # edges of a ring go in and out of it by turns
    order = np.lexsort((height, ring[e], slab))
    e, slab, height = e[order], slab[order], height[order]
    new = np.append(True, (slab[1:] != slab[:-1]) | (ring[e][1:] != ring[e][:-1]))[: len(e)]
    turn = np.arange(len(e)) - np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    sign = 1 - 2 * (turn % 2)
    order = np.lexsort((height, slab))
    e, slab, height = e[order], slab[order], height[order]
    covered = np.cumsum(sign[order])[:-1] > 0
    area = np.diff(height) * (cuts[slab[:-1] + 1] - cuts[slab[:-1]])
    return np.bincount(cell[e[:-1]][covered], area[covered], cells) if len(e) else np.zeros(cells)


def _swept(pieces: DataFrame, kind: str) -> DataFrame:
    """(g, area) of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column("pieces")
            points, ring = _rings(listed.flatten())
            cell = np.repeat(np.arange(len(b)), listed.value_lengths().to_numpy(zero_copy_only=False))[ring]
            ends = np.append(0, np.cumsum(np.bincount(cell, minlength=len(b))))
            pairs = np.diff(ends).astype(np.int64) ** 2
            area, at = np.zeros(len(b)), 0
            while at < len(b):
                to = at + max(1, int(np.searchsorted(np.cumsum(pairs[at : at + 65_536]), PAIRS, "right")))
                part = slice(ends[at], ends[to])
                if pairs[at] > PAIRS:
                    area[at] = union_area(np.split(points[part], np.flatnonzero(np.diff(ring[part])) + 1))
                else:
                    area[at:to] = swept(points[part], ring[part], cell[part] - at, to - at)
                at = to
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(area)], ["g", "area"])

    return pieces.groupBy("g", "cx", "cy").agg(F.collect_list("piece").alias("pieces")).select("g", "pieces").mapInArrow(run, f"g {kind}, area double")


def union_areas(footprints: DataFrame, by: str, ring: Column, side: float | None = None) -> DataFrame:
    """(by, area): what each group's footprints cover together. ``ring``: array of structs (x, y), three points at least.

    Even-odd within a ring. ``side`` is that of the first cells; by default, the mean extent of a footprint, up to a power of
    two. Null groups are a group. A group without a usable ring has no row.
    """
    kind = dict(footprints.dtypes)[by]
    rows = footprints.select(F.col(by).alias("g"), ring.alias("r")).where(F.size("r") >= 3)
    rows = rows.withColumn("r", F.transform("r", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
    ends = [f(F.col(f"r.{c}")).alias(f"{n}{c}") for c in "xy" for n, f in (("a", F.array_min), ("b", F.array_max))]
    rows = rows.select("g", "r", *ends)
    if side is None:
        extent = rows.agg(F.avg(F.greatest(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).first()[0]
        side = 2.0 ** math.ceil(math.log2(extent)) if extent else 1.0
    span = lambda a, b: F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.column("r")
            flat = r.flatten()
            points = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("g", "ax", "bx", "ay", "by")), _binary(points, r.value_lengths().to_numpy(zero_copy_only=False))], ["g", "ax", "bx", "ay", "by", "ring"])

    rows = rows.mapInArrow(packed, f"g {kind}, ax double, bx double, ay double, by double, ring binary")
    dealt = rows.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by"))).select("g", "cx", "cy", "ring")
    parts = []
    for turn in range(ROUNDS + 1):
        pieces = cut(_clip(dealt, side, kind))
        sizes = pieces.groupBy("g", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("covered"))
        parts.append(sizes.where("covered").select("g", F.lit(side * side).alias("area")))
        key = F.expr("p.g <=> s.g and p.cx = s.cx and p.cy = s.cy")
        open_ = pieces.alias("p").join(sizes.where("not covered").hint("merge").alias("s"), key).select("p.*", "s.n")
        calm = open_.where(F.col("n") <= CROWDED) if turn < ROUNDS else open_
        parts.append(_swept(calm, kind))
        crowded = open_.where(F.col("n") > CROWDED)
        if turn == ROUNDS or crowded.isEmpty():
            break
        side /= 2
        quarter = F.array(*[F.struct((2 * F.col("cx") + i).alias("cx"), (2 * F.col("cy") + j).alias("cy")) for i in (0, 1) for j in (0, 1)])
        dealt = crowded.select("g", F.inline(quarter), F.col("piece").alias("ring"))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.union(more)
    return whole.groupBy(F.col("g").alias(by)).agg(F.sum("area").alias("area"))
