"""Outlines of unions of many footprints.

Edges are cut where they meet other edges, cell by cell of a grid; a piece stays if no footprint covers what lies on its
right, so that inner edges cancel and shared ones count once. Pieces follow each other from end to begin; connected chains
are found by star contraction, and each is one ring: counter-clockwise around the union, clockwise around its holes.
Places are whole numbers of UNIT, so that pieces made in different tasks meet exactly.

A group of few points needs no cells: tasks take such groups whole, all those of an Arrow batch at once on flat arrays, and
only groups of more than WHOLE points go by cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .areas import PAIRS, following, within
from .graphs import cut, merge_groups
from .joins import along_cells

#: Places are rounded to this (in the rings' units); how far beside a piece coverage is looked up, and what counts as on an edge.
UNIT, BESIDE, ON = 1e-6, 2e-5, 2e-6
#: Points of a group that a task takes whole.
WHOLE = 256


def _crossings(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, point) for each place where another of the edges (ax, ay, bx, by) crosses, touches or ends on an edge."""
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    length = np.hypot(d[:, 0], d[:, 1])
    edges, points = [], []
    for i in range(len(e)):
        # ends of others on this edge
        for p in (a, a + d):
            t = ((p - a[i]) @ d[i]) / length[i] ** 2
            off = np.abs((p[:, 0] - a[i, 0]) * d[i, 1] - (p[:, 1] - a[i, 1]) * d[i, 0]) / length[i]
            on = (off <= ON) & (t > 0) & (t < 1)
            edges += [i] * int(on.sum())
            points.append(p[on])
        # crossings with later edges: one place for both
        j = np.arange(i + 1, len(e))
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = a[j] - a[i]
            t = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / cross
            u = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / cross
        hit = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        p = a[i] + t[hit, None] * d[i]
        edges += [i] * len(p) + j[hit].tolist()
        points += [p, p]
    return np.asarray(edges, np.int64), np.concatenate(points) if points else np.empty((0, 2))


def _split(edges: DataFrame, side: float, kind: str) -> DataFrame:
    """(g, eid, px, py): places, in UNIT, at which edges are cut."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            gs, eids, places = [], [], []
            for g, e, *ends in zip(f["g"], f["eid"], f["ax"], f["ay"], f["bx"], f["by_"]):
                at, p = _crossings(np.stack(ends, axis=1))
                gs += [g] * len(at)
                eids.append(np.asarray(e)[at])
                places.append(np.rint(p / UNIT).astype(np.int64))
            q = np.concatenate(places) if places else np.empty((0, 2), np.int64)
            yield pd.DataFrame({"g": pd.Series(gs, dtype=f["g"].dtype), "eid": np.concatenate(eids) if eids else q[:, 0], "px": q[:, 0], "py": q[:, 1]})

    # many cells come in one batch; an edge that is alone in its cell meets nothing there
    dealt = along_cells(edges, ON, side).groupBy("g", "cx", "cy").agg(*[F.collect_list(c).alias(c) for c in ("eid", "ax", "ay", "bx", "by_")]).where(F.size("eid") > 1)
    return dealt.select("g", "eid", "ax", "ay", "bx", "by_").mapInPandas(run, f"g {kind}, eid long, px long, py long").distinct()


def _inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether each point lies in a ring (even-odd)."""
    out = np.zeros(len(points), bool)
    x, y = points[:, 0], points[:, 1]
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
        if ay != by:
            out ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return out


def _open(pieces: DataFrame, rings: DataFrame, side: float, kind: str) -> DataFrame:
    """Pieces (g, px, py, qx, qy) whose right side no ring (g, ring) covers."""
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    far = BESIDE / F.sqrt(dx * dx + dy * dy)
    beside = pieces.withColumn("sx", (F.col("px") + F.col("qx")) / 2 * UNIT + dy * far).withColumn("sy", (F.col("py") + F.col("qy")) / 2 * UNIT - dx * far)
    beside = beside.withColumn("cx", F.floor(F.col("sx") / side)).withColumn("cy", F.floor(F.col("sy") / side))
    span = lambda c: F.sequence(F.floor(F.array_min(F.col(f"ring.{c}")) / side), F.floor(F.array_max(F.col(f"ring.{c}")) / side))
    around = rings.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            gs, kept = [], []
            for g, rx, ry, *mine in zip(f["g"], f["rx"], f["ry"], f["px"], f["py"], f["qx"], f["qy"], f["sx"], f["sy"]):
                pieces, points = np.stack(mine[:4], axis=1), np.stack(mine[4:], axis=1)
                left = np.ones(len(points), bool)
                for x, y in zip(rx if rx is not None else (), ry if ry is not None else ()):
                    left[left] = ~_inside(points[left], np.stack([x, y], axis=1))
                gs += [g] * int(left.sum())
                kept.append(pieces[left])
            q = np.concatenate(kept) if kept else np.empty((0, 4), np.int64)
            yield pd.DataFrame({"g": pd.Series(gs, dtype=f["g"].dtype), **{c: q[:, i] for i, c in enumerate(("px", "py", "qx", "qy"))}})

    # many cells come in one batch
    each = beside.groupBy("g", "cx", "cy").agg(*[F.collect_list(c).alias(c) for c in ("px", "py", "qx", "qy", "sx", "sy")])
    around = around.groupBy("g", "cx", "cy").agg(F.collect_list("ring.x").alias("rx"), F.collect_list("ring.y").alias("ry"))
    both = each.join(around.hint("merge"), ["g", "cx", "cy"], "left")
    return both.select("g", "px", "py", "qx", "qy", "sx", "sy", "rx", "ry").mapInPandas(run, f"g {kind}, px long, py long, qx long, qy long")


def _chained(ids: list[int], xs: list[int], ys: list[int], nexts: list[int]) -> list[tuple[int, int]]:
    """Corners of one ring, from pieces and the piece that follows each; places in the middle of a straight line are left out."""
    step = dict(zip(ids, nexts))
    place = dict(zip(ids, zip(xs, ys)))
    at = first = min(step)
    points = []
    while True:
        points.append(place[at])
        at = step.get(at)
        if at is None or at == first or len(points) > len(step):
            break
    n = len(points)
    bend = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]))
    size = lambda a, b: math.hypot(b[0] - a[0], b[1] - a[1])
    return [p for i, p in enumerate(points) if bend(points[i - 1], p, points[(i + 1) % n]) > 4 * max(size(points[i - 1], p), size(p, points[(i + 1) % n]))]


def _runs(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Items in runs (from, to) whose partners, so many for each item, add up to PAIRS at most; one item at least."""
    ends, at = np.cumsum(many), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        yield at, to
        at = to


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which of rows in order differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows in order, each once."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = _new(*columns)
    return [c[new] for c in columns]


def _met(g: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_crossings`` of the edges of many groups at once, which lie group by group: edge, and x and y of the place."""
    dx, dy = bx - ax, by - ay
    length = np.hypot(dx, dy)
    lx, hx, ly, hy = np.minimum(ax, bx) - ON, np.maximum(ax, bx) + ON, np.minimum(ay, by) - ON, np.maximum(ay, by) + ON
    many = np.bincount(g)
    start = np.cumsum(many) - many
    found = []
    for at, to in _runs(many[g]):
        i, k = within(many[g[at:to]])
        i = i + at
        j = start[g[i]] + k
        near = (lx[i] <= hx[j]) & (lx[j] <= hx[i]) & (ly[i] <= hy[j]) & (ly[j] <= hy[i]) & (i != j)
        i, j = i[near], j[near]
        # ends of others on this edge
        for ex, ey in ((ax, ay), (bx, by)):
            vx, vy = ex[j] - ax[i], ey[j] - ay[i]
            t = (vx * dx[i] + vy * dy[i]) / length[i] ** 2
            on = (np.abs(vx * dy[i] - vy * dx[i]) / length[i] <= ON) & (t > 0) & (t < 1)
            found.append((i[on], ex[j[on]], ey[j[on]]))
        # crossings with later edges: one place for both
        later = j > i
        i, j = i[later], j[later]
        cross = dx[i] * dy[j] - dy[i] * dx[j]
        vx, vy = ax[j] - ax[i], ay[j] - ay[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (vx * dy[j] - vy * dx[j]) / cross, (vx * dy[i] - vy * dx[i]) / cross
        hit = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        i, j, t = i[hit], j[hit], t[hit]
        x, y = ax[i] + t * dx[i], ay[i] + t * dy[i]
        found += [(i, x, y), (j, x, y)]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (g[:0], ax[:0], ay[:0])


def _covered(g: np.ndarray, x: np.ndarray, y: np.ndarray, sides: list[np.ndarray], groups: int) -> np.ndarray:
    """Whether a ring of its group holds each point (even-odd). sides: group, ring, ax, ay, bx, by, group by group."""
    of, ring, ax, ay, bx, by = sides
    many = np.bincount(of, minlength=groups)
    start = np.cumsum(many) - many
    out = np.zeros(len(x), bool)
    rings = int(ring.max()) + 1 if len(ring) else 1
    for at, to in _runs(many[g]):
        i, k = within(many[g[at:to]])
        i = i + at
        j = start[g[i]] + k
        hit = (ay[j] > y[i]) != (by[j] > y[i])
        i, j = i[hit], j[hit]
        hit = x[i] < (bx[j] - ax[j]) * (y[i] - ay[j]) / (by[j] - ay[j]) + ax[j]
        pair, times = np.unique(i[hit] * rings + ring[j[hit]], return_counts=True)
        out[pair[times % 2 == 1] // rings] = True
    return out


def _in_order(nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces ring by ring in the order they follow each other, and the ring of each; every piece is the next one of one other."""
    root, to = np.arange(len(nexts)), nexts
    while True:
        least = np.minimum(root, root[to])
        if (least == root).all():
            break
        root, to = least, to[to]
    # steps that are left to the ring's end
    end = len(nexts)
    to = np.append(np.where(nexts == root, end, nexts), end)
    left = np.append(np.ones(end, np.int64), 0)
    while (to[:-1] != end).any():
        left, to = left + left[to], to[to]
    order = np.lexsort((-left[:-1], root))
    return order, np.cumsum(_new(root[order])) - 1


def _loose(g: np.ndarray, px: np.ndarray, py: np.ndarray, nexts: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Group and corners of rings whose pieces don't follow each other one by one; -1: nothing follows."""
    on = np.flatnonzero(nexts >= 0)
    root = {i: i for i in on.tolist()}

    def top(i: int) -> int:
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for i, k in zip(on.tolist(), nexts[on].tolist()):
        a, b = sorted((top(i), top(k)))
        root[b] = a
    chains: dict[int, list[int]] = {}
    for i in on.tolist():
        chains.setdefault(top(i), []).append(i)
    for ids in chains.values():
        yield int(g[ids[0]]), _chained(ids, px[ids].tolist(), py[ids].tolist(), nexts[ids].tolist())


def _units(v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.copysign(np.floor(np.abs(v / UNIT) + 0.5), v).astype(np.int64)


def outlined(x: np.ndarray, y: np.ndarray, ring: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rings around what the rings of each group cover together: x and y of their corners, the ring of each; group and area of each ring.

    ``ring`` is that of each point and ``group`` that of each ring, from 0 on and in order.
    """
    if not len(x):
        return x, y, ring, group[:0], x
    g, after = group[ring], following(ring)
    groups, first = int(group[-1]) + 1, np.flatnonzero(_new(ring))
    # a group's places count from its first point
    zero = np.flatnonzero(_new(g))
    x0, y0 = _units(x[zero]), _units(y[zero])
    px, py = _units(x) - x0[g], _units(y) - y0[g]
    ax, ay, bx, by = px, py, px[after], py[after]
    fx, fy = px[first][ring], py[first][ring]
    usable = np.isfinite(x) & np.isfinite(y)
    usable = np.bincount(ring, ~usable) == 0
    twice = np.bincount(ring, (ax - fx) * 1.0 * (by - fy) - (bx - fx) * 1.0 * (ay - fy)) * UNIT * UNIT
    use, turn = (usable & (np.abs(twice) > UNIT))[ring] & ((ax != bx) | (ay != by)), (twice < 0)[ring]
    ax, ay, bx, by = (np.where(turn, a, b)[use] for a, b in ((bx, ax), (by, ay), (ax, bx), (ay, by)))
    sides = [g[use], ring[use], *(c * UNIT for c in (ax, ay, bx, by))]
    g, ax, ay, bx, by = _distinct(g[use], ax, ay, bx, by)
    # pieces between the places at which edges are cut
    at, mx, my = _met(g, *(c * UNIT for c in (ax, ay, bx, by)))
    e = np.arange(len(g))
    e, px, py = _distinct(np.concatenate([e, e, at]), *(np.concatenate([a, b, np.rint(m / UNIT).astype(np.int64)]) for a, b, m in ((ax, bx, mx), (ay, by, my))))
    order = np.lexsort((py, px, (px - ax[e]) * 1.0 * (bx - ax)[e] + (py - ay[e]) * 1.0 * (by - ay)[e], e))
    e, px, py = e[order], px[order], py[order]
    on = np.flatnonzero(~_new(e)) - 1 if len(e) else e
    g, px, py, qx, qy = _distinct(g[e[on]], px[on], py[on], px[on + 1], py[on + 1])
    far = BESIDE / np.hypot(qx - px, qy - py)
    open_ = ~_covered(g, (px + qx) / 2 * UNIT + (qy - py) * far, (py + qy) / 2 * UNIT - (qx - px) * far, sides, groups)
    g, px, py, qx, qy = (c[open_] for c in (g, px, py, qx, qy))
    # of several ways on from a place, the one that turns left most, so that rings which touch stay apart
    n = len(g)
    both = [np.concatenate([g, g]), np.concatenate([px, qx]), np.concatenate([py, qy])]
    order = np.lexsort(both[::-1])
    place = np.empty(2 * n, np.int64)
    place[order] = np.cumsum(_new(*(c[order] for c in both))) - 1
    many = np.bincount(place[:n], minlength=2 * n)
    start = np.cumsum(many) - many
    i, k = within(many[place[n:]])
    j = start[place[n:][i]] + k
    ux, uy, vx, vy = ((b - a)[m] * 1.0 for m in (i, j) for a, b in ((px, qx), (py, qy)))
    turn = np.arctan2(ux * vy - uy * vx, ux * vx + uy * vy)
    order = np.lexsort((j, turn, i))
    i, j = i[order], j[order]
    last = np.append(_new(i)[1:], True) if n and len(i) else np.zeros(len(i), bool)
    nexts = np.full(n, -1)
    nexts[i[last]] = j[last]
    # groups in which a piece has no next one, or shares it with another
    loose = np.zeros(groups, bool)
    loose[g[nexts < 0]] = True
    loose[g[np.bincount(nexts[nexts >= 0], minlength=n) != 1]] = True
    odd = list(_loose(*(c[loose[g]] for c in (g, px, py)), _renumbered(nexts, loose[g]))) if loose.any() else []
    keep = ~loose[g]
    nexts, g, px, py = _renumbered(nexts, keep), g[keep], px[keep], py[keep]
    order, ring = _in_order(nexts)
    g, px, py = g[order], px[order], py[order]
    # places in the middle of a straight line are left out
    after = following(ring)
    before = np.empty_like(after)
    before[after] = np.arange(len(after))
    ux, uy, vx, vy = px - px[before], py - py[before], px[after] - px, py[after] - py
    bend = np.abs(ux * 1.0 * vy - uy * 1.0 * vx) > 4 * np.maximum(np.hypot(ux, uy), np.hypot(vx, vy))
    bend &= np.bincount(ring[bend], minlength=len(ring) + 1)[ring] >= 3
    g, px, py, ring = g[bend], px[bend], py[bend], ring[bend]
    if odd := [(k, p) for k, p in odd if len(p) >= 3]:
        top = int(ring[-1]) + 1 if len(ring) else 0
        size = [len(p) for _, p in odd]
        ring = np.append(ring, np.repeat(np.arange(top, top + len(odd)), size))
        g = np.append(g, np.repeat([k for k, _ in odd], size))
        px, py = (np.append(c, [q[axis] for _, p in odd for q in p]) for axis, c in enumerate((px, py)))
    first = _new(ring)
    ring = np.cumsum(first) - 1
    of, after = g[first], following(ring)
    dx, dy = px - px[first][ring], py - py[first][ring]
    area = np.bincount(ring, dx * 1.0 * dy[after] - dx[after] * 1.0 * dy) / 2 * UNIT * UNIT
    return (px + x0[g]) * UNIT, (py + y0[g]) * UNIT, ring, of, area


def _renumbered(nexts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The next piece of those that are kept, by its number among them."""
    number = np.append(np.where(keep, np.cumsum(keep) - 1, -1), -1)
    return number[nexts][keep]


def _by_group(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """Outlines of groups that a task takes whole."""

    def made(b: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        xs, ys = b.column("x"), b.column("y")
        ring = np.repeat(np.arange(len(b)), xs.value_lengths().to_numpy(zero_copy_only=False))
        x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (xs, ys))
        x, y, ring, group, area = outlined(x, y, ring, np.cumsum(first) - 1)
        ends = np.append(0, np.cumsum(np.bincount(ring, minlength=len(group)))).astype(np.int32)
        rings = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
        return pa.RecordBatch.from_arrays([b.column("g").take(pa.array(np.flatnonzero(first)[group])), rings, pa.array(area), pa.array(area < 0)], ["g", "ring", "area", "hole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            # the last group may go on in the next batch
            b = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks().to_batches()
            if not b:
                continue
            b = b[0]
            first = b.column("n").to_numpy(zero_copy_only=False) == 1
            last = int(np.flatnonzero(first)[-1])
            if last:
                yield made(b.slice(0, last), first[:last])
            rest = b.slice(last)
        if rest is not None:
            yield made(rest, rest.column("n").to_numpy(zero_copy_only=False) == 1)

    places = [F.col(f"ring.{c}").cast("array<double>").alias(c) for c in "xy"]
    # in order by group; what is dealt by it already needs no shuffle
    ordered = rows.select("g", *places).withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("g")))
    return ordered.mapInArrow(run, f"g {kind}, ring array<struct<x: double, y: double>>, area double, hole boolean").withColumnRenamed("g", by)


def union_outlines(footprints: DataFrame, by: str, ring: Column, side: float | None = None) -> DataFrame:
    """(by, ring, area, hole): rings around what each group's footprints cover together, and around the holes in it.

    Footprints are simple rings (arrays of structs x, y), of either direction. A ring of the result is an array of such
    structs, counter-clockwise and with an area above 0, or a hole, clockwise and below 0; areas add up to the union's.
    Rings that touch in a point stay apart. Groups without a usable ring have no row; null groups are left out. ``side``
    is that of the cells, by default four times a footprint's mean extent; with it, all groups go by cells.
    """
    kind = dict(footprints.dtypes)[by]
    rows = footprints.select(F.col(by).alias("g"), ring.alias("ring")).where((F.size("ring") >= 3) & F.col("g").isNotNull())
    if side is not None:
        return _by_cells(rows, by, kind, side)
    large = cut(rows.groupBy("g").agg(F.sum(F.size("ring")).alias("n")).where(F.col("n") > WHOLE).select("g"))
    if large.isEmpty():
        return _by_group(rows, by, kind)
    small, rest = (rows.join(large.hint("merge"), "g", how) for how in ("left_anti", "left_semi"))
    return _by_group(small, by, kind).unionByName(_by_cells(rest, by, kind))


def _by_cells(rings: DataFrame, by: str, kind: str, side: float | None = None) -> DataFrame:
    """Outlines of groups of any size."""
    whole = F.transform("ring", lambda p: F.struct((F.round(p["x"] / UNIT) * UNIT).alias("x"), (F.round(p["y"] / UNIT) * UNIT).alias("y")))
    rings = rings.select("g", whole.alias("ring")).distinct()
    follow = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    sides = F.zip_with("ring", follow, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by_")))
    twice = F.aggregate("sides", F.lit(0.0), lambda s, e: s + (e["ax"] - F.col("ring")[0]["x"]) * (e["by_"] - F.col("ring")[0]["y"]) - (e["bx"] - F.col("ring")[0]["x"]) * (e["ay"] - F.col("ring")[0]["y"]))
    turned = F.transform("sides", lambda e: F.struct(e["bx"].alias("ax"), e["by_"].alias("ay"), e["ax"].alias("bx"), e["ay"].alias("by_")))
    rings = cut(rings.withColumn("sides", sides).withColumn("twice", twice).where(F.abs("twice") > UNIT).withColumn("sides", F.when(F.col("twice") > 0, F.col("sides")).otherwise(turned)).drop("twice"))
    if side is None:
        extent = lambda c: F.array_max(F.col(f"ring.{c}")) - F.array_min(F.col(f"ring.{c}"))
        side = 4 * (rings.agg(F.avg(F.greatest(extent("x"), extent("y")))).first()[0] or 1.0)
    edges = rings.select("g", F.inline("sides")).where("ax <> bx or ay <> by_").distinct()
    edges = cut(edges.withColumn("eid", F.monotonically_increasing_id()))
    ends = F.array(*[F.struct(F.round(F.col(x) / UNIT).cast("long").alias("px"), F.round(F.col(y) / UNIT).cast("long").alias("py")) for x, y in (("ax", "ay"), ("bx", "by_"))])
    cuts = edges.select("g", "eid", F.inline(ends)).unionByName(_split(edges, side, kind)).distinct()
    along = (F.col("px") * UNIT - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("py") * UNIT - F.col("ay")) * (F.col("by_") - F.col("ay"))
    placed = cuts.join(edges.drop("g").hint("merge"), "eid").withColumn("t", along)
    after = Window.partitionBy("eid").orderBy("t", "px", "py")
    pieces = placed.withColumn("qx", F.lead("px").over(after)).withColumn("qy", F.lead("py").over(after)).where("qx is not null").select("g", "px", "py", "qx", "qy").distinct()
    kept = cut(_open(pieces, rings.select("g", "ring"), side, kind).withColumn("id", F.monotonically_increasing_id()))
    # of several ways on from a place, the one that turns left most, so that rings which touch stay apart
    on = kept.select("g", F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("qx").alias("rx"), F.col("qy").alias("ry"), F.col("id").alias("next"))
    ux, uy, vx, vy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py"), F.col("rx") - F.col("qx"), F.col("ry") - F.col("qy")
    turn = F.atan2((ux * vy - uy * vx).cast("double"), (ux * vx + uy * vy).cast("double"))
    ways = kept.join(on.hint("merge"), ["g", "qx", "qy"]).groupBy("g", "id").agg(F.max_by(F.struct("px", "py", "next"), F.struct(turn.alias("turn"), "next")).alias("w"))
    ways = cut(ways.select("g", "id", "w.px", "w.py", "w.next"))
    chains = merge_groups(ways.select(F.col("id").alias("a"), F.col("next").alias("b")))

    def ringed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for g, ids, xs, ys, nexts in zip(f["g"], f["id"], f["px"], f["py"], f["next"]):
                p = _chained(ids.tolist(), xs.tolist(), ys.tolist(), nexts.tolist())
                x0, y0 = p[0] if p else (0, 0)
                area = sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(p, p[1:] + p[:1])) / 2 * UNIT * UNIT
                if len(p) >= 3:
                    rows.append((g, [{"x": x * UNIT, "y": y * UNIT} for x, y in p], area, area < 0))
            yield pd.DataFrame(rows, columns=["g", "ring", "area", "hole"])

    dealt = ways.join(chains.hint("merge"), F.col("id") == F.col("node")).groupBy("g", "root").agg(*[F.collect_list(c).alias(c) for c in ("id", "px", "py", "next")])
    return dealt.select("g", "id", "px", "py", "next").mapInPandas(ringed, f"g {kind}, ring array<struct<x: double, y: double>>, area double, hole boolean").withColumnRenamed("g", by)
