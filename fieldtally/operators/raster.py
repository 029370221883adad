"""Sparse grids: counts, coverage, smoothing, merging, masks, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smoothing kernels end at so many standard deviations.
KERNEL_REACH = 4.0


def cells(points: DataFrame, size: float, x: str = "x", y: str = "y", x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Points counted by grid cell: row, col, n."""
    return points.groupBy(F.floor((F.col(y) - y0) / size).alias("row"), F.floor((F.col(x) - x0) / size).alias("col")).agg(F.count(F.lit(1)).alias("n"))


def kernel(sigma: float) -> list[tuple[int, float]]:
    """Weights of a one-dimensional Gaussian, in cells, that sum to 1."""
    reach = int(KERNEL_REACH * sigma + 0.5)
    raw = [(k, math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-reach, reach + 1)]
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw]


def density(counts: DataFrame, size: float, bandwidth: float) -> DataFrame:
    """Gaussian density of cell counts, in points a hectare: row, col, density.

    The kernel is separable: each pass spreads a row or a column and adds up, so the cost is cells times the kernel's
    length, twice. Cells below 1e-4 of a lone point's peak are left out.
    """
    w = kernel(bandwidth / size)
    spread = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("w")) for k, v in w])
    out = counts.select("row", "col", F.col("n").cast("double").alias("v"))
    for axis in ("row", "col"):
        s = out.withColumn("s", F.explode(spread)).withColumn(axis, F.col(axis) + F.col("s.k"))
        out = s.groupBy("row", "col").agg(F.sum(F.col("v") * F.col("s.w")).alias("v"))
    per_ha = 10_000.0 / (size * size)
    peak = max(v for _, v in w) ** 2
    return out.where(F.col("v") >= 1e-4 * peak).select("row", "col", (F.col("v") * per_ha).alias("density"))


def coverage(footprints: DataFrame, size: float) -> DataFrame:
    """Frames that see each cell's centre, of axis-parallel footprints (frame, lx, ly, hx, hy): row, col, frames."""
    first = lambda c: F.ceil(F.col(c) / size - 0.5)
    last = lambda c: F.floor(F.col(c) / size - 0.5)
    span = lambda a, b: F.when(last(b) >= first(a), F.sequence(first(a), last(b)))
    c = footprints.withColumn("row", F.explode(span("ly", "hy"))).withColumn("col", F.explode(span("lx", "hx")))
    return c.groupBy("row", "col").agg(F.count_distinct("frame").alias("frames"))


def coverage_summary(covered: DataFrame, size: float) -> DataFrame:
    """One row: covered area, area seen more than once, most and mean frames."""
    a = size * size
    return covered.agg(
        (F.count(F.lit(1)) * a).alias("covered"), (F.coalesce(F.sum((F.col("frames") > 1).cast("long")), F.lit(0)) * a).alias("multi_covered"),
        F.max("frames").alias("most"), F.avg("frames").alias("mean"),
    )


def merge(pixels: DataFrame, how: str) -> DataFrame:
    """One value a cell from several frames' rasters (frame, row, col, v): first, last, min, max or average (half to even)."""
    pick = {
        "first": F.min_by("v", "frame"), "last": F.max_by("v", "frame"), "min": F.min("v"), "max": F.max("v"), "average": F.rint(F.avg("v")),
    }[how]
    return pixels.where("v is not null").groupBy("row", "col").agg(pick.alias("v"))


def erode(mask: DataFrame, times: int) -> DataFrame:
    """Cells of a mask (row, col) whose four neighbours are in it too, applied several times."""
    out = mask.select("row", "col").distinct()
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    for _ in range(times):
        votes = out.withColumn("k", F.explode(around)).select((F.col("row") + F.col("k.a")).alias("row"), (F.col("col") + F.col("k.b")).alias("col"))
        out = votes.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n = 5").select("row", "col")
    return out


def bounds(raster: DataFrame) -> DataFrame:
    """Smallest box of rows and columns that holds all cells."""
    return raster.agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))])


def histogram(rows: DataFrame, value: str, top: Column, bins: Column) -> DataFrame:
    """Counts by equal bins over [0, top], the last one closed on the right; empty bins included: bin, n."""
    facts = rows.where(F.col(value) <= top).withColumn("b", bins)
    b = F.least(F.floor(F.col(value) / top * F.col("b")), F.col("b") - 1)
    counts = facts.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = facts.agg(F.max("b").alias("b")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("b").cast("long") - 1)).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def binned_percentile(rows: DataFrame, value: str, share: float, width: float = 0.25) -> DataFrame:
    """Centre of the first bin at which a share of the rows is reached."""
    from pyspark.sql import Window

    h = rows.groupBy(F.floor(F.col(value) / width).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cum = F.sum("n").over(Window.orderBy("b"))
    total = F.sum("n").over(Window.partitionBy())
    return h.withColumn("cum", cum).withColumn("total", total).where(F.col("cum") >= share * F.col("total")).agg(((F.min("b") + 0.5) * width).alias("value"))
