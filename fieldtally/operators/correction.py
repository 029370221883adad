"""Height and yaw that bring seen ground points onto surveyed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def height_and_yaw(points: DataFrame, by: str, height: float, reach: float = 100.0) -> DataFrame:
    """(by, tz, rz, residual) of points (by, dx, dy, tx, ty): seen and surveyed ground offsets from the camera.

    Ground offsets scale with the height above ground and turn with the yaw. As complex numbers that is one factor, whose
    least-squares value is a quotient of two sums; so a group of any size is reduced by partial sums. ``residual`` is the
    root of the mean square error. Groups whose offset is beyond ``reach``, or without any extent, give nulls.
    """
    sums = points.groupBy(by).agg(
        F.sum(F.col("dx") * F.col("tx") + F.col("dy") * F.col("ty")).alias("re"), F.sum(F.col("dx") * F.col("ty") - F.col("dy") * F.col("tx")).alias("im"),
        F.sum(F.col("dx") ** 2 + F.col("dy") ** 2).alias("dd"), F.sum(F.col("tx") ** 2 + F.col("ty") ** 2).alias("tt"), F.count(F.lit(1)).alias("n"),
    )
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    tz = height * (F.try_divide(size, F.col("dd")) - 1)
    ok = (F.col("dd") > 0) & (F.abs(tz) <= reach)
    error = F.greatest(F.lit(0.0), F.col("tt") - F.try_divide(size * size, F.col("dd")))
    return sums.select(by, F.when(ok, tz).alias("tz"), F.when(ok, F.atan2("im", "re")).alias("rz"), F.when(ok, F.sqrt(error / F.col("n"))).alias("residual"))
