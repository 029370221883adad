"""Row numbers over a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cut


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their place, from 1, in the order of a column whose values differ.

    Rows are dealt by ranges of the column and numbered within them; a prefix sum over the ranges' sizes, a row for each,
    makes places of the whole.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) + F.col("_before")
    return dealt.join(before, "_range").withColumn(name, place.cast("long")).drop("_range", "_before")
