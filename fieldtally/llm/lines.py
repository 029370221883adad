"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a document make a window. A window that occurred before (in an earlier document, or
further up in the same one) is removed, and so are all lines that such windows cover. The first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bind, packed, row_keys, stored

WINDOW = 3


def _windows(text: Column) -> Column:
    """Array of (at, h1, h2): place of the first line and a 128-bit hash, of windows that have a word."""

    def made(lines: Column) -> Column:
        starts = F.when(F.size(lines) >= WINDOW, F.sequence(F.lit(0), F.size(lines) - WINDOW)).otherwise(
            F.array().cast("array<int>")
        )
        three = [lambda i, k=k: F.get(lines, i + k) for k in range(WINDOW)]
        return F.transform(
            F.filter(starts, lambda i: F.translate(F.concat(*[f(i) for f in three]), SPACE_CHARS, "") != ""),
            lambda i: F.struct(
                i.alias("at"),
                F.xxhash64(*[f(i) for f in three]).alias("h1"),
                F.xxhash64(F.lit(WINDOW), *[f(i) for f in reversed(three)]).alias("h2"),
            ),
        )

    return bind(F.split(text, "\n", -1), made)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with columns n_lines, n_removed and kept_text.

    Documents are ordered by doc_id (nulls last), then by hashes of their text; a window's first occurrence in that
    order stays whole. Of rows that are equal in doc_id and text one comes first, and the others, whose windows all
    are later occurrences, lose what those cover. A null or empty text, and one of fewer than three lines, keeps all
    it has; windows without any word never count as repeated. An empty table gives an empty one. Columns n_lines,
    n_removed and kept_text of the input are replaced, others pass through, whatever their names.
    """
    k1, k2 = row_keys("doc_id", "text")
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), k1.alias("k1"), k2.alias("k2"), "text")
    found = stored(rows.select("id", "k1", "k2", F.inline(_windows(F.col("text")))), "windows")
    # nulls last: (0, id) sorts before (1, null)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "at")
    first = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    first = stored(first.where("n > 1"), "repeats")
    again = found.withColumn("place", place).join(first.hint("merge"), ["h1", "h2"])
    # rows equal in doc_id and text share k1 and k2: whether a window is later for their first is kept beside its place
    covered = again.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.when(F.col("place") > F.col("first"), F.col("at")))).alias("later"), F.array_sort(F.collect_set("at")).alias("all")
    )
    covered = stored(covered, "covered")
    both = packed(docs, ("n_lines", "n_removed", "kept_text"), text=F.col("text"), k1=k1, k2=k2).join(covered.hint("merge"), ["k1", "k2"], "left")
    turn = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1", "k2"))
    both = both.withColumn("starts", F.when(turn == 1, F.col("later")).otherwise(F.col("all"))).withColumn("starts", F.when(F.size("starts") > 0, F.col("starts")))
    lines = F.split(F.col("text"), "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.transform(F.lit(_offsets()), lambda k: s + k))))
    left = bind(lines, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)))
    out = both.select(
        "row",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
        F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept_text"),
    )
    return out.select("row.*", "n_lines", "n_removed", "kept_text")


def _offsets() -> list[int]:
    return list(range(WINDOW))
