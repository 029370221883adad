"""Mixing sources to target weights by systematic sampling.

A source's documents lie on a line, each with a length of its expected copies (the source's rate). The line is
shifted by one random offset, and a document is emitted once for each whole number inside its piece. The order on
the line is size first, so that what a source gives stays near its target.

The prefix sums never need a whole source in one task. A source is cut by size class, a class by digits of a hash of
the document id; row numbers within those pieces, and sums of piece counts, add up to the place on the line. With n
rows and about sqrt(n) hash pieces, no task holds more than about sqrt(n) rows of a source and class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, row_keys, stored, words

#: Weights of the sources in code point order (null last), repeated as often as needed.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Rates and offsets are whole numbers of such parts of a copy.
SCALE = 10**12
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null."""
    return F.size(words(text)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source: source, source_size, n_docs, target.

    Sources share ``share`` times all sizes by weight. None gets more than ``most`` times its own size; what is
    over goes to the others by weight, until none is above. A source is at its limit exactly if limit / weight is
    below the common level, so sources sorted by that ratio need one pass. This table has a row for each source, and
    only that is brought together. No source, or all sizes 0: targets of 0.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    w = F.array(*[F.lit(x) for x in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.get(w, rank % len(weights))).withColumn("limit", most * F.col("source_size"))
    by = by.withColumn("ratio", F.col("limit") / F.col("weight"))
    every = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share
    after = every.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("level", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source, in this order, whose limit isn't below the level sets the level of all that follow
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    by = by.withColumn("common", F.first(fits, ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.col("weight") * F.col("common"), F.col("limit"))
    return by.select("source", "source_size", "n_docs", F.least(target, F.col("limit")).alias("target"))


def _class(size: Column) -> Column:
    """Bit length and leading bits: sizes within about an eighth of each other share a class."""
    bits = F.bin(size)
    return F.length(bits) * 16 + F.conv(F.substring(F.rpad(bits, 4, "0"), 1, 4), 2, 10).cast("int")


def _offset(seed: str) -> Column:
    """The source's random offset, in SCALE-ths of a copy: the same in each run."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long") % SCALE


def _placed(docs: DataFrame, weights, share: float, most: float, seed: str) -> DataFrame:
    """(k1, k2, size, source_size, target, rate, u, first): where each different row of ``docs`` lies on its source's line.

    ``first`` is the place of the first of the rows that are equal in doc_id, source and text; the others follow it.
    """
    k1, k2 = row_keys("doc_id", "source", "text")
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    size = word_count(F.col("text")).alias("size")
    sized = docs.select("source", size, h.alias("h"), F.col("doc_id").alias("id"), k1.alias("k1"), k2.alias("k2"))
    sized = stored(sized, "sizes")
    aims = targets(sized.select("source", "size"), weights, share, most)
    digits = max(1, min(8, math.ceil(math.log(sized.count() + 1, 256))))
    each = sized.groupBy("source", "size", "h", "id", "k1", "k2").agg(F.count(F.lit(1)).alias("m"))
    each = each.withColumn("c", _class(F.col("size"))).withColumn("p", F.substring("h", 1, digits))
    counted = each.groupBy("source", "c", "p").agg(F.sum("m").alias("n"))
    in_class = Window.partitionBy("source", "c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before_p", F.coalesce(F.sum("n").over(in_class), F.lit(0)))
    classes = counted.groupBy("source", "c").agg(F.sum("n").alias("nc"))
    in_source = Window.partitionBy("source").orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("before_c", F.coalesce(F.sum("nc").over(in_source), F.lit(0)))
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    facts = (
        counted.alias("k")
        .join(classes.alias("c"), F.expr("k.source <=> c.source and k.c = c.c"))
        .join(aims.alias("a"), F.expr("k.source <=> a.source"))
        .select(
            "k.source", "k.c", "k.p", (F.col("before_p") + F.col("before_c")).alias("before"), "source_size", "target",
            F.floor(rate * SCALE + 0.5).alias("rate"),
        )
    )
    in_piece = Window.partitionBy("source", "c", "p").orderBy("h", "id", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    rows = each.withColumn("here", F.coalesce(F.sum("m").over(in_piece), F.lit(0)))
    both = rows.alias("d").join(facts.alias("f"), F.expr("d.source <=> f.source and d.c = f.c and d.p = f.p"))
    both = both.select("d.*", "f.before", "f.source_size", "f.target", "f.rate").withColumn("u", _offset(seed))
    return both.select("k1", "k2", "size", "source_size", "target", "rate", "u", (F.col("here") + F.col("before") + 1).alias("first"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with a struct column ``mix``: size, source_size, target, copies (0 or more).

    Needs columns doc_id, text and source; all columns but one named mix pass through. A null source is a source, a
    null text has size 0. Rows that share a doc_id are ordered by a hash of their content; rows equal in doc_id, text
    and source are interchangeable. Two runs over equal rows give equal copies, whatever the partitions. An empty
    table gives an empty one. Places and rates are whole numbers (a rate in SCALE-ths of a copy), so that sums over
    any number of rows are exact: a document gets its rate rounded down or up, never more.
    """
    placed = stored(_placed(docs, weights, share, most, seed), "places")
    k1, k2 = row_keys("doc_id", "source", "text")
    both = packed(docs, ("mix",), k1=k1, k2=k2).join(placed.hint("merge"), ["k1", "k2"])
    place = F.col("first") + F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1", "k2")) - 1
    upto = lambda at: F.expr(f"(cast(rate as decimal(19,0)) * cast({at} as decimal(19,0)) + u) div {SCALE}")
    copies = upto("place") - upto("(place - 1)")
    out = F.struct("size", "source_size", "target", copies.cast("int").alias("copies"))
    return both.withColumn("place", place).select("row", out.alias("mix")).select("row.*", "mix")


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as it was drawn, without the column ``mix``."""
    drawn = packed(mixed, ("mix",), n=F.col("mix.copies")).where("n > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
