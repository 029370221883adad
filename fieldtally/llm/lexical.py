"""Ranked lexical search by a threshold-seeded join.

Documents are indexed once: a posting for each document and term, and for each term its weight, its largest impact (what
the term adds to a score at most) and its k-th largest. An item's k-th score is at least the k-th impact of any of its
terms: k documents reach that with this term alone. Sums over an item's few strongest terms raise this threshold further,
since they too are lower bounds of scores. Sorted by largest impact, the terms at the weak end whose largest impacts sum
up to less than the threshold can bring no document into the result on their own: only postings of the others make
candidates. A candidate whose sum, with all that the weak terms could add, stays below the threshold, or below the k-th of
these sums, goes; the rest are scored exactly from the index.

Terms are the maximal runs of ASCII letters and digits and of all code points from U+0080, A-Z in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: Strongest terms of an item whose sums raise the threshold.
SEEDS = 8
#: Rows of a table of items' terms up to which it is sent to all tasks; a larger one is joined by shuffles.
SMALL = 200_000


@dataclass(frozen=True)
class Index:
    """``postings``: row, doc_id, term, tf, m. ``terms``: term, weight, kth and top (impacts). ``asked``: item, item_id, term."""

    postings: DataFrame
    terms: DataFrame
    asked: DataFrame
    n_asked: int


def terms_of(text: Column) -> Column:
    """Terms of a text, in order, with repeats; none for a null."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _near(table: DataFrame, n: int) -> DataFrame:
    """A table of n rows for a join: sent to all tasks only if it is small."""
    return F.broadcast(table) if n <= SMALL else table.hint("merge")


def impact(weight: Column, tf: Column, m: Column) -> Column:
    """What a term adds to a score; whole numbers."""
    return weight * F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)")


def index(docs: DataFrame, items: DataFrame, k: int = TOP) -> Index:
    """The index of ``docs`` (doc_id, text) for the terms of ``items`` (item_id, text), stored.

    Every row is a document of its own, also where rows repeat; one without a term counts nowhere. Counts and
    statistics are of all documents, postings of the terms that are asked for.
    """
    asked = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.array_distinct(terms_of(F.col("text"))).alias("words"))
    asked = stored(asked.select("item", "item_id", F.explode("words").alias("word")), "asked")
    # the empty word stands for the document itself: its posting is there once, with or without terms that are asked for
    known = asked.select("word").distinct().union(docs.sparkSession.range(1).select(F.lit("").alias("word")))
    known = stored(known.withColumn("term", F.monotonically_increasing_id()), "known-terms")
    own = known.where("word = ''").first().term
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", terms_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    each = found.select("row", "doc_id", F.size("words").cast("long").alias("n"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("word"))
    each = each.join(_near(known, known.count()), "word").groupBy("row", "doc_id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    # a document's postings lie together, so that sums over them are small before they are shuffled
    counted = stored(each.repartition("row"), "counted")
    total = counted.where(F.col("term") == own).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    m = F.expr(f"50 + (50 * n * {total.docs}) div {max(1, total.terms or 0)}")
    postings = counted.where(F.col("term") != own).select("row", "doc_id", "term", "tf", m.alias("m"))
    # impacts depend on tf and m alone, so a term's k-th is found from counts of these
    shapes = stored(postings.groupBy("term", "tf", "m").agg(F.count(F.lit(1)).alias("n")), "shapes")
    weights = shapes.groupBy("term").agg(F.floor(1000 * F.log(F.lit(2.0 * total.docs + 2) / (2 * F.sum("n") + 1))).cast("long").alias("weight"))
    valued = shapes.join(weights.hint("merge"), "term").withColumn("impact", impact(F.col("weight"), F.col("tf"), F.col("m")))
    upto = F.sum("n").over(Window.partitionBy("term").orderBy(F.col("impact").desc()))
    terms = valued.withColumn("upto", upto).groupBy("term").agg(
        F.first("weight").alias("weight"), F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("impact"))), F.lit(0)).alias("kth"), F.max("impact").alias("top")
    )
    terms = stored(terms, "terms")
    remove(docs.sparkSession, shapes)
    asked = stored(asked.join(known, "word").select("item", "item_id", "term"), "asked-terms")
    return Index(postings, terms, asked, asked.count())


def _sums(ix: Index, wanted: DataFrame) -> DataFrame:
    """(item, row, least, sum): impacts of the wanted (item, term, weight, least), by item and document."""
    both = ix.postings.join(_near(wanted, ix.n_asked), "term")
    return both.groupBy("item", "row", "least").agg(F.sum(impact(F.col("weight"), F.col("tf"), F.col("m"))).alias("sum"))


def search(ix: Index, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score for each item, best first.

    ``k`` is that of the index or smaller. Only scores above 0; of equal ones the smallest doc_id comes first (a null last). A null item or document has no
    terms, and so no rows; items that repeat have rows of their own each, as do documents. Empty tables give none.
    """
    item = Window.partitionBy("item")
    terms = ix.asked.join(ix.terms, "term").withColumn("least", F.max("kth").over(item))
    terms = terms.withColumn("place", F.row_number().over(item.orderBy(F.col("top").desc(), "term")))
    terms = stored(terms, "item-terms")
    # the k-th sum over the strongest terms is a lower bound as well
    seeds = _sums(ix, terms.where(F.col("place") <= SEEDS).select("item", "term", "weight", "least"))
    best = seeds.withColumn("r", F.row_number().over(item.orderBy(F.col("sum").desc()))).where(F.col("r") <= k)
    raised = best.groupBy("item").agg(F.min(F.when(F.col("r") == k, F.col("sum"))).alias("raised"))
    terms = terms.join(raised, "item", "left").withColumn("least", F.greatest("least", F.coalesce("raised", F.lit(0))))
    # from the weak end: what all terms up to here could add
    weak = F.sum("top").over(item.orderBy(F.col("place").desc()))
    terms = terms.withColumn("upto", weak).withColumn("strong", F.col("upto") >= F.col("least"))
    rest = F.coalesce(F.max(F.when(~F.col("strong"), F.col("upto"))).over(item), F.lit(0))
    terms = terms.withColumn("rest", rest).withColumn("least", F.greatest(F.col("least") - F.col("rest"), F.lit(1)))
    terms = stored(terms, "bounded-terms")
    found = _sums(ix, terms.where("strong").select("item", "term", "weight", "least")).where(F.col("sum") >= F.col("least"))
    # the k-th of these sums bounds the k-th score once more; what the weak terms add can't make up for less than that
    found = stored(found, "sums")
    best = found.withColumn("r", F.row_number().over(item.orderBy(F.col("sum").desc()))).where(F.col("r") <= k)
    last = best.groupBy("item").agg(F.min(F.when(F.col("r") == k, F.col("sum"))).alias("last"))
    last = last.join(terms.groupBy("item").agg(F.first("rest").alias("rest")), "item").select("item", (F.col("last") - F.col("rest")).alias("need"))
    found = found.join(_near(last, ix.n_asked), "item").where(F.col("need").isNull() | (F.col("sum") >= F.col("need")))
    found = stored(found.select("item", "row"), "candidates")
    # all postings of the candidates, and of these the item's terms
    exact = ix.postings.join(found.hint("merge"), "row").join(_near(terms.select("item", "item_id", "term", "weight"), ix.n_asked), ["item", "term"])
    exact = exact.groupBy("item", "item_id", "row", "doc_id").agg(F.sum(impact(F.col("weight"), F.col("tf"), F.col("m"))).alias("score"))
    rank = F.row_number().over(item.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"))
    return exact.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
