"""A Merkle manifest of a dataset: a digest tree by source, and a proof for every document.

Leaves are dealt into aligned blocks of ARITY ** LEVELS neighbours. A block's nodes are visited in postorder: a subtree
returns its digest and, while the recursion unwinds, appends the siblings of each child to all leaves that the child
contains. The blocks' roots are again numbered nodes and go through the same traversal, distributed as before, until each
source has one; sources' roots are then the leaves of the last tree. Paths come down again by a join of each block's
nodes with its root, so no join has more rows for a key than a block has nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import named, packed, stored

#: Columns of a document that its leaf covers, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
#: Rows that a traversal sends on together, but for a larger block.
SENT = 2048
PATH = "array<struct<before: string, after: string>>"


def leaf(**changed: Column) -> Column:
    """Digest of a document's COLUMNS: ``-`` for a null, else UTF-8 byte count, ``:`` and value. ``changed``: other values by name."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, COLUMNS)), 256)


def traverse(digests: list[str], levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Digest of a block after so many levels, and each node's path: siblings before and after it, level by level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in digests]

    def visit(first: int, level: int) -> str:
        if level == 0:
            return digests[first]
        width = ARITY ** (level - 1)
        starts = range(first, min(first + ARITY * width, len(digests)), width)
        found = [visit(s, level - 1) for s in starts]
        for i, s in enumerate(starts):
            beside = ("".join(found[:i]), "".join(found[i + 1 :]))
            for path in paths[s : s + width]:
                path.append(beside)
        return hashlib.sha256("".join(found).encode()).hexdigest()

    return visit(0, levels), paths


def height(n: int) -> int:
    """Levels until n nodes are one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (g, id, digest, row) with ``at``, their place from 0 in the group g by id (nulls first) and digest, and the group's size n.

    Rows are dealt by ranges and numbered within them; sums of the ranges' counts make places. Equal rows are dealt by
    their place in the table, so that no number of them meets in one task.
    """
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    order = ("g", F.col("id").asc_nulls_first(), "digest", "salt")
    dealt = stored(salted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("g", "part").agg(F.count(F.lit(1)).alias("here"))
    group = Window.partitionBy("g").orderBy("part")
    before = F.sum("here").over(group.rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")
    whole = F.sum("here").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    counts = counts.select("g", "part", before.alias("before"), whole.alias("n"))
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order[1:]))
    both = dealt.withColumn("place", place).join(counts.hint("merge"), ["g", "part"])
    return both.select("g", (F.col("place") - 1 + F.col("before")).alias("at"), "n", "digest", "row")


def _traversed(nodes: DataFrame) -> DataFrame:
    """Nodes (g, at, n, digest, row) with their path within the block; ``top``, the block's digest, stands at its first node only."""
    sent = nodes.withColumn("block", F.expr(f"at div {BLOCK}"))
    sent = sent.repartition("g", "block").sortWithinPartitions("g", "block", "at").select("g", "at", "n", "digest", "block", "row")
    schema = StructType([*(sent.schema[c] for c in ("g", "block", "n", "row")), *StructType.fromDDL(f"top string, path {PATH}")])

    def run(batches):
        # blocks of which all nodes are here; the last one may go on in the next batch
        out, size, block, key = [], 0, [], None

        def close():
            rows = pa.Table.from_batches(block)
            top, paths = traverse(rows["digest"].to_pylist(), min(LEVELS, height(rows["n"][0].as_py())))
            steps = [s for p in paths for s in p]
            beside = pa.StructArray.from_arrays([pa.array([s[i] for s in steps], pa.string()) for i in (0, 1)], ["before", "after"])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in paths])]), pa.int32())
            rows = rows.select(["g", "block", "n", "row"]).append_column("top", pa.array([top] + [None] * (len(paths) - 1), pa.string()))
            out.append(rows.append_column("path", pa.ListArray.from_arrays(offsets, beside)))

        for b in batches:
            groups, blocks = b.column("g").to_pylist(), b.column("block").to_pylist()
            start = 0
            for i in range(b.num_rows):
                now = (groups[i], blocks[i])
                if now != key:
                    if i > start:
                        block.append(b.slice(start, i - start))
                    if block:
                        close()
                        size += out[-1].num_rows
                    block, key, start = [], now, i
                    if size >= SENT:
                        yield from pa.concat_tables(out).combine_chunks().to_batches()
                        out, size = [], 0
            block.append(b.slice(start))
        if block:
            close()
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return sent.mapInArrow(run, schema)


def _risen(nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes (g, at, n, digest, row) to rows (row, path, tops).

    ``above`` takes the groups' last nodes (g, digest) and returns (g, path, tops): how it goes on from there.
    """
    done = stored(_traversed(nodes), "traversed")
    roots = done.where(F.col("top").isNotNull())
    roots = roots.select("g", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
    if (roots.agg(F.max("n")).first()[0] or 0) > 1:
        upper = _risen(roots.withColumn("row", F.struct("g", "at")), above).select("row.g", "row.at", "path", "tops")
    else:
        upper = roots.select("g", "at").join(above(roots.select("g", "digest")), "g")
    upper = upper.select("g", F.col("at").alias("block"), F.col("path").alias("rest"), "tops")
    both = done.join(upper.hint("merge"), ["g", "block"])
    return both.select("row", F.concat("path", "rest").alias("path"), "tops")


def manifest(docs: DataFrame) -> DataFrame:
    """``docs`` with columns subroot, root and path (siblings before and after, from the leaf to the root).

    Needs columns doc_id, source and leaf (a digest in lowercase hex). A null source is one, and comes first, as does a
    null doc_id. Rows that share a doc_id are ordered by their leaves; rows equal in both are leaves of their own, in any
    order. An empty table gives an empty one. Columns of these names are replaced, all others pass through, whatever their
    names; keep texts out of ``docs``, since its rows are shuffled.
    """
    def sources(tops: DataFrame) -> DataFrame:
        """Sources' roots as the leaves of the last tree."""
        rows = tops.select(F.lit("").alias("g"), F.col("g").alias("id"), "digest", F.struct("g", F.col("digest").alias("subroot")).alias("row"))
        end = lambda t: t.select("g", F.array().cast(PATH).alias("path"), F.col("digest").alias("tops"))
        risen = _risen(_numbered(rows), end)
        return risen.select("row.g", "path", F.struct("row.subroot", F.col("tops").alias("root")).alias("tops"))

    g = F.coalesce(F.concat(F.lit("s"), named("source")), F.lit(""))
    rows = packed(docs, ("subroot", "root", "path"), g=g, id=named("doc_id"), digest=named("leaf"))
    return _risen(_numbered(rows), sources).select("row.*", "tops.subroot", "tops.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda x, s: F.sha2(F.concat(s["before"], x, s["after"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)
