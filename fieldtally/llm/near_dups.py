"""Near-duplicates by an LSH forest of MinHash signatures.

A document is the set of its 5-word shingles. Each tree sorts all different sets by a signature of DEPTH values
(range-partitioned, so that no order is in one task), and every set gets the length of the prefix that it has in common
with its neighbours in that order. A run of neighbours with DEPTHS[0] values in common is a region. Its depth adapts:
a region of more than DENSE sets is cut where neighbours have fewer than DEPTHS[1], then DEPTHS[2] values in common, and
sets of such regions are sorted in MORE further trees at that depth. Candidates are the pairs inside the regions that
result; they are confirmed on full sets.

A pair at a similarity of 0.85 is missed with a probability below 1e-6 either way: (1 - 0.85^4)^20 = 4e-7 where no region
is dense, (1 - 0.85^6)^30 = 7e-7 at the most where some are.

Nothing is expanded into all pairs of a group. Equal sets are one set from the start. Regions of up to SMALL sets list
their pairs. Larger ones are read in chunks of at most CHUNK neighbours, whose links are found at once; those links make
components. What a region still has to show are links between different components: its largest component is the hub,
and only sets outside of it are compared with the others. A region of copies is one component by then, and costs no
more than its chunks did.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, packed, remove, stored
from .components import components
from .shingling import grouped, mix, shingle_sets

TREES, MORE, DEPTHS = 20, 10, (4, 5, 6)
DEPTH = DEPTHS[-1]
SMALL, DENSE, CHUNK = 8, 512, 128
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, (TREES + MORE) * DEPTH, dtype=np.uint64) | np.uint64(1)


def _signature(shingles: np.ndarray) -> bytes:
    """For each tree, DEPTH least hashes of 32 bits."""
    least = np.full(len(_FACTORS), (1 << 32) - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        hashes = (shingles[at : at + 4096, None] * _FACTORS) >> np.uint64(32)
        np.minimum(least, hashes.min(axis=0), out=least)
    return least.astype(">u4").tobytes()


def _key(shingles: np.ndarray) -> bytes:
    """128-bit name of a set."""
    parts = (mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return b"".join(int(mix(np.asarray([p + np.uint64(len(shingles))], np.uint64))[0]).to_bytes(8, "big") for p in parts)


def _texts(column) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in column]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, key (null for an empty set) and signature of each row."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = [s for g in grouped(_texts(b.column(2))) for s in shingle_sets(g)]
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([_signature(s) if len(s) else None for s in sets], pa.binary()),
                ], ["doc_id", "h", "n_shingles", "key", "signature"])

    sent = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return sent.mapInArrow(run, "doc_id long, h long, n_shingles long, key binary, signature binary")


def _node(doc_id: Column, key: Column) -> Column:
    """Name of a class that sorts by its least doc_id, nulls last, and holds it."""
    place = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(str(-(1 << 63))).cast("long"))), 16, "0")
    return F.concat(F.when(doc_id.isNull(), F.lit("1" + "0" * 16)).otherwise(F.concat(F.lit("0"), place)), F.hex(key))


def _least_id(node: Column) -> Column:
    """The least doc_id that a name holds."""
    value = F.conv(F.substring(node, 2, 16), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.startswith(node, F.lit("0")), value.cast("long"))


def _order(classes: DataFrame, trees: range, least: int) -> DataFrame:
    """(part, place, sig, node) of the sets that have ``least`` values in common with a neighbour in an order.

    ``sig`` is the tree's number and signature. Orders are cut into ranges of rows; at the ends of a range, where one
    neighbour is in another task, a set stays.
    """
    width = 4 * DEPTH
    each = F.transform(
        F.sequence(F.lit(trees.start), F.lit(trees.stop - 1)),
        lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 8, "0")), F.substring(F.col("signature"), t * width + 1, F.lit(width))),
    )
    rows = classes.select(F.explode(each).alias("sig"), "node")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "sig", "node").sortWithinPartitions("sig", "node")

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of values that rows have in common from the first on; -1 in different trees."""
        return np.cumprod(a == b, axis=1).sum(axis=1) - 1

    def run(batches):
        part, place, held = TaskContext.get().partitionId(), 0, None  # the last row waits for its neighbour
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held[0], b]).combine_chunks().to_batches()[0]
            sig = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u4").reshape(-1, DEPTH + 1)
            both = common(sig[1:], sig[:-1])
            before = np.concatenate([[DEPTH if held is None else held[1]], both])
            near = np.maximum(before[:-1], both) >= least
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(near.sum(), part, np.int32)), pa.array(place + np.flatnonzero(near)), *b.slice(0, len(near)).filter(pa.array(near)).columns
            ], ["part", "place", "sig", "node"])
            place += len(near)
            held = (b.slice(len(near)), int(before[-1]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place]), *held[0].columns], ["part", "place", "sig", "node"])

    return stored(rows.mapInArrow(run, "part int, place long, sig binary, node string"), "order")


def _runs(rows: DataFrame, depth: int) -> DataFrame:
    """``rows`` of an order with ``region`` (a hash of tree and prefix) and ``n``, its sets; those of two sets or more."""
    rows = rows.drop("region", "n").withColumn("region", F.xxhash64(F.lit(depth), F.substring("sig", 1, 4 + 4 * depth)))
    size = stored(rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "region-sizes")
    return stored(rows.join(size.hint("merge"), "region"), "regions")


def _regions(classes: DataFrame) -> DataFrame:
    """(region, n, part, place, node) of all regions with two sets or more, cut deeper where they are dense."""
    rows, done, dense = _runs(_order(classes, range(TREES), DEPTHS[0]), DEPTHS[0]), [], None
    for depth in DEPTHS[1:]:
        done.append(rows.where(F.col("n") <= DENSE))
        rows = rows.where(F.col("n") > DENSE)
        if dense is None:
            dense = stored(rows.select("node").distinct(), "dense")
        rows = _runs(rows, depth)
    done.append(rows)
    further = classes.join(dense.hint("merge"), "node", "left_semi")
    done.append(_runs(_order(further, range(TREES, TREES + MORE), DEPTH), DEPTH))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("region", "n", "part", "place", "node")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _pair_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) whose full sets are similar enough."""
    both = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.hint("merge").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches):
        for b in batches:
            read = [np.frombuffer(s.as_py(), np.uint64) for s in b.column(2)], [np.frombuffer(s.as_py(), np.uint64) for s in b.column(3)]
            yield b.select(["a", "b"]).filter(pa.array([_linked(x, y, percent) for x, y in zip(*read)], pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a string, b string")


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of ``left`` and of ``right`` that hold their components together, by full sets."""
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part[left] @ part[right].T
    sizes = np.asarray(list(map(len, sets)), np.float64)
    linked = 100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = int(left[i]), int(right[j])
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _grouped_links(dealt: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): links inside groups of ``keys`` between sets ``mine`` and sets ``theirs``; a set may be both."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        nodes, left, right = g["node"].to_numpy(), np.flatnonzero(g["mine"]), np.flatnonzero(g["theirs"])
        found = block_links([np.frombuffer(s, np.uint64) for s in g["shingles"]], left, right, percent) if len(left) and len(right) else []
        return pd.DataFrame([(nodes[a], nodes[b]) for a, b in found], columns=["a", "b"], dtype=object)

    return dealt.select(*keys, "node", "shingles", "mine", "theirs").groupBy(*keys).applyInPandas(run, "a string, b string")


def _chunk_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between neighbours: sets of a region and of one chunk of its order."""
    dealt = rows.withColumn("chunk", F.floor(F.col("place") / CHUNK)).hint("merge").join(sets, "node")
    return _grouped_links(dealt.withColumns({"mine": F.lit(True), "theirs": F.lit(True)}), ["region", "part", "chunk"], percent)


def _hub_links(rows: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside regions between components (node, label): of sets outside a region's hub, with all of the region."""
    label = F.coalesce("label", "node")
    rows = stored(rows.hint("merge").join(found, "node", "left").select("region", "n", "node", label.alias("label")), "labelled")
    by = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    hub = by.groupBy("region").agg(F.max_by("label", F.struct("m", "label")).alias("hub"), (F.first("n") - F.max("m")).alias("out"))
    hub = stored(hub.where("out > 0"), "hubs")
    dealt = rows.join(hub.hint("merge"), "region").withColumn("out?", F.col("label") != F.col("hub"))
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(n / CHUNK)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.ceil(n / CHUNK).cast("int") - 1)
    # every set meets each block of sets that are outside the hub; those are themselves in one such block
    pairs = F.flatten(F.array(
        F.transform(each(F.col("out")), lambda j: F.struct(part(F.col("n"), 1).alias("i"), j.alias("j"), F.lit(True).alias("theirs"))),
        F.when(F.col("out?"), F.transform(each(F.col("n")), lambda i: F.struct(i.alias("i"), part(F.col("out"), 2).alias("j"), F.lit(False).alias("theirs")))).otherwise(F.array()),
    ))
    dealt = dealt.select("region", "node", "out?", F.inline(pairs))
    dealt = dealt.groupBy("region", "i", "j", "node").agg(F.max(~F.col("theirs")).alias("mine"), F.max("theirs").alias("theirs"))
    return _grouped_links(stored(dealt, "hub-blocks").hint("merge").join(sets, "node"), ["region", "i", "j"], percent)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted classes (node, doc_id, h, key), each from the text of one of its documents.

    Joined by doc_id and the text's hash: however many rows share a doc_id, or have none, a class meets only its own text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").alias("d")
    by = F.expr("d.h = w.h and d.doc_id <=> w.doc_id")
    found = texts.join(wanted.select("doc_id", "h", "key", "node").hint("merge").alias("w"), by).select("text", "key", "node")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = [s for g in grouped(_texts(b.column(0))) for s in shingle_sets(g)]
                own = [len(s) > 0 and _key(s) == k.as_py() for s, k in zip(sets, b.column(1))]
                made = pa.RecordBatch.from_arrays([b.column(2), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])
                yield made.filter(pa.array(own, pa.bool_()))

    return found.mapInArrow(run, "node string, shingles binary").dropDuplicates(["node"])


def group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links, the own one included; ``kept`` says whether it is the
    row's own. A null text, or one without words, has no shingles and no links: it is kept. Rows with equal sets are
    linked; rows that share a doc_id are judged one by one. A null doc_id counts as larger than any other; a group of
    such rows alone has a null component_id and keeps all. An empty table gives an empty one. Of ``docs``, only doc_id
    and text are read.
    """
    spark = docs.sparkSession
    rows = stored(features(docs), "features")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")
    classes = rows.where("key is not null").groupBy("key").agg(least, F.first("signature").alias("signature"))
    classes = classes.select("key", "least.doc_id", "least.h", "signature")
    classes = stored(classes.withColumn("node", _node(F.col("doc_id"), F.col("key"))), "classes")
    regions = stored(_regions(classes.select("node", "signature")), "all-regions")
    small = regions.where(F.col("n") <= SMALL).groupBy("region").agg(F.array_sort(F.collect_list("node")).alias("m"))
    pair = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = stored(small.select(F.inline(pair)).distinct(), "pairs")
    large = regions.where(F.col("n") > SMALL)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    sets = stored(_sets(docs, classes.drop("signature").join(nodes.hint("merge"), "node")), "sets")
    links = stored(_pair_links(pairs, sets, percent).union(_chunk_links(large, sets, percent)), "links")
    found = stored(components(links), "components")
    over = stored(_hub_links(large, found, sets, percent), "hub-links")
    if not over.isEmpty():
        # components that are linked in a region become one: each node follows its label
        name = lambda c: found.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        ends = over.hint("merge").join(name("a"), "a", "left").hint("merge").join(name("b"), "b", "left")
        ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        higher = stored(components(stored(ends, "component-links")).toDF("label", "top"), "higher")
        found = found.join(higher.hint("merge"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        alone = higher.withColumnRenamed("label", "node").join(found.hint("merge"), "node", "left_anti")
        found = found.union(alone.select("node", F.col("top").alias("label")))
    named_ = stored(classes.drop("signature").join(found.hint("merge"), "node", "left").select("key", F.coalesce(_least_id(F.col("label")), "doc_id").alias("least")), "named")
    for done in (regions, pairs, sets, links, over):
        remove(spark, done)
    out = rows.select("doc_id", "n_shingles", "key").hint("merge").join(named_, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each group, those with its smallest doc_id. All columns pass through."""
    kept = stored(group(docs, percent).where("kept").select(F.col("doc_id").alias("id")).distinct(), "kept")
    rows = packed(docs, doc=named("doc_id").cast("long"))
    return rows.join(kept.hint("merge"), F.expr("doc <=> id"), "left_semi").select("row.*")
