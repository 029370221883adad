"""Suffix-array dedup: bytes covered by long strings that also start elsewhere.

Every window of WIDTH bytes has one anchor: the least of the hashes of its short pieces (the last one of equals). The
anchor depends on the window's content alone, so equal windows have equal anchors at equal places. Windows that share
an anchor make a context of at most a few hundred bytes. Only contexts whose anchor is shared are looked at further:

* contexts that are equal as a whole are repeated, without another look;
* different contexts of one anchor go to suffix arrays (``suffixes``), in blocks of at most BLOCK contexts, cut to the
  windows whose core (what STEP neighbours have in common) another context of the block has; where an
  anchor has several blocks, the different windows of each are compared over blocks by hash, but for windows whose
  core (what STEP neighbours have in common) is in no other context.

Each grouping is by an anchor or a context, counts are partial sums, joins on hot keys can be split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import views
from .common import packed, remove, stored
from .shingling import _BYTES, mix, powers
from .suffixes import repeated_starts

WIDTH = 200
PIECE = 24
#: A window's anchor lies within its first SPAN places.
SPAN = WIDTH - PIECE + 1
#: Every window has at least so many bytes on one side of its anchor.
SIDE = (WIDTH - PIECE) // 2
BLOCK = 256
#: Windows of so many neighbouring places have a core in common.
STEP = 11
#: Texts are hashed together up to so many bytes; longer ones in parts.
PART = 1 << 20


def _parts(texts: list[bytes]):
    """Lists of (row, first byte, bytes) whose windows cover each window of each text once."""
    group, size = [], 0
    for row, t in enumerate(texts):
        for at in range(0, max(0, len(t) - WIDTH + 1), PART):
            piece = t if len(t) <= PART else t[at : at + PART + WIDTH - 1]
            if group and size + len(piece) > PART:
                yield group
                group, size = [], 0
            group.append((row, at, piece))
            size += len(piece)
    if group:
        yield group


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def contexts(parts: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """Contexts of some texts: row, lo (first window), hi (last), p (the anchor's place), anchor, whole, left and right (hashes), has_left, has_right."""
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    lengths = np.asarray([len(p) for _, _, p in parts])
    begins = np.concatenate([[0], np.cumsum(lengths)])
    sums, down = _hashes(data)
    span = lambda a, b: mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    n = len(data)
    at = np.arange(n - PIECE + 1)
    piece = span(at, at + PIECE)
    # order by hash, then later places first: high bits of the hash over the negated place
    key = (piece & ~np.uint64((1 << 24) - 1)) | (np.uint64((1 << 24) - 1) - at.astype(np.uint64))
    blocks = np.full(-(-len(key) // SPAN) * SPAN + SPAN, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(key)] = key
    table = blocks.reshape(-1, SPAN)
    upto = np.minimum.accumulate(table, axis=1).ravel()
    onward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.concatenate([np.arange(b, b + m - WIDTH + 1) for b, m in zip(begins, lengths)])
    least = np.minimum(onward[starts], upto[starts + SPAN - 1])
    anchor = (np.uint64((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1))).astype(np.int64)
    owner = np.searchsorted(begins, starts, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    lo, hi = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1]
    p, owner = anchor[first], owner[first]
    whole = mix(span(lo, hi + WIDTH) + mix(((p - lo) * 1024 + (hi - lo)).astype(np.uint64)))
    has_left, has_right = p - lo >= SIDE, p - hi < SIDE
    left = span(np.where(has_left, p - SIDE, p), p)
    right = span(p + PIECE, np.where(has_right, p + PIECE + SIDE, p + PIECE))
    shift = np.asarray([a for _, a, _ in parts])[owner] - begins[owner]
    return {
        "row": np.asarray([r for r, _, _ in parts])[owner], "lo": lo + shift, "hi": hi + shift, "p": p + shift, "anchor": piece[p],
        "whole": whole, "left": left, "right": right, "has_left": has_left, "has_right": has_right,
    }


def _text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text (together they name a row; rows equal in both get equal results) and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")


def _emit(docs: DataFrame, columns: str) -> DataFrame:
    """Contexts of all texts, with the wanted columns of doc_id, k, lo, hi, p, anchor, whole, l, r; hi and p count from lo."""
    names = columns.split()
    kinds = {"doc_id": "long", "k": "long", "lo": "long", "hi": "int", "p": "int", "anchor": "long", "whole": "long", "l": "int", "r": "int"}

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [(t.as_py() or "").encode() for t in part.column(2)]
                for group in _parts(texts):
                    c = contexts(group)
                    row = pa.array(c["row"])
                    made = {
                        "doc_id": lambda: part.column(0).take(row),
                        "k": lambda: part.column(1).take(row),
                        "lo": lambda: pa.array(c["lo"]),
                        "hi": lambda: pa.array((c["hi"] - c["lo"]).astype(np.int32)),
                        "p": lambda: pa.array((c["p"] - c["lo"]).astype(np.int32)),
                        "anchor": lambda: pa.array(c["anchor"].view(np.int64)),
                        "whole": lambda: pa.array(c["whole"].view(np.int64)),
                        "l": lambda: pa.array((c["left"] >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=~c["has_left"]),
                        "r": lambda: pa.array((c["right"] >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=~c["has_right"]),
                    }
                    yield pa.RecordBatch.from_arrays([made[n]() for n in names], names)

    return _text_rows(docs).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def _cores(found: DataFrame) -> DataFrame:
    """(anchor, whole, core, k) of contexts (anchor, whole, p, data).

    Windows with k * STEP to k * STEP + STEP - 1 bytes to the left of their anchor make class k; equal windows are in
    one class and have the bytes in common that all windows of the class hold, of which ``core`` is a hash.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, p = b.column(3).to_pylist(), b.column(2).to_numpy().astype(np.int64)
            lengths = np.asarray(list(map(len, data)))
            begins = np.cumsum(lengths) - lengths
            sums, down = _hashes(np.frombuffer(b"".join(data), np.uint8))
            first = (p - (lengths - WIDTH)) // STEP
            n = p // STEP - first + 1
            row = np.repeat(np.arange(len(data)), n)
            k = np.arange(len(row)) - (np.cumsum(n) - n)[row] + first[row]
            at = begins[row] + p[row]
            lo, end = at - STEP * k, at + PIECE + np.maximum(0, WIDTH - PIECE - STEP * k - STEP + 1)
            core = mix((sums[end] - sums[lo]) * down[lo] + k.astype(np.uint64))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(core.view(np.int64)), pa.array(k.astype(np.int32))], ["anchor", "whole", "core", "k"])

    return found.select("anchor", "whole", "p", "data").mapInArrow(run, "anchor long, whole long, core long, k int")


def alike_parts(data: list[bytes], places: list[int]) -> list[tuple[int, int, bytes]]:
    """(index, first byte, bytes) of the part of each context (bytes, anchor's place) whose classes have their core in another of these contexts.

    Classes and cores are as in ``_cores``, cores by their bytes; what is left out repeats in none of the others.
    """
    seen: dict[tuple[int, bytes], int] = {}
    classes = []
    for t, p in zip(data, places):
        own = []
        for k in range((p - len(t) + WIDTH) // STEP, p // STEP + 1):
            at = p - STEP * k
            own.append((k, t[at : p + PIECE + max(0, WIDTH - PIECE - STEP * k - STEP + 1)]))
        for c in own:
            seen[c] = seen.get(c, 0) + 1
        classes.append(own)
    out = []
    for i, (t, p, own) in enumerate(zip(data, places, classes)):
        shared = [k for k, core in own if seen[k, core] > 1]
        if shared:
            lo = max(0, p - STEP * shared[-1] - STEP + 1)
            out.append((i, lo, t[lo : p - STEP * shared[0] + WIDTH]))
    return out


def _blocks(found: DataFrame) -> DataFrame:
    """Suffix arrays over blocks of contexts (anchor, block, blocks, whole, p, near, data): (anchor, whole, lo, hi, digest).

    ``lo`` to ``hi`` are repeated windows of the context, with a null ``digest``; or, where the anchor has several
    blocks, one place of each different window in the block, with a digest to compare it by with other blocks; of
    these, only windows of the classes in the bits of ``near``.
    """

    def run(table: pa.Table) -> pa.Table:
        data = table.column("data").to_pylist()
        context, lo, hi = [], [], []
        parts = alike_parts(data, table.column("p").to_pylist())
        for (i, first, _), starts in zip(parts, repeated_starts([t for _, _, t in parts], WIDTH) if parts else ()):
            if starts:
                s = np.asarray(starts, np.int32) + np.int32(first)
                breaks = np.flatnonzero(np.diff(s) > 1)
                lo.append(s[np.concatenate([[0], breaks + 1])])
                hi.append(s[np.concatenate([breaks, [len(s) - 1]])])
                context.append(np.full(len(lo[-1]), i))
        digest = [np.zeros(sum(map(len, lo)), np.int64)]
        told = len(digest[0])
        if table.column("blocks")[0].as_py() > 1:
            bytes_ = np.frombuffer(b"".join(data), np.uint8)
            begins = np.cumsum([0, *map(len, data)])
            sums, down = _hashes(bytes_)
            at = np.concatenate([np.arange(b, b + len(t) - WIDTH + 1) for b, t in zip(begins, data)])
            of = np.searchsorted(begins, at, side="right") - 1
            place, near = (table.column(c).to_numpy().astype(np.int64) for c in ("p", "near"))
            at = at[(near[of] >> ((begins[of] + place[of] - at) // STEP)) & 1 == 1]
            names, first = np.unique(mix((sums[at + WIDTH] - sums[at]) * down[at]), return_index=True)
            owner = np.searchsorted(begins, at[first], side="right") - 1
            context.append(owner)
            lo.append((at[first] - begins[owner]).astype(np.int32))
            hi.append(lo[-1])
            digest.append(names.view(np.int64))
        flat = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        take, names = pa.array(flat(context, np.int64)), flat(digest, np.int64)
        return pa.table({
            "anchor": table.column("anchor").take(take), "whole": table.column("whole").take(take),
            "lo": pa.array(flat(lo, np.int32)), "hi": pa.array(flat(hi, np.int32)), "digest": pa.array(names, mask=np.arange(len(names)) < told),
        })

    return found.groupBy("anchor", "block").applyInArrow(run, "anchor long, whole long, lo int, hi int, digest long")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, k, lo, hi): runs of window starts, ``lo`` to ``hi`` included, whose WIDTH bytes also start elsewhere."""
    every = stored(_emit(docs, "anchor whole l r doc_id k lo hi p"), "all-contexts")
    shared = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(shared.select("anchor"), "anchors")
    seen = stored(every.join(shared.hint("merge"), "anchor"), "contexts")
    remove(docs.sparkSession, every)
    place = F.struct("doc_id", "k", "lo", "hi", "p")
    each = seen.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.first(place).alias("at"), F.first("l").alias("l"), F.first("r").alias("r"))
    each = stored(each, "different")
    equal = seen.join(each.where("n > 1").select("anchor", "whole").hint("merge"), ["anchor", "whole"])
    equal = equal.select("doc_id", "k", "lo", (F.col("lo") + F.col("hi")).alias("hi"))

    # of the others, those that share an anchor and one side of it with a different context; a window has SIDE bytes to
    # the left of its anchor or else more than SIDE to the right, so that those of a side that is not shared are alone
    sides = []
    for side in ("l", "r"):
        common = each.where(F.col(side).isNotNull()).groupBy("anchor", side).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        common = stored(common.select("anchor", side), "sides")
        sides.append(each.join(common.hint("merge"), ["anchor", side]).select("anchor", "whole", "at", F.lit(side).alias("side")))
    alike = sides[0].union(sides[1]).groupBy("anchor", "whole").agg(F.first("at").alias("at"), F.min("side").alias("from"), F.max("side").alias("to"))
    skipped = F.when(F.col("from") == "l", 0).otherwise(F.greatest(F.lit(0), F.col("at.p") - (SIDE - 1)))
    last = F.when(F.col("to") == "r", F.col("at.hi")).otherwise(F.least("at.hi", F.col("at.p") - SIDE))
    place = F.struct("at.doc_id", "at.k", (F.col("at.lo") + skipped).alias("lo"), (last - skipped).alias("hi"), (F.col("at.p") - skipped).alias("p"))
    alike = stored(alike.select("anchor", "whole", place.alias("at")), "alike")
    size = stored(alike.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "sizes")
    wanted = alike.join(size.hint("merge"), "anchor").withColumn("block", F.pmod(F.xxhash64("whole", F.lit(1)), F.col("blocks")).cast("int"))
    wanted = wanted.select("anchor", "whole", "block", "blocks", "at.*")
    cut = _text_rows(docs).alias("t").join(wanted.hint("merge").alias("w"), F.expr("t.doc_id <=> w.doc_id and t.k = w.k"))
    piece = F.expr(f"substring(cast(t.text as binary), cast(w.lo + 1 as int), w.hi + {WIDTH})")
    cut = cut.select("anchor", "whole", "block", "blocks", "p", piece.alias("data"))
    # rows that share doc_id and text bring a context more than once
    cut = stored(cut, "bytes").dropDuplicates(["anchor", "whole"])
    cores = stored(_cores(cut.where("blocks > 1")), "cores")
    common = stored(cores.groupBy("anchor", "core").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("anchor", "core"), "common")
    near = cores.join(common.hint("merge"), ["anchor", "core"]).groupBy("anchor", "whole").agg(F.expr("bit_or(shiftleft(1, k))").alias("near"))
    cut = cut.join(near.hint("merge"), ["anchor", "whole"], "left").fillna(0, ["near"])
    marks = stored(_blocks(cut), "marks")
    many = marks.where("digest is not null").groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    over = marks.join(stored(many.select("anchor", "digest"), "digests").hint("merge"), ["anchor", "digest"])
    runs = marks.where("digest is null").select("anchor", "whole", "lo", "hi").union(over.select("anchor", "whole", "lo", "hi"))
    once = alike.join(each.where("n = 1").select("anchor", "whole").hint("merge"), ["anchor", "whole"])
    alone = runs.hint("merge").join(once, ["anchor", "whole"])
    alone = alone.select("at.doc_id", "at.k", (F.col("at.lo") + F.col("lo")).alias("lo"), (F.col("at.lo") + F.col("hi")).alias("hi"))
    return equal.union(alone)


def removed_runs(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (first byte, end) covered by windows at the given runs of starts."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + WIDTH)
        else:
            out.append([lo, hi + WIDTH])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with columns n_bytes, n_removed, n_spans and kept_bytes.

    Removed is each byte covered by a string of WIDTH bytes that also starts anywhere else in the table: in another
    row, a repeated row included, or in the same text. A null text is empty, and nothing shorter than WIDTH bytes is
    touched. Columns of the new names are replaced, others pass through, whatever their names. Rows that repeat get
    equal results, and an empty table gives an empty one. Needs doc_id and text.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
    runs = repeated_windows(docs).groupBy("doc_id", "k").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("runs"))
    runs = stored(runs, "runs")
    sent = packed(docs, new, doc=F.col("doc_id").cast("long"), h=F.xxhash64("text"))
    sent = sent.join(runs.hint("merge"), F.expr("doc <=> doc_id and h = k"), "left").select("row", "runs.lo", "runs.hi")
    at_text = next(i for i, f in enumerate(sent.schema["row"].dataType) if f.name.lower() == "text")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows = []
                for lo, hi, data in zip(b.column(1), b.column(2), views(b.column(0).field(at_text))):
                    text = data.tobytes()
                    spans = removed_runs(list(zip(lo.as_py() or [], hi.as_py() or [])))
                    kept, last = [], 0
                    for a, e in spans:
                        kept.append(text[last:a])
                        last = e
                    kept.append(text[last:])
                    rows.append((len(text), sum(e - a for a, e in spans), len(spans), b"".join(kept)))
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], ["row", *new])

    schema = StructType([sent.schema["row"], *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_bytes binary")])
    return sent.mapInArrow(run, schema).select("row.*", *new)
