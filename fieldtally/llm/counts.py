"""Edit-aware token counts.

A document's text is cut into leaves at pre-token boundaries; a segment tree keeps code points and tokens of each
subtree. ``plant`` encodes the texts once and stores each document's leaves as a column of the table. ``revise`` takes
such a table and edits: it puts the tree up again from the stored leaves, without encoding them, and re-encodes only
the leaves that an edit touches and the leaf before them, on until a pre-token boundary of the new text falls on one of
the old text. Sums change on the paths from those leaves to the root alone, also where the number of leaves changes:
the tree is cut at the touched leaves and joined again. The leaves that result can be stored for later edits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .bpe import CHUNK, PRE_TOKEN_LOOKAHEAD, Encoder, encoder, text_chunks, views
from .common import named, packed

#: Code points that a leaf has at least, but for the last one.
LEAF = 128
#: Code points of texts whose pre-tokens are counted together.
TOGETHER = 1 << 19
LEAVES = "array<struct<chars: int, tokens: int>>"
ARROW_LEAVES = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
ARROW = {"bigint": pa.int64(), "string": pa.string()}


class Node:
    """A leaf with the sums of its subtree. ``rank`` is random and larger than those below, which keeps trees flat."""

    __slots__ = ("text", "own", "rank", "left", "right", "chars", "tokens")
    made = 0

    def __init__(self, text: str, tokens: int):
        Node.made += 1
        self.text, self.own, self.left, self.right = text, tokens, None, None
        self.rank = Node.made * 0x9E3779B97F4A7C15 & 0xFFFFFFFF
        self.chars, self.tokens = len(text), tokens

    def pull(self) -> Node:
        """Sums from the children's."""
        self.chars, self.tokens = len(self.text), self.own
        for child in (self.left, self.right):
            if child is not None:
                self.chars += child.chars
                self.tokens += child.tokens
        return self


def join(a: Node | None, b: Node | None) -> Node | None:
    """The tree with the leaves of ``a``, then those of ``b``."""
    if a is None or b is None:
        return a if b is None else b
    if a.rank > b.rank:
        a.right = join(a.right, b)
        return a.pull()
    b.left = join(a, b.left)
    return b.pull()


def split(t: Node | None, chars: int) -> tuple[Node | None, Node | None]:
    """The leaves that begin before a place, which is a leaf's boundary, and the others."""
    if t is None:
        return None, None
    here = t.left.chars if t.left is not None else 0
    if here < chars:
        t.right, behind = split(t.right, chars - here - len(t.text))
        return t.pull(), behind
    before, t.left = split(t.left, chars)
    return before, t.pull()


def leaf_at(t: Node, char: int) -> tuple[int, int]:
    """Where the leaf that holds a code point begins and ends."""
    first = 0
    while True:
        here = t.left.chars if t.left is not None else 0
        if char < here:
            t = t.left
        elif char < here + len(t.text) or t.right is None:
            return first + here, first + here + len(t.text)
        else:
            first += here + len(t.text)
            char -= here + len(t.text)
            t = t.right


def leaves_of(t: Node | None) -> Iterator[Node]:
    """Leaves from left to right."""
    path = []
    while path or t is not None:
        while t is not None:
            path.append(t)
            t = t.left
        t = path.pop()
        yield t
        t = t.right


def tree_of(leaves: Iterable[tuple[str, int]]) -> Node | None:
    """A tree of leaves (text, tokens)."""
    path: list[Node] = []  # the right edge, from the root down
    for text, tokens in leaves:
        node, below = Node(text, tokens), None
        while path and path[-1].rank < node.rank:
            below = path.pop().pull()
        node.left = below
        if path:
            path[-1].right = node
        path.append(node)
    root = None
    while path:
        root = path.pop().pull()
    return root


class CountTree:
    """Counts of one text. ``reencoded`` is the number of code points that were encoded since the tree was put up."""

    def __init__(self, e: Encoder, leaves: Iterable[tuple[str, int]] = ()):
        self.e, self.reencoded = e, 0
        self.look = max(PRE_TOKEN_LOOKAHEAD, *map(len, e.v.special), 0)
        self.root = tree_of(leaves)

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root is not None else 0

    @property
    def n_chars(self) -> int:
        return self.root.chars if self.root is not None else 0

    def leaves(self) -> Iterator[tuple[str, int]]:
        return ((n.text, n.own) for n in leaves_of(self.root))

    def edit(self, start: int, length: int, text: str) -> None:
        """Replace ``length`` code points at ``start`` by ``text``; both are clipped to the text there is."""
        n = self.n_chars
        start = min(max(0, start), n)
        length = min(max(0, length), n - start)
        if self.root is None:
            self.root, self.reencoded = tree_of(cut(self.e, text)), self.reencoded + len(text)
            return
        # a leaf's start stands if the edit is beyond all that this boundary can depend on
        first = leaf_at(self.root, max(0, start - 1 - self.look))[0]
        stop = leaf_at(self.root, min(n - 1, start + length))[1]
        before, rest = split(self.root, first)
        touched, after = split(rest, stop - first)
        old = "".join(t.text for t in leaves_of(touched))
        more = 1
        while True:
            new = old[: start - first] + text + old[start - first + length :]
            grown = cut(self.e, new, self._head(after))
            self.reencoded += len(new)
            if grown is not None:
                break
            for _ in range(more):  # twice as many leaves each time, so that one long pre-token costs no more than its size
                if after is not None:
                    taken, after = split(after, leaf_at(after, 0)[1])
                    old += taken.text
            more *= 2
        self.root = join(join(before, tree_of(grown)), after)

    def _head(self, t: Node | None) -> str:
        """The first code points of a subtree, as many as a boundary can depend on."""
        out = ""
        for leaf in leaves_of(t):
            out += leaf.text[: self.look + 1 - len(out)]
            if len(out) > self.look:
                break
        return out


def cut(e: Encoder, text: str, behind: str = "") -> list[tuple[str, int]] | None:
    """Leaves (text, tokens) of a text that begins at a pre-token boundary and is followed by ``behind``.

    None if the text's end is no pre-token boundary there. A leaf also ends with what was read at once.
    """
    whole = text + behind if behind else text
    return _leaves_from(e, whole, len(text), read(e, whole))


def read(e: Encoder, text: str) -> Iterator[tuple[list[str], bool]]:
    """Pre-tokens of a text, some at a time, and whether they are a special token."""
    return e.lists((text[i : i + CHUNK], i + CHUNK >= len(text)) for i in range(0, len(text), CHUNK))


def cut_all(e: Encoder, texts: Iterable[str]) -> Iterator[list[tuple[str, int]]]:
    """Leaves of whole texts. The pre-tokens of texts that are short enough to be held are counted together."""
    held, size = [], 0

    def done() -> list[list[tuple[str, int]]]:
        e.counts.learn(set().union(*[found for _, lists in held for found, special in lists if not special]))
        return [_leaves_from(e, t, len(t), lists) for t, lists in held]

    for text in texts:
        if held and (size + len(text) > TOGETHER or len(text) > CHUNK):
            yield from done()
            held, size = [], 0
        if len(text) > CHUNK:
            yield cut(e, text)
        else:
            held.append((text, list(read(e, text))))
            size += len(text)
    yield from done()


def _leaves_from(e: Encoder, whole: str, size: int, lists: Iterable[tuple[list[str], bool]]) -> list[tuple[str, int]] | None:
    """Leaves of the first ``size`` code points of a text, from its pre-tokens."""
    look, out, at = e.counts.__getitem__, [], 0
    for found, special in lists:
        if at >= size:
            break
        ends = list(accumulate(map(len, found), initial=at))[1:]
        counts = [1] if special else list(map(look, found))
        first, stop = 0, len(found)
        if ends and ends[-1] > size:
            stop = bisect_left(ends, size) + 1
            if ends[stop - 1] != size:
                return None
        while first < stop:
            last = min(stop, bisect_left(ends, at + LEAF, first) + 1)
            out.append((whole[at : ends[last - 1]], sum(counts[first:last])))
            first, at = last, ends[last - 1]
    return out


def _mapped(sent: DataFrame, make, fields: str) -> DataFrame:
    """``sent`` (row and further columns) with columns: ``make(further values, one iterable each)`` yields those of each row.

    Leaves go in and out as lists of (code points, tokens).
    """
    new = StructType.fromDDL(fields)
    kinds = [f.name for f in new]
    schema = StructType([sent.schema["row"], *new.fields])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                made = zip(*make(*map(_values, b.columns[1:])))
                yield pa.RecordBatch.from_arrays([b.column(0), *[_array(v, f.dataType.simpleString()) for v, f in zip(made, new)]], ["row", *kinds])

    return sent.mapInArrow(run, schema).select("row.*", *kinds)


def _values(column: pa.Array):
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return views(column)
    if column.type == ARROW_LEAVES:
        return _leaves(column)
    return (v.as_py() for v in column)


def _leaves(column: pa.Array) -> Iterator[list[tuple[int, int]] | None]:
    """Lists of (code points, tokens), None for a null list or one with nulls in it."""
    ends = column.offsets.to_pylist()
    chars, tokens = (x.slice(ends[0], ends[-1] - ends[0]).to_pylist() for x in column.values.flatten())
    for valid, start, end in zip(column.is_valid().to_pylist(), ends, ends[1:]):
        found = list(zip(chars[start - ends[0] : end - ends[0]], tokens[start - ends[0] : end - ends[0]])) if valid else None
        yield None if found is None or any(a is None or b is None for a, b in found) else found


def _array(values: tuple, kind: str) -> pa.Array:
    if kind in ARROW:
        return pa.array(values, ARROW[kind])
    offsets = pa.array(list(accumulate(map(len, values), initial=0)), pa.int32())
    parts = [pa.array([x[i] for v in values for x in v], pa.int32()) for i in (0, 1)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(ARROW_LEAVES.value_type)))


def _text(value: memoryview) -> str:
    return "".join(t for t, _ in text_chunks(value))


def plant(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with columns n_tokens, n_chars (code points) and leaves: what later edits need of each text's tree.

    A null or empty text has no leaves. Columns of these names are replaced, all others pass through, whatever their
    names. Rows are independent: ties and repeated rows get equal counts, an empty table gives an empty one.
    """

    def make(values):
        for leaves in cut_all(encoder(vocabulary), map(_text, values)):
            yield sum(n for _, n in leaves), sum(len(t) for t, _ in leaves), [(len(t), n) for t, n in leaves]

    sent = packed(docs, ("n_tokens", "n_chars", "leaves"), value=named(text))
    return _mapped(sent, make, f"n_tokens long, n_chars long, leaves {LEAVES}")


def revise(planted: DataFrame, edits: str, vocabulary: str | None = None, text: str = "text", leaves: str = "leaves", keep_text: bool = True) -> DataFrame:
    """``planted`` with columns text_after, leaves_after, n_tokens_after, n_chars_after and n_chars_reencoded.

    Without ``keep_text``, the texts and leaves, old and new, are left out of the result and need not be sent back.

    ``edits`` names a column of arrays of structs (start, length, text), applied one after the other to the text as
    the ones before have left it; code points, clipped to the text. Null edits, or null parts of one: no edit, position
    0, no length, no text. Only touched leaves are encoded; ``n_chars_reencoded`` counts their code points. Leaves that
    are null, or don't fit the text, are made anew (and counted). Other columns pass through, whatever their names.
    """

    def revised(value, stored, todo):
        e, t = encoder(vocabulary), _text(value)
        if sum(chars for chars, _ in stored or ()) == len(t):
            at, found = 0, []
            for chars, tokens in stored or ():
                found.append((t[at : at + chars], tokens))
                at += chars
            tree = CountTree(e, found)
        else:
            tree = CountTree(e)
            tree.edit(0, 0, t)
        for x in todo or []:
            if x is not None:
                tree.edit(x["start"] or 0, x["length"] or 0, x["text"] or "")
        sums = tree.n_tokens, tree.n_chars, tree.reencoded
        if not keep_text:
            return sums
        now = list(tree.leaves())
        return "".join(p for p, _ in now), [(len(p), n) for p, n in now], *sums

    def make(*columns):
        return map(revised, *columns)

    new = ("text_after", "leaves_after", "n_tokens_after", "n_chars_after", "n_chars_reencoded")
    gone = () if keep_text else (text.lower(), leaves.lower())
    sent = packed(planted, new + gone, value=named(text), stored=named(leaves), todo=named(edits))
    texts = f"text_after string, leaves_after {LEAVES}, " if keep_text else ""
    return _mapped(sent, make, f"{texts}n_tokens_after long, n_chars_after long, n_chars_reencoded long")


def count_tokens(docs: DataFrame, edits: str, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with columns n_tokens, n_tokens_after, n_chars, n_chars_after and n_chars_reencoded: ``plant``, then ``revise``.

    Columns of the new names are replaced, all others pass through.
    """
    new = ("n_tokens", "n_tokens_after", "n_chars", "n_chars_after", "n_chars_reencoded")
    sent = packed(docs, new, value=named(text), edits=named(edits))
    done = revise(plant(sent, vocabulary, "value"), "edits", vocabulary, "value", keep_text=False)
    return done.select("row.*", *new)
