"""Byte-level BPE encoding and decoding as streaming transducers.

Encoding reads bytes from left to right. For each position it keeps the last token of the encoding of all text up to
there: the one vocabulary entry that ends there and stays apart from the token before it under the merge list. The
tokens on the way back from a position form a chain. The merge list's longest token, of L bytes, bounds what later
bytes can still reach: every future chain starts at one of the last L positions, so what those chains share is
stable and is emitted. State is the unstable part alone, whatever the text's length: texts come in as chunks, also in
the middle of a special token or of a pre-token of any length, and ids leave chunk by chunk.

Decoding maps ids to bytes and bytes to text with an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import named, packed

#: Fixed value: the pre-token pattern of the byte-level vocabularies, with white space named as a property.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A pre-token that ends so many code points before the end of what was read does not depend on what follows.
PRE_TOKEN_LOOKAHEAD = 3
#: Code points that are read at once, and bytes of a longer text that become such a chunk.
CHUNK = 1 << 16
#: Bytes of results that are sent on together; a longer result alone.
SENT = 1 << 20
#: Pre-tokens that a worker remembers, in each of two generations.
REMEMBERED = 100_000
#: Bytes at the beginning of pre-tokens, and how many such beginnings a worker remembers with the state behind them.
HEAD, HEADS = 5, 50_000
#: Pairs of tokens that a worker remembers as staying apart or not.
PAIRS = 150_000
#: Bytes of pre-tokens that are counted many at once, those up to each width together, and how many these are at most.
WIDTHS, MANY = (8, 12, 24), 1 << 13
#: Above all ranks: no merge.
NO_MERGE = np.iinfo(np.int32).max


def default_vocabulary() -> str:
    """Path of the byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain_pattern() -> re.Pattern:
    """PRE_TOKEN for Python's own expressions, which are faster: its classes as ranges, up to U+FFFF. Surrogates are in none."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    pattern = PRE_TOKEN
    for name in (r"\p{White_Space}", r"\p{L}", r"\p{N}"):
        runs = "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(name + "+", every))
        negated = name.replace("p", "P", 1)
        pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(name, runs), pattern).replace(name, f"[{runs}]").replace(negated, f"[^{runs}]")
    return re.compile(pattern)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def read_tokens(path: str) -> tuple[dict[bytes, int], dict[str, int], list[tuple[bytes, bytes]]]:
    """Ids of tokens and of special tokens, and the merges in order, of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    alphabet = byte_alphabet()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    return (
        {bytes(alphabet[c] for c in t): i for t, i in file["model"]["vocab"].items()},
        {t["content"]: t["id"] for t in file.get("added_tokens", [])},
        [tuple(bytes(alphabet[c] for c in part) for part in pair) for pair in pairs],
    )


def bytes_by_id(ids: dict[bytes, int], special: dict[str, int]) -> list[bytes]:
    """The bytes of each id."""
    out = [b""] * (1 + max([*ids.values(), *special.values()]))
    for token, i in [*ids.items(), *((t.encode(), i) for t, i in special.items())]:
        out[i] = token
    return out


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        self.ids, self.special, coded = read_tokens(path)
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(coded)}
        #: The merge that makes a token: rank, left and right part.
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, token) in self.merges.items():
            if token not in self.made or rank < self.made[token][0]:
                self.made[token] = (rank, a, b)
        self.bytes_of = bytes_by_id(self.ids, self.special)
        self.lengths = list(map(len, self.bytes_of))
        self.base = [self.ids[bytes([b])] for b in range(256)]
        #: The sufficient lookahead of the merge list: no token spans more bytes.
        self.lookahead = max(map(len, self.ids))
        self.known: dict[tuple[int, int], bool] = {}
        #: Finds all tokens that end at each position of a text, the longest first; bytes stand as characters.
        self.tokens = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.tokens.add_word(token.decode("latin-1"), i)
        self.tokens.make_automaton()

    def apart(self, a: int, b: int) -> bool:
        """Whether the merge list leaves these two neighbours as they are.

        Goes back in time over what stood left and right of the border: the part that was merged last is undone first,
        and a pair across the border would have been merged if it comes before what was undone.
        """
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[a, b] = self._stays(a, b)
        return found

    def _stays(self, a: int, b: int) -> bool:
        before = len(self.merges)
        while True:
            if self.merges.get((a, b), (before,))[0] < before:
                return False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                before, a = made_a[0], made_a[2]
            else:  # of equal ranks, the pair on the left comes first
                before, b = made_b[0] + 1, made_b[1]


class Transducer:
    """Bytes of one pre-token in, stable token ids out."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.buffer = b""
        #: last[i] is the last token of the first i unstable bytes; last[0] the last token that is stable.
        self.last: list[int] = [-1]
        #: States after the first HEAD bytes of a pre-token, where many begin alike.
        self.heads: dict[bytes, tuple[int, ...]] = {}

    def feed(self, data: bytes) -> list[int]:
        """Ids that these bytes make stable. What is stable is looked up once the buffer holds twice the lookahead."""
        out: list[int] = []
        look = self.v.lookahead
        if not self.buffer and self.last[0] < 0 and len(data) > HEAD:
            head, data = data[:HEAD], data[HEAD:]
            state = self.heads.get(head)
            if state is None:
                self._read(head)
                if len(self.heads) >= HEADS:
                    self.heads.clear()
                self.heads[head] = tuple(self.last)
            else:
                self.buffer, self.last = head, [*state]
        for at in range(0, len(data), 4 * look):
            self._read(data[at : at + 4 * look])
            if len(self.buffer) > 2 * look:
                out += self._emit(self._stable())
        return out

    def finish(self) -> list[int]:
        """The remaining ids; the transducer is then ready for another pre-token."""
        last, lengths, end, out = self.last, self.v.lengths, len(self.buffer), []
        while end:
            token = last[end]
            out.append(token)
            end -= lengths[token]
        out.reverse()
        self.buffer, self.last = b"", [-1]
        return out

    def _read(self, data: bytes) -> None:
        lengths, known, apart, last = self.v.lengths, self.v.known.get, self.v.apart, self.last
        buffer = self.buffer + data
        # a token that ends in the new bytes begins after here
        skip = max(0, len(self.buffer) - self.v.lookahead + 1)
        at = len(last)
        for end, token in self.v.tokens.iter(buffer[skip:].decode("latin-1")):
            # one token, and only one, belongs to each end
            if skip + end + 1 == at:
                before = last[at - lengths[token]]
                if before < 0 or (stays := known((before, token))) or (stays is None and apart(before, token)):
                    last.append(token)
                    at += 1
        self.buffer = buffer

    def _chain(self, end: int) -> list[int]:
        """Boundaries from ``end`` back to 0."""
        out = [end]
        while end:
            end -= self.v.lengths[self.last[end]]
            out.append(end)
        return out

    def _stable(self) -> int:
        """The last boundary on the chains of all positions that later tokens can start at."""
        end = len(self.buffer)
        shared = set(self._chain(end))
        for start in range(max(0, end - self.v.lookahead + 1), end):
            shared &= set(self._chain(start))
        return max(shared)

    def _emit(self, upto: int) -> list[int]:
        ends = self._chain(upto)[::-1][1:]
        out = [self.last[e] for e in ends]
        if out:
            self.last = [out[-1], *self.last[upto + 1 :]]
            self.buffer = self.buffer[upto:]
        return out


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """Ids of pre-tokens as little-endian 32-bit bytes: what the transducer made of each. Remembers two generations.

    A pre-token longer than the lookahead is not remembered, so that memory is bounded.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.transducer, self.old = Transducer(vocabulary), {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "replace")
            packed = as_bytes(self.transducer.feed(data) + self.transducer.finish())
            if len(data) > self.transducer.v.lookahead:
                return packed
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Merges:
    """Merges of many short pre-tokens at once: a row of an array each, the pair of the lowest rank in each row at each step."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = len(vocabulary.bytes_of)
        keys = np.array([a * self.size + b for a, b in vocabulary.merges], np.int64)
        order = np.argsort(keys)
        made = np.array(list(vocabulary.merges.values()), np.int32).reshape(-1, 2)
        self.keys, self.ranks = np.append(keys[order], -1), np.append(made[order, 0], NO_MERGE)
        #: What a merge makes, by its rank.
        self.tokens = np.zeros(made[:, 0].max(initial=0) + 1, np.int32)
        self.tokens[made[:, 0]] = made[:, 1]
        #: Tokens of bytes and ranks of their pairs; 256 stands for no byte.
        self.base = np.array([*vocabulary.base, -1], np.int32)
        self.pairs = self._ranks(self.base[:, None], self.base)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, NO_MERGE without one. Tokens below 0 are none."""
        pairs = a.astype(np.int64) * self.size + b
        pairs[(a < 0) | (b < 0)] = -2
        at = np.searchsorted(self.keys[:-1], pairs)
        return np.where(self.keys[at] == pairs, self.ranks[at], NO_MERGE).astype(np.int32)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each of these pre-tokens."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = lengths.copy()
        for low, high in zip((1, *WIDTHS), WIDTHS):
            of = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(of):
                counts[of] -= self._merged([pieces[i] for i in of.tolist()], lengths[of], high)
        return counts

    def _merged(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> np.ndarray:
        """Number of merges in pre-tokens of at most ``width`` bytes."""
        data = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), np.uint8).reshape(-1, width)
        data = np.where(np.arange(width) < lengths[:, None], data, np.int16(256))
        tokens, ranks = self.base[data], self.pairs[data[:, :-1], data[:, 1:]]
        done, rows = np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        for step in range(width - 1):
            own = np.arange(len(rows))
            at = ranks.argmin(axis=1)  # of equal ranks the first
            best = ranks[own, at]
            merged = best < NO_MERGE
            done[rows[~merged]] = step
            rows, at, best, tokens, ranks, own = rows[merged], at[merged], best[merged], tokens[merged], ranks[merged], own[: merged.sum()]
            left = width - 1 - step
            # the left part becomes the token made, the right part and the pair go, and what stands behind moves up
            made = tokens[own, at] = self.tokens[best]
            tokens = tokens[np.arange(left + 1) != at[:, None] + 1].reshape(len(rows), left)
            ranks = ranks[np.arange(left) != at[:, None]].reshape(len(rows), left - 1)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self._ranks(tokens[some, at[some] - 1], made[some])
            some = np.flatnonzero(at < left - 1)
            ranks[some, at[some]] = self._ranks(made[some], tokens[some, at[some] + 1])
            if not len(rows):
                break
        done[rows] = width - 1
        return done


class Counts(dict):
    """Number of tokens of pre-tokens, for what needs no ids. Remembers two generations, as ``Pieces`` does.

    ``learn`` merges many short ones at once. What comes one by one is searched for: tokens are the encoding if each two neighbours stay apart, and only one way through the bytes has that. It is looked
    for from the left, the longest token first; a place from which no way goes on is not tried again.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.transducer, self.old, self.merges = Transducer(vocabulary), {}, Merges(vocabulary)

    def learn(self, pieces: set[str]) -> None:
        """Remember the counts of those of these pre-tokens that are new and short."""
        known, new = self.old.get, []
        for piece in pieces.difference(self):
            n = known(piece)
            if n is not None:
                self[piece] = n
            elif 0 < len(data := piece.encode("utf-8", "replace")) <= WIDTHS[-1]:
                new.append((piece, data))
        for at in range(0, len(new), MANY):
            some = new[at : at + MANY]
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self.update(zip([p for p, _ in some], self.merges.counts([data for _, data in some]).tolist()))

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            data = piece.encode("utf-8", "replace")
            if len(data) > self.transducer.v.lookahead:
                return len(self.transducer.feed(data)) + len(self.transducer.finish())
            n = self._count(data)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = n
        return n

    def _count(self, data: bytes) -> int:
        v = self.transducer.v
        token_of, known, apart = v.ids.get, v.known.get, v.apart
        size = end = len(data)
        start, before, path, closed = 0, -1, [], set()
        while True:
            token = token_of(data[start:end])
            if token is not None and end not in closed and (before < 0 or (stays := known((before, token))) or (stays is None and apart(before, token))):
                path.append((start, before))
                if end == size:
                    return len(path)
                start, before, end = end, token, size
            elif end - start > 1:
                end -= 1
            else:
                closed.add(start)
                end = start - 1
                start, before = path.pop()
                while end == start:  # the token before was a single byte: nothing shorter
                    closed.add(start)
                    end = start - 1
                    start, before = path.pop()


class Encoder:
    """Text in, ids out, in bounded chunks."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pieces, self.counts = vocabulary, Pieces(vocabulary), Counts(vocabulary)
        self.find, self.plain, self.beyond = regex.compile(PRE_TOKEN), plain_pattern(), re.compile("[\U00010000-\U0010ffff]")
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special)) or r"(?!)")
        self.longest = max(map(len, vocabulary.special), default=0)
        self.spaces = regex.compile(r"\p{White_Space}*")
        self.runs = [self.spaces, *map(regex.compile, (r"\p{L}*", r"\p{N}*", r"[^\p{White_Space}\p{L}\p{N}]*"))]

    def found(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return (self.find if not text.isascii() and self.beyond.search(text) else self.plain).findall(text)

    def segments(self, chunks: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, bool | None]]:
        """Text between special tokens, and whether it ends there; a special token comes with None.

        ``chunks``: pieces of a text, and whether a piece is the last. Only what could be the start of a special token
        is held back.
        """
        held = ""
        for chunk, last in chunks:
            held += chunk
            sure = len(held) if last else len(held) - self.longest + 1  # what begins before is whole
            at = 0
            for m in self.special.finditer(held):
                if m.start() >= sure:
                    break
                yield held[at : m.start()], True
                yield m[0], None
                at = m.end()
            upto = max(at, sure)
            if upto > at or last:
                yield held[at:upto], last
            held = held[upto:]

    def pre_tokens(self, segments: Iterable[tuple[str, bool | None]]) -> Iterator[tuple[list[str] | str, bool | None]]:
        """(list of whole pre-tokens, None), (special token, None) or, of a very long pre-token, (part, whether it ends)."""
        held, run = "", None
        for text, ends in segments:
            if ends is None:
                yield text, None
                continue
            held += text
            while held or run is not None:
                if run is not None:
                    n = run.match(held).end()
                    over = n < len(held)
                    # the last of several spaces belongs to what follows them, if anything does
                    n -= run is self.spaces and n > 0 and (over or not ends)
                    yield held[:n], over or ends
                    held = held[n:]
                    if not over and not ends:
                        break
                    run = None
                elif ends:
                    yield self.found(held), None
                    held = ""
                else:
                    found, done = self.found(held), len(held)
                    while found and done > len(held) - PRE_TOKEN_LOOKAHEAD:
                        done -= len(found.pop())
                    yield found, None
                    held = held[done:]
                    if len(held) <= CHUNK:
                        break
                    letter = self.find.match(held)[0][-1]
                    run = next(r for r in self.runs if r.match(letter).end())
                    if held[0] == " " and run is not self.spaces:
                        yield " ", False
                        held = held[1:]

    def stream(self, text: str | Iterable[tuple[str, bool]]) -> Iterator[bytes]:
        """Packed ids of a text, or of one that comes in chunks (piece, whether it is the last)."""
        look, transducer, special = self.pieces.__getitem__, self.pieces.transducer, self.v.special
        for piece, ends in self.pre_tokens(self.segments([(text, True)] if isinstance(text, str) else text)):
            if ends is not None:
                ids = transducer.feed(piece.encode("utf-8", "replace"))
                yield as_bytes(ids + transducer.finish() if ends else ids)
            elif isinstance(piece, str):
                yield as_bytes([special[piece]])
            else:
                yield b"".join(map(look, piece))

    def lists(self, chunks: Iterable[tuple[str, bool]]) -> Iterator[tuple[list[str], bool]]:
        """Pre-tokens of a text that comes in chunks, some at a time, and whether they are a special token."""
        parts = []
        for piece, ends in self.pre_tokens(self.segments(chunks)):
            if ends is None:
                yield (piece, False) if isinstance(piece, list) else ([piece], True)
            else:
                parts.append(piece)
                if ends:
                    yield ["".join(parts)], False
                    parts = []


def decode_stream(bytes_of: list[bytes], packed: Iterable[bytes]) -> Iterator[str]:
    """Text of packed ids, chunk by chunk; a broken sequence becomes U+FFFD. ``bytes_of``: the bytes of each id."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    token = bytes_of.__getitem__
    for ids in packed:
        yield machine.decode(b"".join(map(token, np.frombuffer(ids, "<u4").tolist())))
    yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """The worker's encoder; kept between tasks."""
    return Encoder(Vocabulary(path or default_vocabulary()))


@lru_cache(maxsize=2)
def id_bytes(path: str | None) -> list[bytes]:
    """The bytes of each token id, which is all that decoding needs."""
    return bytes_by_id(*read_tokens(path or default_vocabulary())[:2])


def views(array: pa.Array) -> Iterator[memoryview]:
    """The bytes of each value of a string or binary array, without a copy; none for a null."""
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return
    ends = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    data = memoryview(data if data is not None else b"")
    for valid, start, end in zip(array.is_valid(), ends, ends[1:]):
        yield data[start:end] if valid.as_py() else data[:0]


def text_chunks(data: memoryview) -> Iterator[tuple[str, bool]]:
    """UTF-8 bytes as pieces of text, and whether a piece is the last."""
    if len(data) <= CHUNK:
        yield str(data, "utf-8", "replace"), True
        return
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(data), CHUNK):
        last = at + CHUNK >= len(data)
        yield machine.decode(data[at : at + CHUNK], last), last


class Grown:
    """A string or binary column that grows piece by piece in one buffer."""

    def __init__(self):
        self.data, self.ends = bytearray(), [0]

    def close(self) -> None:
        """The value ends here."""
        self.ends.append(len(self.data))

    def array(self, kind: pa.DataType) -> pa.Array:
        return pa.Array.from_buffers(kind, len(self.ends) - 1, [None, pa.py_buffer(np.asarray(self.ends, np.int32)), pa.py_buffer(self.data)])


def _appended(df: DataFrame, source: str, write, finish, fields: list[StructField], dropped: tuple[str, ...] = (), grows: int = 1) -> DataFrame:
    """``df`` with columns made from the bytes of ``source``: ``write(value, *grown)`` adds a result to each of ``grows`` buffers, ``finish(*grown)`` makes the columns.

    The source is sent once: within the row where it passes through, else beside it.
    """
    gone = tuple(f.name.lower() for f in fields) + tuple(c.lower() for c in dropped)
    inside = source.lower() not in gone
    sent = packed(df, gone) if inside else packed(df, gone, source=named(source))
    schema = StructType([sent.schema["row"], *fields])
    at = next((i for i, f in enumerate(sent.schema["row"].dataType) if f.name.lower() == source.lower()), None)

    def run(batches):
        for b in batches:
            grown, start = [Grown() for _ in range(grows)], 0
            for i, value in enumerate(views(b.column(0).field(at) if inside else b.column(1)), 1):
                write(value, *grown)
                for g in grown:
                    g.close()
                if max(len(g.data) for g in grown) > SENT or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, i - start), *finish(*grown)], schema.names)
                    grown, start = [Grown() for _ in range(grows)], i

    return sent.mapInArrow(run, schema).select("row.*", *[f.name for f in fields])


#: Columns that encoding and decoding make.
ENCODED = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
DECODED = [StructField("decoded", StringType())]


def _encoded(grown: Grown) -> list[pa.Array]:
    return [pa.array(np.diff(grown.ends) // 4, pa.int64()), grown.array(pa.binary())]


def _write_ids(vocabulary: str | None, value: memoryview, ids: Grown) -> None:
    for piece in encoder(vocabulary).stream(text_chunks(value)):
        ids.data += piece


def _write_text(bytes_of: list[bytes], value, first: int, text: Grown) -> None:
    """The text of the packed ids in ``value`` from byte ``first`` on."""
    parts = (value[i : i + 4 * CHUNK] for i in range(first, len(value), 4 * CHUNK))
    for t in decode_stream(bytes_of, parts):
        text.data += t.encode()


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with columns n_tokens and ids (token ids as little-endian unsigned 32-bit integers).

    Without ``keep_text``, the text itself is left out of the result and need not be sent back.

    A null text counts as empty: no ids. Special tokens inside a text count as such. Columns of these names are
    replaced, all others pass through, whatever their names; rows are independent, so ties and repeated rows get equal
    ids and an empty table gives an empty one. A very long text is read and encoded in chunks. ``vocabulary`` is the
    path of a tokenizer file on every executor.
    """
    return _appended(docs, text, lambda value, ids: _write_ids(vocabulary, value, ids), _encoded, ENCODED, () if keep_text else (text,))


def decode(encoded: DataFrame, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column decoded: the text of its ids, special tokens included.

    Null ids give an empty text. A column named decoded is replaced, all others pass through; rows are independent.
    """
    return _appended(encoded, ids, lambda value, text: _write_text(id_bytes(vocabulary), value, 0, text), lambda text: [text.array(pa.string())], DECODED)


def round_trip(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with columns n_tokens, ids and decoded: ``encode``, then ``decode``, of each row in one pass.

    A task then needs one Python worker and not one for each of the two, which keep tokens and caches in memory until they end.
    """

    def write(value, ids, decoded):
        first = len(ids.data)
        _write_ids(vocabulary, value, ids)
        _write_text(encoder(vocabulary).v.bytes_of, ids.data, first, decoded)

    finish = lambda ids, decoded: [*_encoded(ids), decoded.array(pa.string())]
    return _appended(docs, text, write, finish, ENCODED + DECODED, () if keep_text else (text,), 2)
