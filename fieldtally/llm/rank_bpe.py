"""Byte-level BPE encoding and decoding in Spark's higher-order functions.

A rank file gives each token's bytes a rank, which is its id. A pre-token starts as single bytes; as long as two
neighbours together are a token, the pair of the lowest rank, the first of equal ones, becomes one. ``fold`` does so with
``aggregate`` over a pre-token's bytes: its state is the boundaries of the parts and the rank of each pair, and ranks come
from a literal map. Decoding looks each id's bytes up and concatenates them.

Map lookups in Spark go through a map's keys one by one, so a literal map is an array of small ones by the hash of the
key (``buckets``): a scalar subquery that is computed once and sent with the tasks. Its size is the vocabulary's.

The words of a corpus are counted, and the most frequent ones, at most MEMO, are folded once and kept in a second
literal map of bounded size. All others are folded where they stand, without a shuffle. Both give the same ids.

A pre-token of more than CHUNK bytes is folded chunk by chunk, and what stands around a border is folded again. Tokens
are what a whole pre-token is encoded to if, and only if, each two neighbours stay as they are when encoded on their own
(merges within two neighbours come in the same order with and without the rest, until one of them crosses a border). So
the chunks' tokens are right if the window around their border ends with the tokens that it began and ended with before.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind, named, packed, remove, stored

#: Most words that are folded once for all; their bytes are at most MEMO_BYTES each.
MEMO, MEMO_BYTES = 1 << 19, 64
#: Small maps in the literal map of ranks, a power of two.
RANKS = 1 << 16
#: Bytes that are folded at once: of a pre-token, and at most.
CHUNK, FOLDED = 96, 126
#: A rank is kept as the character from FIRST on, and NONE, above all of them, stands for no rank; between are MOST ranks.
FIRST, NONE = 0x100, "\ufffd"
MOST = 0xD800 - FIRST
#: Bytes on each side of a border within which tokens are folded again, until those at the window's ends stay. A token is shorter than the last.
WINDOWS = (16, 34, 62)
#: The published pattern, the characters that are white space, and the pattern with them.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PLAIN = rf" ?\p{{L}}++|'(?:[stmd]|re|ve|ll)| ?\p{{N}}++| ?[^{WHITE}\p{{L}}\p{{N}}]++|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: One character for each byte.
BYTES = "ISO-8859-1"


def default_vocabulary() -> str:
    """Path of the rank file for many languages among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    """The published pre-token pattern for Java's regular expressions.

    (?U) makes white space a Unicode property. The pattern that is known is put as PLAIN, which finds the same faster:
    what words match comes first, runs don't go back, white space is named by its characters.
    """
    import public_tokenizers

    return PLAIN if public_tokenizers.PATTERN == KNOWN else "(?U)" + public_tokenizers.PATTERN


def ranks(path: str) -> pa.Table:
    """Columns (key, value) of a rank file of at most MOST ranks: each token's bytes, and its rank as a character. Only the driver reads it."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    if max(int(b) for _, b in pairs) >= MOST:
        raise ValueError(f"{path}: ranks of {MOST} and more are not supported")
    keys, values = [base64.b64decode(a) for a, _ in pairs], [chr(FIRST + int(b)) for _, b in pairs]
    return pa.table({"key": pa.array(keys, pa.binary()), "value": pa.array(values, pa.string())})


def one_value(spark: SparkSession, value: pa.Array) -> Column:
    """An Arrow list as an array that Spark computes once and sends with the tasks."""
    offsets = pa.array([0, len(value)], pa.int32())
    return spark.createDataFrame(pa.table({"value": pa.ListArray.from_arrays(offsets, value)})).scalar()


def buckets(spark: SparkSession, pairs: pa.Table, size: int) -> Column:
    """Columns (key, value) as a literal map: an array of ``size`` small maps, by the key's hash. For tables of a bounded size only."""
    keys = pairs["key"].combine_chunks().cast(pa.binary())
    # Spark's xxhash64 of one value
    at = np.fromiter((xxhash.xxh64_intdigest(k.as_buffer(), seed=42) & (size - 1) for k in keys), np.int64, len(keys))
    order = np.argsort(at, kind="stable")
    offsets = pa.array(np.searchsorted(at[order], np.arange(size + 1)).astype(np.int32))
    sides = [pairs[c].combine_chunks().take(pa.array(order)) for c in ("key", "value")]
    return one_value(spark, pa.MapArray.from_arrays(offsets, *sides))


def found(table: Column, key: Column, size: int) -> Column:
    """A key's value in a literal map of ``size``, or null."""
    return F.get(table, F.xxhash64(key).bitwiseAND(F.lit(size - 1)).cast("int"))[key]


def _rank(table: Column, data: Column, start: Column, end: Column) -> Column:
    """Rank of the bytes from ``start`` to before ``end`` as a character, or null."""
    return _rank_of(table, F.substring(data, start + 1, end - start))


def _rank_of(table: Column, token: Column) -> Column:
    return bind(token, lambda x: found(table, x, RANKS))


def _none() -> Column:
    return F.array().cast("array<int>")


def _steps(a: Column, b: Column) -> Column:
    return F.when(b >= a, F.sequence(a, b)).otherwise(_none())


def fold(table: Column, data: Column, first: Column, end: Column) -> Column:
    """Boundaries of the tokens of ``data`` from ``first`` to ``end``, at most FOLDED bytes: an array of places, both ends included.

    A step merges one pair. The state is two strings, which Spark cuts and joins faster than arrays: ``pairs`` has the rank
    of each pair of neighbours as a character (NONE: they are no token), so the least one, where it stands first, is the
    pair to merge; ``cuts`` has the places where parts begin, and the end, as the characters from 1.
    """
    at = lambda cuts, i: F.ascii(F.substring(cuts, i, F.lit(1)))

    def step(state: Column, _) -> Column:
        cuts, pairs = state["cuts"], state["pairs"]

        def rank(i: Column, j: Column) -> Column:
            # the first place is a character, from 1, and so is substring's
            return F.coalesce(_rank_of(table, F.substring(data, at(cuts, i) + first, at(cuts, j) - at(cuts, i))), F.lit(NONE))

        def merged(i: Column) -> Column:
            # pair i is of the parts that begin at cuts i and i + 1, so cut i + 1 goes
            before = F.when(i > 1, rank(i - 1, i + 2)).otherwise("")
            behind = F.when(i < F.length(pairs), rank(i, i + 3)).otherwise("")
            return F.struct(
                F.concat(F.substring(cuts, F.lit(1), i), F.substr(cuts, i + 2)).alias("cuts"),
                F.concat(F.substring(pairs, F.lit(1), i - 2), before, behind, F.substr(pairs, i + 2)).alias("pairs"),
            )

        lowest = F.array_min(F.split(pairs, ""))
        return bind(lowest, lambda x: F.when(x < NONE, bind(F.instr(pairs, x), merged)).otherwise(state))

    n = end - first
    start = F.struct(
        F.substring(F.lit("".join(map(chr, range(1, FOLDED + 2)))), F.lit(1), n + 1).alias("cuts"),
        F.array_join(F.transform(_steps(first, end - 2), lambda i: F.coalesce(_rank_of(table, F.substring(data, i + 1, F.lit(2))), F.lit(NONE))), "").alias("pairs"),
    )
    done = F.aggregate(_steps(F.lit(2), n), start, step, lambda state: state["cuts"])
    return bind(done, lambda cuts: F.transform(_steps(F.lit(1), F.length(cuts)), lambda i: at(cuts, i) + (first - 1)))


def fold_long(table: Column, data: Column) -> Column:
    """Boundaries of the tokens of ``data``, of any length: the exact way where chunks can't be joined.

    As ``fold``, but with arrays of boundaries and of pairs' ranks.
    """

    def step(state: Column, _) -> Column:
        cuts, pairs = state["cuts"], state["pairs"]
        empty = F.array().cast("array<string>")

        def merged(i: Column) -> Column:
            # pair i (from 1) is of the parts between cuts i - 1, i and i + 1 (from 0): cut i goes
            before = F.when(i > 1, F.array(_rank(table, data, F.get(cuts, i - 2), F.get(cuts, i + 1)))).otherwise(empty)
            behind = F.when(i < F.size(pairs), F.array(_rank(table, data, F.get(cuts, i - 1), F.get(cuts, i + 2)))).otherwise(empty)
            return F.struct(
                F.concat(F.slice(cuts, F.lit(1), i), F.slice(cuts, i + 2, F.size(cuts))).alias("cuts"),
                F.concat(F.slice(pairs, F.lit(1), F.greatest(i - 2, F.lit(0))), before, behind, F.slice(pairs, i + 2, F.size(pairs))).alias("pairs"),
            )

        lowest = F.array_min(pairs)
        return F.when(lowest.isNull(), state).otherwise(bind(F.array_position(pairs, lowest).cast("int"), merged))

    n = F.length(data)
    start = F.struct(
        F.sequence(F.lit(0), n).alias("cuts"),
        F.transform(_steps(F.lit(0), n - 2), lambda i: _rank(table, data, i, i + 2)).alias("pairs"),
    )
    return F.aggregate(_steps(F.lit(0), n - 2), start, step, lambda state: state["cuts"])


def chunked(table: Column, data: Column) -> Column:
    """Boundaries of a pre-token of any length, chunk by chunk; null where what stands around a border found no rest."""
    n = F.length(data)

    def add(state: Column, start: Column) -> Column:
        """The next chunk: ``last`` holds the boundaries of the chunk before, ``done`` those of all before it."""

        def joined(chunk: Column) -> Column:
            last, end = state["last"], F.get(chunk, F.size(chunk) - 1)

            def window(k: int) -> Column:
                a = F.size(F.filter(last, lambda c: c < start - k))
                b = F.size(F.filter(chunk, lambda c: c <= start + k)) - 1

                def kept(w: Column) -> Column:
                    # the first and the last token stay what they were, but for those at the text's begin or the chunk's end
                    from_a, to_b = F.get(last, a), F.get(chunk, b)
                    ok_a = (from_a == 0) | ((from_a < start) & (F.get(w, F.lit(1)) == F.get(last, a + 1)))
                    ok_b = (to_b == end) | ((to_b > start) & (F.get(w, F.size(w) - 2) == F.get(chunk, b - 1)))
                    new = F.struct(
                        F.concat(state["done"], F.array(F.slice(last, F.lit(1), a))).alias("done"),
                        F.concat(w, F.slice(chunk, b + 2, F.size(chunk))).alias("last"),
                    )
                    return F.when(ok_a & ok_b, new)

                return bind(fold(table, data, F.get(last, a), F.get(chunk, b)), kept)

            return F.coalesce(*[window(k) for k in WINDOWS])

        return bind(fold(table, data, start, F.least(start + CHUNK, n)), joined)

    begin = F.struct(F.array().cast("array<array<int>>").alias("done"), fold(table, data, F.lit(0), F.least(F.lit(CHUNK), n)).alias("last"))
    more = F.when(n > CHUNK, F.sequence(F.lit(CHUNK), n - 1, F.lit(CHUNK))).otherwise(_none())
    return F.aggregate(more, begin, lambda state, at: F.when(state.isNotNull(), add(state, at)), lambda s: F.concat(F.flatten(s["done"]), s["last"]))


def word_ids(table: Column, word: Column) -> Column:
    """Ids of one pre-token, as characters: its own rank where it is a token, else its tokens'."""

    def of(data: Column) -> Column:
        short = fold(table, data, F.lit(0), F.length(data))
        cuts = F.when(F.length(data) <= CHUNK, short).otherwise(F.coalesce(chunked(table, data), fold_long(table, data)))
        tokens = bind(cuts, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: _rank(table, data, F.get(c, i - 1), F.get(c, i))))
        return F.coalesce(found(table, data, RANKS), F.array_join(tokens, ""))

    return bind(F.encode(word, "UTF-8"), of)


def pieces(text: Column) -> Column:
    """Pre-tokens of a text; none for a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern()), F.lit(0))


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent values of a column ``word``: all with a count at which they are at most ``most`` together."""
    counted = stored(words.groupBy("word").count(), "word-counts")
    heights = counted.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    upto = heights.select("count", F.sum("n").over(Window.orderBy(F.col("count").desc())).alias("upto"))
    least = upto.where(F.col("upto") <= most).agg(F.min("count")).first()[0]
    kept = stored(counted.where(F.col("count") >= F.lit(least)).select("word"), "frequent-words")
    remove(words.sparkSession, counted)
    return kept


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", memo: int = MEMO) -> DataFrame:
    """``docs`` with columns n_tokens and ids (array of token ids), each pre-token encoded on its own, no special tokens.

    A null or empty text has no ids. Columns of these names are replaced, all others pass through, whatever their names;
    rows are independent, so ties and repeated rows get equal ids, and an empty table gives an empty one. Pre-tokens and
    texts may have any length. ``vocabulary`` is the path of a rank file, read by the driver; ``memo`` bounds the words
    that are folded once.
    """
    spark = docs.sparkSession
    table = buckets(spark, ranks(vocabulary or default_vocabulary()), RANKS)
    words = docs.select(F.explode(pieces(named(text))).alias("word")).where(F.octet_length("word") <= MEMO_BYTES)
    often = frequent(words, memo)
    # a literal map is a column first, since a subquery can't stand in a higher-order function; Spark puts it in its place
    once = often.select("word", table.alias("t")).select(F.col("word").alias("key"), bind(F.col("t"), lambda t: word_ids(t, F.col("word"))).alias("value"))
    known = buckets(spark, once.toArrow(), MEMO)
    one = lambda t, k: lambda w: F.coalesce(found(k, w, MEMO), word_ids(t, w))
    coded = bind(F.col("t"), lambda t: bind(F.col("k"), lambda k: F.array_join(F.transform(pieces(F.col("text")), one(t, k)), "")))
    done = packed(docs, ("n_tokens", "ids"), text=named(text), t=table, k=known).select("row", coded.alias("c"))
    ids = F.when(F.col("c") == "", _none()).otherwise(F.transform(F.split("c", ""), lambda x: F.ascii(x) - FIRST))
    done = done.select("row", ids.alias("ids"))
    return done.select("row.*", F.size("ids").cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column decoded: the bytes of its ids, one after the other.

    Null ids give empty bytes; an id outside of the vocabulary, or a null one, raises an error. A column named decoded is replaced, all others pass
    through; rows are independent.
    """
    pairs = ranks(vocabulary or default_vocabulary())
    # token bytes by id; ids may have gaps
    ids_of = np.asarray([ord(c) - FIRST for c in pairs["value"].to_pylist()])
    at = np.full(ids_of.max() + 1, -1)
    at[ids_of] = np.arange(len(ids_of))
    # as characters, one a byte: Spark joins strings at once, and binary values two by two
    tokens = pa.array([k.as_py().decode(BYTES) for k in pairs["key"]]).take(pa.array(at, mask=at < 0))
    table = one_value(encoded.sparkSession, tokens)
    lookup = lambda t: F.transform(F.col("ids"), lambda i: F.coalesce(F.get(t, i), F.raise_error(F.lit("unknown token id")).cast("string")))
    sent = packed(encoded, ("decoded",), ids=F.coalesce(named(ids), _none()), t=table)
    return sent.select("row.*", bind(F.col("t"), lambda t: F.encode(F.array_join(lookup(t), ""), BYTES)).alias("decoded"))
