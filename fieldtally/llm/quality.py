"""Quality rules as a bitmask ledger.

Every rule runs once for each document. The ledger keeps the measurements and one failure bit for each rule; a
policy is a versioned mask over those bits, so that a new policy, or the effect of leaving one rule out, needs no
second look at any text. All of it is Spark SQL expressions on the row itself: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bind, named, packed, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``failed`` judges the measurements, given as columns by name; ``bit`` never changes its meaning."""

    bit: int
    name: str
    failed: Callable[[dict[str, Column]], Column]


RULES = (
    Rule(0, "too_few_words", lambda m: m["n_words"] < 10),
    Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule(2, "symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule(3, "duplicate_lines", lambda m: 5 * m["n_dup_lines"] > 2 * m["n_lines"]),
    Rule(4, "short_mean_word", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule(5, "long_mean_word", lambda m: m["word_chars"] > 25 * m["n_words"]),
)

#: Version to the rules that it enforces. Versions are only ever added.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "duplicate_lines", "short_mean_word", "long_mean_word"),
}
DEFAULT_POLICY = "v1"


def mask(policy: str) -> int:
    """The bits that a policy enforces."""
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def _covered(starts: Column) -> Column:
    """Number of words in the union of the windows that begin at the given ascending positions."""
    done = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + s + WINDOW - F.greatest(s, acc["end"])).cast("long").alias("n"), (s + WINDOW).alias("end")
        ),
    )
    return done["n"]


def _repeat_words(w: Column) -> Column:
    """Words in windows that occur twice or more, compared as whole strings.

    Hashes only decide whether a document needs that comparison: with as many different hashes as windows, no
    two windows are equal.
    """
    last = F.size(w) - WINDOW
    starts = F.sequence(F.lit(0), last)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def compared() -> Column:
        keyed = F.transform(
            starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("k"), i.alias("i"))
        )
        return bind(
            F.array_sort(keyed),
            lambda s: _covered(
                F.array_sort(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
                            | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)),
                        ),
                        lambda x: x["i"],
                    )
                )
            ),
        )

    none = F.lit(0).cast("long")
    return F.when(last < 1, none).otherwise(
        bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(compared()))
    )


def _lines(text: Column) -> Column:
    """Lines that have a word: all lines, and those that equal an earlier one."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    return bind(
        kept,
        lambda k: F.struct(
            F.size(k).cast("long").alias("all"), (F.size(k) - F.size(F.array_distinct(k))).cast("long").alias("dup")
        ),
    )


def ledger(docs: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """``docs`` with a column ``into``: a struct of the measurements and ``failed_bits``.

    A null or empty text has no words and no lines, and so fails ``too_few_words``. Other columns, whatever their
    names, pass through; one named as ``into`` is replaced. Rows are independent: ties and repeats get equal ledgers, and
    an empty table gives an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    counted = bind(
        words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))
    )
    bare = F.translate(t, SPACE_CHARS, "")
    measured = F.struct(
        counted.alias("c"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _lines(t).alias("l"),
    )

    def judged(m: Column) -> Column:
        fields = {
            "n_words": m["c"]["n_words"], "word_chars": m["word_chars"], "n_symbols": m["n_symbols"],
            "n_lines": m["l"]["all"], "n_dup_lines": m["l"]["dup"], "n_repeat_words": m["c"]["n_repeat_words"],
        }
        bits = F.lit(0)
        for rule in RULES:
            bits = bits.bitwiseOR(F.when(rule.failed(fields), 1 << rule.bit).otherwise(0))
        return F.struct(*[v.alias(k) for k, v in fields.items()], bits.cast("long").alias("failed_bits"))

    return docs.withColumn(into, bind(measured, judged))


def kept_by(policy: str = DEFAULT_POLICY, ledger: str = "ledger") -> Column:
    """Whether a policy keeps the row, from its ledger alone."""
    return named(ledger)["failed_bits"].bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(ledgered: DataFrame, policy: str = DEFAULT_POLICY, ledger: str = "ledger") -> DataFrame:
    """The rows that a policy keeps, without their ledger."""
    return ledgered.where(kept_by(policy, ledger)).drop(ledger)


def keep(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The rows that a policy keeps; all columns pass through, one named ledger as well."""
    judged = ledger(packed(docs, text=named(text)))
    return judged.where(kept_by(policy)).select("row.*")


def ablations(ledgered: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """What each rule of a policy does: rows that fail it, rows that fail it alone (and would come back without it).

    One row for each rule, plus the rule ``(any)`` for the policy as a whole; partial sums only cross the network.
    An empty table gives zeros.
    """
    bits, m = F.col("ledger.failed_bits"), mask(policy)
    enforced = [r for r in RULES if r.name in POLICIES[policy]]
    sums = [F.coalesce(F.sum((bits.bitwiseAND(F.lit(m)) != 0).cast("long")), F.lit(0)).alias("any")]
    for r in enforced:
        hit = bits.bitwiseAND(F.lit(1 << r.bit)) != 0
        alone = bits.bitwiseAND(F.lit(m)) == (1 << r.bit)
        sums += [F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias(f"f_{r.bit}"), F.coalesce(F.sum(alone.cast("long")), F.lit(0)).alias(f"a_{r.bit}")]
    one = ledgered.agg(*sums)
    rows = [F.struct(F.lit("(any)").alias("rule"), F.col("any").alias("failed"), F.col("any").alias("failed_alone"))]
    rows += [F.struct(F.lit(r.name).alias("rule"), F.col(f"f_{r.bit}").alias("failed"), F.col(f"a_{r.bit}").alias("failed_alone")) for r in enforced]
    return one.select(F.inline(F.array(*rows)))
