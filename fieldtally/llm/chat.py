"""Chat formatting by prefix-target expansion.

A conversation becomes one training example for each assistant turn: all earlier turns as context and that reply as
the only trainable part. Control strings inside texts are escaped so that no text can contain a marker, and the
escapes can be undone. All of it is Spark SQL expressions.

A turn is written ``### role: text </turn>`` and a line feed. In roles and texts, a backslash becomes ``\\b``, a
number sign ``\\h``, a less-than sign ``\\l`` and, in roles alone, a colon ``\\c``; so markers never arise from text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, COLON, END = "### ", ": ", " </turn>\n"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    """A text without marker characters; a null gives an empty text."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given. The backslash comes last, since it makes new ones."""
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(F.replace(out, F.lit("\\c"), F.lit(":")), F.lit("\\b"), F.lit("\\"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(COLON))


def format_examples(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to examples: conv_id, example, formatted, loss_start, loss_length.

    ``formatted`` ends with the reply to learn, at 0-based character ``loss_start``, for ``loss_length`` characters.
    Turns behind the last reply, or of a conversation without one, make one more example with a loss_length of 0,
    so that the output holds every turn. A conversation's rows are ordered by turn, then role, then text: ties and
    repeated rows have one order. Null roles and texts count as empty, a null turn comes first, rows of a null
    conv_id are one conversation. An empty table gives no examples; further columns are not used. One conversation
    is one row while it is formatted, as each of its examples holds all that precedes.
    """
    pieces = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))),
        lambda t: F.struct(_head(t["role"]).alias("head"), escape(t["text"]).alias("text"), (t["role"] == TARGET_ROLE).alias("learn")),
    )
    convs = turns.groupBy("conv_id").agg(pieces.alias("p"))
    last = F.size("p") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(F.col("p"), i)["learn"] | (i == last))
    each = convs.select("conv_id", "p", F.posexplode(ends).alias("example", "end"))
    before = F.array_join(
        F.transform(
            F.slice("p", F.lit(1), F.col("end")), lambda t: F.concat(t["head"], t["text"], F.lit(END))
        ),
        "",
    )
    goal = F.get(F.col("p"), F.col("end"))
    start = F.concat(before, goal["head"])
    return each.select(
        "conv_id",
        "example",
        F.concat(start, goal["text"], F.lit(END)).alias("formatted"),
        F.length(start).alias("loss_start"),
        F.when(goal["learn"], F.length(goal["text"])).otherwise(0).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of one example, as an array of structs (role, text)."""
    parts = F.filter(F.split(formatted, END, -1), lambda x: x != "")

    def parsed(x: Column) -> Column:
        body = F.substring(x, F.lit(len(START) + 1), F.length(x))
        at = F.instr(body, COLON)
        role, text = F.substring(body, F.lit(1), at - 1), F.substring(body, at + len(COLON), F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, parsed)


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, from their formatted text and loss spans alone.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed for each turn of the longest example),
    loss_chars and loss_sha256 (all trainable text, in order), formatted_chars (of all examples).
    """
    span = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))
    read = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        unescape(span).alias("loss"),
        F.col("formatted"),
    )
    by = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("all"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    by = by.select("conv_id", read_turns(F.col("all")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"), "formatted_chars")
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
