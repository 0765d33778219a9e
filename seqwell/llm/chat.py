"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that reply is
trainable. Turns after the last reply, and conversations without a reply, are kept as one more example without a
trainable span, so that the output holds every turn.

Template of a turn: ``<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>``. Roles and texts are escaped: a backslash is doubled and
``<|`` becomes ``<\\|``; an escaped string never holds ``<|``, so the control strings are unambiguous and `unescaped`
gives back the exact text.

Defined results: a null text or role counts as empty; rows of one conversation are ordered by (turn, role, text) with
nulls first, repeated rows stay repeated turns; a null conv_id is a conversation of its own; an empty table gives no
examples; other columns are ignored. One conversation's turns are held together, as its full prefix has to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
REPLY = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, formatted, loss_start, loss_end (code point offsets)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    last = F.size("t") - 1
    at = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("t", i)["role"] == REPLY) | (i == last))
    shown = lambda x: F.concat(F.lit(START), escaped(x["role"]), F.lit(SEP), escaped(x["text"]), F.lit(END))
    # each turn is escaped once, below the explode
    cut = whole.select("conv_id", "t", F.transform("t", shown).alias("shown"), at.alias("at")).select("conv_id", "t", "shown", F.posexplode("at").alias("example", "i"))
    own = F.get("t", F.col("i"))
    made = cut.select(
        "conv_id",
        "example",
        (F.col("i") + 1).cast("long").alias("n_turns"),
        F.array_join(F.slice("shown", F.lit(1), F.col("i") + 1), "").alias("formatted"),
        F.when(own["role"] == REPLY, F.length(escaped(own["text"]))).alias("target"),
    )
    end = F.length("formatted") - F.when(F.col("target").isNull(), 0).otherwise(len(END))
    return made.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        "n_turns",
        "formatted",
        (end - F.coalesce("target", F.lit(0))).cast("long").alias("loss_start"),
        end.cast("long").alias("loss_end"),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescaped(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))


def turns_of(formatted: Column) -> Column:
    """The (role, text) turns that an example's formatted string holds, unescaped."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(p, SEP, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """What the formatted output says of each conversation, read back from it."""
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("said")))), lambda x: x["said"]),
            "",
        ).alias("loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    per = per.withColumn("turns", turns_of(F.col("longest")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
