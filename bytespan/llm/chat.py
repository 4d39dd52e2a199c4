"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its reply is trainable. The template is

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

for each turn. Inside roles and texts "&" is written "&amp;" and "<|" is written
"&lt;|" (in roles also a line feed as "&#10;"), so no text can forge a control
string and reading back is exact.

Defined cases: a null role or text counts as empty; turns sort by (turn, role,
text), nulls first, so ties have one order and repeated rows stay repeated
turns; a null conv_id is a conversation of its own; other columns are ignored;
an empty table gives no examples. A conversation that doesn't end with an
assistant turn also gets one example without a target, so that no turn is lost.

A conversation is the unit of an example: its last example holds all its turns,
so one conversation has to fit into a row. Conversations are dealt out by
conv_id; a conversation of n turns yields examples of O(n^2) text by definition
of the expansion, made one at a time from an array of n pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|"))
    return F.replace(plain, F.lit("&amp;"), F.lit("&"))


def expand_prefix_targets(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, text, loss_start and loss_chars (code points of
    the trainable span in text; null without a target), last (whether text holds the whole conversation)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == ASSISTANT).alias("target"),
        ),
    )
    made = grouped.select("conv_id", pieces.alias("pieces")).withColumn("n", F.size("pieces"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("pieces", i)["target"] | (i == F.col("n")))
    made = made.select("conv_id", "pieces", "n", F.posexplode(ends).alias("example", "end"))
    before = F.array_join(F.transform(F.slice("pieces", F.lit(1), F.col("end") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    last = F.element_at("pieces", F.col("end"))
    made = made.select("conv_id", "example", "end", (F.col("end") == F.col("n")).alias("last"), before.alias("context"), last.alias("reply"))
    span = F.when(F.col("reply.target"), F.length("context") + F.length("reply.head"))
    return made.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("end").cast("long").alias("n_turns"),
        F.concat("context", "reply.head", "reply.body", F.lit(END + "\n")).alias("text"),
        span.cast("long").alias("loss_start"),
        F.when(F.col("reply.target"), F.length("reply.body")).cast("long").alias("loss_chars"),
        "last",
    )


def parse_turns(text: Column) -> Column:
    """Formatted text back into an array of (role, text)."""
    parts = F.slice(F.split(text, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(text, r"<\|im_start\|>")) - 1, F.lit(0)))
    tail = len(END) + 1

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - tail)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: n_turns, turns_sha256 (over role, \\n, text, \\n of every turn),
    loss_chars and loss_sha256 (all trainable text, unescaped, in order), formatted_chars (all examples), n_examples."""
    turns = F.when(F.col("last"), parse_turns(F.col("text")))
    loss = unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    read = examples.select("conv_id", "example", turns.alias("turns"), loss.alias("loss"), F.length("text").alias("chars"))
    read = read.select(
        "conv_id", "example", "loss", "chars",
        F.size("turns").alias("n"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
        F.col("turns").isNotNull().alias("whole"),
    )
    pieces = F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss"))))
    text = F.array_join(F.transform("pieces", lambda p: p["loss"]), "")
    by = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("whole"), F.col("n"))).cast("long").alias("n_turns"),
        F.max(F.when(F.col("whole"), F.col("sha"))).alias("turns_sha256"),
        pieces.alias("pieces"),
        F.sum("chars").alias("formatted_chars"),
        F.count("loss").alias("n_examples"),
    )
    return by.select("conv_id", "n_turns", "turns_sha256", F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars", "n_examples")
