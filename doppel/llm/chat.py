r"""Training examples from conversations by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, only its text under the loss mask. Turns after
the last assistant turn, or of a conversation without one, come as a last example with an empty mask, so no turn is lost.

A turn is written as `<s>[INST] role [/INST]text</s>`. Inside roles and texts a backslash is doubled and each of the four control
strings gets a backslash after its first character, so control strings mark turns only and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"

# Targets expanded by one row; more of a long conversation go to other tasks.
TARGETS = 32


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def format_examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn, and one for trailing turns without a reply.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, then role, then text, nulls first;
    repeated rows are turns of their own. Null roles and texts are empty, rows of a null conv_id form one conversation, an empty
    table gives no rows. Returns conv_id, example (from 0), n_turns, whole (it holds all turns), text, loss_start, loss_end
    (code points of the reply in the text; equal where nothing is trainable).
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
             .withColumn("turns", F.transform("turns", lambda t: F.struct(
                 (t["role"] == "assistant").alias("target"),
                 F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"))))
             .withColumn("ends", F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["target"] | (i == F.size("turns"))))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.size("ends") - 1) / TARGETS).cast("int"))))
             .repartition("conv_id", "chunk"))
    made = (turns.select("conv_id", "turns", "chunk", F.posexplode(F.slice("ends", F.col("chunk") * TARGETS + 1, F.lit(TARGETS))).alias("k", "n"))
            .withColumn("last", F.element_at("turns", F.col("n")))
            .withColumn("context", F.array_join(F.transform(
                F.slice("turns", F.lit(1), F.col("n") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")))
    start = F.length("context") + F.length("last.head")
    text = F.concat("context", F.col("last.head"), F.col("last.body"), F.lit(CLOSE))
    return made.select(
        "conv_id", (F.col("chunk") * TARGETS + F.col("k")).cast("long").alias("example"), F.col("n").cast("long").alias("n_turns"),
        (F.col("n") == F.size("turns")).alias("whole"), text.alias("text"),
        F.when(F.col("last.target"), start).otherwise(F.length(text)).cast("long").alias("loss_start"),
        F.when(F.col("last.target"), start + F.length("last.body")).otherwise(F.length(text)).cast("long").alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of role and text."""
    pieces = F.split(text, CLOSE, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substr(F.split(p, r" \[/INST\]", 2)[0], F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.split(p, r" \[/INST\]", 2)[1]).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: turns, trainable text and length."""
    lines = F.array_join(F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.substr("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    read = examples.select(
        "conv_id", "example", "n_turns", F.length("text").alias("chars"), loss.alias("loss"), F.when(F.col("whole"), F.sha2(lines, 256)).alias("sha"))
    grouped = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum(F.length("loss")).alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    joined = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return grouped.select("conv_id", "n_turns", "turns_sha256", "loss_chars", F.sha2(joined, 256).alias("loss_sha256"), "formatted_chars")
