"""Chat formatting with Spark expressions only.

A conversation becomes one text: ``<turn ROLE>`` + parts joined by ``<part>`` + ``</turn>`` and a
line end per block, where a block merges adjacent turns of one role.  Texts cannot hold control
strings: a backslash is written ``\\s`` and ``<`` is written ``\\l`` (in roles ``>`` is also ``\\g``),
which read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.storage import free

OPEN, OPEN_END, PART, CLOSE = "<turn ", ">", "<part>", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _role_escaped(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def _role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv, ``formatted``, ``loss_mask``.

    Turns are ordered by turn number (null first), then role and text, so ties have one order and
    repeated rows stay.  Null roles and texts count as empty; a null conversation id is one
    conversation.  ``loss_mask`` lists [start, end) code points of ``formatted`` that hold texts
    of role ``trained``.  One conversation is one output row and so is gathered in one task.
    """
    rows = turns.select(F.col(conv).alias("c"), F.struct(
        F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")).alias("x"))
    chats = rows.groupBy("c").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # Blocks of adjacent turns of one role: positions where the role changes, then slices between them.
    count = F.size("xs")
    starts = F.filter(F.sequence(F.lit(1), count), lambda i: (i == 1) | (F.element_at("xs", i)["r"] != F.element_at("xs", F.greatest(i - 1, F.lit(1)))["r"]))
    chats = chats.withColumn("starts", starts)
    ends = F.concat(F.expr("slice(starts, 2, size(starts))"), F.array((F.size("xs") + 1).cast("int")))
    blocks = F.zip_with("starts", ends, lambda a, b: F.struct(
        F.element_at("xs", a)["r"].alias("r"), F.transform(F.slice("xs", a, b - a), lambda x: escaped(x["t"])).alias("ps")))
    chats = chats.withColumn("blocks", blocks)
    # Pieces of the output in order: control strings and texts, each with its loss flag.
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("on"))
    off = F.lit(False)
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(piece(F.concat(F.lit(OPEN), _role_escaped(b["r"]), F.lit(OPEN_END)), off)),
        F.flatten(F.transform(b["ps"], lambda p, i: F.array(
            piece(F.when(i == 0, F.lit("")).otherwise(F.lit(PART)), off), piece(p, b["r"] == F.lit(trained))))),
        F.array(piece(F.lit(CLOSE), off)))))
    chats = chats.withColumn("pieces", pieces)
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["s"])).alias("at"),
        F.when(p["on"], F.concat(acc["spans"], F.array(F.array(acc["at"], acc["at"] + F.length(p["s"]))))).otherwise(acc["spans"]).alias("spans"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans"))
    return chats.select(
        F.col("c").alias(conv), F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.aggregate("pieces", zero, step, lambda acc: acc["spans"]).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> back from a formatted conversation, one entry per original turn."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substring(b, F.instr(b, OPEN_END) + len(OPEN_END), F.length(b)), PART),
        lambda p: F.struct(_role_unescaped(F.substring(b, F.lit(len(OPEN) + 1), F.instr(b, OPEN_END) - len(OPEN) - 1)).alias("role"),
                           unescaped(p).alias("text")))))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(formatted, s[0] + 1, s[1] - s[0]))), "")


def chat_digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read ``formatted`` and ``loss_mask`` back and reduce them to counts and digests."""
    turns, loss = free(chats, "turns", "loss")
    read = chats.withColumn(turns, read_turns(F.col("formatted"))).withColumn(loss, loss_text(F.col("formatted"), F.col("loss_mask")))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv, F.size(turns).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(F.col(loss), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
