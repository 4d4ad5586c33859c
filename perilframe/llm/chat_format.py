"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of public chat templates, which a text may not contain unescaped.
CONTROL = [OPEN, SEP, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(c: Column) -> Column:
    """Write a backslash as \\0 and the k-th control string as \\k: no control string is left, and it reads back."""
    c = F.replace(c, F.lit("\\"), F.lit("\\0"))
    for k, s in enumerate(CONTROL, 1):
        c = F.replace(c, F.lit(s), F.lit(f"\\{k}"))
    return c


def unescape(c: Column) -> Column:
    for k, s in reversed(list(enumerate(CONTROL, 1))):
        c = F.replace(c, F.lit(f"\\{k}"), F.lit(s))
    return F.replace(c, F.lit("\\0"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> (conv_id, formatted, loss_spans).

    Turns are collected as structs, sorted by turn (ties by role, then text), and adjacent turns of one role merge
    into a block `<|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n`. loss_spans lists [start, end) in code points of
    each assistant text within formatted; a text's marks are outside.

    Null text counts as empty, null role as an empty role, null turn sorts first, null conv_id is a conversation of
    its own. Line breaks in a role are written as \\n. Repeated rows are turns of their own. Extra columns are not
    read. A conversation is one output row and has to fit in one, as in any chat format.
    """
    role = F.replace(escape(F.coalesce(F.col("role").cast("string"), F.lit(""))), F.lit("\n"), F.lit("\\n"))
    body = escape(F.coalesce(F.col("text").cast("string"), F.lit("")))
    sorted_ = (turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), body.alias("body")).alias("t"))
               .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")))
    # A turn opens a block unless the turn before has its role, and closes one unless the next has.
    part = F.transform("ts", lambda t, i: F.struct(
        t["role"].alias("role"), t["body"].alias("body"),
        F.when((i > 0) & (F.get("ts", i - 1)["role"] == t["role"]), F.lit(SEP)).otherwise(F.concat(F.lit(OPEN), t["role"], F.lit("\n"))).alias("head"),
        F.when(F.get("ts", i + 1)["role"] == t["role"], F.lit("")).otherwise(F.lit(CLOSE + "\n")).alias("tail")))
    pieces = sorted_.select("conv_id", part.alias("ps"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + F.length(p["tail"])).cast("long").alias("at"),
                        F.when(p["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id", F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.aggregate("ps", begin, add)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), as they were before formatting."""
    blocks = F.filter(F.split(formatted, "\\Q" + OPEN + "\\E"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 2 - len(CLOSE))
        name = unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))
        return F.transform(F.split(body, "\\Q" + SEP + "\\E"), lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
