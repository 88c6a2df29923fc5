"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor turns the parts of each turn (text, image, audio, document) into one string with ordered
placeholders, recording each attachment's reference and the tokens it will expand to. Turns are marked by control
strings; texts are escaped so that no text can hold one, and the escape can be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

START, END = "<|im_start|>", "<|im_end|>\n"
NEWLINE = "<|nl|>"  # a line break inside a role
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 512


def escape(text: Column) -> Column:
    """Backslashes are doubled, then one is put into each ``<|``; see :func:`unescape`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    # Between < and | an escaped text has one backslash from the mark or an even number from doubling.
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A turn of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def _tokens(p: Column) -> Column:
    size = lambda x: F.coalesce(F.greatest(x, F.lit(0)), F.lit(0))
    return (
        F.when(p["type"] == "image", F.ceil(size(p["width"]) / PATCH) * F.ceil(size(p["height"]) / PATCH))
        .when(p["type"] == "audio", F.ceil(F.coalesce(F.greatest(p["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", size(p["pages"]) * PAGE_TOKENS)
        .otherwise(0).cast("long")
    )


def visit(parts: Column) -> Column:
    """struct(content, attachments): the flattened content of a turn.

    Parts of an unknown or null type are taken as text; null text is empty.
    """

    def flat(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, mark in PLACEHOLDERS.items():
            out = F.when(p["type"] == kind, F.lit(mark)).otherwise(out)
        return F.coalesce(out, escape(F.coalesce(p["text"], F.lit(""))))

    held = F.filter(parts, lambda p: F.coalesce(p["type"].isin(*PLACEHOLDERS), F.lit(False)))
    return F.struct(
        F.array_join(F.transform(parts, flat), "").alias("content"),
        F.transform(held, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("attachments"),
    )


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask, attachments, attachment_tokens.

    ``mask`` lists the contents of ``learn_role`` in ``formatted``: (start, chars) from 0 in code points, and (byte, bytes)
    of the same in UTF-8. Turns are ordered by turn, then role, then content (so ties have one order); a null role is
    empty, a null turn comes first, and rows without a conversation id form one of their own. Repeated rows stay. Parts that
    are null or empty are an empty content. An empty table gives an empty table. Other columns are not looked at.
    Rows are formatted before they are shuffled; places are a running sum over the sorted rows of a
    conversation, so the work is in proportion to its turns. The string of one conversation is made in one task.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    seen = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), visit(F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))).alias("v"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    rows = seen.select("conv_id", "turn", "role", head.alias("head"), F.col("v.content").alias("content"), F.col("v.attachments").alias("attachments"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "attachments").rowsBetween(Window.unboundedPreceding, -1)

    def place(size) -> Column:
        whole = size("head") + size("content") + len(END)
        return F.coalesce(F.sum(whole).over(before), F.lit(0)) + size("head")

    item = F.struct(place(F.length).alias("start"), place(F.octet_length).alias("byte"), "head", "content", (F.col("role") == learn_role).alias("learn"), "attachments")
    conv = rows.select("conv_id", item.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("p"))  # by start
    conv = conv.withColumn("attachments", F.flatten(F.transform("p", lambda t: t["attachments"])))
    learnt = F.filter("p", lambda t: t["learn"])
    return conv.select(
        "conv_id",
        F.array_join(F.transform("p", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.transform(learnt, lambda t: F.struct(t["start"], F.length(t["content"]).alias("chars"), t["byte"], F.octet_length(t["content"]).alias("bytes"))).alias("mask"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def parse(formatted: Column) -> Column:
    """array<struct(role, text)>: the turns read back from a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda x, i: i > 0)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        rest = let(role, lambda r: F.substr(x, F.length(r) + 2, F.length(x) - F.length(r) - 1 - len(END)))
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(rest).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, one after the other. Bytes are cut, as code points would be counted from the start each time."""

    def cut(raw: Column) -> Column:
        return F.array_join(F.transform(mask, lambda m: unescape(F.substring(raw, m["byte"].cast("int") + 1, m["bytes"]).cast("string"))), "")

    return let(formatted.cast("binary"), cut)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of :func:`format_conversations`."""
    read = formatted.withColumn("__turns", parse(F.col("formatted"))).withColumn("__loss", masked_text(F.col("formatted"), F.col("mask")))
    said = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("__turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
