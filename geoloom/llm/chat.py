"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Each assistant turn becomes an example of its own: all preceding turns as context, then the reply, which alone is
under the loss mask. Turns after the last reply (or a conversation without one) give one more example with an
empty mask, so no turn is lost.

A turn is ``<s>[role]`` newline text ``</s>``. Inside roles and texts the characters that markers are made of are
escaped with a backslash and a letter, so no text can forge a marker, and :func:`parse_turns` gives back
every turn exactly.

Turns are ordered by turn, then role, then text, nulls first, so ties and repeated rows have one defined order.
Null text or role is empty. A null conv_id is a conversation of its own. An empty table gives an empty result.
Examples hold their whole prefix: the size of an output follows from the method and is not cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, NAMED, END = "<s>[", "]\n", "</s>"
REPLY = "assistant"
#: Fixed order: the backslash goes first when escaping and last when reading back.
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c"))


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id long, example int, text string, mask_start long, mask_length long); offsets in code points from 0."""
    empty = F.lit("")
    row = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(
        (t["role"] == REPLY).alias("reply"),
        F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(NAMED)).alias("head"),
        escape(t["text"]).alias("body"),
    ))
    whole = whole.select("conv_id", parts.alias("parts"))
    # the last turn always ends an example; other turns do if they are replies
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda k: F.element_at("parts", k)["reply"] | (k == F.size("parts")))
    ended = whole.select("conv_id", "parts", F.posexplode(ends).alias("example", "k"))
    last = F.element_at("parts", F.col("k"))
    text_of = lambda p: F.concat(p["head"], p["body"], F.lit(END))
    context = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("k") - 1), text_of), "")
    return ended.select("conv_id", "example", context.alias("context"), last.alias("last")).select(
        "conv_id",
        "example",
        F.concat("context", text_of(F.col("last"))).alias("text"),
        (F.length("context") + F.length("last.head")).cast("long").alias("mask_start"),
        F.when(F.col("last.reply"), F.length("last.body")).otherwise(0).cast("long").alias("mask_length"),
    )


def parse_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    raw = F.slice(F.split(text, END), F.lit(1), F.size(F.split(text, END)) - 1)
    return F.transform(raw, lambda t: F.struct(
        unescape(F.substring_index(F.substr(t, F.lit(len(BEGIN) + 1)), NAMED, 1)).alias("role"),
        unescape(F.substring_index(t, NAMED, -1)).alias("text"),
    ))


def masked(text: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example."""
    return unescape(F.substr(text, start.cast("int") + 1, length.cast("int")))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and checksums of each conversation, read back from its examples."""
    read = formatted.withColumn("loss", masked(F.col("text"), F.col("mask_start"), F.col("mask_length")))
    per = read.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    turns = parse_turns(F.col("longest"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select("conv_id", turns.alias("turns"), "loss", "formatted_chars").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
