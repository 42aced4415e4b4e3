"""Chat formatting as relational expressions.

Turn structs are collected per conversation and sorted; the turns of a run of one role are
merged by an array aggregation; the runs are concatenated. Where a text stands in the output
is a running sum over the sorted turns. Nothing runs outside Spark expressions, and a
conversation costs time in proportion to its length.

Template, one block per run of turns of one role::

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT ...]<|im_end|>\\n

Escaping is reversible: in a text (or role) every backslash is doubled, then ``<|``
becomes ``<\\|``; a newline in a role becomes ``<\\n|``. So ``<|`` occurs in the output
only where the template wrote it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import text_of

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``(conv_id, formatted, loss_spans)``.

    ``loss_spans`` lists ``(start, length, byte_start, byte_length)``, in code points and in bytes
    of ``formatted`` from 0, one span for each text of ``loss_role`` (the texts alone: no marks,
    no separators).

    Null text or role: empty. Turns are ordered by turn, ties by role then text; null turns
    come first. Repeated rows stay, each as its own turn. Rows with a null conversation id
    form one conversation. Other columns are ignored. No rows: no rows.

    A conversation becomes one row, so its size bounds the memory of a task; different
    conversations never share one.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        text_of(F.col(f"`{role_col}`")).alias("role"),
        text_of(F.col(f"`{text_col}`")).alias("text"),
    )
    t = t.withColumns({"place": F.row_number().over(order), "before": F.lag("role").over(order)})
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    opening = F.when(F.col("before").isNull(), head).when(F.col("before") == F.col("role"), SEP).otherwise(F.concat(F.lit(END), head))
    t = t.withColumns({"open": opening, "body": escape(F.col("text"))})
    until = lambda size: F.sum(size("open") + size("body")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size("body")
    turn = F.struct(
        "place",
        (F.col("before").isNull() | (F.col("before") != F.col("role"))).alias("first"),
        "role",
        "body",
        F.struct(
            until(F.length).alias("start"),
            F.length("body").cast("long").alias("length"),
            until(F.octet_length).alias("byte_start"),
            F.octet_length("body").cast("long").alias("byte_length"),
        ).alias("span"),
    )
    t = t.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    begins = F.transform(F.filter("ts", lambda x: x["first"]), lambda x: x["place"])
    t = t.select("conv_id", "ts", F.concat(begins, F.array(F.size("ts") + 1)).alias("at"))
    runs = F.transform(
        F.slice("at", 1, F.size("at") - 1),
        lambda begin, i: F.struct(
            F.get(F.col("ts"), begin - 1)["role"].alias("role"),
            F.array_join(F.transform(F.slice(F.col("ts"), begin, F.get(F.col("at"), i + 1) - begin), lambda x: x["body"]), SEP).alias("text"),
        ),
    )
    block = lambda r: F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n"), r["text"], F.lit(END))
    spans = F.transform(F.filter("ts", lambda x: x["role"] == loss_role), lambda x: x["span"])
    return t.select("conv_id", F.array_join(F.transform(runs, block), "").alias("formatted"), spans.alias("loss_spans"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """``(conv_id, turns array<struct<role, text>>, loss_text, formatted)`` read back from the output alone."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.locate("\n", b) + 1), r"<\|im_sep\|>"),
                lambda s: F.struct(
                    unescape_role(
                        F.substr(b, F.lit(len(START) + 1), F.locate("\n", b) - F.lit(len(START) + 1))
                    ).alias("role"),
                    unescape(s).alias("text"),
                ),
            ),
        )
    )
    # bytes are cut without a walk from the beginning; as an element of an array they are made once
    whole = F.array(F.struct(F.encode("formatted", "UTF-8").alias("bytes"), F.col("loss_spans").alias("spans")))
    cut = lambda z, s: F.decode(F.substr(z["bytes"], (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")), "UTF-8")
    loss = F.transform(whole, lambda z: F.array_join(F.transform(z["spans"], lambda s: unescape(cut(z, s))), ""))[0]
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def digest(chats: DataFrame) -> DataFrame:
    """The digest columns of the chat query."""
    p = parse_chats(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return p.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
