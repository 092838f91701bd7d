"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template, one after another without anything between:

    [INST user] text [/INST]        any role but assistant; its name stands in the mark
    [OUT] text</s>                  assistant; its text is what the loss counts

A conversation is rendered with its texts as they are, parsed again by the grammar above and
compared with its source.  Where they differ, the texts that hold a control character are
escaped (mark with "!": ``[INST! user]``, ``[OUT!]``), and, should the turns still differ, all
texts are; escaped texts hold no ``[`` and no ``<``, so that the last step always agrees.
Escapes: backslash ``\\b``, ``[`` ``\\o``, ``]`` ``\\c``, ``<`` ``\\l``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
TURN = r"\[INST(!?) ([^\]]*)\] ([\s\S]*?) \[/INST\]|\[OUT(!?)\] ([\s\S]*?)</s>"
ESCAPES = (("\\", "\\b"), ("[", "\\o"), ("]", "\\c"), ("<", "\\l"))
CONTROL = r"[\[<\\]"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _render(turns: Column, level: int) -> Column:
    """Text of all turns; level 0 escapes nothing, 1 texts with a control character, 2 all."""

    def one(t: Column) -> Column:
        if level == 0:
            mark, text = F.lit(""), t["text"]
        else:
            needs = F.lit(True) if level == 2 else t["text"].rlike(CONTROL)
            mark, text = F.when(needs, "!").otherwise(""), F.when(needs, escape(t["text"])).otherwise(t["text"])
        out = F.concat(F.lit("[OUT"), mark, F.lit("] "), text, F.lit("</s>"))
        return F.when(t["role"] == ASSISTANT, out).otherwise(F.concat(F.lit("[INST"), mark, F.lit(" "), escape(t["role"]), F.lit("] "), text, F.lit(" [/INST]")))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text, raw), raw with its marks."""

    def one(m: Column) -> Column:
        loss = m.startswith("[OUT")
        group = lambda i: F.regexp_extract(m, TURN, i)
        text = F.when(loss, group(5)).otherwise(group(3))
        marked = F.when(loss, group(4)).otherwise(group(1)) == "!"
        return F.struct(
            F.when(loss, ASSISTANT).otherwise(unescape(group(2))).alias("role"),
            F.when(marked, unescape(text)).otherwise(text).alias("text"),
            text.alias("raw"),
            m.alias("turn_text"),
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), one)


def _same(turns: Column, formatted: Column, parsed: Column) -> Column:
    """Whether the parse covers the whole text and gives the source's turns."""
    bare = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return (F.array_join(F.transform(parsed, lambda t: t["turn_text"]), "") == formatted) & (bare(turns) == bare(parsed))


def format_chats(rows: DataFrame) -> DataFrame:
    """Format conversations (conv_id, turn, role, text), one row per conv_id.

    Result: conv_id, formatted string, turns array<struct<role,text>> as read back from formatted,
    pieces array<struct<text, runs>>: formatted cut by turn, each with its part of the mask;
    loss_mask array<struct<chars int, loss boolean>>: runs of code points that cover formatted.
    A null text or role is empty; an empty role stays one; rows are taken by turn, then role, then
    text (null turns first, repeated rows each count); rows with a null conv_id form one conversation;
    an empty table gives an empty table; other columns are not looked at.
    One conversation is one output row, so it must fit into a task, as its digest must anyhow.
    """
    src = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    df = src.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    df = df.withColumn("formatted", _render(F.col("source"), 0)).withColumn("parsed", parse(F.col("formatted")))
    for level in (1, 2):
        df = df.withColumn("same", _same(F.col("source"), F.col("formatted"), F.col("parsed")))
        df = df.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(_render(F.col("source"), level)))
        df = df.withColumn("parsed", F.when(F.col("same"), F.col("parsed")).otherwise(parse(F.col("formatted"))))
    run = lambda n, loss: F.struct(n.alias("chars"), F.lit(loss).alias("loss"))

    def runs(t: Column) -> Column:
        whole, body = F.length(t["turn_text"]), F.length(t["raw"])
        spoken = F.array(run(whole - body - 4, False), run(body, True), run(F.lit(4), False))
        return F.when(t["role"] == ASSISTANT, spoken).otherwise(F.array(run(whole, False)))

    return df.select(
        "conv_id",
        "formatted",
        F.transform("parsed", lambda t: F.struct(t["turn_text"].alias("text"), runs(t).alias("runs"))).alias("pieces"),
        F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.flatten(F.transform("parsed", runs)).alias("loss_mask"),
    )


def loss_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, cut from the formatted text run by run and unescaped where its turn is marked; nothing between."""

    def step(acc: Column, run: Column) -> Column:
        body = F.substring(formatted, acc["at"] + 1, run["chars"])
        mark = F.substring(formatted, acc["at"] - 2, F.lit(1)) == "!"  # of "[OUT!] ", right before the text
        parts = F.when(run["loss"], F.array_append(acc["parts"], F.when(mark, unescape(body)).otherwise(body))).otherwise(acc["parts"])
        return F.struct((acc["at"] + run["chars"]).alias("at"), parts.alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(loss_mask, zero, step, lambda acc: F.array_join(acc["parts"], ""))


def loss_of_pieces(pieces: Column) -> Column:
    """The same from the pieces of the formatted text, one a turn, that it is the sequence of: work in proportion to the text."""

    def cut(piece: Column) -> Column:
        def one(run: Column, k: Column) -> Column:
            at = F.aggregate(F.slice(piece["runs"], F.lit(1), k), F.lit(0), lambda a, r: a + r["chars"])
            body = F.substring(piece["text"], at + 1, run["chars"])
            mark = F.substring(piece["text"], at - 2, F.lit(1)) == "!"
            return F.when(run["loss"], F.when(mark, unescape(body)).otherwise(body)).otherwise("")

        return F.array_join(F.transform(piece["runs"], one), "")

    return F.array_join(F.transform(pieces, cut), "")


def digests(rows: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted text: the turns by the grammar, the loss text under the loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return format_chats(rows).withColumn("loss", loss_of_pieces(F.col("pieces"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
