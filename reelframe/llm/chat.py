"""Chat formatting: turns of a conversation become one marked string, in Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn (ties: role, then text,
nulls first, so repeated rows give the same string every time). An array aggregation merges
adjacent turns of one role into blocks; a block is

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT...<|im_end|>\\n

so the merge loses no turn border. In texts and roles every backslash is doubled and `<|` becomes
`<\\|`: a marker can't occur inside a text, and `unescape` gives the text back. A line feed in a
role becomes `<|nl|>`, which escaped text can't hold either.

Defined cases: a null text or role is empty; a null turn sorts first; rows of a null conversation
id form one conversation with a null id; a conversation is one row, however many turns or long texts it has, and
its time grows with the square of its turns; an empty table gives an empty result; columns beside
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, NL = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"
TRAINED_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    """The inverse of escape: after the first step backslashes stand in pairs only."""
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(NL))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(NL), F.lit("\n")))


def _merged(turns: Column) -> Column:
    """Blocks of adjacent turns of one role: array<struct<role, texts>>."""
    block = "array<struct<role:string,texts:array<string>>>"

    def step(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))),
        )
        added = F.concat(acc, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))))
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == t["role"])
        return F.when(same, joined).otherwise(added).cast(block)

    return F.aggregate(turns, F.array().cast(block), step)


def _mask(blocks: Column) -> Column:
    """(start, length) in `formatted`, from 0, of each text that the model is trained on."""
    state = "struct<at:int,spans:array<struct<start:int,length:int>>>"
    empty = F.array().cast("array<struct<start:int,length:int>>")

    def texts(acc: Column, block: Column) -> Column:
        begin = acc["at"] + F.lit(len(START) + 1) + F.length(block["role"])
        inner = F.aggregate(
            block["texts"],
            F.struct(begin.alias("at"), acc["spans"].alias("spans")).cast(state),
            lambda a, t: F.struct(
                (a["at"] + F.length(t) + len(SEP)).alias("at"),
                F.when(
                    block["role"] == TRAINED_ROLE,
                    F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(t).alias("length")))),
                ).otherwise(a["spans"]).alias("spans"),
            ).cast(state),
        )
        return F.struct((inner["at"] + F.lit(len(END) + 1 - len(SEP))).alias("at"), inner["spans"].alias("spans")).cast(state)

    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("spans")).cast(state), texts, lambda a: a["spans"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss_mask (spans in formatted)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    collected = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(_escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    blocks = collected.select("conv_id", _merged(escaped).alias("blocks"))
    line = F.array_join(
        F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END + "\n"))), ""
    )
    return blocks.select("conv_id", line.alias("formatted"), _mask(F.col("blocks")).alias("loss_mask"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """The turns and trained texts, from the formatted strings and spans alone."""
    quoted = lambda s: "\\Q" + s + "\\E"
    pieces = F.slice(F.split("formatted", quoted(END + "\n")), 1, F.size(F.split("formatted", quoted(END + "\n"))) - 1)

    def of_block(b: Column) -> Column:
        body = F.substr(b, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substr(body, F.length(role) + 2), quoted(SEP))
        return F.transform(texts, lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")))

    return formatted.select(
        "*",
        F.flatten(F.transform(pieces, of_block)).alias("turns"),
        F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss_texts"),
    )
