"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of
one role merged by an array aggregation, and the template is laid on by
concatenation. A merged block keeps its turn borders as a mark, so the
conversation can be read back turn by turn. Any text may hold control strings:
the escape character doubles itself and breaks every `<|` of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT = "<|im_start|>", "<|im_end|>\n", "<|im_next|>"
ESCAPE = "\\"


def escaped(text: Column) -> Column:
    """Every backslash doubled, and one set inside every `<|`: no mark can occur."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit("<|"), F.lit("<" + ESCAPE + "|"))


def escaped_role(role: Column) -> Column:
    """As `escaped`, and line feeds written as backslash n: a role ends at its line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit(ESCAPE + "n"))


def unescaped(text: Column) -> Column:
    """Undoes `escaped`: a backslash before `|` goes, a double one is one."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescaped_role(role: Column) -> Column:
    """Undoes `escaped_role`; an n is a line feed after an odd run of backslashes."""
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_chats(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its id, `formatted` and `segments`.

    segments: array of (text, loss) that joined give `formatted`; loss is true
    for the text of each turn of `loss_role`, false for marks and the rest.
    Turns sort by `order`, nulls first, ties by role, then text. Null role and
    text count as empty; rows of a null conversation id form one conversation;
    repeated rows stay. Only the four named columns are read. An empty table
    gives no rows.
    """
    turn = F.struct(turns[order].alias("at"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))
    chats = turns.groupBy(turns[conv].alias(conv)).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    border = F.transform("_turns", lambda t, i: F.when((i == 0) | (F.get("_turns", i - 1)["role"] != t["role"]), i))
    chats = chats.withColumn("_starts", F.filter(border, lambda i: i.isNotNull()))
    end = lambda j: F.coalesce(F.get("_starts", j + 1), F.size("_turns"))
    blocks = F.transform("_starts", lambda s, j: F.struct(F.get("_turns", s)["role"].alias("role"), F.transform(F.slice("_turns", s + 1, end(j) - s), lambda t: t["text"]).alias("texts")))
    chats = chats.select(conv, blocks.alias("_blocks"))
    mark = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def laid(b):
        head = F.concat(F.lit(START), escaped_role(b["role"]), F.lit("\n"))
        texts = F.transform(b["texts"], lambda t, i: F.array(mark(F.when(i == 0, head).otherwise(NEXT)), F.struct(escaped(t).alias("text"), (b["role"] == loss_role).alias("loss"))))
        return F.concat(F.flatten(texts), F.array(mark(F.lit(END))))

    chats = chats.select(conv, F.flatten(F.transform("_blocks", laid)).alias("segments"))
    return chats.select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted chat, in order."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block):
        inner = F.substr(block, F.lit(len(START) + 1))
        role = F.substring_index(inner, "\n", 1)
        texts = F.split(F.substr(inner, F.length(role) + 2), r"<\|im_next\|>")
        return F.transform(texts, lambda t: F.struct(unescaped_role(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
