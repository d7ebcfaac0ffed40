"""Chat formatting with Spark expressions alone.

Turns of a conversation are collected, sorted, and cut where the role changes; each run of turns of one role becomes one block:

    <|turn|>ROLE<|text|>TEXT<|sep|>TEXT ...<|end|>

Control strings inside roles and texts are broken by a word joiner (U+2060) after their first character. Text that holds such a
broken string already gets one more joiner, so undoing it gives the very text back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docweft.llm.shared import text_or_empty

TURN, TEXT, SEP, END = "<|turn|>", "<|text|>", "<|sep|>", "<|end|>"
JOINER = "\u2060"
#: A control string starts with <| (any of ours, or of other templates), or is <s>, </s>, [INST] or [/INST].
_ESCAPE = rf"(<{JOINER}*)(\||s>|/s>)|(\[{JOINER}*)(/?INST\])"
_UNESCAPE = rf"(<{JOINER}*){JOINER}(\||s>|/s>)|(\[{JOINER}*){JOINER}(/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, rf"$1$3{JOINER}$2$4")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$3$2$4")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def formatted_conversations(turns: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conv_id: conv_id, formatted, segments (array of text, loss), which joined in order are the formatted text.

    Turns are sorted by (turn, role, text); null text and null role count as empty, null turns come first, null conv_ids are one
    conversation. Repeated rows are repeated turns. Only the texts of loss_roles are under the loss mask, each as a segment of its
    own. A conversation is one value of the result and so must fit one (2 GB). Other columns are ignored.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    index = F.sequence(F.lit(0), F.size("turns") - 1)
    starts = F.filter(index, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    cut = sorted_.withColumn("starts", starts)
    blocks = F.transform("starts", lambda s, k: F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s))
    no = F.lit(False)

    def block_segments(block: Column) -> Column:
        role = block[0]["role"]
        loss = role.isin(list(loss_roles))
        texts = F.flatten(F.transform(block, lambda t, j: F.when(j == 0, F.array(_segment(escaped(t["text"]), loss))).otherwise(
            F.array(_segment(F.lit(SEP), no), _segment(escaped(t["text"]), loss)))))
        return F.concat(F.array(_segment(F.concat(F.lit(TURN), escaped(role), F.lit(TEXT)), no)), texts, F.array(_segment(F.lit(END), no)))

    segments = cut.withColumn("blocks", blocks).select("conv_id", F.flatten(F.transform("blocks", block_segments)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns back from a formatted text: array of role, text."""
    def turns_of(block: Column) -> Column:
        role = unescaped(F.substring_index(block, TEXT, 1))
        start = F.instr(block, TEXT) + len(TEXT)
        body = F.substring(block, start, F.char_length(block) - start + 1 - len(END))
        return F.transform(F.split(body, r"<\|sep\|>", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, F.length(formatted) + 1)
    return F.flatten(F.transform(blocks, turns_of))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, without its escapes, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def loss_read(formatted: Column, loss_roles: Sequence[str] = ("assistant",)) -> Column:
    """The same text read back from a formatted text alone: its mask covers what stands between the marks in blocks of loss_roles."""
    own = F.filter(read_turns(formatted), lambda t: t["role"].isin(list(loss_roles)))
    return F.array_join(F.transform(own, lambda t: t["text"]), "")
