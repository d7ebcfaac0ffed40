"""Exact dedup with a heavy-hitter split.

Misra-Gries counters (Spark's freqItems) name the digests that may be frequent; an exact count verifies them. Rows of verified
digests meet their winner by a map-side join, all others are grouped by an ordinary shuffle, in which no digest is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweft.llm.shared import SPACES, keep_rows, text_key, text_or_empty, written

#: A digest on more than this share of the rows is surely found; at most 1 / SUPPORT digests are broadcast.
SUPPORT = 0.001


def _winner() -> Column:
    """Most code points first, then smallest doc_id (null last); the row number parts repeated rows."""
    return F.min(F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Texts are equal when they agree after deleting blanks and the control characters 9 to 13. Null text counts as empty, so
    all null, empty and blank texts are one group. Of repeated rows one is kept. An empty table gives an empty result; other
    columns are ignored.
    """
    text = text_or_empty()
    rows = written(docs.select(
        "doc_id", F.char_length(text).cast("long").alias("n_chars"), F.sha2(F.translate(text, SPACES, ""), 256).alias("text_sha256"),
        text_key().alias("text_key"), F.monotonically_increasing_id().alias("row")), "digests")
    frequent = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    winners = written(
        rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(F.count("*").alias("group_size"), _winner())
        .filter("group_size > 1"), "winners")
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = light.groupBy("text_sha256").agg(F.count("*").alias("group_size"), _winner()).filter("group_size > 1")
    alone = F.struct(F.lit(None).cast("long").alias("fewer"), F.lit(None).cast("boolean").alias("no_id"), "doc_id", "row")
    grouped = light.join(groups, "text_sha256", "left").withColumns(
        {"group_size": F.coalesce("group_size", F.lit(1)), "best": F.coalesce("best", alone)})
    return heavy.select(*grouped.columns).unionByName(grouped).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "text_key")


def drop_exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """docs without the rows that exact_duplicates does not keep; all columns stay."""
    return keep_rows(docs, exact_duplicates(docs, support))
