"""Sharding by proportional stratified interleaving.

Rows are ranked within their source in a seeded order; (rank + 1/2) / rows of the source is a row's fractional rank. In the order
of that rank every stretch of rows holds the sources in their overall proportion, so equal stretches make the shards.

All ranks come from counts over ordered buckets (ranges of source and hash, then stretches of the fractional rank) and row numbers
inside a bucket. Ranges cut through a large source and through repeated rows, so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweft.llm.shared import buckets_for, numbered, rows_before, text_or_empty, written


def document_size() -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the record's length."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, source, shard (0 to shards - 1), slot (0, 1, ... in each shard).

    Shards' row counts differ by one at most, and every shard holds each source in its overall proportion, up to one row per
    source. Null text counts as empty; null sources are one source. Repeated rows get different slots. Nothing but doc_id, text
    and source is read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    crc, size = F.crc32(text_or_empty()), document_size()
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), crc.cast("string"), size.cast("string")))
    rows = written(docs.select(
        "doc_id", "source", size.alias("size"), crc.alias("text_crc32"), F.substring(mark, 1, 16).alias("hash"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("stratum")), "shard-rows")
    total = rows.count()
    ranks = numbered(rows, "stratum", ["hash", "doc_id", "text_crc32", "size"]).withColumnRenamed("idx", "rank")
    ranked = written(ranks.withColumn("fraction", (F.col("rank") + 0.5) / F.col("of")).drop("hash", "of"), "ranked")

    buckets = buckets_for(spark, total)
    stretched = ranked.withColumn("bucket", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    stretches = written(rows_before(stretched.groupBy("bucket").agg(F.count("*").alias("rows")), "bucket"), "stretches").select("bucket", "before")
    order = Window.partitionBy("bucket").orderBy("fraction", "stratum", "rank")
    placed = stretched.withColumn("number", F.row_number().over(order)).join(stretches, "bucket")
    place = F.col("before") + F.col("number") - 1
    shard = F.floor(place * shards / F.lit(max(total, 1))) if total * shards < 1 << 53 else (place.cast("decimal(20,0)") * shards / total).cast("long")
    cut = placed.select("doc_id", "size", "text_crc32", "source", place.alias("place"), shard.cast("int").alias("shard"))
    first = F.ceil(F.col("shard").cast("long") * total / F.lit(shards))
    return cut.select("doc_id", "size", "text_crc32", "source", "shard", (F.col("place") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The texts, one folder per shard and in slot order within each file. Needs doc_ids that tell the rows apart."""
    docs.join(placed.select("doc_id", "shard", "slot"), "doc_id").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
