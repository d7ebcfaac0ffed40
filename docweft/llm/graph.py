"""Connected components of links, on tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docweft.llm.shared import heavy_keys, join_split, written


def smallest_connected(links: DataFrame) -> DataFrame:
    """row, class (the smallest row that links reach) of all rows in links (a, b), both long.

    Each row points at another of its component. In a round, rows and what they point at move to the smallest row that a neighbour's
    pointer points at (the hooking and shortcuts of FastSV), so rounds grow with the logarithm of a component's width. A row
    with very many links and a class of very many rows are joined by broadcasts of the few such keys.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    both = written(links.select(a.alias("row"), b.alias("to")).unionByName(links.select(b.alias("row"), a.alias("to"))).distinct(), "edges")
    busy = heavy_keys(both, "to", both.count())
    start = written(both.groupBy("row").agg(F.least("row", F.min("to")).alias("class"), F.lit(None).cast("long").alias("old")), "start")
    rows = start.count()
    labels = _pointing_on(start, rows)
    while not labels.filter("old IS NULL OR old <> grand").isEmpty():
        seen = labels.select(F.col("row").alias("to"), F.col("grand").alias("near"))
        near = join_split(both, seen, "to", busy).groupBy("row").agg(F.min("near").alias("near"))
        met = written(labels.select("row", "class", "grand").join(near, "row"), "near")
        moved = met.select("row", F.least("class", "grand", "near").alias("class"), F.col("grand").alias("old"))
        hooked = met.groupBy("class").agg(F.min("near").alias("near")).select(F.col("class").alias("row"), F.col("near").alias("class"), F.lit(None).cast("long").alias("old"))
        labels = _pointing_on(written(moved.unionByName(hooked).groupBy("row").agg(F.min("class").alias("class"), F.max("old").alias("old")), "moved"), rows)
    return labels.select("row", F.col("grand").alias("class"))


def _pointing_on(labels: DataFrame, rows: int) -> DataFrame:
    """Written: labels (row, class, old) with grand: what the class points at itself."""
    next_ = labels.select(F.col("row").alias("class"), F.col("class").alias("grand"))
    return written(join_split(labels, next_, "class", heavy_keys(labels, "class", rows)), "labels")
