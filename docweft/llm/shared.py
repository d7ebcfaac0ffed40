"""What several operators need: written intermediate tables, row decisions, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Tokens of the text separated by these count as words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="docweft-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe from lost executors, and with a size that Spark knows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 8 << 20) -> Iterator[None]:
    """Whole texts go to Python at most `rows` rows and about `size` bytes at a time in the jobs run inside, and no more than the session allows itself.

    Tasks hold a batch in the JVM and several times in Python, so this bounds what workers take. No result depends on it.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, most in wanted.items():
        now = int(before[key].rstrip("bB"))
        spark.conf.set(key, str(min(now, most) if now > 0 else most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """With doc_id, this tells rows of different texts apart."""
    return F.xxhash64(text_or_empty(column))


def buckets_for(spark: SparkSession, rows: int, most: int = 100_000) -> int:
    """How many buckets give each about `most` rows or fewer, and each core one at least. No result may depend on it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


#: Bits of the largest filter that is broadcast: 16 MB.
FILTER_BITS = 27


def _listed(rows: DataFrame, key: str, listed: DataFrame, count: int) -> DataFrame:
    """rows with `__maybe`: whether they may be among the listed (doc_id, text_key); true for each that is, and for few others.

    The hashes of the listed rows set bits of a filter of 64 bits a row, at most 2^FILTER_BITS, held as bitmaps of 32,768 bits each.
    """
    bits = min(FILTER_BITS, max(15, (64 * count - 1).bit_length()))
    place = lambda key: F.pmod(F.xxhash64("doc_id", key), F.lit(1 << bits))
    own = listed.select(place("text_key").alias("at")).groupBy(F.shiftright("at", 15).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32_767))).alias("__bits"))
    met = rows.withColumns({"__at": place(key), "__bucket": F.shiftright(place(key), 15)}).join(F.broadcast(own), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(F.col("__at").bitwiseAND(F.lit(32_767)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.col("__at").bitwiseAND(F.lit(7)).cast("int"))
    return met.withColumn("__maybe", F.coalesce(bit == 1, F.lit(False))).drop("__bits", "__bucket", "__at")


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs that decisions (doc_id, text_key, kept: one row per row of docs) keep.

    Of rows equal in doc_id and text, as many stay as are kept. Texts are not shuffled for it: a bounded filter of the dropped rows' hashes is
    broadcast, rows that it lets pass stay, and of the few others only the keys meet the list of dropped rows. Repeated rows of which
    several but not all stay are written and numbered on their keys, in ranges, however many there are.
    """
    row = written(decisions.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("rows"), F.sum(F.col("kept").cast("long")).alias("stay")).filter("stay < rows"), "decisions")
    count = row.count()
    if not count:
        return docs
    keyed = _listed(docs.withColumn("__key", text_key()), "__key", row, count)

    def meets(rows: DataFrame, side: DataFrame, how: str, *more: str) -> DataFrame:
        side = side.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), *more)
        return rows.join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text")), how)

    kept, maybe = keyed.filter("NOT __maybe"), keyed.filter("__maybe")
    wrongly = written(meets(maybe.select("doc_id", "__key"), row, "left_anti").distinct().withColumnRenamed("__key", "text_key"), "wrongly")
    one, several = row.filter("stay = 1"), row.filter("stay > 1")
    if not wrongly.isEmpty():
        kept = kept.unionByName(meets(maybe, wrongly, "left_semi"))
    if not one.isEmpty():
        kept = kept.unionByName(meets(maybe, one, "left_semi").dropDuplicates(["doc_id", "__key"]))
    if not several.isEmpty():
        some = written(meets(maybe, several, "left_semi").withColumn("__at", F.monotonically_increasing_id()), "repeated")
        group = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("__key").cast("string"))
        numbers = numbered(written(some.select("doc_id", "__key", "__at", group.alias("__group")), "numbers"), "__group", [])
        first = meets(numbers, several, "inner", F.col("stay").alias("__stay")).filter("idx < __stay").select("__at")
        kept = kept.unionByName(some.join(first, "__at", "left_semi").drop("__at"))
    return kept.drop("__key", "__maybe")


def rows_before(counts: DataFrame, bucket: str, *within: str) -> DataFrame:
    """Adds `before`: the rows in earlier buckets. Counts are few: buckets by groups at most."""
    along = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("rows").over(along), F.lit(0)))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (a written table) with idx (0, 1, ... in each group by `order`, nulls first) and of (the group's rows).

    Rows are cut into ranges of (group, order), numbered inside them, and the counts of the ranges before are added: neither a
    large group nor many rows of one key meet in one task. Rows equal in group and order come in any order.
    """
    ranges = buckets_for(rows.sparkSession, rows.count())
    at = F.monotonically_increasing_id()
    cut = written(rows.withColumn("__row", at).repartitionByRange(ranges, group, *order, "__row").withColumn("__range", F.spark_partition_id()), "ranges")
    counts = rows_before(cut.groupBy(group, "__range").agg(F.count("*").alias("rows")), "__range", group)
    counts = written(counts.withColumn("of", F.sum("rows").over(Window.partitionBy(group))), "counts").drop("rows")
    number = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order, "__row"))
    joined = cut.withColumn("__number", number).join(counts, [group, "__range"])
    return joined.withColumn("idx", F.col("before") + F.col("__number") - 1).drop("__row", "__range", "__number", "before")


def heavy_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """Written: the keys that many of the `total` rows share, at most four for each partition of a shuffle."""
    limit = max(1_000, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return written(rows.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > limit).select(key), "heavy")


def join_split(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """left joined ("inner" or "left") to right, which has each key at most once; the columns of both. No key is null.

    The rows of left with a heavy key, from heavy_keys, meet their rows of right in a broadcast, which is as short as that list. Other
    keys are shuffled as usual. So no task gets one key's rows in bulk.
    """
    if heavy.isEmpty():
        return left.join(right, key, how)
    light = left.join(F.broadcast(heavy), key, "left_anti").join(right, key, how)
    bulk = left.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(right.join(F.broadcast(heavy), key, "left_semi")), key, how)
    return light.unionByName(bulk)
