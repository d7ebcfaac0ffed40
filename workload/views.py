"""Views over the given tables: documents, candidates, results, edits, jobs, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweft.functions.text import fixed_decimals
from docweft.schema import null_value, value_struct
from workload.fixed import FAILURE_MESSAGES

STAMP = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(key: Column, values: tuple[str, ...]) -> Column:
    """The value at position `key` of a fixed list."""
    return F.get(F.array(*[F.lit(v) for v in values]), key.cast("int"))


def orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    running = F.coalesce((status == "O") & urgent, F.lit(False))
    failed = (status == "P") & ~low
    stages = ("parsing", "extracting", "validating", "post_checks")
    return orders_of_customers(spark, sf_dir).select(
        F.col("c_mktsegment").alias("tenant_id"), key.alias("job_id"), key.alias("document_id"),
        (key % 7).alias("template_version_id"),
        F.when(status == "F", "completed").when(status == "P", F.when(low, "cancelled").otherwise("failed"))
        .when(urgent, "running").otherwise("queued").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.timestamp_add("HOUR", (key % 48).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("updated_at"),
        F.when(failed, choose(key % 7, FAILURE_MESSAGES)).alias("error_message"),
        F.when(running, choose(key % 4, stages)).alias("progress_stage"),
        F.when(key % 5 == 0, (key % 300).cast("double") - 50.5).alias("progress_pct"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("Vendor Name: "), F.col("c_mktsegment"), F.lit("\nTotal Due: $"),
        fixed_decimals(F.col("o_totalprice"), 2, grouped=True), F.lit("\nOrder Date: "),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nInvoice "), F.col("o_orderkey").cast("string"))
    return orders_of_customers(spark, sf_dir).select(
        F.col("o_orderkey").alias("doc_id"), F.col("c_mktsegment").alias("tenant_id"),
        (F.col("o_orderkey") % 7).alias("template_version_id"), "o_totalprice", "o_orderdate", text.alias("text"))


def field_name() -> Column:
    return F.concat(F.lit("field_"), F.col("l_linenumber").cast("string"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = ~((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"))
    price = F.col("l_extendedprice")
    cited = F.concat(F.col("l_returnflag"), F.lit(" "), F.col("l_quantity").cast("bigint").cast("string"))
    nothing = F.lit(None)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("result_id"), field_name().alias("field_name"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("seq"),
        price.cast("string").alias("extracted_value"),
        F.when(usable, value_struct(amount=price, currency=F.lit("USD"))).otherwise(null_value()).alias("normalized_value"),
        (1 - F.col("l_discount") * 5).alias("confidence"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(cited).alias("source_text"),
        nothing.cast("int").alias("char_start"), nothing.cast("int").alias("char_end"),
        nothing.cast("int").alias("page_number"), F.lit("").alias("location_reference"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(".")).alias("notes"),
        (F.col("l_returnflag") == "R").alias("requires_review"),
    )


def result_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders are results, also those without a single candidate."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result_id"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    invalid = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_extendedprice").alias("amount"), F.max(1 - F.col("l_discount") * 5).alias("confidence"),
        F.bool_or(invalid).alias("invalid"), F.bool_or(F.col("l_returnflag") != "N").alias("requires_review"))
    return grouped.select(
        F.col("l_orderkey").alias("result_id"), field_name().alias("field_name"),
        F.concat(F.lit("Field "), F.col("l_linenumber").cast("string")).alias("label"), F.lit("currency").alias("data_type"),
        F.col("amount").cast("string").alias("extracted_value"),
        value_struct(amount=F.col("amount"), currency=F.lit("USD")).alias("normalized_value"),
        "confidence", F.when(F.col("invalid"), "invalid").otherwise("valid").alias("validation_status"),
        "requires_review", (F.col("l_linenumber") - 1).alias("field_no"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("result_id"), field_name().alias("field_name"),
        value_struct(amount=F.col("l_extendedprice"), currency=F.lit("USD")).alias("new_value"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("edited "), F.col("l_partkey").cast("string"))).alias("extracted_value"),
        F.concat(F.lit("reviewer_"), F.col("l_suppkey").cast("string")).alias("reviewer"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        (days * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("seq"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("tenant_"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        F.col("event_type").alias("action"), F.col("props").alias("metadata"),
        F.col("ts").cast("timestamp").alias("created_at"), "user_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.floor(F.col("turn") / 2).cast("int") + 1).alias("page_no"),
        F.col("turn").alias("seq"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")
