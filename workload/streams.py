"""Streaming operators on static data, and one real stream over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweft.operators import ops
from docweft.schema import FieldDef, Template
from docweft.streaming import streams as st
from workload import views as v
from workload.ops import log_lines
from workload.registry import query
from workload.sources import scratch

STAMP_SQL = "'%Y-%m-%d %H:%M:%S'"
TOTAL = Template("Totals", "1", "invoice", (FieldDef("total_amount", "Total Amount", "currency"),))


def stamp(column: str) -> Column:
    return F.date_format(column, v.STAMP)


def start_sql(seconds: int) -> str:
    return f"strftime(make_timestamp(CAST(floor(epoch(ts) / {seconds}) * {seconds} AS BIGINT) * 1000000), {STAMP_SQL})"


@query("l01_stream_extract", """
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS attempt,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 0.5 ELSE o_totalprice END AS total_amount, 'pending' AS review_status FROM orders""")
def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once, every fourth again with a second attempt; the stream keeps the latest."""
    inbox, out, checkpoint = (scratch(spark, n) for n in ("inbox", "stream", "checkpoint"))
    docs = v.invoices(spark, sf_dir).select(F.col("doc_id").alias("job_id"), F.lit(1).alias("attempt"), "doc_id", "text")
    again = docs.filter("job_id % 4 = 0").select(
        "job_id", F.lit(2).alias("attempt"), "doc_id", F.concat(F.lit("Total Due: $"), F.col("job_id").cast("string"), F.lit(".50")).alias("text"))
    docs.unionByName(again).write.parquet(inbox)
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(inbox)
    st.stream_extract(source, TOTAL, out, checkpoint).awaitTermination()
    amount = F.get_json_object(F.get("extracted_fields", F.lit(0))["normalized_value"], "$.amount").cast("double")
    return st.latest_results(spark, out).select("job_id", "attempt", amount.alias("total_amount"), "review_status")


_sums = ", ".join(
    [f"CAST(sum(CASE WHEN event_id % 4 = 1 THEN user_id % {i + 2} ELSE user_id % {i + 2} END) AS BIGINT) AS {n}" for i, n in enumerate(ops.EXTRACTION_SUMS)]
    + [f"CAST(sum(CASE WHEN user_id % 3 <> 0 THEN user_id % {i + 3} ELSE 0 END) AS BIGINT) AS {n}" for i, n in enumerate(ops.FEEDBACK_SUMS)])


@query("l02_stream_log_counts", f"""
SELECT {start_sql(3600)} AS window_start, CASE event_id % 4 WHEN 0 THEN '{ops.REJECTED}' WHEN 1 THEN '{ops.COMPLETED}' ELSE '{ops.FEEDBACK}' END AS event,
  count(*) AS n_lines, CAST(sum(user_id) AS BIGINT) AS document_chars, {_sums}
FROM events WHERE event_id % 50 <> 0 AND event_id % 77 <> 0 AND event_id % 91 <> 0 AND event_id % 4 < 3 GROUP BY 1, 2""")
def stream_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.stream_log_counts(log_lines(spark, sf_dir)).withColumn("window_start", stamp("window_start"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = st.event_time(v.table(spark, sf_dir, "events"))
    return events.select(
        "ts", F.concat(F.lit("tenant_"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("user_id").alias("job_id"), "event_id")


@query("l03_failed_jobs_alert", f"""
SELECT strftime(make_timestamp((CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 - 300 * i) * 1000000), {STAMP_SQL}) AS window_start, 'tenant_' || user_id % 5 AS tenant_id, count(*) AS failed_jobs
FROM events, (SELECT unnest(range(12)) AS i) WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 3""")
def failed_jobs_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.failed_jobs_alert(job_events(spark, sf_dir)).withColumn("window_start", stamp("window_start"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = st.event_time(v.table(spark, sf_dir, "events"))
    return events.select(
        "ts", F.concat(F.lit("tenant_"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        (F.col("user_id") % 20).cast("int").alias("queue_depth"), F.when(F.col("event_type") == "click", "idle").otherwise("running").alias("worker_state"))


@query("l04_queue_depth_alert", f"""
SELECT {start_sql(900)} AS window_start, 'tenant_' || user_id % 5 AS tenant_id, CAST(min(user_id % 20) AS INTEGER) AS min_depth, count(*) AS n_samples
FROM events GROUP BY 1, 2 HAVING min(user_id % 20) >= 10""")
def queue_depth_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.queue_depth_alert(samples(spark, sf_dir)).withColumn("window_start", stamp("window_start"))


@query("l04_idle_worker_alert", f"""
SELECT {start_sql(600)} AS window_start, 'tenant_' || user_id % 5 AS tenant_id, count(*) AS n_samples
FROM events GROUP BY 1, 2 HAVING bool_and(event_type = 'click' AND user_id % 20 > 0)""")
def idle_worker_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.idle_worker_alert(samples(spark, sf_dir)).withColumn("window_start", stamp("window_start"))


@query("l05_dedupe_events", f"""
SELECT 'tenant_' || user_id % 5 AS tenant_id, user_id AS job_id, strftime(min(ts), {STAMP_SQL}) AS ts FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    completed = job_events(spark, sf_dir).filter("status = 'completed'")
    return st.dedupe_events(completed).select("tenant_id", "job_id", stamp("ts").alias("ts"))
