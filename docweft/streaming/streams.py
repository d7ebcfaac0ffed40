"""Streaming forms of the operators. Each function takes a static or a streaming DataFrame.

Event times must be timestamps with a session time zone; cast zone-less columns first (`event_time`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweft.operators.calculate import result_envelope
from docweft.operators.ops import log_event_totals
from docweft.plans.dry_run import extract_documents
from docweft.schema import Template

# ---- fixed values -------------------------------------------------------------------------------
LATE_BY = "10 minutes"
FAILED_JOBS = 3
DEEP_QUEUE = 10

#: Batches between two compactions of a stream's results.
COMPACT_EVERY = 20


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def _watermarked(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withWatermark(column, LATE_BY) if df.isStreaming else df


def stream_log_counts(lines: DataFrame, every: str = "1 hour") -> DataFrame:
    """Known events (ts, line) counted and their counters summed per tumbling window; late lines within the
    watermark still count."""
    windowed = _watermarked(lines).select(F.window("ts", every).alias("w"), "line")
    totals = log_event_totals(windowed, keys=("event",), by=("w",))
    return totals.filter("event IS NOT NULL").select(
        F.col("w.start").alias("window_start"), *[c for c in totals.columns if c not in ("w", "line_kind")])


def failed_jobs_alert(jobs: DataFrame, at_least: int = FAILED_JOBS) -> DataFrame:
    """Sliding hours with at least `at_least` failures per tenant; `jobs` holds tenant_id, status, ts."""
    failed = _watermarked(jobs).filter("status = 'failed'")
    return (
        failed.groupBy(F.window("ts", "1 hour", "5 minutes").alias("w"), "tenant_id")
        .agg(F.count(F.lit(1)).alias("failed_jobs"))
        .filter(F.col("failed_jobs") >= at_least)
        .select(F.col("w.start").alias("window_start"), "tenant_id", "failed_jobs")
    )


def queue_depth_alert(samples: DataFrame, at_least: int = DEEP_QUEUE) -> DataFrame:
    """Quarter hours in which every sample of a tenant's queue was deep."""
    return (
        _watermarked(samples).groupBy(F.window("ts", "15 minutes").alias("w"), "tenant_id")
        .agg(F.min("queue_depth").alias("min_depth"), F.count(F.lit(1)).alias("n_samples"))
        .filter(F.col("min_depth") >= at_least)
        .select(F.col("w.start").alias("window_start"), "tenant_id", "min_depth", "n_samples")
    )


def idle_worker_alert(samples: DataFrame) -> DataFrame:
    """Ten-minute windows in which the worker was idle at every sample while jobs were waiting."""
    idle = (F.col("worker_state") == "idle") & (F.col("queue_depth") > 0)
    return (
        _watermarked(samples).groupBy(F.window("ts", "10 minutes").alias("w"), "tenant_id")
        .agg(F.bool_and(idle).alias("stuck"), F.count(F.lit(1)).alias("n_samples"))
        .filter("stuck")
        .select(F.col("w.start").alias("window_start"), "tenant_id", "n_samples")
    )


def dedupe_events(events: DataFrame, keys: Sequence[str] = ("tenant_id", "job_id"), column: str = "ts") -> DataFrame:
    """One completion per job under at-least-once delivery: the earliest; on a stream the first to arrive, at once."""
    if events.isStreaming:
        return _watermarked(events, column).dropDuplicatesWithinWatermark(list(keys))
    return earliest_events(events, keys, column)


def earliest_events(
    events: DataFrame, keys: Sequence[str] = ("tenant_id", "job_id"), column: str = "ts", remember: str = "1 day",
) -> DataFrame:
    """The earliest event per key, whatever the order of arrival; ties by the other columns in order.

    A stream keeps the earliest event of a key so far and emits it when the watermark has passed it, as nothing earlier
    can come then; for `remember` after that it knows the key as done. Events later than the watermark are left out.
    """
    if events.isStreaming:
        return _earliest_by_state(_watermarked(events, column), keys, column, remember)
    others = [c for c in events.columns if c not in keys]
    earliest = events.groupBy(*keys).agg(F.min(F.struct(column, *[c for c in others if c != column])).alias("_e"))
    return earliest.select(*keys, "_e.*").select(*events.columns)


def _earliest_by_state(events: DataFrame, keys: Sequence[str], column: str, remember: str) -> DataFrame:
    columns, schema = events.columns, events.schema
    held = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    order = [column, *[c for c in columns if c not in keys and c != column]]
    at = columns.index(column)
    after_ms = int(pd.Timedelta(remember) / pd.Timedelta(milliseconds=1))

    def milliseconds(stamp) -> int:
        return int(pd.Timestamp(stamp).timestamp() * 1000) + 1

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            *event, done = state.get
            if done:
                state.remove()
                return
            state.update((*event, True))
            state.setTimeoutTimestamp(max(milliseconds(event[at]), state.getCurrentWatermarkMs()) + after_ms)
            yield pd.DataFrame([event], columns=columns)
            return
        known = state.get if state.exists else None
        rows = [batch.sort_values(order, kind="stable").iloc[0].tolist() for batch in batches if len(batch)]
        if known is not None and known[-1]:
            state.setTimeoutTimestamp(max(milliseconds(known[at]), state.getCurrentWatermarkMs()) + after_ms)
            return
        if known is not None:
            rows.append(list(known[:-1]))
        first = pd.DataFrame(rows, columns=columns).sort_values(order, kind="stable").iloc[0].tolist()
        state.update((*[x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in first], False))
        state.setTimeoutTimestamp(max(milliseconds(first[at]), state.getCurrentWatermarkMs() + 1))

    return events.groupBy(*keys).applyInPandasWithState(
        keep, schema, f"{held}, _done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stream_extract(
    docs: DataFrame, template: Template, path: str, checkpoint: str, keys: Sequence[str] = ("job_id", "attempt", "doc_id"),
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Extract every micro-batch of documents and store its results under its batch number.

    A replayed batch overwrites its own directory, so a restart after a lost executor or driver leaves no
    duplicates; `latest_results` reads the newest attempt per job. The extraction itself keeps no state. Every `compact_every` batches the
    newest attempts so far are stored in one place, made from the last such place and the batches since, so a replay makes the same.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        # the few files of a batch would keep few cores busy
        few = batch.rdd.getNumPartitions() < batch.sparkSession.sparkContext.defaultParallelism
        spread = batch.select(*keys, "text").hint("rebalance") if few else batch
        results = result_envelope(extract_documents(spread, template, keys), template, keys)
        results.drop("reviewed_at").withColumn("review_status", F.lit("pending")).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact_results(batch.sparkSession, path, batch_id, compact_every)

    return (
        docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _batches(spark: SparkSession, path: str, first: int, last: int) -> DataFrame | None:
    """The stored batches from first to last, as far as they are there; other directories are not opened."""
    wanted = ",".join(str(n) for n in range(first, last + 1))
    try:
        return spark.read.option("mergeSchema", "true").option("basePath", path).parquet(f"{path}/batch_id={{{wanted}}}")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def _newest(stored: DataFrame, key: str) -> DataFrame:
    row = F.struct(*[c for c in stored.columns if c != key])
    newest = stored.groupBy(key).agg(F.max_by(row, F.struct("attempt", "batch_id")).alias("_row"))
    return newest.select(key, "_row.*")


def compact_results(spark: SparkSession, path: str, batch_id: int, every: int = COMPACT_EVERY, key: str = "job_id") -> None:
    """Store the newest attempt per job as of a batch, then note that it is complete."""
    since = _batches(spark, path, batch_id - every + 1, batch_id)
    if since is None:
        return
    before = batch_id - every
    stored = spark.read.parquet(f"{path}.newest/upto={before}").unionByName(since, allowMissingColumns=True) if before >= 0 else since
    _newest(stored, key).write.mode("overwrite").parquet(f"{path}.newest/upto={batch_id}")
    spark.createDataFrame([(batch_id, every)], "upto bigint, every bigint").write.mode("overwrite").parquet(f"{path}.complete/at={batch_id}")


def latest_results(spark: SparkSession, path: str, key: str = "job_id") -> DataFrame:
    """Newest attempt of every job: the last compacted results and the few batches after them, or all batches if none were compacted."""
    try:
        upto, every = spark.read.parquet(f"{path}.complete").agg(F.max(F.struct("upto", "every")).alias("m")).select("m.*").first()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return _newest(spark.read.option("mergeSchema", "true").parquet(path), key)
    stored, since = spark.read.parquet(f"{path}.newest/upto={upto}"), _batches(spark, path, upto + 1, upto + every)
    return _newest(stored if since is None else stored.unionByName(since, allowMissingColumns=True), key)
