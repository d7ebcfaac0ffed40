"""Operations, audit and log analytics over jobs, results, events and log lines."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docweft.functions import text as tx

# ---- fixed values -------------------------------------------------------------------------------
JOB_STATUSES = ("queued", "running", "completed", "failed", "cancelled")
FAILURE_CLASSES = (
    ("Document parser disabled", ("Docling parsing is disabled",)),
    ("PDF parse produced no usable text", ("Docling PDF parsing produced no usable text",)),
    ("Image OCR produced no usable text", ("Docling image parsing produced no usable text",)),
    ("Document parse returned no usable content", (
        "Docling DOCX parsing produced no usable text", "Docling PPTX parsing produced no usable text",
        "Docling HTML parsing produced no usable text")),
    ("Parser runtime failed", ("Docling failed to parse",)),
)
STAGES = {
    "queued": (0, "Waiting in queue"), "parsing": (15, "Parsing document"), "extracting": (45, "Extracting fields"),
    "validating": (70, "Validating results"), "calculating": (85, "Running calculations"), "completed": (100, "Complete"),
    "failed": (0, "Failed"),
}
RUNNING_LABEL = "Processing"
AUDIT_CHAIN = ("document.uploaded", "job.queued", "job.completed", "review.saved", "export.created")
TENANT_ID_PATTERN = r"\A[a-zA-Z0-9][a-zA-Z0-9._-]{0,63}\z"
STORAGE_REFERENCE_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9._-]*(?:/[A-Za-z0-9][A-Za-z0-9._-]*)*\z"
CONTROLS_SETTING = "admin.controls"
REJECTED = "langextract_document_rejected"
COMPLETED = "langextract_extraction_completed"
FEEDBACK = "langextract_feedback_suggestions_built"
EXTRACTION_SUMS = (
    "extracted_field_count", "calculated_field_count", "review_required_count", "document_note_count",
    "low_confidence_review_count", "multi_candidate_review_count", "citation_gap_count", "validation_error_count",
)
FEEDBACK_SUMS = (
    "reviewed_result_count", "reviewed_edit_count", "generated_suggestion_count", "visible_suggestion_count",
    "dismissed_suggestion_count", "skipped_missing_document_text", "skipped_missing_target_field",
    "skipped_missing_grounding", "skipped_span_override", "skipped_span_mismatch", "skipped_empty_context",
    "skipped_no_contextual_extractions",
)
PROBE_MAX_AGE_HOURS = 24


# ---- metrics ------------------------------------------------------------------------------------
def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("tenant_id", "status").agg(F.count(F.lit(1)).alias("n_jobs"))


def _count_by_tenant(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(name))


def ops_metrics(jobs: DataFrame, documents: DataFrame, templates: DataFrame, results: DataFrame) -> DataFrame:
    """Queue depth, job counts and totals for every tenant that appears in any of the tables.

    Each table is counted by tenant first, so the joins only see one row per tenant.
    """
    status = F.col("status")
    counted = jobs.groupBy("tenant_id").agg(
        F.count_if(status.isin("queued", "running")).alias("queue_depth"),
        F.count_if(status == "failed").alias("failed_jobs"),
        F.count_if(status == "cancelled").alias("cancelled_jobs"),
        F.count_if(status == "completed").alias("completed_jobs"),
    )
    parts = [counted, _count_by_tenant(documents, "documents"), _count_by_tenant(templates, "templates"),
             _count_by_tenant(results, "results")]
    return reduce(lambda a, b: a.join(b, "tenant_id", "full_outer"), parts).fillna(0)


def tenant_controls(settings: DataFrame) -> DataFrame:
    """Latest suspension state per tenant from settings keyed `tenant:{id}:admin.controls`."""
    parts = F.split("key", ":", 3)
    mine = settings.filter((F.get(parts, F.lit(0)) == "tenant") & (F.get(parts, F.lit(2)) == CONTROLS_SETTING))
    latest = mine.groupBy(F.get(parts, F.lit(1)).alias("tenant_id")).agg(F.max_by("value", "updated_at").alias("value"))
    payload = F.from_json("value", "suspended boolean, reason string, updated_at string")
    return latest.select(
        "tenant_id",
        F.coalesce(payload["suspended"], F.lit(False)).alias("suspended"),
        payload["reason"].alias("reason"),
        payload["updated_at"].alias("updated_at"),
    )


def tenant_usage(
    documents: DataFrame, templates: DataFrame, jobs: DataFrame, results: DataFrame, exports: DataFrame, settings: DataFrame
) -> DataFrame:
    """Usage per tenant over the union of tenants of five tables."""
    done = jobs.groupBy("tenant_id").agg(
        F.count_if(F.col("status") == "completed").alias("jobs_completed"), F.max("updated_at").alias("latest_activity_at"))
    tenants = reduce(lambda a, b: a.union(b), [
        t.select("tenant_id").distinct() for t in (documents, templates, jobs, results, exports)]).distinct().filter("tenant_id <> ''")
    joined = tenants
    for part in (_count_by_tenant(documents, "documents"), done, _count_by_tenant(results, "results"),
                 _count_by_tenant(exports, "exports")):
        joined = joined.join(part, "tenant_id", "left")
    controls = tenant_controls(settings).select("tenant_id", "suspended", F.col("reason").alias("suspension_reason"))
    return joined.join(controls, "tenant_id", "left").fillna(0).fillna({"suspended": False})


# ---- audit --------------------------------------------------------------------------------------
def audit_events(
    events: DataFrame,
    tenant_id: str | None = None,
    action: str | None = None,
    from_time: datetime | str | None = None,
    to_time: datetime | str | None = None,
    **ids: int,
) -> DataFrame:
    """Audit events by tenant, action, inclusive time range and ids inside their metadata.

    Plain column filters come first so that they reach the scan.
    """
    df = events
    if tenant_id is not None:
        df = df.filter(F.col("tenant_id") == tenant_id)
    if action:
        df = df.filter(F.col("action") == action)
    if from_time is not None:
        df = df.filter(F.col("created_at") >= F.lit(from_time).cast("timestamp"))
    if to_time is not None:
        df = df.filter(F.col("created_at") <= F.lit(to_time).cast("timestamp"))
    return audit_metadata_filter(df, **ids)


def audit_metadata_filter(events: DataFrame, **ids: int) -> DataFrame:
    """Keep events whose JSON metadata holds each given id, as a number or a numeric string."""
    for name, expected in ids.items():
        if expected is not None:
            held = F.get_json_object("metadata", f"$.{name}").try_cast("bigint")
            events = events.filter(held == expected)
    return events


def page(df: DataFrame, limit: int = 100, offset: int = 0, id_column: str = "event_id") -> DataFrame:
    """One page of the newest rows plus the total before paging, ties ordered by id.

    The total is one small aggregate joined to the page; the page itself is a top-k, not a full sort.
    """
    rows = df.orderBy(F.desc("created_at"), F.desc(id_column)).offset(offset).limit(limit)
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(1))
    return rows.withColumn("_k", F.lit(1)).join(total, "_k", "left").drop("_k")


def seek_page(df: DataFrame, limit: int = 100, after: tuple | None = None, id_column: str = "event_id") -> DataFrame:
    """The `limit` newest rows that come after (created_at, id) of the last row seen; the first page without it.

    The position is a filter that reaches the scan, and a task keeps `limit` rows at most however far the page is.
    """
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        df = df.filter((F.col("created_at") <= at) & ((F.col("created_at") < at) | (F.col(id_column) < last)))
    return df.orderBy(F.desc("created_at"), F.desc(id_column)).limit(limit)


def page_result(df: DataFrame, limit: int = 100, after: tuple | None = None, id_column: str = "event_id") -> DataFrame:
    """One row: total (of all pages, right on an empty page too), limit, and items, newest first; at most `limit` items are gathered."""
    page_ = seek_page(df, limit, after, id_column)
    others = [c for c in df.columns if c not in ("created_at", id_column)]
    items = page_.agg(F.sort_array(F.collect_list(F.struct("created_at", id_column, *others)), asc=False).alias("items"), F.lit(1).alias("_k"))
    total = df.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("_k"))
    return total.join(items, "_k").select("total", F.lit(limit).alias("limit"), "items")


def audit_chain(events: DataFrame) -> DataFrame:
    """Per document which lifecycle actions happened, first times in order, and whether the chain is whole.

    First times per action are kept instead of event lists, so a very busy document stays one small row.
    """
    document = F.coalesce(F.get_json_object("metadata", "$.document_id").try_cast("bigint"),
                          F.when(F.col("object_type") == "document", F.col("object_id").try_cast("bigint")))
    named = events.withColumn("document_id", document).filter("document_id IS NOT NULL")
    firsts = [F.min(F.when(F.col("action") == a, F.col("created_at"))).alias(f"_{i}") for i, a in enumerate(AUDIT_CHAIN)]
    grouped = named.groupBy("tenant_id", "document_id").agg(*firsts)
    steps = F.array_compact(F.array(*[
        F.when(F.col(f"_{i}").isNotNull(), F.struct(F.col(f"_{i}").alias("at"), F.lit(i).alias("no"), F.lit(a).alias("action")))
        for i, a in enumerate(AUDIT_CHAIN)]))
    path = F.transform(F.array_sort(steps), lambda s: s["action"])
    return grouped.select(
        "tenant_id", "document_id", path.alias("actions"),
        F.array_except(F.array(*[F.lit(a) for a in AUDIT_CHAIN]), path).alias("missing_actions"),
        (F.size(path) == len(AUDIT_CHAIN)).alias("is_complete"),
    )


# ---- workspace ----------------------------------------------------------------------------------
def job_groups(jobs: DataFrame, results: DataFrame, label: str | None = None) -> DataFrame:
    """Jobs counted per workspace group; a failed job with open fields is in two groups, empty ones are absent.

    `results` holds tenant_id, job_id and `open_fields`.
    """
    joined = jobs.join(results.select("tenant_id", "job_id", "open_fields"), ["tenant_id", "job_id"], "left")
    status, open_fields = F.col("status"), F.coalesce("open_fields", F.lit(0))
    labels = F.array_compact(F.array(
        F.when(status.isin("queued", "running"), "Processing"),
        F.when(open_fields > 0, "Needs review"),
        F.when(status == "failed", "Failed"),
        F.when(status == "cancelled", "Cancelled"),
        F.when((status == "completed") & (open_fields == 0), "Completed"),
    ))
    grouped = joined.select("tenant_id", F.explode(labels).alias("job_group")).groupBy("tenant_id", "job_group").agg(
        F.count(F.lit(1)).alias("n_jobs"))
    return grouped if label is None else grouped.filter(F.contains(F.lower("job_group"), F.lit(label.lower())))


def workspace_stage(jobs: DataFrame) -> DataFrame:
    """Stage from `status` (null for no job), `open_fields`, `review_status` and `require_cleared`."""
    open_review = (F.coalesce("open_fields", F.lit(0)) > 0) | (
        F.coalesce("require_cleared", F.lit(False)) & F.coalesce(F.col("review_status") == "pending", F.lit(False)))
    stage = (
        F.when(F.col("status").isNull(), "draft").when(F.col("status") == "failed", "failed")
        .when(F.col("status") == "completed", F.when(open_review, "review").otherwise("ready"))
        .otherwise("processing"))
    return jobs.withColumn("stage", stage)


def review_backlog(results: DataFrame, minimum: float = 0.85) -> DataFrame:
    """Per tenant: results with open fields, open fields, and the share that is high confidence.

    `results` is long (tenant_id, result_id, requires_review, validation_status, confidence).
    """
    open_field = F.col("requires_review") | (F.col("validation_status") == "invalid")
    high = F.col("requires_review") & (F.col("validation_status") != "invalid") & (F.col("confidence") >= minimum)
    per_result = results.groupBy("tenant_id", "result_id").agg(
        F.count_if(F.col("requires_review")).alias("flagged"), F.count_if(open_field).alias("open"), F.count_if(high).alias("high"))
    totals = per_result.groupBy("tenant_id").agg(
        F.count_if(F.col("flagged") > 0).alias("reviewable_results"), F.sum("flagged").alias("review_count"),
        F.sum("open").alias("fields_needing_review"), F.sum("high").alias("high_confidence_review_count"))
    return totals.withColumn("high_confidence_share", F.round(
        F.try_divide(F.col("high_confidence_review_count").cast("double"), F.col("fields_needing_review").cast("double")), 6))


def failure_class(message: Column) -> Column:
    chosen = F.when(F.coalesce(message, F.lit("")) == "", None)
    for name, phrases in FAILURE_CLASSES:
        for phrase in phrases:
            chosen = chosen.when(F.contains(message, F.lit(phrase)), name)
    return chosen


def parser_failure_triage(jobs: DataFrame) -> DataFrame:
    """Jobs with an error message counted per failure class; messages of no class count as 'Other'."""
    failed = jobs.filter("error_message <> ''").select(
        "tenant_id", F.coalesce(failure_class(F.col("error_message")), F.lit("Other")).alias("failure_class"))
    return failed.groupBy("tenant_id", "failure_class").agg(F.count(F.lit(1)).alias("n_jobs"))


def list_exports(exports: DataFrame, results: DataFrame) -> DataFrame:
    """Exports with the job of their result (0 when the result is gone), newest first."""
    return exports.join(results.select("tenant_id", "result_id", "job_id"), ["tenant_id", "result_id"], "left").withColumn(
        "job_id", F.coalesce("job_id", F.lit(0).cast("bigint"))).orderBy(F.desc("created_at"), F.desc("export_id"))


def provider_readiness(catalog: DataFrame, known_env_vars: Sequence[str] = ()) -> DataFrame:
    """Ready flag, status and checks of provider settings rows."""
    style, base = F.col("api_style"), F.coalesce("base_url", F.lit(""))
    env = F.coalesce("api_key_env_var", F.lit(""))
    is_azure, is_local_only = style == "azure_openai", style == "langextract"
    no_base = (style != "mock") & (base == "")
    no_env_name = F.col("api_key_required") & (env == "")
    no_env = F.col("api_key_required") & (env != "") & ~env.isin(*known_env_vars)
    no_deployment = is_azure & (F.coalesce("deployment", F.lit("")) == "")
    no_version = is_azure & (F.coalesce("api_version", F.lit("")) == "")
    not_local = is_local_only & (F.col("mode") != "local")
    external = is_local_only & F.col("allow_external_processing")
    flaws = [no_base, no_env_name, no_env, no_deployment, no_version, not_local, external]
    flawed = reduce(lambda a, b: a | b, flaws)
    ready = ~flawed & ~is_local_only
    status = (
        F.when(is_local_only & ~flawed, "probe_required")
        .when(not_local | external, "not_ready")
        .when(ready | (style == "mock"), "ready")
        .otherwise("not_ready"))
    checks = F.array_compact(F.array(
        F.when(no_base, "Missing base_url"),
        F.when(no_env_name, "Missing api_key_env_var"),
        F.when(no_env, F.concat(F.lit("Missing environment variable "), env)),
        F.when(no_deployment, "Missing Azure deployment name"),
        F.when(no_version, "Missing Azure API version"),
        F.when(not_local, "LangExtract is only supported in local mode"),
        F.when(external, "LangExtract v1 must keep allow_external_processing disabled"),
        F.when(is_local_only, "Run a live probe to confirm Ollama runtime and model availability"),
        F.when(style == "mock", "Bootstrap provider only").when(ready, "Configuration present"),
    ))
    return catalog.withColumns({"ready": ready, "readiness": status, "checks": checks})


def stale_probes(profiles: DataFrame, now: datetime | str, max_age_hours: int = PROBE_MAX_AGE_HOURS) -> DataFrame:
    """Profiles without a probe, not reachable at the last one, or probed longer ago than the limit."""
    limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(max_age_hours)} HOURS")
    probed = F.col("last_probe_at").cast("timestamp")
    stale = probed.isNull() | ~F.coalesce(F.col("last_probe_status") == "reachable", F.lit(False)) | (probed < limit)
    return profiles.filter(stale)


def tenant_chain_check(jobs: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Jobs whose document or template version is missing or belongs to another tenant."""
    docs = documents.select("document_id", F.col("tenant_id").alias("document_tenant"), F.lit(True).alias("_doc"))
    vers = versions.select("template_version_id", F.col("tenant_id").alias("version_tenant"), F.lit(True).alias("_ver"))
    joined = jobs.join(docs, "document_id", "left").join(vers, "template_version_id", "left")
    missing = F.col("_doc").isNull() | F.col("_ver").isNull()
    mixed = (F.col("tenant_id") != F.col("document_tenant")) | (F.col("tenant_id") != F.col("version_tenant"))
    mismatch = F.concat(
        F.lit("Tenant mismatch between job, document, and template version. job="), F.col("tenant_id"),
        F.lit(", document="), F.col("document_tenant"), F.lit(", template_version="), F.col("version_tenant"), F.lit("."))
    problem = F.when(missing, "Document or template version missing.").when(mixed, mismatch)
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("job_id", "tenant_id", "problem")


def clamp_percent(value: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.coalesce(value, F.lit(0)) + 0.5))).cast("int")


def progress(jobs: DataFrame) -> DataFrame:
    """Percent and label of each job's stage; own percentages are clamped to 0-100."""
    stage = F.coalesce("progress_stage", F.when(F.col("status") == "queued", "queued"))
    percent, label = F.lit(None), F.when(stage.isNull(), RUNNING_LABEL).when(stage == "running", RUNNING_LABEL)
    percent = F.when(F.lit(False), 0)
    for name, (pct, text) in STAGES.items():
        percent, label = percent.when(stage == name, pct), label.when(stage == name, text)
    shown = clamp_percent(F.coalesce(F.col("progress_pct").cast("double"), percent.cast("double")))
    return jobs.withColumn("percent", shown).withColumn("stage_label", label.otherwise(F.replace(stage, F.lit("_"), F.lit(" "))))


def valid_keys(rows: DataFrame) -> DataFrame:
    """Well-formedness of `tenant_id` and of `storage_reference` after path normalization."""
    path = F.replace("storage_reference", F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    cleaned = F.array_join(parts, "/")
    ok = (~F.startswith("storage_reference", F.lit("/"))) & ~F.array_contains(parts, "..") & F.regexp_like(
        cleaned, F.lit(STORAGE_REFERENCE_PATTERN))
    return rows.withColumns({
        "valid_tenant_id": F.coalesce(F.regexp_like(tx.strip(F.col("tenant_id")), F.lit(TENANT_ID_PATTERN)), F.lit(False)),
        "normalized_reference": F.when(ok, cleaned),
        "valid_reference": F.coalesce(ok, F.lit(False)),
    })


# ---- logs ---------------------------------------------------------------------------------------
LOG_MEMBERS = ("event", "reason", "model", "document_chars", *EXTRACTION_SUMS, *FEEDBACK_SUMS)


def line_kind(line: Column) -> Column:
    """blank / invalid / other (JSON, but no object) / record."""
    body = tx.strip(line)
    return (F.when(body == "", "blank").when(F.try_parse_json(body).isNull(), "invalid")
            .when(F.startswith(body, F.lit("{")), "record").otherwise("other"))


def parsed_log_lines(lines: DataFrame) -> DataFrame:
    """Add `line_kind` and, for records, the known members as `record` (texts; null when absent)."""
    schema = ", ".join(f"{name} string" for name in LOG_MEMBERS)
    kinds = lines.withColumn("line_kind", line_kind(F.col("line")))
    return kinds.withColumn("record", F.from_json(F.when(F.col("line_kind") == "record", F.col("line")), schema))


def _whole(name: str) -> Column:
    return F.coalesce(F.col(f"record.{name}").try_cast("bigint"), F.lit(0).cast("bigint"))


def log_event_totals(lines: DataFrame, keys: Sequence[str] = ("event", "reason", "model"), by: Sequence[str] = ()) -> DataFrame:
    """Lines counted and all counters summed per kind of line and `keys`, in one map-side combined pass.

    There are as many groups as combinations of event, reason and model, however long the log is.
    """
    known = F.col("record.event").isin(REJECTED, COMPLETED, FEEDBACK)
    members = {"event": F.when(known, F.col("record.event")),
               "reason": F.when(F.col("record.event") == REJECTED, F.coalesce("record.reason", F.lit("unknown"))),
               "model": F.when(F.col("record.event").isin(REJECTED, COMPLETED) & (F.col("record.model") != ""), F.col("record.model"))}
    sums = ("document_chars", *EXTRACTION_SUMS, *FEEDBACK_SUMS)
    # filters on what a generator gives stay above it, so they do not parse the lines a second time
    row = F.struct("line_kind", *[members[k].alias(k) for k in keys], *[_whole(n).alias(n) for n in sums])
    flat = parsed_log_lines(lines).select(*by, F.inline(F.array(row)))
    return flat.groupBy(*by, "line_kind", *keys).agg(
        F.count(F.lit(1)).alias("n_lines"), *[F.sum(n).alias(n) for n in sums])


def log_summary(lines: DataFrame) -> DataFrame:
    """Totals over all log lines as (section, item, amount) rows."""
    totals = log_event_totals(lines)
    kind, event = F.col("line_kind"), F.col("event")

    def counter(section: str, item: Column, amount: str, when: Column) -> Column:
        return F.when(F.coalesce(when & item.isNotNull(), F.lit(False)), F.struct(
            F.lit(section).alias("section"), item.alias("item"), F.col(amount).alias("amount")))

    counters = [
        counter("lines", F.lit("lines_processed"), "n_lines", F.lit(True)),
        counter("lines", F.lit("json_records_processed"), "n_lines", kind == "record"),
        counter("lines", F.lit("invalid_line_count"), "n_lines", kind == "invalid"),
        counter("events_seen", event, "n_lines", F.lit(True)),
        counter("rejection_reasons", F.col("reason"), "n_lines", event == REJECTED),
        counter("rejection_models", F.col("model"), "n_lines", event == REJECTED),
        counter("rejection_totals", F.lit("rejected_document_chars"), "document_chars", event == REJECTED),
        counter("extraction_models", F.col("model"), "n_lines", event == COMPLETED),
        *[counter("extraction_totals", F.lit(n), n, event == COMPLETED) for n in EXTRACTION_SUMS],
        *[counter("feedback_totals", F.lit(n), n, event == FEEDBACK) for n in FEEDBACK_SUMS],
    ]
    items = totals.select(F.inline(F.array_compact(F.array(*counters))))
    return items.groupBy("section", "item").agg(F.sum("amount").alias("amount"))


def invalid_log_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor JSON, without their text."""
    return lines.filter(line_kind(F.col("line")) == "invalid").drop("line")
