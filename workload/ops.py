"""Operations, audit and log queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweft.operators import ops
from workload import views as v
from workload.extraction import joined
from workload.registry import query

STAMP_SQL = "'%Y-%m-%d %H:%M:%S'"


def stamp(column: str) -> Column:
    return F.date_format(column, v.STAMP)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order, owned by its customer's segment; a few belong to another tenant."""
    moved = F.when(F.col("job_id") % 101 == 0, "ELSEWHERE").otherwise(F.col("tenant_id"))
    return v.jobs(spark, sf_dir).filter("job_id % 103 <> 0").select("document_id", moved.alias("tenant_id"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template versions of every tenant."""
    return v.table(spark, sf_dir, "customer").select("c_mktsegment", (F.col("c_custkey") % 7).alias("template_version_id")).distinct().select(
        F.col("c_mktsegment").alias("tenant_id"), "template_version_id")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of completed jobs with the number of their open fields."""
    open_fields = v.results(spark, sf_dir).groupBy(F.col("result_id").alias("job_id")).agg(F.count_if("requires_review").alias("open_fields"))
    done = v.jobs(spark, sf_dir).filter("status IN ('completed', 'failed')").select("tenant_id", "job_id")
    return done.join(open_fields, "job_id").select("tenant_id", "job_id", F.col("job_id").alias("result_id"), "open_fields")


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of every third order, some of results that are gone."""
    return v.jobs(spark, sf_dir).filter("job_id % 3 = 0").select(
        (F.col("job_id") + 7).alias("export_id"), "tenant_id", F.col("job_id").alias("result_id"), "created_at")


OPS_SQL = """
WITH docs AS (SELECT document_id, CASE WHEN job_id % 101 = 0 THEN 'ELSEWHERE' ELSE tenant_id END AS tenant_id FROM v_jobs WHERE job_id % 103 <> 0),
vers AS (SELECT DISTINCT c_mktsegment AS tenant_id, c_custkey % 7 AS template_version_id FROM customer),
res AS (SELECT j.tenant_id, j.job_id, o.open_fields FROM v_jobs j JOIN (SELECT result_id, count(*) FILTER (WHERE requires_review) AS open_fields FROM v_results GROUP BY 1) o
  ON o.result_id = j.job_id WHERE status IN ('completed', 'failed')),
exps AS (SELECT job_id + 7 AS export_id, tenant_id, job_id AS result_id, created_at FROM v_jobs WHERE job_id % 3 = 0)
"""


@query("j01_jobs_by_status", "SELECT tenant_id, status, count(*) AS n_jobs FROM v_jobs GROUP BY 1, 2")
def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.jobs_by_status(v.jobs(spark, sf_dir))


@query("j02_ops_metrics", OPS_SQL + """
SELECT t.tenant_id, coalesce(queue_depth, 0) AS queue_depth, coalesce(failed_jobs, 0) AS failed_jobs, coalesce(cancelled_jobs, 0) AS cancelled_jobs,
  coalesce(completed_jobs, 0) AS completed_jobs, coalesce(d.n, 0) AS documents, coalesce(v.n, 0) AS templates, coalesce(r.n, 0) AS results
FROM (SELECT tenant_id FROM v_jobs UNION SELECT tenant_id FROM docs UNION SELECT tenant_id FROM vers UNION SELECT tenant_id FROM res) t
LEFT JOIN (SELECT tenant_id, count(*) FILTER (WHERE status IN ('queued', 'running')) AS queue_depth, count(*) FILTER (WHERE status = 'failed') AS failed_jobs,
  count(*) FILTER (WHERE status = 'cancelled') AS cancelled_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs FROM v_jobs GROUP BY 1) j USING (tenant_id)
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM docs GROUP BY 1) d USING (tenant_id) LEFT JOIN (SELECT tenant_id, count(*) AS n FROM vers GROUP BY 1) v USING (tenant_id)
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM res GROUP BY 1) r USING (tenant_id)""")
def ops_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ops_metrics(v.jobs(spark, sf_dir), documents(spark, sf_dir), templates(spark, sf_dir), results(spark, sf_dir))


def control_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspension history: every customer row is one write of its segment's control setting."""
    suspended = F.when(F.col("c_acctbal") < 0, "true").otherwise("false")
    value = F.concat(F.lit('{"suspended":'), suspended, F.lit(',"reason":"case '), F.col("c_custkey").cast("string"), F.lit('"}'))
    return v.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("tenant:"), F.col("c_mktsegment"), F.lit(":admin.controls")).alias("key"), value.alias("value"),
        F.col("c_custkey").alias("updated_at"))


CONTROL_SQL = """SELECT c_mktsegment AS tenant_id, max_by(c_acctbal, c_custkey) < 0 AS suspended, 'case ' || max(c_custkey) AS reason FROM customer GROUP BY 1"""


@query("j03_tenant_usage", OPS_SQL + f"""
SELECT t.tenant_id, coalesce(d.n, 0) AS documents, coalesce(j.done, 0) AS jobs_completed, strftime(j.latest, {STAMP_SQL}) AS latest_activity_at, coalesce(r.n, 0) AS results,
  coalesce(e.n, 0) AS exports, coalesce(s.suspended, false) AS suspended, s.reason AS suspension_reason
FROM (SELECT tenant_id FROM docs UNION SELECT tenant_id FROM vers UNION SELECT tenant_id FROM v_jobs UNION SELECT tenant_id FROM res UNION SELECT tenant_id FROM exps) t
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM docs GROUP BY 1) d USING (tenant_id)
LEFT JOIN (SELECT tenant_id, count(*) FILTER (WHERE status = 'completed') AS done, max(updated_at) AS latest FROM v_jobs GROUP BY 1) j USING (tenant_id)
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM res GROUP BY 1) r USING (tenant_id) LEFT JOIN (SELECT tenant_id, count(*) AS n FROM exps GROUP BY 1) e USING (tenant_id)
LEFT JOIN ({CONTROL_SQL}) s USING (tenant_id)""")
def tenant_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = ops.tenant_usage(documents(spark, sf_dir), templates(spark, sf_dir), v.jobs(spark, sf_dir), results(spark, sf_dir),
                             exports(spark, sf_dir), control_settings(spark, sf_dir))
    return usage.withColumn("latest_activity_at", stamp("latest_activity_at"))


@query("j04_tenant_controls", CONTROL_SQL)
def tenant_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tenant_controls(control_settings(spark, sf_dir)).select("tenant_id", "suspended", "reason")


@query("j05_audit_events", f"""
SELECT event_id, tenant_id, action, strftime(created_at, {STAMP_SQL}) AS created_at FROM v_audit
WHERE tenant_id = 'tenant_3' AND action = 'purchase' AND created_at >= TIMESTAMP '2024-01-02 00:00:00' AND created_at <= TIMESTAMP '2024-03-31 00:00:00'""")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.audit_events(v.audit(spark, sf_dir), "tenant_3", "purchase", "2024-01-02 00:00:00", "2024-03-31 00:00:00")
    return found.select("event_id", "tenant_id", "action", stamp("created_at").alias("created_at"))


@query("j06_audit_metadata_filter", """
SELECT event_id, tenant_id, action FROM v_audit WHERE CAST(json_extract_string(metadata, '$.k') AS BIGINT) = 42""")
def audit_metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.audit_metadata_filter(v.audit(spark, sf_dir), k=42).select("event_id", "tenant_id", "action")


@query("j07_page", f"""
SELECT event_id, action, strftime(created_at, {STAMP_SQL}) AS created_at, (SELECT count(*) FROM v_audit WHERE tenant_id = 'tenant_1') AS total
FROM v_audit WHERE tenant_id = 'tenant_1' ORDER BY v_audit.created_at DESC, event_id DESC LIMIT 100 OFFSET 200""")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = ops.audit_events(v.audit(spark, sf_dir), "tenant_1").select("event_id", "action", "created_at")
    return ops.page(mine, limit=100, offset=200).withColumn("created_at", stamp("created_at"))


def _mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.audit_events(v.audit(spark, sf_dir), "tenant_1").select("event_id", "action", "created_at")


@query("j07_seek_page", f"""
SELECT event_id, action, strftime(created_at, {STAMP_SQL}) AS created_at FROM v_audit WHERE tenant_id = 'tenant_1' ORDER BY v_audit.created_at DESC, event_id DESC LIMIT 100 OFFSET 200""")
def seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page, each asked for by the last row of the one before."""
    mine, after = _mine(spark, sf_dir), None
    for _ in range(2):
        seen = ops.seek_page(mine, 100, after).collect()
        after = (seen[-1]["created_at"], seen[-1]["event_id"]) if seen else after
    return ops.seek_page(mine, 100, after).withColumn("created_at", stamp("created_at"))


@query("j07_page_result", """
SELECT (SELECT count(*) FROM v_audit WHERE tenant_id = 'tenant_1') AS total, 100 AS "limit", 0 AS n_items
UNION ALL SELECT (SELECT count(*) FROM v_audit WHERE tenant_id = 'tenant_1'), 100, least(100, (SELECT count(*) FROM v_audit WHERE tenant_id = 'tenant_1'))""")
def page_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page beyond the last row, and the first page."""
    mine = _mine(spark, sf_dir)
    beyond = mine.agg(F.min("created_at").alias("at")).first()["at"]
    pages = [ops.page_result(mine, 100, after) for after in ((beyond, -1), None)]
    return pages[0].unionByName(pages[1]).select("total", "limit", F.size("items").alias("n_items"))


@query("j08_job_groups", OPS_SQL + """
SELECT tenant_id, g AS job_group, count(*) AS n_jobs FROM (
  SELECT j.tenant_id, unnest(list_filter([CASE WHEN status IN ('queued', 'running') THEN 'Processing' END, CASE WHEN coalesce(open_fields, 0) > 0 THEN 'Needs review' END,
    CASE WHEN status = 'failed' THEN 'Failed' END, CASE WHEN status = 'cancelled' THEN 'Cancelled' END,
    CASE WHEN status = 'completed' AND coalesce(open_fields, 0) = 0 THEN 'Completed' END], lambda x: x IS NOT NULL)) AS g
  FROM v_jobs j LEFT JOIN res r ON r.tenant_id = j.tenant_id AND r.job_id = j.job_id) GROUP BY 1, 2""")
def job_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.job_groups(v.jobs(spark, sf_dir), results(spark, sf_dir))


@query("j09_workspace_stage", OPS_SQL + """
SELECT j.job_id, CASE WHEN j.job_id % 50 = 0 THEN 'draft' WHEN status = 'failed' THEN 'failed'
  WHEN status = 'completed' THEN CASE WHEN coalesce(open_fields, 0) > 0 OR (j.job_id % 2 = 0 AND j.job_id % 3 = 0) THEN 'review' ELSE 'ready' END ELSE 'processing' END AS stage
FROM v_jobs j LEFT JOIN res r ON r.tenant_id = j.tenant_id AND r.job_id = j.job_id""")
def workspace_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("job_id")
    rows = v.jobs(spark, sf_dir).join(results(spark, sf_dir), ["tenant_id", "job_id"], "left").withColumns({
        "status": F.when(key % 50 != 0, F.col("status")), "require_cleared": key % 2 == 0,
        "review_status": F.when(key % 3 == 0, "pending").otherwise("reviewed")})
    return ops.workspace_stage(rows).select("job_id", "stage")


@query("j10_review_backlog", """
WITH per AS (SELECT j.tenant_id, r.result_id, count(*) FILTER (WHERE requires_review) AS flagged, count(*) FILTER (WHERE requires_review OR validation_status = 'invalid') AS open,
  count(*) FILTER (WHERE requires_review AND validation_status <> 'invalid' AND confidence >= 0.85) AS high FROM v_results r JOIN v_jobs j ON j.job_id = r.result_id GROUP BY 1, 2)
SELECT tenant_id, count(*) FILTER (WHERE flagged > 0) AS reviewable_results, CAST(sum(flagged) AS BIGINT) AS review_count, CAST(sum(open) AS BIGINT) AS fields_needing_review,
  CAST(sum(high) AS BIGINT) AS high_confidence_review_count, round(sum(high)::DOUBLE / sum(open)::DOUBLE, 6) AS high_confidence_share FROM per GROUP BY 1""")
def review_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = v.jobs(spark, sf_dir).select("tenant_id", F.col("job_id").alias("result_id"))
    return ops.review_backlog(v.results(spark, sf_dir).join(owners, "result_id"))


@query("j11_parser_failure_triage", """
SELECT tenant_id, CASE job_id % 7 WHEN 0 THEN 'Document parser disabled' WHEN 1 THEN 'PDF parse produced no usable text' WHEN 2 THEN 'Image OCR produced no usable text'
  WHEN 3 THEN 'Document parse returned no usable content' WHEN 4 THEN 'Document parse returned no usable content' WHEN 5 THEN 'Parser runtime failed' ELSE 'Other' END AS failure_class,
  count(*) AS n_jobs FROM v_jobs WHERE status = 'failed' GROUP BY 1, 2""")
def parser_failure_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.parser_failure_triage(v.jobs(spark, sf_dir))


@query("j12_list_exports", OPS_SQL + f"""
SELECT export_id, e.tenant_id, e.result_id, strftime(e.created_at, {STAMP_SQL}) AS created_at, coalesce(r.job_id, 0) AS job_id
FROM exps e LEFT JOIN res r ON r.tenant_id = e.tenant_id AND r.job_id = e.result_id""")
def list_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_exports(exports(spark, sf_dir), results(spark, sf_dir)).select(
        "export_id", "tenant_id", "result_id", stamp("created_at").alias("created_at"), "job_id")


@query("j13_provider_readiness", """
WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'mock' WHEN 1 THEN 'openai_compatible' WHEN 2 THEN 'azure_openai' ELSE 'langextract' END AS style,
  s_suppkey % 3 = 0 AS no_base, s_suppkey % 5 < 2 AS key_required, CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'MISSING_KEY' ELSE 'KNOWN_KEY' END AS env,
  s_suppkey % 11 = 0 AS no_dep, s_suppkey % 13 = 0 AS no_ver, s_suppkey % 9 = 0 AS cloud, s_suppkey % 8 = 7 AS ext FROM supplier),
f AS (SELECT *, list_filter([CASE WHEN style <> 'mock' AND no_base THEN 'Missing base_url' END, CASE WHEN key_required AND env IS NULL THEN 'Missing api_key_env_var' END,
  CASE WHEN key_required AND env = 'MISSING_KEY' THEN 'Missing environment variable MISSING_KEY' END, CASE WHEN style = 'azure_openai' AND no_dep THEN 'Missing Azure deployment name' END,
  CASE WHEN style = 'azure_openai' AND no_ver THEN 'Missing Azure API version' END, CASE WHEN style = 'langextract' AND cloud THEN 'LangExtract is only supported in local mode' END,
  CASE WHEN style = 'langextract' AND ext THEN 'LangExtract v1 must keep allow_external_processing disabled' END], lambda x: x IS NOT NULL) AS flaws FROM s),
g AS (SELECT *, len(flaws) = 0 AND style <> 'langextract' AS ready FROM f)
SELECT k AS provider_key, ready, CASE WHEN style = 'langextract' AND len(flaws) = 0 THEN 'probe_required' WHEN style = 'mock' OR ready THEN 'ready' ELSE 'not_ready' END AS readiness,
  array_to_string(list_concat(flaws, list_filter([CASE WHEN style = 'langextract' THEN 'Run a live probe to confirm Ollama runtime and model availability' END,
    CASE WHEN style = 'mock' THEN 'Bootstrap provider only' WHEN ready THEN 'Configuration present' END], lambda x: x IS NOT NULL)), '|') AS checks FROM g""")
def provider_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    nothing = F.lit(None).cast("string")
    catalog = v.table(spark, sf_dir, "supplier").select(
        k.alias("provider_key"), v.choose(k % 4, ("mock", "openai_compatible", "azure_openai", "langextract")).alias("api_style"),
        F.when(k % 3 != 0, "http://models.example").alias("base_url"), (k % 5 < 2).alias("api_key_required"),
        F.when(k % 7 == 0, nothing).when(k % 7 == 1, "MISSING_KEY").otherwise("KNOWN_KEY").alias("api_key_env_var"),
        F.when(k % 11 != 0, "d1").alias("deployment"), F.when(k % 13 != 0, "v1").alias("api_version"),
        F.when(k % 9 == 0, "cloud").otherwise("local").alias("mode"), (k % 8 == 7).alias("allow_external_processing"))
    return ops.provider_readiness(catalog, ["KNOWN_KEY"]).select("provider_key", "ready", "readiness", joined(F.col("checks")).alias("checks"))


@query("j14_stale_probes", """
SELECT event_id AS profile_id FROM events WHERE event_id % 11 = 0 OR event_type <> 'click' OR ts < TIMESTAMP '2024-01-19 12:00:00'""")
def stale_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = v.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("profile_id"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("last_probe_at"),
        F.when(F.col("event_type") == "click", "reachable").otherwise("unreachable").alias("last_probe_status"))
    return ops.stale_probes(profiles, "2024-01-20 12:00:00").select("profile_id")


@query("j15_tenant_chain_check", OPS_SQL + """,
owned AS (SELECT template_version_id, min(tenant_id) AS tenant_id FROM vers WHERE template_version_id < 6 GROUP BY 1)
SELECT job_id, j.tenant_id, CASE WHEN d.document_id IS NULL OR o.template_version_id IS NULL THEN 'Document or template version missing.'
  ELSE 'Tenant mismatch between job, document, and template version. job=' || j.tenant_id || ', document=' || d.tenant_id || ', template_version=' || o.tenant_id || '.' END AS problem
FROM v_jobs j LEFT JOIN docs d ON d.document_id = j.document_id LEFT JOIN owned o ON o.template_version_id = j.template_version_id
WHERE d.document_id IS NULL OR o.template_version_id IS NULL OR d.tenant_id <> j.tenant_id OR o.tenant_id <> j.tenant_id""")
def tenant_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = templates(spark, sf_dir).filter("template_version_id < 6").groupBy("template_version_id").agg(F.min("tenant_id").alias("tenant_id"))
    return ops.tenant_chain_check(v.jobs(spark, sf_dir), documents(spark, sf_dir), owned)


def chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = (*ops.AUDIT_CHAIN, "document.viewed")
    return v.audit(spark, sf_dir).select(
        "tenant_id", "created_at", v.choose(F.col("event_id") % 6, actions).alias("action"),
        F.when(F.col("event_id") % 6 == 0, "document").otherwise("job").alias("object_type"), F.col("user_id").cast("string").alias("object_id"),
        F.when(F.col("event_id") % 6 == 0, "{}").otherwise(F.concat(F.lit('{"document_id":'), F.col("user_id").cast("string"), F.lit("}"))).alias("metadata"))


@query("j16_audit_chain", """
WITH e AS (SELECT tenant_id, user_id AS document_id, event_id % 6 AS n, min(created_at) AS first_at FROM v_audit GROUP BY 1, 2, 3),
names(n, action) AS (VALUES (0, 'document.uploaded'), (1, 'job.queued'), (2, 'job.completed'), (3, 'review.saved'), (4, 'export.created'))
SELECT tenant_id, document_id, coalesce(string_agg(action, '|' ORDER BY first_at, e.n) FILTER (WHERE action IS NOT NULL), '') AS actions, count(action) = 5 AS is_complete
FROM e LEFT JOIN names ON names.n = e.n GROUP BY 1, 2""")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.audit_chain(chain_events(spark, sf_dir)).select("tenant_id", "document_id", joined(F.col("actions")).alias("actions"), "is_complete")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON log lines; some blank, some broken, some JSON without an object, some of unknown kind."""
    key, user = F.col("event_id"), F.col("user_id")
    names = (ops.REJECTED, ops.COMPLETED, ops.FEEDBACK, "worker_started")
    model = F.concat(F.lit("model-"), (user % 3).cast("string"))
    record = F.to_json(F.struct(
        v.choose(key % 4, names).alias("event"), F.when(user % 5 != 0, F.when(user % 2 == 0, "document_too_large").otherwise("other")).alias("reason"),
        F.when(user % 7 != 0, model).alias("model"), user.alias("document_chars"),
        *[(user % (i + 2)).alias(n) for i, n in enumerate(ops.EXTRACTION_SUMS)],
        *[F.when(user % 3 != 0, user % (i + 3)).alias(n) for i, n in enumerate(ops.FEEDBACK_SUMS)]))
    line = (F.when(key % 50 == 0, "not-json").when(key % 77 == 0, "   ").when(key % 91 == 0, "[1, 2]").otherwise(record))
    return v.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), line.alias("line"))


_extraction = " UNION ALL ".join(f"SELECT 'extraction_totals', '{n}', CAST(sum(user_id % {i + 2}) AS BIGINT) FROM r WHERE event_id % 4 = 1"
                                 for i, n in enumerate(ops.EXTRACTION_SUMS))
_feedback = " UNION ALL ".join(
    f"SELECT 'feedback_totals', '{n}', CAST(sum(CASE WHEN user_id % 3 <> 0 THEN user_id % {i + 3} ELSE 0 END) AS BIGINT) FROM r WHERE event_id % 4 = 2"
    for i, n in enumerate(ops.FEEDBACK_SUMS))
LOG_SQL = f"""
WITH r AS (SELECT * FROM events WHERE event_id % 50 <> 0 AND event_id % 77 <> 0 AND event_id % 91 <> 0)
SELECT 'lines' AS section, 'lines_processed' AS item, count(*) AS amount FROM events
UNION ALL SELECT 'lines', 'json_records_processed', count(*) FROM r
UNION ALL SELECT 'lines', 'invalid_line_count', count(*) FROM events WHERE event_id % 50 = 0
UNION ALL SELECT 'events_seen', CASE event_id % 4 WHEN 0 THEN '{ops.REJECTED}' WHEN 1 THEN '{ops.COMPLETED}' ELSE '{ops.FEEDBACK}' END, count(*) FROM r WHERE event_id % 4 < 3 GROUP BY 2
UNION ALL SELECT 'rejection_reasons', CASE WHEN user_id % 5 = 0 THEN 'unknown' WHEN user_id % 2 = 0 THEN 'document_too_large' ELSE 'other' END, count(*) FROM r WHERE event_id % 4 = 0 GROUP BY 2
UNION ALL SELECT 'rejection_models', 'model-' || user_id % 3, count(*) FROM r WHERE event_id % 4 = 0 AND user_id % 7 <> 0 GROUP BY 2
UNION ALL SELECT 'rejection_totals', 'rejected_document_chars', CAST(sum(user_id) AS BIGINT) FROM r WHERE event_id % 4 = 0
UNION ALL SELECT 'extraction_models', 'model-' || user_id % 3, count(*) FROM r WHERE event_id % 4 = 1 AND user_id % 7 <> 0 GROUP BY 2
UNION ALL {_extraction} UNION ALL {_feedback}"""


@query("j17_log_summary", LOG_SQL)
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.log_summary(log_lines(spark, sf_dir))


@query("j18_progress", """
WITH p AS (SELECT job_id, progress_pct, coalesce(progress_stage, CASE WHEN status = 'queued' THEN 'queued' END) AS stage FROM v_jobs)
SELECT job_id, CAST(least(100, greatest(0, floor(coalesce(progress_pct, CASE stage WHEN 'parsing' THEN 15 WHEN 'extracting' THEN 45 WHEN 'validating' THEN 70 ELSE 0 END) + 0.5))) AS INTEGER) AS percent,
  CASE WHEN stage IS NULL THEN 'Processing' ELSE CASE stage WHEN 'queued' THEN 'Waiting in queue' WHEN 'parsing' THEN 'Parsing document' WHEN 'extracting' THEN 'Extracting fields'
    WHEN 'validating' THEN 'Validating results' ELSE 'post checks' END END AS stage_label FROM p""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.progress(v.jobs(spark, sf_dir)).select("job_id", "percent", "stage_label")


@query("j19_valid_keys", """
SELECT page_id, page_id % 4 <> 0 AS valid_tenant_id, page_id % 5 IN (0, 1) AS valid_reference,
  CASE page_id % 5 WHEN 0 THEN 'uploads/doc_' || page_id || '.txt' WHEN 1 THEN 'a/b-' || page_id END AS normalized_reference FROM pages""")
def valid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    text = key.cast("string")
    reference = (F.when(key % 5 == 0, F.concat(F.lit("uploads//doc_"), text, F.lit(".txt"))).when(key % 5 == 1, F.concat(F.lit("./a/b-"), text))
                 .when(key % 5 == 2, F.concat(F.lit("../"), text)).when(key % 5 == 3, F.concat(F.lit("/abs/"), text)).otherwise(F.concat(F.lit("sp ace/"), text)))
    tenant = F.when(key % 4 == 0, F.concat(F.lit("-bad"), text)).when(key % 4 == 1, F.concat(F.lit(" t."), text)).otherwise(F.concat(F.lit("tenant_"), text))
    rows = v.table(spark, sf_dir, "pages").select("page_id", tenant.alias("tenant_id"), reference.alias("storage_reference"))
    return ops.valid_keys(rows).select("page_id", "valid_tenant_id", "valid_reference", "normalized_reference")
