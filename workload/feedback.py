"""Feedback-mining queries over invoices whose fields carry spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweft.functions import values as fv
from docweft.operators import feedback as fb
from docweft.schema import null_value, value_struct
from workload import views as v
from workload.extraction import joined
from workload.registry import query
from workload.sources import scratch

RADIUS = 20


def field_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long results: vendor, amount and date of every invoice with spans; some broken on purpose (by key)."""
    docs = v.invoices(spark, sf_dir).withColumns({
        "amount": F.concat(F.lit("$"), fv.tx.fixed_decimals(F.col("o_totalprice"), 2, grouped=True)),
        "date": F.date_format("o_orderdate", "yyyy-MM-dd")})
    k = F.col("doc_id") % 13
    seg = F.length("tenant_id")
    amount, date = F.col("amount"), F.col("date")
    amount_at = 25 + seg
    date_at = amount_at + F.length(amount) + 13

    def row(name: str, kind: str, source: Column, start: Column, value: Column) -> Column:
        shifted = F.when(k == 0, F.lit(None)).when(k == 2, start + 1).otherwise(start).cast("int")
        return F.struct(
            F.lit(name).alias("field_name"), F.lit(kind).alias("data_type"),
            F.when(k == 1, F.concat(source, F.lit(" Inc"))).when(k == 5, F.concat(F.lit(" "), source)).otherwise(source).alias("extracted_value"),
            value.alias("normalized_value"), source.alias("source_text"), shifted.alias("char_start"),
            (shifted + F.length(source)).cast("int").alias("char_end"))

    vendor = row("vendor_name", "text", F.col("tenant_id"), F.lit(13), value_struct(text=F.col("tenant_id")))
    total = row("total_amount", "currency", amount, amount_at,
                value_struct(amount=F.col("o_totalprice"), currency=F.lit("USD"), display_value=amount))
    dated = row("order_date", "date", date, date_at, value_struct(text=date, display_value=date))
    rows = F.when(k == 4, F.array(vendor, total)).otherwise(F.array(vendor, total, dated))
    return docs.select("tenant_id", F.col("doc_id").alias("result_id"), F.col("doc_id").alias("job_id"),
                       date.alias("reviewed_at"), F.inline(rows))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.result_fields(field_results(spark, sf_dir), ("tenant_id", "result_id", "job_id", "reviewed_at"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("doc_id") % 13 == 3, " \n").otherwise(F.col("text"))
    return v.invoices(spark, sf_dir).select("tenant_id", "doc_id", blank.alias("text"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = v.invoices(spark, sf_dir).select("tenant_id", F.col("doc_id").alias("result_id"))
    named = v.choose(F.col("l_linenumber") % 3, ("vendor_name", "total_amount", "order_date"))
    rows = v.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("result_id"), named.alias("field_name"))
    return rows.join(owners, "result_id")


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.reviewed_edits(results(spark, sf_dir), v.jobs(spark, sf_dir), documents(spark, sf_dir), edits(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.edit_candidates(reviewed(spark, sf_dir), RADIUS)


def decisions(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """A dismissal history for every third suggestion; the later decision of some takes it back."""
    keys = ["tenant_id", "template_version_id", "suggestion_key"]
    chosen = found.filter("occurrence_count % 3 = 0")
    first = chosen.select(*keys, F.lit(True).alias("dismissed"), F.lit(1).alias("updated_at"))
    later = chosen.filter("template_version_id % 2 = 0").select(*keys, F.lit(False).alias("dismissed"), F.lit(2).alias("updated_at"))
    return first.union(later)


FEEDBACK_SQL = """
WITH inv AS (SELECT *, doc_id % 13 AS k, '$' || format('{:,.2f}', o_totalprice) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day, length(tenant_id) AS seg FROM v_invoices),
f AS (
  SELECT doc_id, tenant_id, k, text, 'vendor_name' AS field_name, tenant_id AS source, 13 AS s0, '{"value":"' || tenant_id || '"}' AS attributes FROM inv
  UNION ALL SELECT doc_id, tenant_id, k, text, 'total_amount', amount, 25 + seg, '{"currency":"USD","value":"' || amount || '"}' FROM inv
  UNION ALL SELECT doc_id, tenant_id, k, text, 'order_date', day, 38 + seg + length(amount), '{"value":"' || day || '"}' FROM inv WHERE k <> 4),
fields AS (SELECT *, CASE k WHEN 0 THEN NULL WHEN 2 THEN s0 + 1 ELSE s0 END AS s, CASE k WHEN 0 THEN NULL WHEN 2 THEN s0 + 1 ELSE s0 END + length(source) AS e FROM f),
e AS (SELECT l_orderkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'vendor_name' WHEN 1 THEN 'total_amount' ELSE 'order_date' END AS field_name, count(*) AS n_edits
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
cand AS (SELECT e.doc_id AS result_id, i.tenant_id, i.doc_id % 7 AS template_version_id, e.field_name, n_edits, i.day AS reviewed_at, i.k, t.s, t.e,
    CASE WHEN i.k = 3 THEN 'missing_document_text' WHEN t.field_name IS NULL THEN 'missing_target_field' WHEN i.k = 0 THEN 'missing_grounding'
      WHEN i.k = 1 THEN 'span_override' WHEN i.k = 2 THEN 'span_mismatch' END AS skip_reason,
    greatest(0, t.s - 20) AS w0, least(length(i.text), t.e + 20) AS w1, i.text
  FROM e JOIN inv i ON i.doc_id = e.doc_id LEFT JOIN fields t ON t.doc_id = e.doc_id AND t.field_name = e.field_name),
ex AS (SELECT c.result_id, c.field_name, string_agg('{"attributes":' || g.attributes || ',"extraction_class":"' || g.field_name || '","extraction_text":"' || g.source || '"}', ',' ORDER BY g.s, g.field_name) AS body,
    string_agg(g.field_name, '|' ORDER BY g.s, g.field_name) AS classes
  FROM cand c JOIN fields g ON g.doc_id = c.result_id AND g.s >= c.w0 AND g.e <= c.w1 WHERE c.skip_reason IS NULL GROUP BY 1, 2),
ok AS (SELECT c.*, x.classes, trim(substring(text, CAST(w0 + 1 AS BIGINT), CAST(w1 - w0 AS BIGINT)), ' ' || chr(10)) AS example_text, x.body FROM cand c JOIN ex x ON x.result_id = c.result_id AND x.field_name = c.field_name),
keyed AS (SELECT *, substring(sha256('{"example_text":' || CAST(to_json(example_text) AS VARCHAR) || ',"extractions":[' || body || ']}'), 1, 16) AS suggestion_key FROM ok),
sugg AS (SELECT tenant_id, template_version_id, suggestion_key, CAST(sum(n_edits) AS BIGINT) AS occurrence_count, count(DISTINCT result_id) AS n_source_results,
    string_agg(DISTINCT field_name, '|' ORDER BY field_name) AS source_field_names, max(reviewed_at) AS last_reviewed_at, any_value(example_text) AS example_text FROM keyed GROUP BY 1, 2, 3)
"""


@query("i01_reviewed_edits", FEEDBACK_SQL + "SELECT tenant_id, result_id, template_version_id, field_name, n_edits FROM cand")
def reviewed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed(spark, sf_dir).select("tenant_id", "result_id", "template_version_id", "field_name", "n_edits")


@query("i02_skip_reason", FEEDBACK_SQL + "SELECT result_id, field_name, skip_reason FROM cand")
def skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("result_id", "field_name", "skip_reason")


@query("i03_context_window", FEEDBACK_SQL + "SELECT result_id, field_name, example_text FROM ok")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).filter("skip_reason IS NULL").select("result_id", "field_name", "example_text")


@query("i04_contextual_extractions", FEEDBACK_SQL + "SELECT result_id, field_name, classes FROM ok")
def contextual_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = F.transform("extractions", lambda e: e["extraction_class"])
    return candidates(spark, sf_dir).filter("skip_reason IS NULL").select("result_id", "field_name", joined(classes).alias("classes"))


@query("i05_feedback_attributes", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_linenumber
  WHEN 1 THEN '{"value":"part ' || l_partkey || '"}' WHEN 2 THEN '{"currency":"EUR","value":"' || CAST(l_extendedprice AS VARCHAR) || '"}'
  WHEN 3 THEN '{"value":"' || CAST(l_quantity AS VARCHAR) || '"}' WHEN 4 THEN CASE WHEN l_partkey % 2 = 0 THEN '{"value":"true"}' ELSE '{"value":"false"}' END
  WHEN 5 THEN CASE WHEN l_partkey % 2 = 0 THEN '{"value":["a","' || l_partkey || '"]}' ELSE '{}' END WHEN 6 THEN '{"a":"x","b":"' || l_partkey || '"}' ELSE '{}' END AS attributes
FROM lineitem""")
def feedback_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    even = F.col("l_partkey") % 2 == 0
    value = (
        F.when(n == 1, value_struct(text=F.concat(F.lit(" part "), part)))
        .when(n == 2, value_struct(amount=F.col("l_extendedprice"), currency=F.lit("EUR")))
        .when(n == 3, value_struct(number=F.col("l_quantity")))
        .when(n == 4, value_struct(flag=even))
        .when(n == 5, value_struct(items=F.when(even, F.array(F.lit(" a "), F.lit(" "), part)).otherwise(F.array(F.lit(" ")))))
        .when(n == 6, value_struct(object_json=F.concat(F.lit('{"b":'), part, F.lit(',"c":"  ","a":" x "}'))))
        .otherwise(null_value()))
    kinds = ("", "text", "currency", "number", "boolean", "list", "json_object", "text")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = v.table(spark, sf_dir, "lineitem").select(*keys, value.alias("x"), v.choose(n, kinds).alias("kind"))
    return rows.select(*keys, fv.feedback_attributes(F.col("x"), F.col("kind")).alias("attributes"))


@query("i06_suggestion_key", FEEDBACK_SQL + "SELECT result_id, field_name, suggestion_key FROM keyed")
def suggestion_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = fb.suggestion_key(F.col("example_text"), F.col("extractions"))
    return candidates(spark, sf_dir).filter("skip_reason IS NULL").select("result_id", "field_name", key.alias("suggestion_key"))


@query("i07_suggestions", FEEDBACK_SQL + "SELECT * FROM sugg")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.suggestions(candidates(spark, sf_dir)).drop("extractions").withColumn("source_field_names", joined(F.col("source_field_names")))


@query("i07_suggestion_results", FEEDBACK_SQL + "SELECT DISTINCT tenant_id, template_version_id, suggestion_key, result_id FROM keyed")
def suggestion_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.suggestion_results(candidates(spark, sf_dir))


@query("i08_visible_suggestions", FEEDBACK_SQL + """
SELECT tenant_id, template_version_id, suggestion_key, occurrence_count FROM sugg WHERE NOT (occurrence_count % 3 = 0 AND template_version_id % 2 <> 0)""")
def visible_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fb.suggestions_of(stored_outcome(spark, sf_dir))
    return fb.visible_suggestions(found, decisions(spark, sf_dir, found)).select(
        "tenant_id", "template_version_id", "suggestion_key", "occurrence_count")


def stored_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pass over the candidates gives, stored, as decisions and counters both read it."""
    path = scratch(spark, "mined")
    fb.mined(candidates(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


_skips = ",\n  ".join(f"coalesce((SELECT CAST(sum(n_edits) AS BIGINT) FROM cand c WHERE c.tenant_id = a.tenant_id AND c.template_version_id = a.template_version_id AND skip_reason = '{r}'), 0) AS skipped_{r}"
                      for r in fb.SKIP_REASONS)


@query("i09_feedback_diagnostics", FEEDBACK_SQL + f"""
SELECT a.tenant_id, a.template_version_id, a.n AS reviewed_result_count, coalesce(b.n, 0) AS reviewed_edit_count, coalesce(s.n, 0) AS generated_suggestion_count,
  coalesce(s.gone, 0) AS dismissed_suggestion_count, coalesce(s.n - s.gone, 0) AS visible_suggestion_count, {_skips}
FROM (SELECT tenant_id, doc_id % 7 AS template_version_id, count(*) AS n FROM inv GROUP BY 1, 2) a
LEFT JOIN (SELECT tenant_id, template_version_id, CAST(sum(n_edits) AS BIGINT) AS n FROM cand GROUP BY 1, 2) b ON b.tenant_id = a.tenant_id AND b.template_version_id = a.template_version_id
LEFT JOIN (SELECT tenant_id, template_version_id, count(*) AS n, count(*) FILTER (WHERE occurrence_count % 3 = 0 AND template_version_id % 2 <> 0) AS gone FROM sugg GROUP BY 1, 2) s
  ON s.tenant_id = a.tenant_id AND s.template_version_id = a.template_version_id""")
def feedback_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored_outcome(spark, sf_dir)
    return fb.feedback_diagnostics(results(spark, sf_dir), v.jobs(spark, sf_dir), edits(spark, sf_dir), candidates(spark, sf_dir), None,
                                   decisions(spark, sf_dir, fb.suggestions_of(counted)), counted)


@query("i01_grounding_versions_only", FEEDBACK_SQL + "SELECT tenant_id, result_id, template_version_id, field_name, n_edits FROM cand WHERE template_version_id IN (1, 4, 5)")
def grounding_versions_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions 1 and 4 name the provider, version 5 the style; the others neither."""
    version = F.col("template_version_id")
    templates = v.jobs(spark, sf_dir).select("tenant_id", "template_version_id").distinct().select(
        "tenant_id", "template_version_id", F.when(version.isin(1, 4), fb.GROUNDING_PROVIDER).otherwise("mock").alias("provider_type"),
        F.when(version == 5, fb.GROUNDING_PROVIDER).alias("api_style"))
    found = fb.reviewed_edits(results(spark, sf_dir), v.jobs(spark, sf_dir), documents(spark, sf_dir), edits(spark, sf_dir), templates)
    return found.select("tenant_id", "result_id", "template_version_id", "field_name", "n_edits")


@query("i10_dismiss", """
SELECT 'tenant_' || user_id % 5 AS tenant_id, user_id % 7 AS template_version_id, 'key_' || user_id AS suggestion_key,
  max_by(event_type = 'click', event_id) AS dismissed, max(event_id) AS updated_at FROM events GROUP BY 1, 2, 3""")
def dismiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    history = v.audit(spark, sf_dir).select(
        "tenant_id", (user % 7).alias("template_version_id"), F.concat(F.lit("key_"), user.cast("string")).alias("suggestion_key"),
        (F.col("action") == "click").alias("dismissed"), F.col("event_id").alias("updated_at"))
    return fb.dismiss(history)
