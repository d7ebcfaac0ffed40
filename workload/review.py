"""Review and export-gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docweft.operators import calculate as ca, review as rv
from docweft.schema import CalcDef, FieldDef, Template, value_struct
from workload import views as v
from workload.extraction import joined
from workload.registry import query

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
SHORT = ["result_id", "field_name", "validation_status", "requires_review"]

REVIEWED = Template(
    "Reviewed Lines", "1", "statement",
    tuple(FieldDef(f"field_{i}", f"Field {i}", "currency") for i in range(1, 8)),
    (CalcDef("total", "Total", "currency", "field_1.amount + field_2.amount", ("field_1", "field_2")),
     CalcDef("checked", "Checked", "currency", "coalesce(field_3.amount, 0) * 2", ("field_3",), requires_review=True),
     CalcDef("doubled", "Doubled", "currency", "coalesce(field_4.amount, 1) * 2", ("field_4",))),
)


@query("h01_approve_high_confidence", """
SELECT result_id, field_name, CASE WHEN ok THEN 'reviewed' ELSE validation_status END AS validation_status, requires_review AND NOT ok AS requires_review
FROM (SELECT *, requires_review AND validation_status <> 'invalid' AND confidence >= 0.85 AS ok FROM v_results)""")
def approve_high_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.approve_high_confidence(v.results(spark, sf_dir)).select(*SHORT)




@query("h02_approve_all", """
SELECT r.result_id, r.field_name, CASE WHEN r.requires_review AND e.result_id IS NULL THEN 'reviewed' ELSE validation_status END AS validation_status,
  r.requires_review AND e.result_id IS NOT NULL AS requires_review
FROM v_results r LEFT JOIN (SELECT DISTINCT result_id FROM v_edits) e ON e.result_id = r.result_id""")
def approve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.approve_all(v.results(spark, sf_dir), v.edits(spark, sf_dir)).select(*SHORT)


LAST_EDIT_SQL = """
WITH last AS (SELECT result_id, field_name, max_by(new_amount, seq) AS new_amount, max_by(edit_extracted, seq) FILTER (WHERE edit_extracted IS NOT NULL) AS edit_extracted
  FROM v_edits GROUP BY 1, 2),
edited AS (SELECT r.*, coalesce(l.new_amount, r.amount) AS final_amount, coalesce(l.edit_extracted, r.extracted_value) AS final_extracted, l.result_id IS NOT NULL AS e
  FROM v_results r LEFT JOIN last l ON l.result_id = r.result_id AND l.field_name = r.field_name)
"""


@query("h03_apply_edits", LAST_EDIT_SQL + """
SELECT result_id, field_name, final_amount AS amount, final_extracted AS extracted_value, CASE WHEN e THEN 'reviewed' ELSE validation_status END AS validation_status,
  requires_review AND NOT e AS requires_review FROM edited""")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.apply_edits(v.results(spark, sf_dir), v.edits(spark, sf_dir)).select(
        "result_id", "field_name", "normalized_value.amount", "extracted_value", "validation_status", "requires_review")


@query("h03_unknown_edits", """
SELECT e.result_id, e.field_name, e.seq FROM (SELECT result_id, CASE WHEN seq % 7 = 0 THEN 'no_such_field' ELSE field_name END AS field_name, seq FROM v_edits) e
WHERE NOT EXISTS (SELECT 1 FROM v_results r WHERE r.result_id = e.result_id AND r.field_name = e.field_name)""")
def unknown_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh edit names a field that no result has."""
    planted = v.edits(spark, sf_dir).withColumn("field_name", F.when(F.col("seq") % 7 == 0, "no_such_field").otherwise(F.col("field_name")))
    return rv.unknown_edits(planted, v.results(spark, sf_dir)).select("result_id", "field_name", "seq")


@query("h04_edit_log", """
SELECT e.result_id, e.field_name, e.seq, e.reviewer, coalesce(lag(new_amount) OVER (PARTITION BY e.result_id, e.field_name ORDER BY e.seq), r.amount) AS previous_amount, new_amount
FROM v_edits e JOIN v_results r ON r.result_id = e.result_id AND r.field_name = e.field_name""")
def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.edit_log(v.edits(spark, sf_dir), v.results(spark, sf_dir)).select(
        "result_id", "field_name", "seq", "reviewer", F.col("previous_value.amount").alias("previous_amount"),
        F.col("new_value.amount").alias("new_amount"))


def full_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with every column of a field result, after the edits."""
    nothing = F.lit(None)
    return rv.apply_edits(v.results(spark, sf_dir), v.edits(spark, sf_dir)).withColumns({
        "source_text": F.lit("line"), "char_start": nothing.cast("int"), "char_end": nothing.cast("int"),
        "page_number": nothing.cast("int"), "location_reference": F.lit(""), "notes": F.lit(""),
        "n_candidates": F.lit(1), "validation_errors": F.array().cast("array<string>")})


@query("h05_recalculate_after_review", LAST_EDIT_SQL + """,
wide AS (SELECT result_id, max(final_amount) FILTER (WHERE l_linenumber = 1) AS f1, max(final_amount) FILTER (WHERE l_linenumber = 2) AS f2,
  max(final_amount) FILTER (WHERE l_linenumber = 3) AS f3, max(final_amount) FILTER (WHERE l_linenumber = 4) AS f4,
  coalesce(string_agg(field_name, '|' ORDER BY l_linenumber) FILTER (WHERE requires_review AND NOT e), '') AS open_fields FROM edited GROUP BY 1)
SELECT result_id, round(CAST(CAST(f1 + f2 AS VARCHAR) AS DECIMAL(38, 16)), 2)::DOUBLE AS total, CASE WHEN f1 + f2 IS NULL THEN 'invalid' ELSE 'reviewed' END AS total_status,
  round(CAST(CAST(coalesce(f3, 0) * 2 AS VARCHAR) AS DECIMAL(38, 16)), 2)::DOUBLE AS checked, 'valid' AS checked_status, 'reviewed' AS doubled_status, 'reviewed' AS review_status,
  open_fields || CASE WHEN f1 + f2 IS NULL THEN CASE WHEN open_fields = '' THEN 'total|' ELSE '|total|' END ELSE CASE WHEN open_fields = '' THEN '' ELSE '|' END END || 'checked' AS fields_requiring_review
FROM wide""")
def recalculate_after_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rv.recalculate_after_review(full_results(spark, sf_dir), REVIEWED)
    return wide.select(
        "result_id", F.col("total.calculated_value.amount").alias("total"), F.col("total.validation_status").alias("total_status"),
        F.col("checked.calculated_value.amount").alias("checked"), F.col("checked.validation_status").alias("checked_status"),
        F.col("doubled.validation_status").alias("doubled_status"), "review_status",
        joined(ca.review_list(REVIEWED)).alias("fields_requiring_review"))


@query("h06_latest_reviewer", """
SELECT r.result_id, coalesce(e.reviewer, 'local-user') AS reviewer FROM (SELECT DISTINCT result_id FROM v_results) r
LEFT JOIN (SELECT result_id, first(reviewer ORDER BY created_at DESC, seq DESC) AS reviewer FROM v_edits GROUP BY 1) e ON e.result_id = r.result_id""")
def latest_reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.latest_reviewer(v.results(spark, sf_dir), v.edits(spark, sf_dir))


GATE_SETTINGS_SQL = """
WITH settings AS (SELECT c_mktsegment AS tenant_id, count(*) % 2 = 0 AS enabled FROM customer GROUP BY 1),
"""


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export policies: JSON objects for some tenants, bare booleans for others."""
    per_tenant = v.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    enabled = F.when(F.col("n") % 2 == 0, "true").otherwise("false")
    value = F.when(F.col("c_mktsegment") < "F", F.concat(F.lit('{"enabled":'), enabled, F.lit("}"))).otherwise(enabled)
    return per_tenant.select(
        F.concat(F.lit("tenant:"), F.col("c_mktsegment"), F.lit(":" + rv.REVIEW_POLICY_KEY)).alias("key"), value.alias("value"))


@query("h07_export_gate", GATE_SETTINGS_SQL + f"""
open AS (SELECT result_id, count(*) FILTER (WHERE requires_review) AS open_fields FROM v_results GROUP BY 1)
SELECT result_id, j.tenant_id, coalesce(enabled, false) AND (o.result_id % 3 = 0 OR open_fields > 0) AS export_blocked,
  CASE WHEN coalesce(enabled, false) AND (o.result_id % 3 = 0 OR open_fields > 0) THEN '{rv.EXPORT_BLOCKED}' END AS block_reason
FROM open o JOIN v_jobs j ON j.job_id = o.result_id LEFT JOIN settings s ON s.tenant_id = j.tenant_id""")
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_fields = v.results(spark, sf_dir).groupBy("result_id").agg(F.count_if("requires_review").alias("open_fields"))
    owners = v.jobs(spark, sf_dir).select(F.col("job_id").alias("result_id"), "tenant_id")
    rows = open_fields.join(owners, "result_id").withColumn(
        "review_status", F.when(F.col("result_id") % 3 == 0, "pending").otherwise("reviewed"))
    policies = rv.tenant_flags(settings(spark, sf_dir), rv.REVIEW_POLICY_KEY)
    return rv.export_gate(rows, policies).select("result_id", "tenant_id", "export_blocked", "block_reason")


DRAFT_TYPES = ("", "currency", "date", "number", "boolean", "table", "json_object", "text")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    price = F.col("l_extendedprice")
    draft = (
        F.when(part % 10 == 0, "  ")
        .when(n == 1, F.when(part % 4 == 0, "12x").otherwise(F.concat(F.lit(" "), price.cast("string"))))
        .when(n == 2, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(n == 3, F.when(part % 4 == 1, "many").otherwise(F.col("l_quantity").cast("string")))
        .when(n == 4, F.when(part % 2 == 0, "true").otherwise("no"))
        .when(n == 5, F.when(part % 3 == 0, '{"a":1}').when(part % 3 == 1, '[{"a":1}]').otherwise("[oops"))
        .when(n == 6, F.when(part % 3 == 0, '{"a":1}').when(part % 3 == 1, "5").otherwise("[1]"))
        .otherwise(F.concat(F.lit(" free "), part.cast("string"))))
    return v.table(spark, sf_dir, "lineitem").select(
        *LINE_KEYS, F.concat(F.lit("Field "), n.cast("string")).alias("label"), v.choose(n, DRAFT_TYPES).alias("data_type"),
        draft.alias("draft"), F.when(part % 2 == 0, "EUR").alias("existing_currency"), "l_extendedprice", "l_shipdate")


DRAFT_SQL = """
WITH d AS (SELECT *, l_partkey % 10 = 0 AS empty, CASE WHEN l_partkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS cur FROM lineitem),
e AS (SELECT *, CASE WHEN empty THEN NULL
    WHEN l_linenumber = 1 AND l_partkey % 4 = 0 THEN 'Field 1 must be a valid number.' WHEN l_linenumber = 3 AND l_partkey % 4 = 1 THEN 'Field 3 must be a valid number.'
    WHEN l_linenumber = 5 AND l_partkey % 3 = 0 THEN 'Field 5 must be a JSON array of rows.' WHEN l_linenumber = 5 AND l_partkey % 3 = 2 THEN 'Field 5 must be valid JSON.'
    WHEN l_linenumber = 6 AND l_partkey % 3 = 1 THEN 'Field 6 must be a JSON object or array.' END AS draft_error FROM d),
typed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, draft_error, empty OR draft_error IS NOT NULL AS nothing, cur, l_shipdate FROM e)
"""


@query("h08_typed_edit_values", DRAFT_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, draft_error,
  CASE WHEN NOT nothing AND l_linenumber = 1 THEN l_extendedprice END AS amount, CASE WHEN NOT nothing AND l_linenumber = 1 THEN cur END AS currency,
  CASE WHEN NOT nothing THEN CASE l_linenumber WHEN 1 THEN cur || ' ' || format('{:,.2f}', l_extendedprice) WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') END END AS display_value,
  CASE WHEN NOT nothing AND l_linenumber = 3 THEN l_quantity END AS number, CASE WHEN NOT nothing AND l_linenumber = 4 THEN l_partkey % 2 = 0 END AS flag,
  CASE WHEN NOT nothing THEN CASE l_linenumber WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 7 THEN ' free ' || l_partkey END END AS text,
  CASE WHEN NOT nothing THEN CASE l_linenumber WHEN 5 THEN '[{"a":1}]' WHEN 6 THEN CASE l_partkey % 3 WHEN 0 THEN '{"a":1}' ELSE '[1]' END END END AS object_json
FROM typed""")
def typed_edit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = rv.typed_edit_values(drafts(spark, sf_dir))
    members = [F.col(f"new_value.{m}").alias(m) for m in ("amount", "currency", "display_value", "number", "flag", "text", "object_json")]
    return typed.select(*LINE_KEYS, "draft_error", *members)


CHANGED_SQL = DRAFT_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'Updated from extraction workspace' AS reason FROM typed
WHERE CASE WHEN nothing THEN l_suppkey % 3 <> 2 ELSE l_suppkey % 3 <> 0 OR l_quantity >= 25 END"""


@query("h09_changed_edits", CHANGED_SQL)
@query("h09_changed_edits_all_types", CHANGED_SQL)
def changed_edits_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draft of the table, against a stored value of its own type (equal below a quantity of 25), extracted text only, or nothing."""
    n, part, supplier, same = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity") < 25
    price, currency = F.col("l_extendedprice"), F.coalesce("existing_currency", F.lit("USD"))
    date = F.when(same, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("1970-01-01")
    stored_value = (
        F.when(n == 1, value_struct(amount=F.when(same, price).otherwise(price + 1), currency=currency, display_value=F.concat(currency, F.lit(" "), F.format_number(price, 2))))
        .when(n == 2, value_struct(text=date, display_value=date))
        .when(n == 3, value_struct(number=F.when(same, F.col("l_quantity")).otherwise(0.5)))
        .when(n == 4, value_struct(flag=(part % 2 == 0) == same))
        .when(n == 5, value_struct(object_json=F.when(same, '[{"a":1}]').otherwise('[{"a":2}]')))
        .when(n == 6, value_struct(object_json=F.when(~same, '{"a":2}').when(part % 3 == 0, '{"a":1}').otherwise("[1]")))
        .otherwise(value_struct(text=F.when(same, F.concat(F.lit(" free "), part.cast("string"))).otherwise(" free"))))
    stored = rv.typed_edit_values(drafts(spark, sf_dir)).withColumns({
        "normalized_value": F.when(supplier % 3 == 0, stored_value), "extracted_value": F.when(supplier % 3 == 1, "free text")})
    return rv.changed_edits(stored).select(*LINE_KEYS, "reason")


@query("h10_review_reasons", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_partkey % 4 WHEN 0 THEN 'Required field is missing.|Check the total.' WHEN 1 THEN 'Check the total.'
  WHEN 2 THEN CASE WHEN l_returnflag = 'R' THEN '{rv.NEEDS_CONFIRMATION}' ELSE '' END ELSE 'Required field is missing.' END AS reasons FROM lineitem""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_partkey") % 4
    error = F.lit("Required field is missing.")
    rows = v.table(spark, sf_dir, "lineitem").select(
        *LINE_KEYS, F.when(kind == 0, F.array(error)).when(kind == 3, F.array(error, F.lit(" Required field is missing. ")))
        .otherwise(F.array().cast("array<string>")).alias("validation_errors"),
        F.when(kind < 2, " Check the total.").otherwise("").alias("notes"), (F.col("l_returnflag") == "R").alias("requires_review"))
    return rv.review_reasons(rows).select(*LINE_KEYS, joined(F.col("review_reasons")).alias("reasons"))


@query("h11_display_value", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_linenumber WHEN 1 THEN 'EUR ' || format('{:,.2f}', l_extendedprice) WHEN 2 THEN 'shown ' || l_partkey
  WHEN 3 THEN CASE WHEN l_partkey % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity + 0.5 AS VARCHAR) END
  WHEN 4 THEN CASE WHEN l_partkey % 2 = 0 THEN 'Yes' ELSE 'No' END WHEN 5 THEN '{"value":["a","b"]}' WHEN 6 THEN '—' ELSE '{"k":[1]}' END AS display_value FROM lineitem""")
def display_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, part, quantity = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")
    value = (
        F.when(n == 1, value_struct(amount=F.col("l_extendedprice"), currency=F.lit("EUR")))
        .when(n == 2, value_struct(amount=F.lit(1.0), display_value=F.concat(F.lit("shown "), part.cast("string"))))
        .when(n == 3, value_struct(number=F.when(part % 2 == 0, quantity).otherwise(quantity + 0.5)))
        .when(n == 4, value_struct(flag=part % 2 == 0))
        .when(n == 5, value_struct(items=F.array(F.lit("a"), F.lit("b"))))
        .when(n == 7, value_struct(object_json=F.lit('{"k":[1]}'))))
    kinds = ("", "currency", "currency", "number", "boolean", "list", "text", "json_object")
    rows = v.table(spark, sf_dir, "lineitem").select(*LINE_KEYS, value.alias("normalized_value"), v.choose(n, kinds).alias("data_type"))
    return rv.with_display_value(rows).select(*LINE_KEYS, "display_value")
