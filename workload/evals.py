"""Evaluation and quality-gate queries: orders as cases of ten expected fields each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweft.operators import evaluation as ev
from workload import views as v
from workload.registry import query

KEYS = ["case_name", "category", "field_name"]


def case_of(key: Column) -> Column:
    return F.concat(F.lit("case_"), F.floor(key / 10).cast("string"))


def as_json(*members: Column) -> Column:
    return F.to_json(F.struct(*members))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings, numbers, objects with lists, booleans, by key; some without a normalized or a review check."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    n = key % 5
    nested = as_json(price.alias("amount"), F.struct(F.array(F.lit("net-30"), F.lit("Ship_To")).alias("tags"), F.lit(True).alias("paid")).alias("terms"))
    normalized = (F.when(n == 0, F.lit('"Acme  Corp-West"')).when(n == 1, price.cast("string")).when(n == 2, nested).when(n == 3, F.lit("[1, 2.0, \"a\"]")))
    return v.table(spark, sf_dir, "orders").select(
        case_of(key).alias("case_name"), F.when(n == 2, "calculated_field").otherwise("field").alias("category"),
        F.concat(F.lit("f"), (key % 10).cast("string")).alias("field_name"),
        F.when(key % 2 == 0, F.lit('"Total_Due"')).alias("extracted_json"), normalized.alias("normalized_json"),
        F.when(key % 3 > 0, F.col("o_orderstatus") == "F").alias("review"))


def actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with near and far deviations, by key; every 17th field is missing."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    n, d = key % 5, key % 7
    near, far = price + 0.004, price + 0.5
    amount = F.when(d < 3, near).when(d == 3, far).otherwise(price)
    tags = F.when(d == 4, F.array(F.lit("net 30"))).when(d == 5, F.array(F.lit("NET_30"), F.lit("ship to"))).otherwise(F.array(F.lit("net 30"), F.lit("elsewhere")))
    paid = F.struct(tags.alias("tags"), F.lit(True).alias("paid"), F.lit("extra").alias("more"))
    nested = as_json(amount.alias("amount"), F.when(d == 5, paid).otherwise(paid).alias("terms"), F.lit(1).alias("extra"))
    normalized = (
        F.when(n == 0, F.when(d < 4, F.lit('"acme corp_west "')).when(d == 4, "5").otherwise('"acme corp"'))
        .when(n == 1, F.when(d == 5, F.concat(F.lit('"'), price.cast("string"), F.lit('"'))).otherwise(amount.cast("string")))
        .when(n == 2, nested)
        .when(n == 3, F.when(d < 4, F.lit('[1.001, 2, "A"]')).when(d == 4, "[1, 2]").otherwise('[1, 2, "a", 3]')))
    return v.table(spark, sf_dir, "orders").filter(key % 17 != 0).select(
        case_of(key).alias("case_name"), F.when(n == 2, "calculated_field").otherwise("field").alias("category"),
        F.concat(F.lit("f"), (key % 10).cast("string")).alias("field_name"),
        F.when(key % 4 == 0, F.lit('"total due"')).otherwise('"Total: Due"').alias("extracted_json"), normalized.alias("normalized_json"),
        (F.col("o_orderpriority") < "3").alias("review"))


CHECK_SQL = """
WITH b AS (SELECT o_orderkey AS k, 'case_' || o_orderkey // 10 AS case_name, CASE WHEN o_orderkey % 5 = 2 THEN 'calculated_field' ELSE 'field' END AS category,
  'f' || o_orderkey % 10 AS field_name, o_orderkey % 5 AS n, o_orderkey % 7 AS d, o_orderkey % 17 <> 0 AS present, o_orderstatus = 'F' AS want_review, o_orderpriority < '3' AS review FROM orders),
checks AS (
  SELECT case_name, category, field_name, 'extracted_value' AS "check", present AND k % 4 = 0 AS matched, present FROM b WHERE k % 2 = 0
  UNION ALL SELECT case_name, category, field_name, 'normalized_value', present AND CASE n WHEN 0 THEN d < 4 WHEN 1 THEN d NOT IN (3, 5) WHEN 2 THEN d = 5 ELSE d < 4 END, present FROM b WHERE n < 4
  UNION ALL SELECT case_name, category, field_name, 'requires_review', present AND want_review = review, present FROM b WHERE k % 3 > 0),
detailed AS (SELECT *, CASE WHEN NOT present THEN 'field missing from extraction output' WHEN NOT matched THEN "check" || ' mismatch' END AS detail FROM checks),
cases AS (SELECT case_name, count(*) FILTER (WHERE matched) AS matched_checks, count(*) FILTER (WHERE NOT matched) AS failed_checks FROM checks GROUP BY 1)
"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.compare_expectations(expected(spark, sf_dir), actual(spark, sf_dir))


@query("k01_compare_expectations", CHECK_SQL + 'SELECT case_name, category, field_name, "check", matched, detail FROM detailed')
def compare_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(spark, sf_dir)


@query("k02_values_match", """
SELECT o_orderkey, o_orderkey % 17 <> 0 AND CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 7 < 4 WHEN 1 THEN o_orderkey % 7 NOT IN (3, 5) WHEN 2 THEN o_orderkey % 7 = 5
  ELSE o_orderkey % 7 < 4 END AS matched FROM orders WHERE o_orderkey % 5 < 4""")
def values_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = expected(spark, sf_dir).filter("normalized_json IS NOT NULL").select(*KEYS, F.col("normalized_json").alias("e"))
    pairs = left.join(actual(spark, sf_dir).select(*KEYS, F.col("normalized_json").alias("a")), KEYS, "left")
    key = F.concat(F.substring("case_name", 6, 20), F.substring("field_name", 2, 1)).cast("bigint")
    parsed = pairs.select(key.alias("o_orderkey"), F.try_parse_json("e").alias("e"), F.try_parse_json("a").alias("a"))
    return parsed.select("o_orderkey", ev.values_match(F.col("e"), F.col("a")).alias("matched"))


@query("k03_review_flags_match", """
WITH f AS (SELECT o_orderkey // 10 AS c, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 2 = 0))) AS e,
  list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 3 = 0))) AS a FROM orders GROUP BY 1)
SELECT 'case_' || c AS case_name, coalesce(e, []) = coalesce(a, []) AS matched FROM f""")
def review_flags_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    cases = v.table(spark, sf_dir, "orders").groupBy(case_of(key).alias("case_name")).agg(
        F.collect_list(F.when(key % 2 == 0, F.col("o_orderpriority"))).alias("expected_flags"),
        F.collect_list(F.when(key % 3 == 0, F.col("o_orderpriority"))).alias("actual_flags"))
    return ev.review_flags_match(cases).select("case_name", "matched")


@query("k04_notes_match", """
SELECT 'case_' || o_orderkey AS case_name, unnest(['Redaction-applied', 'unexpected_field']) AS expected_note,
  unnest([o_orderkey % 2 = 0, o_orderkey % 3 = 0]) AS matched FROM orders""")
def notes_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    notes = F.array(F.when(key % 2 == 0, "Note: redaction  APPLIED for 2 spans.").otherwise("none"), F.when(key % 3 == 0, "Provider returned unexpected field 'x'.").otherwise("unexpected"))
    cases = v.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("case_"), key.cast("string")).alias("case_name"), F.array(F.lit("Redaction-applied"), F.lit("unexpected_field")).alias("expected_notes"),
        notes.alias("actual_notes"))
    return ev.notes_match(cases)


@query("k05_case_results", CHECK_SQL + "SELECT *, failed_checks = 0 AS passed FROM cases")
def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.case_results(checks(spark, sf_dir))


@query("k05_eval_report", CHECK_SQL + """
SELECT count(*) AS total_cases, count(*) FILTER (WHERE failed_checks = 0) AS passed_cases, count(*) FILTER (WHERE failed_checks > 0) AS failed_cases,
  CAST(sum(matched_checks) AS BIGINT) AS matched_checks, CAST(sum(failed_checks) AS BIGINT) AS failed_checks FROM cases""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.eval_report(ev.case_results(checks(spark, sf_dir)))


@query("k05_mismatches", CHECK_SQL + """
SELECT case_name, coalesce('[' || string_agg('{"category":"' || category || '","subject":"' || field_name || '","detail":"' || detail || '"}', ',' ORDER BY category, field_name, detail)
  FILTER (WHERE NOT matched) || ']', '[]') AS mismatches_json FROM detailed GROUP BY 1""")
def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.mismatches(checks(spark, sf_dir))


RUN_SQL = CHECK_SQL.replace("detailed AS", """valued AS (
  SELECT case_name, category, field_name AS subject, 'extracted_value' AS "check", present AND k % 4 = 0 AS matched, present, '"Total_Due"' AS expected, CASE WHEN present THEN CASE WHEN k % 4 = 0 THEN '"total due"' ELSE '"Total: Due"' END END AS got FROM b WHERE k % 2 = 0
  UNION ALL SELECT case_name, category, field_name, 'requires_review', present AND want_review = review, present, CAST(want_review AS VARCHAR), CASE WHEN present THEN CAST(review AS VARCHAR) END FROM b WHERE k % 3 > 0),
lists AS (SELECT 'case_' || o_orderkey // 10 AS case_name, coalesce(list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 2 = 0))), []) AS e,
  coalesce(list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 3 = 0))), []) AS a, bool_or(o_orderstatus = 'F') AS noted FROM orders GROUP BY 1),
flags AS (SELECT case_name, 'review_flags' AS category, 'fields_requiring_review' AS subject, 'review_flags' AS "check", e = a AS matched, true AS present,
  CASE WHEN len(e) = 0 THEN '[]' ELSE '["' || array_to_string(e, '","') || '"]' END AS expected, CASE WHEN len(a) = 0 THEN '[]' ELSE '["' || array_to_string(a, '","') || '"]' END AS got FROM lists),
notes AS (SELECT case_name, 'document_note', 'Redaction-applied', 'document_note', noted, true, 'Redaction-applied', CASE WHEN noted THEN '["Note: redaction  APPLIED."]' ELSE '[]' END FROM lists),
every AS (SELECT * FROM valued UNION ALL SELECT * FROM flags UNION ALL SELECT * FROM notes),
said AS (SELECT *, CASE WHEN NOT present THEN 'field missing from extraction output' WHEN "check" = 'review_flags' THEN 'expected ' || expected || ', got ' || got
  WHEN "check" = 'document_note' THEN 'expected note containing ' || expected || ', got ' || got ELSE "check" || ' mismatch: expected ' || expected || ', got ' || got END AS detail FROM every),
totals AS (SELECT case_name, count(*) FILTER (WHERE matched) AS matched_checks, count(*) FILTER (WHERE NOT matched) AS failed_checks FROM said GROUP BY 1),
items AS (SELECT case_name, '[' || string_agg('{"category":"' || category || '","subject":"' || subject || '","detail":"' || replace(detail, '"', chr(92) || '"') || '"}', ',' ORDER BY category, subject, detail) || ']' AS mismatches_json
  FROM (SELECT DISTINCT case_name, category, subject, detail FROM said WHERE NOT matched) GROUP BY 1),
run AS (SELECT t.case_name, 'mock' AS provider_type, 'Model of ' || t.case_name AS provider_label, 'm-1' AS model, failed_checks = 0 AS passed, matched_checks, failed_checks, coalesce(mismatches_json, '[]') AS mismatches_json
  FROM totals t LEFT JOIN items i ON i.case_name = t.case_name),
detailed AS""")


def run_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases with all four kinds of checks; normalized values are left to k01."""
    key = F.col("o_orderkey")
    wanted = expected(spark, sf_dir).withColumn("normalized_json", F.lit(None).cast("string"))
    cases = v.table(spark, sf_dir, "orders").groupBy(case_of(key).alias("case_name")).agg(
        F.collect_list(F.when(key % 2 == 0, F.col("o_orderpriority"))).alias("expected_flags"),
        F.collect_list(F.when(key % 3 == 0, F.col("o_orderpriority"))).alias("actual_flags"), F.bool_or(F.col("o_orderstatus") == "F").alias("noted"))
    notes = F.when(F.col("noted"), F.array(F.lit("Note: redaction  APPLIED."))).otherwise(F.array().cast("array<string>"))
    cases = cases.withColumns({"expected_notes": F.array(F.lit("Redaction-applied")), "actual_notes": notes, "provider_type": F.lit("mock"),
                               "provider_label": F.concat(F.lit("Model of "), F.col("case_name")), "model": F.lit("m-1")}).drop("noted")
    checks_ = ev.run_checks(ev.compare_expectations(wanted, actual(spark, sf_dir), values=True), cases)
    return ev.case_run(checks_, cases)


@query("k05_case_run", RUN_SQL + "SELECT * FROM run")
def case_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_cases(spark, sf_dir)


@query("k01_expected_and_got", RUN_SQL + """
SELECT case_name, category, subject, "check", matched, expected, got FROM valued""")
def expected_and_got(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = expected(spark, sf_dir).withColumn("normalized_json", F.lit(None).cast("string"))
    found = ev.compare_expectations(wanted, actual(spark, sf_dir), values=True)
    return found.select("case_name", "category", F.col("field_name").alias("subject"), "check", "matched", "expected", "got")


@query("k06_eval_trend", """
WITH runs AS (SELECT o_orderpriority AS label, year(o_orderdate) * 100 + month(o_orderdate) AS run_id, count(*) AS total_cases,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS passed_cases, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed_checks FROM orders GROUP BY 1, 2)
SELECT label, run_id, total_cases, passed_cases, failed_checks, passed_cases - lag(passed_cases) OVER (PARTITION BY label ORDER BY run_id) AS passed_change,
  failed_checks - lag(failed_checks) OVER (PARTITION BY label ORDER BY run_id) AS failed_checks_change FROM runs""")
def eval_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per priority and month; its cases are the orders."""
    run = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint")
    history = v.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label"), run.alias("run_id")).agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if(F.col("o_orderstatus") == "F").alias("passed_cases"),
        F.count_if(F.col("o_orderstatus") != "F").alias("failed_checks")).withColumn("generated_at", F.col("run_id"))
    return ev.eval_trend(history).drop("generated_at")


FAMILIES = ("invoice", "receipt", "lease", "statement", "other")
SLO_SQL = """
WITH f AS (SELECT CASE l_linenumber % 5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'lease' WHEN 3 THEN 'statement' ELSE 'other' END AS document_type,
  l_quantity > 10 AS required, l_quantity <= 40 AS citation_required, l_suppkey % 20 > l_linenumber AS is_correct, l_partkey % (4 + l_linenumber * 2) <> 0 AS cited, l_partkey % 4 = 0 AS requires_review FROM lineitem),
rates AS (SELECT document_type, round(count(*) FILTER (WHERE is_correct AND required)::DOUBLE / count(*) FILTER (WHERE required)::DOUBLE, 6) AS field_accuracy,
  round(count(*) FILTER (WHERE cited AND citation_required)::DOUBLE / count(*) FILTER (WHERE citation_required)::DOUBLE, 6) AS citation_coverage,
  round(count(*) FILTER (WHERE requires_review)::DOUBLE / count(*)::DOUBLE, 6) AS review_rate FROM f GROUP BY 1)
"""


def graded_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    return v.table(spark, sf_dir, "lineitem").select(
        v.choose(n % 5, FAMILIES).alias("document_type"), (F.col("l_quantity") > 10).alias("required"),
        (F.col("l_quantity") <= 40).alias("citation_required"), (F.col("l_suppkey") % 20 > n).alias("is_correct"),
        F.when(part % (4 + n * 2) != 0, "cited").otherwise("").alias("source_text"), (part % 4 == 0).alias("requires_review"))


@query("k07_quality_slo", SLO_SQL + "SELECT * FROM rates")
def quality_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.quality_slo(graded_fields(spark, sf_dir))


@query("k08_slo_gate", SLO_SQL + """,
t(document_type, accuracy, coverage, review) AS (VALUES ('invoice', 0.95, 0.90, 0.25), ('receipt', 0.93, 0.85, 0.30), ('lease', 0.92, 0.88, 0.30), ('statement', 0.90, 0.85, 0.35))
SELECT document_type, 'field_accuracy' AS metric, field_accuracy AS actual, accuracy::DOUBLE AS target FROM rates JOIN t USING (document_type) WHERE field_accuracy < accuracy
UNION ALL SELECT document_type, 'citation_coverage', citation_coverage, coverage::DOUBLE FROM rates JOIN t USING (document_type) WHERE citation_coverage < coverage
UNION ALL SELECT document_type, 'review_rate', review_rate, review::DOUBLE FROM rates JOIN t USING (document_type) WHERE review_rate > review""")
def slo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.slo_gate(ev.quality_slo(graded_fields(spark, sf_dir)))
