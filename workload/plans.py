"""Whole plans over the documents: rule extraction in chunks, with and without redaction, and candidates from elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweft.operators import calculate as ca, extract as ex, reconcile as rc, redaction as rd
from docweft.plans import dry_run, execute
from docweft.schema import CANDIDATE_COLUMNS, CalcDef, FieldDef, Rules, Template
from workload import views as v
from workload.extraction import CALC_SQL, DRY_RUN_SQL, RESULT_KEYS, joined
from workload.fixed import INVOICE, LINES
from workload.registry import query
from workload.text import BLANK_SQL, MASKED_SQL, chunk_sql

SIZE, OVERLAP = 1500, 200
REPORT = Template(
    "Document Report", "1.0.0", "report",
    provider={"provider_type": "remote", "model": "rules", "allow_external_processing": True},
    fields=(
        FieldDef("amount", "Amount", "currency", required=True, rules=Rules(allow_null=False)),
        FieldDef("reference", "Reference No", "number"),
        FieldDef("dated", "Dated", "date", required=True, citation_required=False),
        FieldDef("license", "License", "text", citation_required=False),
        FieldDef("the", "The", "text", citation_required=False),
        FieldDef("mail", "Mail", "boolean", citation_required=False),
    ),
    calcs=(
        CalcDef("with_fee", "With Fee", "currency", "coalesce(amount.amount, 0) * 1.1 + 5", ("amount",)),
        CalcDef("share", "Share", "number", "amount.amount / reference.value", ("amount", "reference")),
    ),
)

_HITS = {
    "amount": (0.72, f"trim(nullif(regexp_extract(chunk, '{ex.RULE_CURRENCY}', 0), ''), {BLANK_SQL})"),
    "reference": (0.65, f"nullif(regexp_extract(chunk, '{ex.RULE_NUMBER}', 1), '')"),
    "dated": (0.70, f"nullif(regexp_extract(chunk, '{ex.RULE_DATE}', 1), '')"),
    "license": (0.58, f"CASE WHEN contains(lower(chunk), 'license') THEN trim(substring(chunk, 1, {ex.SNIPPET_CHARS}), {BLANK_SQL}) END"),
    "the": (0.58, f"CASE WHEN contains(lower(chunk), 'the') THEN trim(substring(chunk, 1, {ex.SNIPPET_CHARS}), {BLANK_SQL}) END"),
    "mail": (0.60, "CASE WHEN contains(lower(chunk), 'mail') THEN 'true' END"),
}


def _report_sql(start: str, notes: str, masked: bool) -> str:
    """start: common table expressions up to pieces (doc_id, idx, chunk); notes: the document notes of a doc_id, from `docs`."""
    hits = " UNION ALL ".join(
        f"SELECT doc_id, idx, {no} AS field_no, '{name}' AS field_name, {score}::DOUBLE AS score, {hit} AS hit FROM pieces"
        for no, (name, (score, hit)) in enumerate(_HITS.items()))
    clear = "coalesce(contains(source, '*'), false) OR coalesce(contains(hit, '*'), false)" if masked else "false"
    return start + f""",
hits AS ({hits}),
sourced AS (SELECT *, CASE WHEN hit IS NULL THEN '' WHEN field_name = 'mail' THEN 'mail' ELSE hit END AS source, CASE WHEN hit IS NULL THEN 0.35 ELSE score END::DOUBLE AS confidence FROM hits),
candidates AS (SELECT *, {clear} AS cleared, hit IS NOT NULL AND NOT ({clear}) AS found FROM sourced),
best AS (SELECT * FROM (SELECT *, count(*) OVER w0 AS n, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY found::INT + (source <> '')::INT DESC, confidence DESC, length(source) DESC, idx) AS rn
  FROM candidates WINDOW w0 AS (PARTITION BY doc_id, field_name)) WHERE rn = 1),
results AS (SELECT *, CASE WHEN source <> '' THEN '{ex.FOUND_NOTE}' ELSE '{ex.MISS_NOTE}' END || ' Chunk ' || idx || '/' || n || '.' || CASE WHEN cleared THEN ' {rd.CLEARED_NOTE}' ELSE '' END
    || CASE WHEN n > 1 THEN ' Selected highest-confidence match from ' || n || ' chunk candidates.' ELSE '' END
    || CASE WHEN found THEN ' Confidence ' || printf('%.2f', confidence) || ' is below the 0.75 review threshold.' ELSE '' END AS notes,
  list_filter([CASE WHEN field_name IN ('amount', 'dated') AND NOT found THEN '{rc.REQUIRED_MISSING}' END, CASE WHEN field_name = 'amount' AND NOT found THEN '{rc.NULL_NOT_ALLOWED}' END,
    CASE WHEN field_name IN ('amount', 'reference') AND source = '' THEN '{rc.CITATION_MISSING}' END], lambda e: e IS NOT NULL) AS errors FROM best),
wide AS (SELECT doc_id, string_agg(field_name || '=' || CASE WHEN cleared OR hit IS NULL THEN '-' ELSE hit END, '|' ORDER BY field_no) AS extracted,
    string_agg(notes, '|' ORDER BY field_no) AS notes, string_agg(array_to_string(errors, ','), '|' ORDER BY field_no) AS errors,
    max(TRY_CAST(regexp_replace(replace(replace(number, '$', ''), ',', ''), '\\s', '', 'g') AS DOUBLE)) FILTER (WHERE field_name = 'amount' AND found) AS amount,
    max(TRY_CAST(number AS DOUBLE)) FILTER (WHERE field_name = 'reference' AND found) AS reference FROM (SELECT *, CASE WHEN field_name IN ('amount', 'reference') THEN hit END AS number FROM results) GROUP BY doc_id),
calc AS (SELECT *, round(CAST(CAST(coalesce(amount, 0) * 1.1::DOUBLE + 5 AS VARCHAR) AS DECIMAL(38, 16)), 2)::DOUBLE AS with_fee, CASE WHEN reference <> 0 THEN amount / reference END AS share,
    CASE WHEN amount IS NULL THEN '{ca.INPUT_MISSING[0]}' WHEN reference = 0 THEN '{ca.DIVIDED_BY_ZERO[0]}' WHEN reference IS NULL THEN '{ca.INPUT_MISSING[0]}' ELSE '' END AS share_errors FROM wide)
SELECT doc_id, 'completed' AS extraction_status, md5(extracted) AS extracted_md5, notes, errors, with_fee, share, share_errors,
  'amount|reference|dated|license|the|mail' || CASE WHEN share_errors <> '' THEN '|share' ELSE '' END AS review, {notes} AS document_notes, NULL::VARCHAR AS error_message FROM calc"""


def report_rows(envelope: DataFrame) -> DataFrame:
    def each(member: str, default: str = "") -> Column:
        return F.transform("extracted_fields", lambda f: F.coalesce(f[member].cast("string"), F.lit(default)))

    named = F.transform("extracted_fields", lambda f: F.concat(f["field_name"], F.lit("="), F.coalesce(f["extracted_value"], F.lit("-"))))
    calculated = F.map_from_entries(F.transform("calculated_fields", lambda c: F.struct(c["field_name"], c)))
    return envelope.withColumn("_c", calculated).select(
        "doc_id", "extraction_status", F.md5(joined(named)).alias("extracted_md5"), joined(each("extraction_notes")).alias("notes"),
        joined(F.transform("extracted_fields", lambda f: F.array_join(f["validation_errors"], ","))).alias("errors"),
        F.get_json_object(F.col("_c")["with_fee"]["calculated_value"], "$.amount").cast("double").alias("with_fee"),
        F.col("_c")["share"]["calculated_value"].cast("double").alias("share"),
        F.array_join(F.col("_c")["share"]["validation_errors"], ",").alias("share_errors"),
        joined(F.col("fields_requiring_review")).alias("review"), joined(F.col("document_level_notes")).alias("document_notes"), "error_message")


@query("p01_process_documents", _report_sql(chunk_sql(SIZE, OVERLAP).rstrip(), "''", False))
def process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rows(execute.process_documents(v.documents(spark, sf_dir), REPORT, chunk_size=SIZE, overlap=OVERLAP))


_REDACTED = MASKED_SQL[: MASKED_SQL.rindex("SELECT d.doc_id, md5(")].rstrip() + """,
redacted AS (SELECT d.doc_id, coalesce(head || substring(d.text, last_end + 1), d.text) AS text FROM documents d LEFT JOIN masked m ON m.doc_id = d.doc_id),
noted AS (SELECT d.doc_id, 'External provider text redaction applied for ' || count(m.doc_id) || ' spans across ' || count(DISTINCT m.entity_type) || ' entity types.' AS note
  FROM documents d LEFT JOIN merged m ON m.doc_id = d.doc_id GROUP BY d.doc_id),
""" + chunk_sql(SIZE, OVERLAP).replace("WITH RECURSIVE base", "base").replace("FROM documents)", "FROM redacted)").strip()


@query("p02_process_redacted_documents", _report_sql(_REDACTED, "(SELECT note FROM noted WHERE noted.doc_id = calc.doc_id)", True))
def process_redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    deployment = execute.Deployment(require_redaction=True)
    return report_rows(execute.process_documents(v.documents(spark, sf_dir), REPORT, ("doc_id",), deployment, SIZE, OVERLAP))


@query("p03_refused_documents", f"""
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'failed' ELSE 'completed' END AS extraction_status, CASE WHEN doc_id % 4 < 2 THEN '{rd.SPREADSHEET_NOT_REDACTED}' END AS error_message,
  doc_id % 4 >= 2 AS has_fields FROM documents""")
def refused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = v.choose(F.col("doc_id") % 4, ("a.csv", "b.XLSX", "c.pdf", "d.xls"))
    docs = v.documents(spark, sf_dir).withColumn("original_filename", names)
    done = execute.process_documents(docs, REPORT, ("doc_id",), execute.Deployment(require_redaction=True))
    return done.select("doc_id", "extraction_status", "error_message", F.col("extracted_fields").isNotNull().alias("has_fields"))


@query("p04_process_candidates", CALC_SQL + f""",
strays AS (SELECT result_id, string_agg('Provider returned unexpected field ''' || field_name || '''.', '|' ORDER BY seq, field_name) AS notes FROM v_candidates WHERE l_linenumber > 5 GROUP BY 1)
SELECT w.result_id AS doc_id, coalesce(s.notes, '') AS document_notes, (SELECT string_agg(r.field_name || '=' || r.validation_status || ' ' || r.notes, '|' ORDER BY r.field_no) FROM recon r WHERE r.result_id = w.result_id) AS fields,
  CASE WHEN flagged = '' THEN coalesce(c, '') WHEN c IS NULL THEN flagged ELSE flagged || '|' || c END AS review
FROM wide w LEFT JOIN strays s ON s.result_id = w.result_id LEFT JOIN (SELECT result_id, string_agg(field_name, '|' ORDER BY field_no) AS c FROM calc WHERE len(errors) > 0 GROUP BY 1) k ON k.result_id = w.result_id""")
def process_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of another extractor, gathered per document; those of unknown fields become document notes."""
    # Gathering makes nothing smaller, so the rows are dealt out as they are, and each candidate is made a struct (in generated code) before.
    each = v.candidates(spark, sf_dir).select(*RESULT_KEYS, F.struct("seq", "field_name", *CANDIDATE_COLUMNS).alias("candidate"))
    found = each.repartition(*RESULT_KEYS).groupBy(*RESULT_KEYS).agg(F.sort_array(F.collect_list("candidate")).alias("found"))
    docs = v.result_ids(spark, sf_dir).join(found, list(RESULT_KEYS), "left").select(F.col("result_id").alias("doc_id"), F.lit("").alias("text"), "found")
    done = execute.process_documents(docs, LINES, candidates="found")
    # By position rather than by an array function: members that are not shown are then never made.
    fields = [F.get("extracted_fields", F.lit(i)) for i in range(len(LINES.fields))]
    status = F.array(*[F.concat(f["field_name"], F.lit("="), f["validation_status"], F.lit(" "), f["extraction_notes"]) for f in fields])
    return done.select("doc_id", joined(F.col("document_level_notes")).alias("document_notes"), joined(status).alias("fields"),
                       joined(F.col("fields_requiring_review")).alias("review"))


@query("e17_schema_dry_run_whole", DRY_RUN_SQL.replace("SELECT doc_id, CASE", f"""SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN 'Dry run (mock)' END AS provider, CASE WHEN doc_id % 10 > 0 THEN '{INVOICE.version}' END AS version,
  CASE WHEN doc_id % 10 > 0 THEN 'valid|valid|' || CASE WHEN dated THEN 'valid' ELSE 'invalid' END || '|valid|valid|valid' END AS statuses,
  CASE WHEN doc_id % 10 > 0 THEN round(CAST(CAST(o_totalprice * 1.10::DOUBLE AS VARCHAR) AS DECIMAL(38, 16)), 2)::DOUBLE END AS buffer, '' AS notes, CASE""", 1))
def schema_dry_run_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.invoices(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 10 == 0, " \n ").otherwise(F.col("text")).alias("text"))
    buffer = F.get(F.filter("summary.calculated_fields", lambda f: f["field_name"] == "amount_with_buffer"), F.lit(0))["calculated_value"]
    return dry_run.schema_dry_run(docs, INVOICE).select(
        "doc_id", F.col("summary.llm_provider")["provider_label"].alias("provider"), F.col("summary.template_version").alias("version"),
        joined(F.transform("extracted_fields", lambda f: f["validation_status"])).alias("statuses"),
        F.get_json_object(buffer, "$.amount").cast("double").alias("buffer"), joined(F.col("document_level_notes")).alias("notes"),
        "ok", joined(F.col("fields_requiring_review")).alias("fields"), joined(F.col("schema_errors")).alias("schema_errors"))
