"""Extraction, reconciliation, validation and calculated-field queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweft.functions import formulas as fx, values as fv
from docweft.operators import calculate as ca, extract as ex, reconcile as rc
from docweft.plans import dry_run as plans
from docweft.schema import FieldDef, Template, value_struct
from workload import views as v
from workload.fixed import INVOICE, LINES
from workload.registry import query

RESULT_KEYS = ("result_id",)


def joined(items: Column) -> Column:
    return F.array_join(items, "|")


# ---- rule extraction ----------------------------------------------------------------------------
MONEY_RE, NUMBER_RE, DATE_RE = ex.RULE_CURRENCY, ex.RULE_NUMBER, ex.RULE_DATE
TAIL_SQL = """CASE WHEN hit <> '' THEN 1 END AS page_number, CASE WHEN hit <> '' THEN 'Page 1' ELSE '' END AS location_reference,
  CASE WHEN hit <> '' THEN 'Mock extraction used.' ELSE 'No value identified by mock extractor.' END AS notes, true AS requires_review"""
TAIL = ["page_number", "location_reference", "notes", "requires_review"]


def rule_rows(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    docs = v.invoices(spark, sf_dir).select("doc_id", "text")
    return ex.rule_extract(docs, INVOICE).filter(F.col("field_name") == field)


@query("d01_rule_currency", f"""
SELECT doc_id, hit AS extracted_value, CAST(replace(num, ',', '') AS DOUBLE) AS amount, 'USD' AS currency, hit AS display_value,
  0.72::DOUBLE AS confidence, hit AS source_text, {TAIL_SQL}
FROM (SELECT doc_id, trim(regexp_extract(text, '{MONEY_RE}', 0)) AS hit, regexp_extract(text, '{MONEY_RE}', 1) AS num FROM v_invoices)""")
def rule_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(spark, sf_dir, "total_amount").select(
        "doc_id", "extracted_value", "normalized_value.amount", "normalized_value.currency", "normalized_value.display_value",
        "confidence", "source_text", *TAIL)


@query("d02_rule_date", f"""
SELECT doc_id, nullif(hit, '') AS extracted_value, nullif(hit, '') AS date_text, CASE WHEN hit <> '' THEN 0.7 ELSE 0.35 END::DOUBLE AS confidence, {TAIL_SQL}
FROM (SELECT doc_id, regexp_extract(text, '{DATE_RE}', 1) AS hit FROM v_invoices)""")
def rule_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(spark, sf_dir, "order_date").select(
        "doc_id", "extracted_value", F.col("normalized_value.text").alias("date_text"), "confidence", *TAIL)


@query("d03_rule_boolean", """
SELECT doc_id, CASE WHEN found THEN 'true' END AS extracted_value, CASE WHEN found THEN true END AS flag,
  CASE WHEN found THEN 0.6 ELSE 0.35 END::DOUBLE AS confidence, CASE WHEN found THEN 'household' ELSE '' END AS source_text
FROM (SELECT doc_id, contains(lower(text), 'household') AS found FROM v_invoices)""")
def rule_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = Template("Flags", "1", "invoice", (FieldDef("household", "Household", "boolean"),))
    found = ex.rule_extract(v.invoices(spark, sf_dir).select("doc_id", "text"), template)
    return found.select("doc_id", "extracted_value", F.col("normalized_value.flag").alias("flag"), "confidence", "source_text")


@query("d04_rule_number", f"""
SELECT doc_id, hit AS extracted_value, CAST(hit AS DOUBLE) AS number, 0.65::DOUBLE AS confidence, {TAIL_SQL}
FROM (SELECT doc_id, regexp_extract(text, '{NUMBER_RE}', 1) AS hit FROM v_invoices)""")
def rule_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(spark, sf_dir, "item_count").select(
        "doc_id", "extracted_value", F.col("normalized_value.number").alias("number"), "confidence", *TAIL)


@query("d05_rule_snippet", """
SELECT doc_id, trim(substring(text, 1, 240)) AS extracted_value, trim(substring(text, 1, 240)) AS snippet, 0.58::DOUBLE AS confidence
FROM v_invoices""")
def rule_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(spark, sf_dir, "vendor_name").select(
        "doc_id", "extracted_value", F.col("normalized_value.text").alias("snippet"), "confidence")


@query("d05b_rule_tail", """
SELECT doc_id, NULL::VARCHAR AS extracted_value, 0.35::DOUBLE AS confidence, '' AS source_text, NULL::INTEGER AS page_number,
  '' AS location_reference, 'No value identified by mock extractor.' AS notes, true AS requires_review FROM v_invoices""")
def rule_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(spark, sf_dir, "ship_mode").select("doc_id", "extracted_value", "confidence", "source_text", *TAIL)


# ---- model replies and annotations --------------------------------------------------------------
@query("d06_parse_extraction_responses", f"""
SELECT request_id, seq, CASE WHEN k >= 3 THEN CASE seq WHEN 0 THEN 'total_amount' ELSE 'status' END END AS field_name,
  CASE WHEN k >= 3 THEN CASE seq WHEN 0 THEN CAST(o_totalprice AS VARCHAR) ELSE o_orderstatus END END AS extracted_value,
  CASE WHEN k >= 3 AND seq = 0 THEN o_totalprice END AS amount, CASE WHEN k >= 3 AND seq = 0 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence,
  CASE k WHEN 0 THEN '{ex.NO_CONTENT}' WHEN 1 THEN '{ex.NOT_JSON}' WHEN 2 THEN '{ex.NO_FIELD_LIST}' END AS error
FROM (SELECT o_orderkey AS request_id, o_orderkey % 6 AS k, o_totalprice, o_orderstatus, unnest([0, 1]::BIGINT[]) AS seq FROM orders)
WHERE k >= 3 OR seq = 0""")
def parse_extraction_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = v.table(spark, sf_dir, "orders")
    price, k = F.col("o_totalprice"), F.col("o_orderkey") % 6
    fields = F.array(
        F.struct(F.lit("total_amount").alias("field_name"), price.cast("string").alias("extracted_value"),
                 F.struct(price.alias("amount"), F.lit("USD").alias("currency")).alias("normalized_value"),
                 F.lit(0.9).alias("confidence_score")),
        F.struct(F.lit("status").alias("field_name"), F.col("o_orderstatus").alias("extracted_value"),
                 F.lit(None).cast("struct<amount:double,currency:string>").alias("normalized_value"),
                 F.lit(None).cast("double").alias("confidence_score")))
    body = F.to_json(F.struct(fields.alias("extracted_fields")))

    def reply(content: Column) -> Column:
        message = F.struct(F.struct(content.alias("content")).alias("message"))
        return F.to_json(F.struct(F.array(message).alias("choices")))

    as_object = F.concat(F.lit('{"choices":[{"message":{"content":'), body, F.lit("}}]}"))
    response = (F.when(k == 0, "{}").when(k == 1, reply(F.lit("oops"))).when(k == 2, reply(F.lit('{"a":1}')))
                .when(k == 3, as_object).otherwise(reply(body)))
    parsed = ex.parse_extraction_responses(orders.select(F.col("o_orderkey").alias("request_id"), response.alias("response")))
    amount = F.get_json_object("normalized_json", "$.amount").cast("double")
    return parsed.select("request_id", "seq", "field_name", "extracted_value", amount.alias("amount"), "confidence", "error")


def invoice_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.invoices(spark, sf_dir)
    key, kind = F.col("doc_id"), F.col("doc_id") % 4
    seg = F.length(F.regexp_extract("text", r"Vendor Name: (\w+)", 1))
    shown = F.regexp_extract("text", r"\$[\d,.]+", 0)
    at = 13 + seg + 12
    span = (F.when(kind == 0, F.struct(F.lit(13).alias("s"), (13 + seg).alias("e")))
            .when(kind == 1, F.struct(at.alias("s"), (at + F.length(shown)).alias("e")))
            .when(kind == 2, F.struct((14 + seg).alias("s"), (19 + seg).alias("e")))
            .when(key % 8 == 7, F.struct(F.lit(9).alias("s"), F.lit(3).alias("e"))))
    text = (F.when(kind == 0, F.regexp_extract("text", r"Vendor Name: (\w+)", 1)).when(kind == 2, "Total ").otherwise(shown))
    return docs.select(
        "doc_id", F.when(kind == 0, "vendor_name").when(kind == 2, "mystery").otherwise("total_amount").alias("extraction_class"),
        F.lit(0).alias("seq"), text.alias("extraction_text"), span["s"].alias("char_start"), span["e"].alias("char_end"),
        F.when(key % 3 == 0, F.create_map(F.lit("currency"), F.lit("EUR"))).alias("attributes"))


def invoice_defs(spark: SparkSession) -> DataFrame:
    rows = [(f.name, f.label, f.type, f.rules.currency) for f in INVOICE.fields]
    return spark.createDataFrame(rows, "field_name string, label string, data_type string, currency string")


@query("d07_ground_annotations", """
WITH a AS (SELECT doc_id, text, k, seg, shown, doc_id % 3 = 0 AS eur,
  CASE k WHEN 0 THEN 13 WHEN 1 THEN 25 + length(seg) WHEN 2 THEN 14 + length(seg) END AS s,
  CASE k WHEN 0 THEN 13 + length(seg) WHEN 1 THEN 25 + length(seg) + length(shown) WHEN 2 THEN 19 + length(seg) END AS e
  FROM (SELECT doc_id, text, doc_id % 4 AS k, tenant_id AS seg, '$' || format('{:,.2f}', o_totalprice) AS shown FROM v_invoices))
SELECT doc_id, CASE k WHEN 0 THEN 'vendor_name' WHEN 2 THEN 'mystery' ELSE 'total_amount' END AS field_name,
  CASE k WHEN 0 THEN 'Vendor Name' WHEN 2 THEN 'mystery' ELSE 'Total Amount' END AS label,
  CASE WHEN k IN (1, 3) THEN 'currency' ELSE 'text' END AS data_type,
  CASE k WHEN 0 THEN seg WHEN 2 THEN 'Total' ELSE shown END AS extracted_value,
  CASE WHEN k IN (1, 3) THEN CAST(replace(substring(shown, 2), ',', '') AS DOUBLE) END AS amount,
  CASE WHEN k IN (1, 3) THEN CASE WHEN eur THEN 'EUR' ELSE 'USD' END END AS currency,
  CASE k WHEN 0 THEN seg WHEN 2 THEN 'Total' END AS text_value,
  CASE WHEN s IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence, coalesce(substring(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), '') AS source_text,
  CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end, '' AS location_reference,
  CASE WHEN s IS NULL THEN 'LangExtract returned an ungrounded extraction.' ELSE 'LangExtract grounded chars ' || s || '-' || e || '.' END AS notes,
  s IS NULL AS requires_review FROM a""")
def ground_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ex.ground_annotations(invoice_annotations(spark, sf_dir), v.invoices(spark, sf_dir), invoice_defs(spark))
    return found.select(
        "doc_id", "field_name", "label", "data_type", "extracted_value", "normalized_value.amount", "normalized_value.currency",
        F.col("normalized_value.text").alias("text_value"), "confidence", "source_text", "char_start", "char_end",
        "location_reference", "notes", "requires_review")


RAW_VALUES = ("yes", "N", "maybe", " TRUE ")


@query("d08_normalize_value", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber WHEN 1 THEN 'Part ' || l_partkey WHEN 7 THEN l_partkey || ' kg'
    WHEN 2 THEN CASE WHEN l_partkey % 4 = 3 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END END AS text,
  CASE l_linenumber WHEN 2 THEN CASE l_partkey % 4 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%m/%d/%Y')
      WHEN 2 THEN strftime(l_shipdate, '%b %-d, %Y') ELSE 'soon' END
    WHEN 4 THEN '-$' || format('{:,.2f}', l_extendedprice) END AS display_value,
  CASE l_linenumber WHEN 3 THEN CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE -l_quantity END END AS number,
  CASE l_linenumber WHEN 4 THEN l_extendedprice END AS amount, CASE l_linenumber WHEN 4 THEN 'USD' END AS currency,
  CASE l_linenumber WHEN 5 THEN CASE l_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END END AS flag,
  CASE l_linenumber WHEN 6 THEN 'a|' || l_partkey || '|c' END AS items FROM lineitem""")
def normalize_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    ship = F.col("l_shipdate")
    date_text = (F.when(part % 4 == 0, F.date_format(ship, "yyyy-MM-dd")).when(part % 4 == 1, F.date_format(ship, "MM/dd/yyyy"))
                 .when(part % 4 == 2, F.date_format(ship, "MMM d, yyyy")).otherwise("soon"))
    raw = (
        F.when(n == 1, F.concat(F.lit(" Part "), part.cast("string"), F.lit(" ")))
        .when(n == 2, date_text)
        .when(n == 3, F.when(part % 2 == 0, "1,200 pcs").otherwise(F.concat((-F.col("l_quantity")).cast("string"), F.lit(" kg"))))
        .when(n == 4, F.concat(F.lit("-$"), fv.tx.fixed_decimals(F.col("l_extendedprice"), 2, grouped=True)))
        .when(n == 5, v.choose(part % 4, RAW_VALUES))
        .when(n == 6, F.concat(F.lit("a, "), part.cast("string"), F.lit(",, c ")))
        .otherwise(F.concat(part.cast("string"), F.lit(" kg"))))
    kinds = ("", "text", "date", "number", "currency", "boolean", "multi_select", "unit_value")
    value = fv.normalize_value(v.choose(n, kinds), raw, F.lit(None).cast("map<string,string>"), F.lit(None).cast("string"))
    df = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("x"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x.text", "x.display_value", "x.number", "x.amount",
                     "x.currency", "x.flag", joined(F.col("x.items")).alias("items"))


@query("d09_extract_with", """
SELECT doc_id, 'total_amount' AS field_name, 0::BIGINT AS seq, '$' || format('{:,.2f}', o_totalprice) AS extracted_value, 0.8::DOUBLE AS confidence
FROM v_invoices""")
def extract_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = re.compile(r"\$[\d,.]+")

    def extractor(text: str) -> list[dict]:
        hit = pattern.search(text)
        return [{"field_name": "total_amount", "extracted_value": hit.group(0), "confidence": 0.8}] if hit else []

    return ex.extract_with(v.invoices(spark, sf_dir), extractor).select("doc_id", "field_name", "seq", "extracted_value", "confidence")


@query("d09_extract_batches", """
SELECT doc_id, CASE WHEN NOT bad THEN 'total_amount' END AS field_name, CASE WHEN NOT bad THEN 0 END::BIGINT AS seq, CASE WHEN NOT bad THEN '$' || format('{:,.2f}', o_totalprice) END AS extracted_value,
  CASE WHEN NOT bad THEN 0.8 END::DOUBLE AS confidence, CASE WHEN bad THEN 'ValueError: no amount' END AS error FROM (SELECT *, doc_id % 500 = 0 AS bad FROM v_invoices)""")
def extract_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of a batch, which fails on some of its texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def extractor(texts: pa.Array) -> pa.RecordBatch:
        amounts = pc.struct_field(pc.extract_regex(texts, r"(?P<amount>\$[\d,.]+)"), "amount")
        if amounts.null_count:
            raise ValueError("no amount")
        rows = pa.array(range(len(texts)))
        return pa.RecordBatch.from_pydict({"row": rows, "field_name": pa.array(["total_amount"] * len(texts)), "extracted_value": amounts, "confidence": pa.array([0.8] * len(texts))})

    docs = v.invoices(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 500 == 0, "none").otherwise(F.col("text")).alias("text"))
    return ex.extract_batches(docs, extractor).select("doc_id", "field_name", "seq", "extracted_value", "confidence", "error")


# ---- reconcile and validate ---------------------------------------------------------------------
RECON_SQL = f"""
WITH defs(field_name, field_no, req, nn, cit) AS (VALUES ('field_1', 0, true, false, true), ('field_2', 1, false, true, false),
  ('field_3', 2, false, false, false), ('field_4', 3, true, true, true), ('field_5', 4, false, false, false), ('field_9', 5, true, true, true)),
base AS (SELECT o.o_orderkey AS result_id, d.field_name, d.field_no, b.amount, b.extracted_value, coalesce(b.confidence, 0.0) AS confidence,
    coalesce(b.source_text, '') AS source_text, coalesce(b.n_candidates, 0) AS n, coalesce(b.requires_review, true) AS base_review,
    CASE WHEN b.result_id IS NULL THEN '{rc.MISSING_FIELD_NOTE}' WHEN b.n_candidates > 1
      THEN b.notes || ' Selected highest-confidence match from ' || b.n_candidates || ' chunk candidates.' ELSE b.notes END AS base_notes,
    list_filter([CASE WHEN req AND amount IS NULL THEN '{rc.REQUIRED_MISSING}' END, CASE WHEN nn AND amount IS NULL THEN '{rc.NULL_NOT_ALLOWED}' END,
      CASE WHEN d.field_name = 'field_1' AND NOT regexp_matches(extracted_value, '^(?:[1-4]\\d*\\.\\d)') THEN '{rc.PATTERN_MISMATCH}' END,
      CASE WHEN d.field_name = 'field_1' AND length(extracted_value) > 7 THEN '{rc.TOO_LONG}' END,
      CASE WHEN cit AND coalesce(source_text, '') = '' THEN '{rc.CITATION_MISSING}' END], lambda x: x IS NOT NULL) AS errors
  FROM orders o CROSS JOIN defs d LEFT JOIN v_best b ON b.result_id = o.o_orderkey AND b.field_name = d.field_name),
recon AS (SELECT *, amount IS NOT NULL AND confidence < 0.75 AS low,
    base_review OR n > 1 OR len(errors) > 0 OR (amount IS NOT NULL AND confidence < 0.75) AS requires_review,
    base_notes || CASE WHEN amount IS NOT NULL AND confidence < 0.75
      THEN ' Confidence ' || printf('%.2f', confidence) || ' is below the 0.75 review threshold.' ELSE '' END AS notes,
    CASE WHEN len(errors) > 0 THEN 'invalid' ELSE 'valid' END AS validation_status FROM base)
"""


def reconciled_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rc.reconcile_wide(v.candidates(spark, sf_dir), v.result_ids(spark, sf_dir), LINES, RESULT_KEYS)
    return rc.validate_wide(wide, LINES)


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.reconcile(v.candidates(spark, sf_dir), v.result_ids(spark, sf_dir), LINES, RESULT_KEYS)


@query("e01_unexpected_fields", """
SELECT result_id, field_name, count(*) AS n_candidates, 'Provider returned unexpected field ''' || field_name || '''.' AS note
FROM v_candidates WHERE l_linenumber > 5 GROUP BY 1, 2""")
def unexpected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.unexpected_fields(v.candidates(spark, sf_dir), LINES, RESULT_KEYS)


@query("e02_best_candidate", "SELECT result_id, field_name, amount, confidence, source_text, extracted_value FROM v_best")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.best_candidates(v.candidates(spark, sf_dir), RESULT_KEYS).select(
        "result_id", "field_name", "normalized_value.amount", "confidence", "source_text", "extracted_value")


@query("e03_multi_candidate_flag", """
SELECT result_id, field_name, CAST(n_candidates AS INTEGER) AS n_candidates, requires_review OR n_candidates > 1 AS requires_review,
  notes || CASE WHEN n_candidates > 1 THEN ' Selected highest-confidence match from ' || n_candidates || ' chunk candidates.' ELSE '' END AS notes
FROM v_best""")
def multi_candidate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.best_candidates(v.candidates(spark, sf_dir), RESULT_KEYS).select(
        "result_id", "field_name", "n_candidates", "requires_review", "notes")


@query("e04_fill_missing_fields", RECON_SQL + "SELECT result_id, field_name, CAST(n AS INTEGER) AS n_candidates, amount, confidence, base_notes AS notes FROM recon")
def fill_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rc.reconcile_wide(v.candidates(spark, sf_dir), v.result_ids(spark, sf_dir), LINES, RESULT_KEYS)
    rows = [F.struct(F.lit(n).alias("field_name"), F.col(n)["n_candidates"].alias("n_candidates"),
                     F.col(n)["normalized_value"]["amount"].alias("amount"), F.col(n)["confidence"].alias("confidence"),
                     F.col(n)["notes"].alias("notes")) for n in LINES.field_names]
    return wide.select("result_id", F.inline(F.array(*rows)))


def _errors(name: str, messages: tuple[str, ...]) -> None:
    wanted = ", ".join(f"'{m}'" for m in messages)

    @query(name, RECON_SQL + f"""SELECT result_id, field_name, array_to_string(list_filter(errors, lambda e: e IN ({wanted})), '|') AS errors
FROM recon WHERE len(list_filter(errors, lambda e: e IN ({wanted}))) > 0""")
    def errors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
        mine = F.filter("validation_errors", lambda e: e.isin(*messages))
        return reconciled(spark, sf_dir).withColumn("mine", mine).filter(F.size("mine") > 0).select(
            "result_id", "field_name", joined(F.col("mine")).alias("errors"))


_errors("e05_required_null_checks", (rc.REQUIRED_MISSING, rc.NULL_NOT_ALLOWED))
_errors("e08_regex_rule", (rc.PATTERN_MISMATCH,))
_errors("e09_max_length_rule", (rc.TOO_LONG,))
_errors("e11_citation_rule", (rc.CITATION_MISSING,))


TERMS = ("Net 30", "Net 60", "Due on receipt")
TERM_INPUTS = ("Net 30", "net30", "Net-60.", "Net 3O", "Due on recipt", "cash", "due ON receipt")
TERMS_TEMPLATE = Template("Terms", "1", "invoice", (FieldDef("terms", "Terms", "category", citation_required=False, allowed_values=TERMS),),
                          review_low=False)
LIST_TEMPLATE = Template("Terms", "1", "invoice", (FieldDef("terms", "Terms", "multi_select", citation_required=False, allowed_values=TERMS),),
                         review_low=False)
TERMS_SQL = """
WITH allowed(a, rank) AS (VALUES ('Net 30', 0), ('Net 60', 1), ('Due on receipt', 2)),
raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  list_extract(['Net 30', 'net30', 'Net-60.', 'Net 3O', 'Due on recipt', 'cash', 'due ON receipt'], CAST((l_partkey + l_linenumber) % 7 + 1 AS BIGINT)) AS c FROM lineitem),
scored AS (SELECT c, a, rank, c = a AS same, lower(regexp_replace(c, '[^a-zA-Z0-9]', '', 'g')) = lower(regexp_replace(a, '[^a-zA-Z0-9]', '', 'g')) AS same_key,
  1 - levenshtein(c, a)::DOUBLE / greatest(length(c), length(a)) AS score FROM (SELECT DISTINCT c FROM raw) CROSS JOIN allowed),
mapped AS (SELECT c, bool_or(same) AS exact, min_by(a, rank) FILTER (WHERE same_key) AS by_key,
  first(a ORDER BY score DESC, rank) FILTER (WHERE score >= 0.85) AS by_score FROM scored GROUP BY c)
"""


def term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    raw = v.choose((part + F.col("l_linenumber")) % 7, TERM_INPUTS)
    return v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", raw.alias("c"))


@query("e06_e07_canonicalize_allowed", TERMS_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN exact THEN m.c ELSE coalesce(by_key, by_score, m.c) END AS value,
  CASE WHEN exact THEN 'Found.' WHEN by_key IS NOT NULL THEN 'Found. Canonicalized allowed value from ''' || m.c || ''' to ''' || by_key || ''' using normalized comparison.'
    WHEN by_score IS NOT NULL THEN 'Found. Canonicalized allowed value from ''' || m.c || ''' to ''' || by_score || ''' using guarded fuzzy matching.' ELSE 'Found.' END AS notes,
  NOT exact AS requires_review, CASE WHEN exact OR by_key IS NOT NULL OR by_score IS NOT NULL THEN '' ELSE 'Value is outside allowed values.' END AS errors
FROM raw JOIN mapped m ON m.c = raw.c""")
def canonicalize_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    wide = term_rows(spark, sf_dir).select(*keys, one_field(value_struct(text=F.col("c")), F.col("c")).alias("terms"))
    checked = rc.validate_wide(wide, TERMS_TEMPLATE)
    return checked.select(*keys, F.col("terms.normalized_value.text").alias("value"), "terms.notes", "terms.requires_review",
                          joined(F.col("terms.validation_errors")).alias("errors"))


@query("e06_canonicalize_lists", TERMS_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'Net 30|' || CASE WHEN exact THEN m.c ELSE coalesce(by_key, by_score, m.c) END AS items,
  NOT (exact OR (by_key IS NULL AND by_score IS NULL)) OR true AS requires_review, 'Value is outside allowed values.' AS errors
FROM raw JOIN mapped m ON m.c = raw.c""")
def canonicalize_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    items = F.array(F.lit("Net 30"), F.col("c"))
    wide = term_rows(spark, sf_dir).select(*keys, one_field(value_struct(items=items), F.col("c")).alias("terms"))
    checked = rc.validate_wide(wide, LIST_TEMPLATE)
    return checked.select(*keys, joined(F.col("terms.normalized_value.items")).alias("items"), "terms.requires_review",
                          joined(F.col("terms.validation_errors")).alias("errors"))


def one_field(value: Column, extracted: Column) -> Column:
    """A reconciled field built from a single value."""
    fixed = {"extracted_value": extracted, "normalized_value": value, "confidence": F.lit(0.9), "source_text": extracted,
             "location_reference": F.lit(""), "notes": F.lit("Found."), "requires_review": F.lit(False)}
    return F.struct(*[fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in rc.CANDIDATE_COLUMNS.items()],
                    F.lit(1).alias("n_candidates"))


CONTRACT = {"type": "object", "required": ["sku"], "properties": {"quantity": {"type": "number", "minimum": 10}}}
CONTRACT_TEMPLATE = Template("Lines", "1", "invoice", (FieldDef("line", "Line", "structured_object", citation_required=False, contract=CONTRACT),),
                             review_low=False)


@query("e10_struct_contract", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_linenumber
  WHEN 2 THEN 'Value does not satisfy schema: ''sku'' is a required property'
  WHEN 3 THEN 'Value does not satisfy schema at ''quantity'': "many" is not of type ''number'''
  WHEN 4 THEN 'Value does not satisfy schema: [1,2] is not of type ''object'''
  WHEN 5 THEN ''
  ELSE CASE WHEN l_quantity < 10 THEN 'Value does not satisfy schema at ''quantity'': ' || CAST(l_quantity AS BIGINT) || ' is less than the minimum of 10' ELSE '' END END AS errors
FROM lineitem""")
def struct_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    n, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("bigint").cast("string")
    body = (F.when(n == 2, F.concat(F.lit('{"quantity":'), F.lit("50}"))).when(n == 3, '{"sku":"a","quantity":"many"}').when(n == 4, "[1,2]")
            .when(n == 5, '{"value":{"sku":"b"}}').otherwise(F.concat(F.lit('{"sku":"c","quantity":'), quantity, F.lit("}"))))
    wide = v.table(spark, sf_dir, "lineitem").select(*keys, one_field(value_struct(object_json=body), body).alias("line"))
    checked = rc.validate_wide(wide, CONTRACT_TEMPLATE)
    return checked.select(*keys, joined(F.col("line.validation_errors")).alias("errors"))


@query("e12_low_confidence_rule", RECON_SQL + "SELECT result_id, field_name, confidence, notes FROM recon WHERE low")
def low_confidence_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir).filter(F.contains("notes", F.lit("review threshold"))).select(
        "result_id", "field_name", "confidence", "notes")


@query("e13_validation_status", RECON_SQL + """
SELECT result_id, field_no, field_name, validation_status, array_to_string(errors, '|') AS errors, requires_review, notes FROM recon""")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir).select(
        "result_id", "field_no", "field_name", "validation_status", joined(F.col("validation_errors")).alias("errors"), "requires_review", "notes")


CALC_SQL = RECON_SQL + f""",
wide AS (SELECT result_id, max(amount) FILTER (WHERE field_name = 'field_1') AS f1, max(amount) FILTER (WHERE field_name = 'field_2') AS f2,
  max(amount) FILTER (WHERE field_name = 'field_3') AS f3, max(amount) FILTER (WHERE field_name = 'field_5') AS f5,
  coalesce(string_agg(field_name, '|' ORDER BY field_no) FILTER (WHERE requires_review), '') AS flagged FROM recon GROUP BY result_id),
raw AS (SELECT *, round(CAST(CAST(f1 + f2 AS VARCHAR) AS DECIMAL(38, 16)), 2)::DOUBLE AS first_two,
  CASE WHEN floor(f5 / 50000) <> 0 THEN f3 / floor(f5 / 50000) END AS share, f3 IS NULL OR f5 IS NULL AS lost FROM wide),
calc AS (
  SELECT result_id, 6 AS field_no, 'first_two' AS field_name, first_two AS value, first_two AS amount,
    list_filter([CASE WHEN first_two IS NULL THEN '{ca.INPUT_MISSING[0]}' END, CASE WHEN first_two > 100000 THEN '{ca.ABOVE_MAXIMUM}' END], lambda x: x IS NOT NULL) AS errors,
    '{ca.BASE_NOTE}' AS calculation_notes FROM raw
  UNION ALL SELECT result_id, 7, 'share', share, NULL,
    list_filter([CASE WHEN share IS NULL AND NOT lost THEN '{ca.DIVIDED_BY_ZERO[0]}' END], lambda x: x IS NOT NULL),
    '{ca.BASE_NOTE}' || CASE WHEN lost THEN ' {ca.INPUT_MISSING[1]}' ELSE '' END FROM raw
  UNION ALL SELECT result_id, 8, 'quiet', share, NULL, list_filter([CASE WHEN share < 5000 THEN '{ca.BELOW_MINIMUM}' END], lambda x: x IS NOT NULL),
    '{ca.BASE_NOTE}' || CASE WHEN lost THEN ' {ca.INPUT_MISSING[1]}' WHEN share IS NULL THEN ' {ca.DIVIDED_BY_ZERO[1]}' ELSE '' END FROM raw)
"""


def calculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.calculated_fields(reconciled_wide(spark, sf_dir), LINES, RESULT_KEYS)


@query("e14_fields_requiring_review", CALC_SQL + """
SELECT w.result_id, CASE WHEN flagged = '' THEN coalesce(c, '') WHEN c IS NULL THEN flagged ELSE flagged || '|' || c END AS fields
FROM wide w LEFT JOIN (SELECT result_id, string_agg(field_name, '|' ORDER BY field_no) AS c FROM calc WHERE len(errors) > 0 GROUP BY 1) k ON k.result_id = w.result_id""")
def fields_requiring_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = ca.all_fields_long(calculated(spark, sf_dir), LINES, RESULT_KEYS)
    return rc.fields_requiring_review(every, RESULT_KEYS).select("result_id", joined(F.col("fields_requiring_review")).alias("fields"))


@query("e15_result_envelope", CALC_SQL + """
SELECT w.result_id, 'statement' AS document_type, 'Order Lines' AS template_name, '2.0.0' AS template_version, 'completed' AS extraction_status,
  6 AS n_extracted, 3 AS n_calculated, (SELECT string_agg(r.field_name || '=' || r.validation_status, '|' ORDER BY r.field_no) FROM recon r WHERE r.result_id = w.result_id) AS statuses,
  CASE WHEN flagged = '' THEN coalesce(c, '') WHEN c IS NULL THEN flagged ELSE flagged || '|' || c END AS fields
FROM wide w LEFT JOIN (SELECT result_id, string_agg(field_name, '|' ORDER BY field_no) AS c FROM calc WHERE len(errors) > 0 GROUP BY 1) k ON k.result_id = w.result_id""")
def result_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    envelope = ca.result_envelope(calculated(spark, sf_dir), LINES, RESULT_KEYS)
    status = F.transform("extracted_fields", lambda f: F.concat(f["field_name"], F.lit("="), f["validation_status"]))
    return envelope.select(
        "result_id", "document_type", "template_name", "template_version", "extraction_status",
        F.size("extracted_fields").alias("n_extracted"), F.size("calculated_fields").alias("n_calculated"),
        joined(status).alias("statuses"), joined(F.col("fields_requiring_review")).alias("fields"))


@query("e16_review_signals", CALC_SQL + f"""
SELECT r.result_id, CAST(sum(CASE WHEN low THEN 1 ELSE 0 END) AS BIGINT) AS low_confidence_review_count,
  CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_candidate_review_count,
  CAST(sum(CASE WHEN list_contains(errors, '{rc.CITATION_MISSING}') THEN 1 ELSE 0 END) AS BIGINT) AS citation_gap_count,
  CAST(sum(CASE WHEN len(errors) > 0 THEN 1 ELSE 0 END) + any_value(k.c) AS BIGINT) AS validation_error_count
FROM recon r JOIN (SELECT result_id, count(*) FILTER (WHERE len(errors) > 0) AS c FROM calc GROUP BY 1) k ON k.result_id = r.result_id GROUP BY 1""")
def review_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = calculated(spark, sf_dir)
    return rc.review_signals(rc.long_form(wide, LINES, RESULT_KEYS), ca.calculated_long(wide, LINES, RESULT_KEYS), RESULT_KEYS)


DRY_RUN_SQL = """
WITH d AS (SELECT *, regexp_extract(text, '\\b(20\\d{2}-\\d{2}-\\d{2})\\b', 1) <> '' AS dated FROM v_invoices)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN false ELSE dated END AS ok,
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'vendor_name|total_amount|order_date|total_due|item_count|ship_mode' || CASE WHEN dated THEN '' ELSE '|days_open' END END AS fields,
  CASE WHEN doc_id % 10 = 0 THEN 'Sample text is required for a dry run.' ELSE '' END AS schema_errors FROM d"""


@query("e17_schema_dry_run", DRY_RUN_SQL)
def schema_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.invoices(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 10 == 0, " \n ").otherwise(F.col("text")).alias("text"))
    return plans.schema_dry_run(docs, INVOICE).select(
        "doc_id", "ok", joined(F.col("fields_requiring_review")).alias("fields"), joined(F.col("schema_errors")).alias("schema_errors"))


ENTRY_SQL = """
WITH d AS (SELECT *, regexp_extract(text, '\\b(20\\d{2}-\\d{2}-\\d{2})\\b', 1) <> '' AS dated FROM v_invoices)
SELECT tenant_id, doc_id, o_totalprice AS total_amount, round(CAST(CAST(o_totalprice * 1.10::DOUBLE AS VARCHAR) AS DECIMAL(38, 16)), 2)::DOUBLE AS amount_with_buffer,
  'vendor_name|total_amount|order_date|total_due|item_count|ship_mode' || CASE WHEN dated THEN '' ELSE '|days_open' END AS fields_requiring_review,
  CASE WHEN dated THEN '' ELSE 'Citation evidence is required.' END AS date_errors, true AS needs_review FROM d"""


@query("entry_review_queue", ENTRY_SQL)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("tenant_id", "doc_id")
    queue = plans.review_queue(v.invoices(spark, sf_dir), INVOICE, keys)
    amount = F.get_json_object(F.get("extracted_fields", F.lit(1))["normalized_value"], "$.amount").cast("double")
    buffer = F.filter("calculated_fields", lambda f: f["field_name"] == "amount_with_buffer")
    return queue.select(
        *keys, amount.alias("total_amount"),
        F.get_json_object(F.get(buffer, F.lit(0))["calculated_value"], "$.amount").cast("double").alias("amount_with_buffer"),
        joined(F.col("fields_requiring_review")).alias("fields_requiring_review"),
        joined(F.get("extracted_fields", F.lit(2))["validation_errors"]).alias("date_errors"), "needs_review")


# ---- calculated fields --------------------------------------------------------------------------
@query("f01_calculated_fields", CALC_SQL + "SELECT result_id, field_name, value FROM calc")
def calculated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.calculated_long(calculated(spark, sf_dir), LINES, RESULT_KEYS).select(
        "result_id", "field_name", F.col("value_text").cast("double").alias("value"))


@query("f02_error_policy", CALC_SQL + f"""
SELECT result_id, field_name, array_to_string(list_filter(errors, lambda e: e IN ('{ca.INPUT_MISSING[0]}', '{ca.DIVIDED_BY_ZERO[0]}')), '|') AS errors, calculation_notes
FROM calc WHERE value IS NULL""")
def error_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = F.filter("validation_errors", lambda e: e.isin(ca.INPUT_MISSING[0], ca.DIVIDED_BY_ZERO[0]))
    return ca.calculated_long(calculated(spark, sf_dir), LINES, RESULT_KEYS).filter("value_text IS NULL").select(
        "result_id", "field_name", joined(policy).alias("errors"), "calculation_notes")


@query("f03_currency_shaping", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(CAST(l_extendedprice * 1.1::DOUBLE AS VARCHAR) AS DECIMAL(38, 16)), 2)::DOUBLE AS amount, 'EUR' AS currency,
  'EUR ' || format('{:,.2f}', round(CAST(CAST(l_extendedprice * 1.1::DOUBLE AS VARCHAR) AS DECIMAL(38, 16)), 2)::DOUBLE) AS display_value FROM lineitem""")
def currency_shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = ca.shape_currency(F.col("l_extendedprice") * 1.1, "EUR")
    return v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shaped.alias("x")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x.amount", "x.currency",
        fx.format_currency(F.col("x.amount"), "EUR").alias("display_value"))


@query("f04_calc_validation", CALC_SQL + f"""
SELECT result_id, field_name, CASE WHEN len(errors) > 0 THEN 'invalid' ELSE 'valid' END AS validation_status, array_to_string(errors, '|') AS errors,
  len(errors) > 0 AS requires_review FROM calc""")
def calc_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.calculated_long(calculated(spark, sf_dir), LINES, RESULT_KEYS).select(
        "result_id", "field_name", "validation_status", joined(F.col("validation_errors")).alias("errors"), "requires_review")


@query("f05_calculated_long", CALC_SQL + """
SELECT result_id, field_no, field_name, CASE field_name WHEN 'first_two' THEN 'currency' ELSE 'number' END AS output_type,
  CASE field_name WHEN 'first_two' THEN 'field_1.amount + field_2.amount' ELSE 'field_3.amount / floor(field_5.amount / 50000)' END AS formula,
  CASE field_name WHEN 'first_two' THEN 'field_1|field_2' ELSE 'field_3|field_5' END AS depends_on,
  CASE field_name WHEN 'first_two' THEN coalesce('USD ' || format('{:,.2f}', amount), '') END AS display_value, calculation_notes FROM calc""")
def calculated_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("field_name") == "first_two", F.col("display_value"))
    return ca.calculated_long(calculated(spark, sf_dir), LINES, RESULT_KEYS).select(
        "result_id", "field_no", "field_name", "output_type", "formula", joined(F.col("depends_on")).alias("depends_on"),
        shown.alias("display_value"), "calculation_notes")


HELPERS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity + l_extendedprice + l_tax END AS sum_of,
  CASE WHEN l_linenumber = 3 THEN (l_quantity + l_extendedprice) / 2 ELSE (l_quantity + l_extendedprice + l_tax) / 3 END AS avg_of,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE least(l_quantity, l_extendedprice, l_tax) END AS min_of,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE greatest(l_quantity, l_extendedprice, l_tax) END AS max_of,
  3 AS count_of, round_even(l_quantity / 2, 0) AS rounded,
  CAST((2001 - year(l_shipdate)) * 12 + 6 - month(l_shipdate) AS INTEGER) AS months,
  CAST(date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-06-15') AS INTEGER) AS days,
  CAST(floor(((2001 - year(l_shipdate)) * 12 + 6 - month(l_shipdate)) / 12) AS INTEGER) AS years,
  l_returnflag IN ('A', 'R') AS contained, CASE l_returnflag WHEN 'A' THEN 'alpha' WHEN 'N' THEN NULL ELSE 'other' END AS looked_up,
  l_quantity * 1.0::DOUBLE / 30.0::DOUBLE AS in_months, 'USD ' || format('{:,.2f}', l_extendedprice) AS currency_text,
  printf('%.2f%%', l_discount * 12.5::DOUBLE) AS percent_text, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS chosen,
  -l_quantity - 7 * floor(-l_quantity / 7) AS modulo
FROM lineitem"""
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query("f06_formula_helpers", HELPERS_SQL)
def formula_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity, price, ship = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_shipdate").cast("date")
    xs = F.array(quantity, price, F.when(F.col("l_linenumber") != 3, F.col("l_tax")))
    end = F.lit("2001-06-15").cast("date")
    names = F.create_map(F.lit("A"), F.lit("alpha"), F.lit("N"), F.lit(None).cast("string"))
    flag = F.col("l_returnflag")
    return v.table(spark, sf_dir, "lineitem").select(
        *LINE_KEYS, fx.list_sum(xs).alias("sum_of"), fx.list_avg(xs).alias("avg_of"), fx.list_min(xs).alias("min_of"),
        fx.list_max(xs).alias("max_of"), fx.count_items(xs).alias("count_of"), fx.round_half_even(quantity / 2).alias("rounded"),
        fx.months_between(ship, end).alias("months"), fx.days_between(ship, end).alias("days"), fx.years_between(ship, end).alias("years"),
        fx.list_contains(F.array(F.lit("A"), F.lit("R")), flag).alias("contained"), fx.lookup(names, flag, F.lit("other")).alias("looked_up"),
        fx.convert_unit(quantity, "days", "months").alias("in_months"), fx.format_currency(price).alias("currency_text"),
        fx.format_percent(F.col("l_discount") * 12.5).alias("percent_text"), fx.iff(quantity > 25, F.lit(1.0), F.lit(0.0)).alias("chosen"),
        fx.modulo(-quantity, F.lit(7.0)).alias("modulo"))


@query("f07_formula_sql_functions", HELPERS_SQL)
def formula_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.register_formula_functions(spark)
    xs = "array(l_quantity, l_extendedprice, if(l_linenumber = 3, NULL, l_tax))"
    ship, end = "CAST(l_shipdate AS DATE)", "DATE'2001-06-15'"
    return v.table(spark, sf_dir, "lineitem").selectExpr(
        *LINE_KEYS, f"calc_sum({xs}) AS sum_of", f"calc_avg({xs}) AS avg_of", f"calc_min({xs}) AS min_of", f"calc_max({xs}) AS max_of",
        f"calc_count(CAST({xs} AS ARRAY<STRING>)) AS count_of", "calc_round(l_quantity / 2) AS rounded",
        f"calc_months_between({ship}, {end}) AS months", f"days_between({ship}, {end}) AS days", f"years_between({ship}, {end}) AS years",
        "calc_contains(array('A', 'R'), l_returnflag) AS contained",
        "lookup(map('A', 'alpha', 'N', NULL), l_returnflag, 'other') AS looked_up",
        "convert_unit(l_quantity, 'days', 'months') AS in_months", "format_currency(l_extendedprice) AS currency_text",
        "format_percent(l_discount * 12.5D) AS percent_text", "iff(l_quantity > 25, 1D, 0D) AS chosen", "calc_mod(-l_quantity, 7D) AS modulo")
