"""Extraction, reconciliation, validation, calculated fields: the documented examples."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docweft.functions import formulas as fx
from docweft.operators import calculate as ca, extract as ex, reconcile as rc
from docweft.plans.dry_run import extract_documents, schema_dry_run
from docweft.schema import CANDIDATE_DDL, NULL_ON_ERROR, CalcDef, FieldDef, Rules, Template, value_struct

VENDOR = FieldDef("vendor_name", "Vendor Name", "text", required=True, rules=Rules(allow_null=False))
AMOUNT = FieldDef("total_amount", "Total Amount", "currency", required=True, citation_required=False)
BUFFER = CalcDef("amount_with_buffer", "Buffer", "currency", "coalesce(total_amount.amount, 0) * 1.10", ("total_amount",))


def template(*fields, calcs=(), **options):
    return Template("Invoice Extraction", "1.0.0", "invoice", tuple(fields), tuple(calcs), **options)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def candidates(spark, *rows):
    """Rows of (field, seq, text value, confidence, source)."""
    raw = spark.createDataFrame([(0, *r) for r in rows], "doc_id int, field_name string, seq bigint, v string, confidence double, source_text string")
    columns = [part.strip().split(" ")[0] for part in CANDIDATE_DDL.split(", ")]
    full = raw.withColumns({
        "extracted_value": F.col("v"), "normalized_value": F.when(F.col("v").isNotNull(), value_struct(text=F.col("v"))),
        "char_start": F.lit(None).cast("int"), "char_end": F.lit(None).cast("int"), "page_number": F.lit(None).cast("int"),
        "location_reference": F.lit(""), "notes": F.lit(""), "requires_review": F.lit(False)})
    return full.select("doc_id", *columns)


def results(spark, tpl, *rows):
    found = rc.reconcile(candidates(spark, *rows), docs(spark, "x"), tpl).collect()
    return {r.field_name: r for r in found}


def wide_amount(spark, amount, *calcs):
    value = value_struct(amount=F.lit(amount).cast("double"), currency=F.lit("USD")) if amount is not None else F.lit(None)
    tpl = template(AMOUNT, calcs=calcs)
    result = F.struct(*[{"normalized_value": value}.get(c, F.lit(None)).cast(t).alias(c) for c, t in rc.CANDIDATE_COLUMNS.items()],
                      F.lit(1).alias("n_candidates"))
    checked = rc.validate_wide(docs(spark, "x").select("doc_id", result.alias("total_amount")), tpl)
    rows = ca.calculated_long(ca.calculated_fields(checked, tpl), tpl).collect()
    return {r.field_name: r for r in rows}


def test_best_candidate_and_chunk_note(spark):
    got = results(spark, template(VENDOR), ("vendor_name", 1, "A", 0.82, "A"), ("vendor_name", 2, "B", 0.94, "B"))["vendor_name"]
    assert got.normalized_value.text == "B" and got.requires_review
    assert got.notes == "Selected highest-confidence match from 2 chunk candidates."


def test_evidence_beats_confidence_and_ties_go_to_the_first(spark):
    tpl = template(VENDOR)
    cited = results(spark, tpl, ("vendor_name", 1, "A", 0.99, ""), ("vendor_name", 2, "B", 0.5, "B"))["vendor_name"]
    assert cited.normalized_value.text == "B"
    tie = results(spark, tpl, ("vendor_name", 2, "later", 0.9, "xy"), ("vendor_name", 1, "first", 0.9, "xy"))["vendor_name"]
    assert tie.normalized_value.text == "first"


def test_missing_and_unexpected_fields(spark):
    rows = [("mystery", 1, "A", 0.9, "A")]
    got = results(spark, template(VENDOR), *rows)["vendor_name"]
    assert got.validation_errors == ["Required field is missing.", "Null is not allowed.", "Citation evidence is required."]
    assert got.validation_status == "invalid" and got.requires_review and got.notes == rc.MISSING_FIELD_NOTE
    stray = rc.unexpected_fields(candidates(spark, *rows), template(VENDOR)).first()
    assert stray.note == "Provider returned unexpected field 'mystery'."


def test_allowed_values_are_canonicalized(spark):
    terms = FieldDef("terms", "Terms", "category", allowed_values=("Net 30", "Due on receipt"))
    got = results(spark, template(terms), ("terms", 1, "net30", 0.95, "net30"))["terms"]
    assert got.normalized_value.text == "Net 30" and got.validation_status == "valid" and got.requires_review
    close = results(spark, template(terms), ("terms", 1, "Due on recipt", 0.95, "x"))["terms"]
    assert close.normalized_value.text == "Due on receipt" and "guarded fuzzy matching" in close.notes


def test_three_rules_fail_together(spark):
    number = FieldDef("number", "Number", "text", allowed_values=("INV-100",), rules=Rules(regex=r"^INV-\d+$", max_length=10))
    got = results(spark, template(number), ("number", 1, "BAD-TOO-LONG", 0.95, "x"))["number"]
    assert got.validation_errors == [rc.OUTSIDE_ALLOWED, rc.PATTERN_MISMATCH, rc.TOO_LONG]


def test_pattern_is_anchored_at_the_start_only(spark):
    field = FieldDef("code", "Code", "text", rules=Rules(regex="a|b"))
    assert results(spark, template(field), ("code", 1, "bzz", 0.9, "x"))["code"].validation_status == "valid"
    assert results(spark, template(field), ("code", 1, "zb", 0.9, "x"))["code"].validation_status == "invalid"


def test_low_confidence_note(spark):
    got = results(spark, template(VENDOR), ("vendor_name", 1, "A", 0.6, "A"))["vendor_name"]
    assert got.requires_review and got.notes == "Confidence 0.60 is below the 0.75 review threshold."


def test_a_hot_document_is_combined(spark):
    rows = [("vendor_name", i, f"v{i}", (i % 100) / 100, "x") for i in range(3000)]
    got = results(spark, template(VENDOR), *rows)["vendor_name"]
    assert got.n_candidates == 3000 and got.normalized_value.text == "v99"


def test_currency_chain(spark):
    got = wide_amount(spark, 1200.0, CalcDef("next", "Next", "number", "amount_with_buffer.amount + 5", ("amount_with_buffer",)), BUFFER)
    assert json.loads(got["amount_with_buffer"].value_json) == {"amount": 1320.0, "currency": "USD"}
    assert got["amount_with_buffer"].display_value == "USD 1,320.00"
    assert float(got["next"].value_text) == 1325.0 and got["next"].depends_on == ["amount_with_buffer"]


def test_division_by_zero_policies(spark):
    formula = "1 / coalesce(total_amount.amount, 0)"
    got = wide_amount(spark, 0.0, CalcDef("quiet", "Q", "number", formula, ("total_amount",), on_divide_by_zero=NULL_ON_ERROR),
                      CalcDef("loud", "L", "number", formula, ("total_amount",)))
    quiet, loud = got["quiet"], got["loud"]
    assert (quiet.value_text, quiet.validation_status, quiet.requires_review) == (None, "valid", False)
    assert "Division by zero returned null by policy." in quiet.calculation_notes
    assert loud.validation_errors == ["Division by zero."] and loud.requires_review


def test_missing_input_policies(spark):
    got = wide_amount(spark, None, CalcDef("quiet", "Q", "number", "total_amount.amount + 1", ("total_amount",), on_missing_input=NULL_ON_ERROR),
                      CalcDef("loud", "L", "number", "total_amount.amount + 1", ("total_amount",)))
    assert got["quiet"].validation_status == "valid" and "Missing input returned null by policy." in got["quiet"].calculation_notes
    assert got["loud"].validation_errors == ["Missing input."]


def test_formulas_do_not_change_the_session(spark):
    wide_amount(spark, 1.0, BUFFER)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_circular_formulas_are_refused():
    tpl = template(AMOUNT, calcs=(CalcDef("a", "A", "number", "b + 1", ("b",)), CalcDef("b", "B", "number", "a + 1", ("a",))))
    with pytest.raises(ValueError, match="Circular"):
        tpl.ordered_calcs()


def test_months_ignore_the_day_and_dates_are_permissive(spark):
    df = spark.createDataFrame([("2025-01-01", "2025-04-01"), ("01/15/2025", "04/15/2025"), ("2025-01-31", "Apr 1, 2025")], "s string, e string")
    got = [r[0] for r in df.select(fx.months_between(fx.parse_date(F.col("s")), fx.parse_date(F.col("e")))).collect()]
    assert got == [3, 3, 3]


def test_unit_conversion(spark):
    assert spark.range(1).select(fx.convert_unit(F.lit(60.0), "days", "months")).first()[0] == 2.0
    with pytest.raises(ValueError):
        fx.convert_unit(F.lit(1.0), "days", "years")


def test_contract_minimum(spark):
    line = FieldDef("line", "Line", "json_object", citation_required=False, contract={
        "type": "object", "required": ["quantity"], "properties": {"quantity": {"type": "number", "minimum": 1}}})
    body = F.struct(*[{"normalized_value": value_struct(object_json=F.lit('{"quantity":0}'))}.get(c, F.lit(None)).cast(t).alias(c)
                      for c, t in rc.CANDIDATE_COLUMNS.items()], F.lit(1).alias("n_candidates"))
    row = rc.validate_wide(spark.range(1).select(body.alias("line")), template(line)).first().line
    assert row.validation_errors == ["Value does not satisfy schema at 'quantity': 0 is less than the minimum of 1"]


def test_grounded_annotations_and_pages(spark):
    text = "[Page 1]\nVendor: Acme Corp\n[Page 2]\nTotal: $1,200.00"
    rows = [(0, "vendor_name", 0, "Acme Corp", text.index("Acme"), text.index("Acme") + 9), (0, "total_amount", 1, "$1,200.00", text.index("$"), len(text)),
            (0, "total_amount", 2, "$9", None, None)]
    notes = spark.createDataFrame(rows, "doc_id int, extraction_class string, seq int, extraction_text string, char_start int, char_end int").withColumn(
        "attributes", F.lit(None).cast("map<string,string>"))
    defs = spark.createDataFrame([("vendor_name", "Vendor Name", "text", None), ("total_amount", "Total", "currency", "USD")],
                                 "field_name string, label string, data_type string, currency string")
    got = {r.seq: r for r in ex.ground_annotations(notes, docs(spark, text), defs).collect()}
    assert (got[0].page_number, got[0].source_text, got[0].confidence) == (1, "Acme Corp", 1.0)
    assert (got[1].page_number, got[1].normalized_value.amount) == (2, 1200.0)
    assert (got[2].confidence, got[2].requires_review, got[2].source_text) == (0.0, True, "")


def test_chunked_and_whole_extraction_agree_on_values(spark):
    tpl = template(AMOUNT, calcs=(BUFFER,))
    text = "Total Due: $1,200.00\n" + "filler words " * 200
    whole = ca.calculated_long(extract_documents(docs(spark, text), tpl), tpl).first()
    chunked = extract_documents(docs(spark, text), tpl, chunk_size=1200).first()
    assert json.loads(whole.value_json)["amount"] == 1320.0
    assert chunked.total_amount.n_candidates > 1
    assert "chunk candidates." in chunked.total_amount.notes


def test_unchunked_extraction_does_not_shuffle(spark):
    plan = extract_documents(docs(spark, "Total: $1"), template(AMOUNT, calcs=(BUFFER,)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_dry_run_reports_blank_samples(spark):
    got = {r.doc_id: r for r in schema_dry_run(docs(spark, "Total: $5", "  \n"), template(AMOUNT, calcs=(BUFFER,))).collect()}
    assert got[0].ok and got[0].schema_errors == []
    assert not got[1].ok and got[1].schema_errors == ["Sample text is required for a dry run."]


def test_validation_prepares_a_value_once(spark):
    """Each text is compared with each allowed value in one place of the plan; structured values are parsed before their contract is checked."""
    fields = (FieldDef("terms", "Terms", "multi_select", allowed_values=("Net 30", "Net 60")), FieldDef("term", "Term", "category", allowed_values=("Net 30", "Net 60")),
              FieldDef("line", "Line", "structured_object", contract={"type": "object", "required": ["sku"], "properties": {"n": {"minimum": 1}}}))
    rows = [(["Net 3O", None, "net60"], "net-30", '{"n":0}'), (None, "cash", "[1]"), ([], None, None)]
    raw = spark.createDataFrame(rows, "items array<string>, one string, body string")

    def field(value):
        fixed = {"normalized_value": value, "notes": F.lit(""), "requires_review": F.lit(False)}
        return F.struct(*[fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in rc.CANDIDATE_COLUMNS.items()], F.lit(1).alias("n_candidates"))

    wide = raw.select(field(value_struct(items=F.col("items"))).alias("terms"), field(value_struct(text=F.col("one"))).alias("term"),
                      field(value_struct(object_json=F.col("body"))).alias("line"))
    checked = rc.validate_wide(wide, Template("T", "1", "t", fields, review_low=False))
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") == 4
    got = checked.select("terms.normalized_value.items", "term.normalized_value.text", "term.notes", "line.validation_errors").collect()
    assert [list(r["items"]) if r["items"] is not None else None for r in got] == [["Net 3O", None, "Net 60"], None, []]
    assert [r.text for r in got] == ["Net 30", "cash", None] and got[0].notes.endswith("using normalized comparison.")
    assert "'sku' is a required property" in got[0].validation_errors[0] and "is not of type 'object'" in got[1].validation_errors[0]
