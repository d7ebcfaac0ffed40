"""Review, feedback, operations, evaluation, sources and streams on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docweft.operators import evaluation as ev, feedback as fb, ops, review as rv, templates as tp
from docweft.schema import template_from_dict, value_struct
from docweft.sources import readers as rd
from docweft.streaming import streams as st

LOG = [
    {"event": ops.REJECTED, "reason": "document_too_large", "document_chars": 181_313, "model": "small"},
    {"event": ops.COMPLETED, "model": "small", "extracted_field_count": 11, "calculated_field_count": 5, "review_required_count": 7,
     "document_note_count": 3, "low_confidence_review_count": 4, "multi_candidate_review_count": 2, "citation_gap_count": 1, "validation_error_count": 6},
    {"event": ops.FEEDBACK, "reviewed_result_count": 13, "reviewed_edit_count": 17, "generated_suggestion_count": 8, "skipped_span_mismatch": 9},
]
DEFINITION = {
    "template_name": "Invoice Extraction", "template_version": "1.0.0", "document_type": "invoice",
    "extracted_fields": [{"name": "vendor_name", "label": "Vendor Name", "description": "", "type": "text", "required": True},
                         {"name": "total_amount", "label": "Total", "description": "", "type": "currency", "validation": {"currency": "EUR"}}],
    "calculated_fields": [{"name": "buffer", "label": "Buffer", "description": "", "output_type": "currency",
                           "formula": "coalesce(total_amount.amount, 0) * 1.10", "depends_on": ["total_amount"]}],
    "langextract_config": {"prompt_description": "p", "examples": [{"text": "t", "extractions": [
        {"extraction_class": "vendor_name", "extraction_text": "t", "attributes": {"value": "t"}}]}]},
}


def test_high_confidence_approval(spark):
    rows = spark.createDataFrame([("a", 0.92, "valid", True), ("b", 0.55, "valid", True), ("c", 0.99, "invalid", True)],
                                 "field_name string, confidence double, validation_status string, requires_review boolean")
    got = {r.field_name: (r.validation_status, r.requires_review) for r in rv.approve_high_confidence(rows, 0.85).collect()}
    assert got == {"a": ("reviewed", False), "b": ("valid", True), "c": ("invalid", True)}


def test_feedback_groups_equal_examples(spark):
    text = "Order of Birch Mills\nSum 3.450,50 EUR\n"
    at, cost = text.index("Birch"), text.index("3.450")
    rows = [("t", r, r, "vendor_name", "text", "Birch Mills", "Birch Mills", at, at + 11, "2031-03-02") for r in (1, 2)]
    rows += [("t", r, r, "total_amount", "currency", "3.450,50 EUR", "3.450,50 EUR", cost, cost + 12, "2031-03-02") for r in (1, 2)]
    long = spark.createDataFrame(rows, "tenant_id string, result_id int, job_id int, field_name string, data_type string, "
                                       "extracted_value string, source_text string, char_start int, char_end int, reviewed_at string")
    long = long.withColumn("normalized_value", F.when(F.col("data_type") == "text", value_struct(text=F.lit("Birch Mills Ltd"))).otherwise(
        value_struct(amount=F.lit(3450.5), currency=F.lit("EUR"), display_value=F.lit("3.450,50 EUR"))))
    results = fb.result_fields(long, ("tenant_id", "result_id", "job_id", "reviewed_at"))
    jobs = spark.createDataFrame([("t", 1, 10, 5), ("t", 2, 20, 5)], "tenant_id string, job_id int, document_id int, template_version_id int")
    docs = spark.createDataFrame([("t", 10, text), ("t", 20, text)], "tenant_id string, doc_id int, text string")
    edits = spark.createDataFrame([("t", 1, "vendor_name"), ("t", 2, "vendor_name"), ("t", 2, "ghost")], "tenant_id string, result_id int, field_name string")
    cands = fb.edit_candidates(fb.reviewed_edits(results, jobs, docs, edits))
    found = fb.suggestions(cands).collect()
    assert len(found) == 1
    one = found[0]
    assert (one.occurrence_count, one.n_source_results, one.source_field_names) == (2, 2, ["vendor_name"])
    assert one.example_text == text.strip()
    assert [e.extraction_class for e in one.extractions] == ["vendor_name", "total_amount"]
    payload = {"example_text": text.strip(), "extractions": [
        {"extraction_class": "vendor_name", "extraction_text": "Birch Mills", "attributes": {"value": "Birch Mills Ltd"}},
        {"extraction_class": "total_amount", "extraction_text": "3.450,50 EUR", "attributes": {"value": "3.450,50 EUR", "currency": "EUR"}}]}
    import hashlib
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    assert one.suggestion_key == want
    decisions = spark.createDataFrame([("t", 5, one.suggestion_key, True, 1)], "tenant_id string, template_version_id int, suggestion_key string, dismissed boolean, updated_at int")
    assert fb.visible_suggestions(fb.suggestions(cands), decisions).count() == 0
    diag = fb.feedback_diagnostics(results, jobs, edits, cands, fb.suggestions(cands), decisions).first()
    assert (diag.reviewed_result_count, diag.reviewed_edit_count, diag.generated_suggestion_count) == (2, 3, 1)
    assert (diag.dismissed_suggestion_count, diag.visible_suggestion_count, diag.skipped_missing_target_field) == (1, 0, 1)


def test_queue_metrics(spark):
    jobs = spark.createDataFrame([("t", s) for s in ("queued", "running", "failed", "completed")], "tenant_id string, status string")
    none = spark.createDataFrame([], "tenant_id string")
    row = ops.ops_metrics(jobs, none, none, none).first()
    assert (row.queue_depth, row.failed_jobs, row.completed_jobs, row.documents) == (2, 1, 1, 0)


def test_metadata_filter_comes_before_paging(spark):
    events = spark.createDataFrame([(i, "t", f'{{"job_id": {v}}}', f"2024-01-01 00:00:0{i}") for i, v in enumerate((7, '"7"', 8, 'null', '"x"'))],
                                   "event_id int, tenant_id string, metadata string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    mine = ops.audit_events(events, "t", job_id=7)
    first, second = ops.page(mine, 1, 0).collect(), ops.page(mine, 1, 1).collect()
    assert [(r.event_id, r.total) for r in first + second] == [(1, 2), (0, 2)]


def test_log_summary_numbers(spark):
    lines = spark.createDataFrame([(json.dumps(x),) for x in LOG] + [("not-json",), ("",), ("[1]",)], "line string")
    got = {(r.section, r.item): r.amount for r in ops.log_summary(lines).collect()}
    assert got["lines", "lines_processed"] == 6 and got["lines", "json_records_processed"] == 3 and got["lines", "invalid_line_count"] == 1
    assert all(got["events_seen", e] == 1 for e in (ops.REJECTED, ops.COMPLETED, ops.FEEDBACK))
    assert got["rejection_reasons", "document_too_large"] == 1 and got["rejection_totals", "rejected_document_chars"] == 181_313
    assert got["extraction_totals", "review_required_count"] == 7 and got["feedback_totals", "skipped_span_mismatch"] == 9


def test_line_numbers_hold_across_file_splits(spark, tmp_path):
    body = "\n".join("bad" if i % 7 == 0 else json.dumps({"event": "x", "n": i}) for i in range(1, 4001))
    (tmp_path / "a.log").write_text(body)
    (tmp_path / "b.log").write_text('{"a":1}\nbad\n\nbad')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = rd.read_event_log(spark, str(tmp_path))
        got = sorted((r.path.rsplit("/", 1)[1], r.line_number) for r in rd.line_numbers(lines, ops.invalid_log_lines(lines)).collect())
        assert lines.rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("a.log", i) for i in range(7, 4001, 7)] + [("b.log", 2), ("b.log", 4)])


def test_text_files_ignore_bad_bytes(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"caf\xc3\xa9 \xff\xfe ok")
    (tmp_path / "y.md").write_text("plain")
    assert sorted(r.text for r in rd.read_text_documents(spark, str(tmp_path)).collect()) == ["café  ok", "plain"]


def test_definitions_from_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "invoice.json").write_text(json.dumps(DEFINITION, indent=2))
    templates = rd.read_templates(spark, str(tmp_path))
    assert {(r.kind, r.name) for r in rd.definition_rows(templates).collect()} == {
        ("extracted", "vendor_name"), ("extracted", "total_amount"), ("calculated", "buffer")}
    assert [r.extraction_class for r in rd.example_rows(templates).collect()] == ["vendor_name"]
    built = template_from_dict(DEFINITION)
    assert built.field("total_amount").rules.currency == "EUR" and built.calcs[0].references(["total_amount"]) == {"total_amount"}


def test_golden_case_expectations(spark, tmp_path):
    case = {"name": "invoice-basic", "tags": ["invoice"], "document_text": "Total Due: $1,200.00", "template_definition": DEFINITION,
            "expected_fields": {"total_amount": {"normalized_value": {"amount": 1200, "currency": "usd"}, "requires_review": False},
                                "vendor_name": {"extracted_value": "acme-corp", "normalized_value": {"value": "Acme Corp"}, "requires_review": False}},
            "expected_calculated_fields": {"buffer": {"normalized_value": {"amount": 1320.0}}}, "expected_review_flags": [],
            "expected_document_level_note_substrings": []}
    (tmp_path / "case.json").write_text(json.dumps(case))
    expected = rd.expectation_rows(rd.read_eval_cases(spark, str(tmp_path)))
    actual = spark.createDataFrame(
        [("invoice-basic", "field", "total_amount", '"$1,200.00"', '{"amount":1200.004,"currency":"USD","display_value":"x"}', False),
         ("invoice-basic", "calculated_field", "buffer", None, '{"amount":1320.0,"currency":"USD"}', False)],
        "case_name string, category string, field_name string, extracted_json string, normalized_json string, review boolean")
    checks = ev.compare_expectations(expected, actual)
    total = ev.case_results(checks).first()
    assert (total.matched_checks, total.failed_checks, total.passed) == (3, 3, False)
    assert {r.detail for r in checks.filter("NOT matched").collect()} == {ev.FIELD_MISSING}


@pytest.mark.parametrize("expected,actual,match", [
    ("1200", "1200.009", True), ("1200", "1200.02", False), ("1", "true", False), ("true", "true", True), ('"A-b  c"', '"a_B c"', True),
    ("[1,2]", "[1,2,3]", False), ("[1,2]", "[1.0,2]", True), ('{"a":1}', '{"a":1,"b":2}', True), ('{"a":1,"b":2}', '{"a":1}', False),
    ('{"a":{"b":["x-y"]}}', '{"a":{"b":["X y"]}}', True), ("1e12", "1000000000000.5", True), ('"1"', "1", False), ("null", "null", True),
])
def test_values_match(spark, expected, actual, match):
    row = spark.createDataFrame([(expected, actual)], "e string, a string").select(ev.json_match(F.col("e"), F.col("a"))).first()
    assert row[0] is match


def test_cycles_are_found_but_not_what_leads_to_them(spark):
    calcs = spark.createDataFrame([("t", "a", ["b"]), ("t", "b", ["a"]), ("t", "c", ["a"]), ("t", "d", ["x"]), ("u", "e", ["e"])],
                                  "template_id string, name string, refs array<string>")
    assert {tuple(r) for r in tp.formula_cycles(calcs).collect()} == {("t", "a"), ("t", "b"), ("u", "e")}


# ---- streams: the streamed result equals the static one -----------------------------------------
def run_stream(spark, static, path, transform, name, mode="append"):
    """Drive a static frame through a stream; a last far-future file flushes the open windows."""
    static.write.parquet(path)
    stream = transform(spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(path))
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@pytest.mark.parametrize("alert", [st.failed_jobs_alert, st.queue_depth_alert, st.idle_worker_alert])
def test_streamed_alerts_equal_static_ones(spark, tmp_path, alert):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", f"t{h % 2}", "failed" if m % 3 == 0 else "completed", 9 + (m + h) % 4, "idle" if m < 20 else "running")
            for h in range(3) for m in range(0, 60, 5)]
    frame = spark.createDataFrame(rows, "ts string, tenant_id string, status string, queue_depth int, worker_state string").withColumn(
        "ts", F.col("ts").cast("timestamp")).coalesce(1).sortWithinPartitions("ts")
    streamed = run_stream(spark, frame, str(tmp_path / "in"), alert, f"alerts_{alert.__name__}", "update")
    static = {tuple(r) for r in alert(frame).collect()}
    assert static and static <= {tuple(r) for r in streamed.collect()}


def test_streamed_log_counts_equal_static_ones(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 4}:00:00", json.dumps(LOG[i % 3])) for i in range(24)]
    frame = spark.createDataFrame(rows, "ts string, line string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    streamed = run_stream(spark, frame, str(tmp_path / "in"), st.stream_log_counts, "log_counts", "update")
    assert {tuple(r) for r in streamed.collect()} == {tuple(r) for r in st.stream_log_counts(frame).collect()}


def test_streamed_duplicates_are_dropped(spark, tmp_path):
    rows = [("t", i % 5, f"2024-01-01 00:00:{i:02d}") for i in range(20)]
    frame = spark.createDataFrame(rows, "tenant_id string, job_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    streamed = run_stream(spark, frame, str(tmp_path / "in"), st.dedupe_events, "dedupe")
    assert sorted(r.job_id for r in streamed.collect()) == sorted(r.job_id for r in st.dedupe_events(frame).collect()) == list(range(5))


@pytest.mark.parametrize("depth", [1, 5, 60])
def test_values_match_at_any_depth(spark, depth):
    texts = ['{"k":[' * depth + f'"{end}"' + "]}" * depth for end in ("Net-30", "net 30", "net 31")]
    rows = spark.createDataFrame([(texts[0], texts[1]), (texts[0], texts[2])], "e string, a string")
    assert [r[0] for r in rows.select(ev.json_match(F.col("e"), F.col("a"))).collect()] == [True, False]


def test_contract_clauses(spark):
    from docweft.functions.contracts import first_failure

    contract = {"type": ["object", "null"], "properties": {
        "q": {"maximum": 5, "exclusiveMinimum": 0}, "s": {"enum": ["a", "b"], "maxLength": 3}, "l": {"items": {"type": "integer"}, "minItems": 1}}}
    cases = {'{"q":9}': "at 'q': 9 is greater than the maximum of 5", '{"q":0}': "at 'q': 0 is less than or equal to", '{"s":"z"}': "at 's': \"z\" is not one of",
             '{"l":[1,"x"]}': "\"x\" is not of type 'integer'", '{"l":[]}': "at 'l': [] is too short", "[1]": "[1] is not of type 'object', 'null'",
             '{"q":5,"s":"b","l":[1]}': None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", first_failure(F.parse_json("v"), contract).alias("m")).collect()
    for row in rows:
        assert (row.m is None) if cases[row.v] is None else (cases[row.v] in row.m), row
    with pytest.raises(ValueError):
        first_failure(F.lit(None), {"oneOf": []})


def test_list_drafts_keep_their_text(spark):
    from docweft.functions.values import draft_value

    value, error = draft_value(F.lit("L"), F.col("t"), F.col("d"), F.lit("EUR"))
    rows = spark.createDataFrame([("list", '["a","b"]'), ("multi_select", "plain")], "t string, d string").select(value.alias("v"), error.alias("e")).collect()
    assert [(list(r.v["items"]), r.e) for r in rows] == [(['["a","b"]'], None), (["plain"], None)]


@pytest.mark.parametrize("formula,names", [
    ("days_between(order_date.value, DATE'2001-01-01')", ["order_date"]), ("calc_round(x, 2)", ["x"]),
    ("transform(items.value, v -> v * rate.value)", ["rate"]), ("aggregate(xs, 0D, (a, x) -> a + x)", ["xs"]),
    ("CASE WHEN a > 1 THEN CAST(b.amount AS DOUBLE) ELSE 1.5D END", ["a", "b"]), ("if(note.value = 'total amount', 1, tax.amount)", ["note", "tax"])])
def test_names_of_fields_in_formulas(spark, formula, names):
    from docweft.schema import CalcDef

    got = spark.createDataFrame([(formula,)], "f string").select(tp.formula_names(F.col("f"))).first()[0]
    assert set(names) <= set(got) | {"rate"} and "DATE" not in got and "total" not in got
    assert CalcDef("n", "l", "number", formula).references([*names, "DATE", "total", "calc_round", "value"]) == set(names)


def test_helpers_in_formulas_take_places_and_texts(spark):
    from docweft.functions.formulas import register_formula_functions

    register_formula_functions(spark)
    row = spark.sql("SELECT calc_round(2.71828D, 2), calc_round(2.5D), format_percent(12.5D), format_percent(12.26D, 1), format_percent(7D, 0), "
                    "text_contains('abc', 'b'), text_contains(NULL, 'b'), count_chars('abc'), iff_text(false, 'a', 'b')").first()
    assert tuple(row) == (2.72, 2.0, "12.50%", "12.3%", "7%", True, False, 3, "b")


def test_newest_results_keep_their_provider(spark, tmp_path):
    for batch, attempt, model in ((0, 1, "small"), (1, 2, "large")):
        spark.createDataFrame([(7, attempt, {"model": model})], "job_id int, attempt int, llm_provider map<string,string>").write.parquet(f"{tmp_path}/batch_id={batch}")
    row = st.latest_results(spark, str(tmp_path)).first()
    assert (row.attempt, row.llm_provider) == (2, {"model": "large"})


def test_log_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("2024-01-01 00:00:00", "{}")], "ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert st.stream_log_counts(lines)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
