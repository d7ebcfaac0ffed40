"""The plan from documents to envelopes, and spans in linear time."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.functions import spans as sp
from docweft.operators import extract as ex, redaction as rd, text_prep as tp
from docweft.operators.reconcile import reconcile_wide
from docweft.plans.dry_run import schema_dry_run
from docweft.plans.execute import Deployment, process_documents
from docweft.schema import CANDIDATE_COLUMNS, CalcDef, FieldDef, Rules, Template

EXTERNAL = {"provider_type": "remote", "allow_external_processing": True}
CLAIM = Template(
    "Claim", "1", "claim", (
        FieldDef("total", "Total Due", "currency", required=True, rules=Rules(allow_null=False)), FieldDef("vendor", "Vendor", "text", citation_required=False),
        FieldDef("paid", "Paid", "boolean", citation_required=False)),
    (CalcDef("twice", "Twice", "currency", "total.amount * 2", ("total",)),), provider=EXTERNAL)


def docs(spark, *rows):
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r, None))) for i, r in enumerate(rows)], "doc_id int, text string, original_filename string")


def test_one_pass_without_a_shuffle(spark):
    for deployment in (Deployment(), Deployment(require_redaction=True)):
        plan = process_documents(docs(spark, "Total Due: $1"), CLAIM, deployment=deployment, chunk_size=50, overlap=5)
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_masked_values_are_cleared_and_noted(spark):
    text = "Vendor: jane@example.com\nTotal Due: $12.50"
    done = {d: process_documents(docs(spark, text), CLAIM, deployment=d).first() for d in (Deployment(), Deployment(require_redaction=True))}
    plain, masked = done.values()
    assert plain.document_level_notes == [] and plain.extracted_fields[1].extracted_value == text
    assert masked.document_level_notes == ["External provider text redaction applied for 1 spans across 1 entity types."]
    vendor = masked.extracted_fields[1]
    assert vendor.extracted_value is None and vendor.normalized_value is None and rd.CLEARED_NOTE in vendor.extraction_notes and vendor.requires_review
    assert masked.extracted_fields[0].extracted_value == "$12.50" and masked.calculated_fields[0].display_value == "USD 25.00"
    assert masked.fields_requiring_review == ["total", "vendor", "paid"] and masked.error_message is None


def test_policy_refuses_before_anything_is_read(spark):
    rows = docs(spark, ("Total Due: $1", "a.CSV"), ("Total Due: $1", "b.pdf"))
    got = process_documents(rows, CLAIM, deployment=Deployment(require_redaction=True)).orderBy("doc_id").collect()
    assert [(r.extraction_status, r.error_message) for r in got] == [("failed", rd.SPREADSHEET_NOT_REDACTED), ("completed", None)]
    assert got[0].extracted_fields is None and got[1].extracted_fields is not None
    assert {r.error_message for r in process_documents(rows, CLAIM, deployment=Deployment(allow_external=False)).collect()} == {rd.EXTERNAL_DISABLED}
    closed = Deployment(require_redaction=True, redaction_enabled=False)
    assert {r.error_message for r in process_documents(rows, CLAIM, deployment=closed).collect()} == {rd.REDACTION_DISABLED}
    local = Template("Claim", "1", "claim", CLAIM.fields, CLAIM.calcs)
    assert {r.error_message for r in process_documents(rows, local, deployment=closed).collect()} == {None}


def test_rows_and_aggregation_reconcile_alike(spark):
    rng = random.Random(2)
    words = ["Total Due:", "$12.50", "$1,999.99", "vendor", "Acme", "paid", "7", "lorem", "\n"]
    rows = docs(spark, *[" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(60)], None, "", " \n ")
    local = Template("Claim", "1", "claim", CLAIM.fields, CLAIM.calcs)
    texts = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = tp.label_chunks(ex.rule_extract(tp.chunk_text(texts, 90, 20), local, text="chunk")).withColumn("seq", F.col("chunk_index").cast("bigint"))
    wide = {r.doc_id: r for r in reconcile_wide(found, texts, local).collect()}
    got = process_documents(rows, local, chunk_size=90, overlap=20).collect()
    assert len(got) == len(wide) == 63
    for r in got:
        for field in r.extracted_fields:
            want = wide[r.doc_id][field.field_name]
            assert (field.extracted_value, field.confidence_score, field.source_text) == (want.extracted_value, want.confidence, want.source_text)
            assert field.extraction_notes.startswith(want.notes)


def test_candidates_of_unknown_fields_become_notes(spark):
    kind = "array<struct<field_name:string,seq:bigint," + ",".join(f"{name}:{kind}" for name, kind in CANDIDATE_COLUMNS.items()) + ">>"
    value = lambda x: (None, None, x, "USD", str(x), None, None, None)
    one = lambda name, seq, amount, source: (name, seq, str(amount), value(amount), 0.9, source, None, None, None, "", "", False)
    rows = spark.createDataFrame([(1, "t", [one("mystery", 1, 1.0, "x"), one("total", 2, 5.0, "5"), one("total", 3, 6.0, "6.0"), one("other", 4, 1.0, "x")]), (2, "t", None), (3, None, [])],
                                 f"doc_id int, text string, found {kind}")
    got = {r.doc_id: r for r in process_documents(rows, Template("Claim", "1", "claim", CLAIM.fields, CLAIM.calcs), candidates="found").collect()}
    assert got[1].document_level_notes == ["Provider returned unexpected field 'mystery'.", "Provider returned unexpected field 'other'."]
    assert got[1].extracted_fields[0].extracted_value == "6.0" and "2 chunk candidates" in got[1].extracted_fields[0].extraction_notes
    assert got[2].extracted_fields[0].extraction_notes == got[3].extracted_fields[0].extraction_notes == "Provider response did not include this schema field."
    assert got[2].document_level_notes == []


def test_dry_run_returns_the_whole_result(spark):
    got = {r.doc_id: r for r in schema_dry_run(docs(spark, "Total Due: $5", " \n").drop("original_filename"), CLAIM).collect()}
    assert got[0].ok and got[0].summary.llm_provider["provider_label"] == "Dry run (mock)" and got[0].summary.document_type == "claim"
    assert [f.extracted_value for f in got[0].extracted_fields] == ["$5", None, None] and got[0].calculated_fields[0].display_value == "USD 10.00"
    assert not got[1].ok and got[1].summary is None and got[1].extracted_fields is None and got[1].schema_errors == ["Sample text is required for a dry run."]


# ---- spans --------------------------------------------------------------------------------------
def merged_plainly(spans):
    out = []
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, k])
    return [tuple(x) for x in out]


def test_islands_against_a_plain_merge():
    rng = random.Random(8)
    for _ in range(300):
        spans = [(s := rng.randint(0, 40), s + rng.randint(1, 8), rng.randint(0, 3)) for _ in range(rng.randint(0, 12))]
        starts, ends, kinds = (np.array(x, dtype=np.int32) for x in (zip(*spans) if spans else ([], [], [])))
        assert list(zip(*(x.tolist() for x in sp.islands(starts, ends, kinds)))) == merged_plainly(spans)


def test_windows_against_the_rule():
    """A window ends at its last blank or line end after the middle, else when it is full."""
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 80)))
        size, overlap = rng.randint(0, 12), rng.randint(0, 14)
        breaks = np.array([i for i, c in enumerate(text) if c in " \n"], dtype=np.int64)
        starts, ends = sp.window_bounds(breaks, len(text), size, overlap)
        assert starts[0] == 0 and ends[-1] == len(text) and len(starts) == len(ends)
        for at, (start, end) in enumerate(zip(starts, ends)):
            if at + 1 < len(starts):
                late = [i for i in range(start + size // 2 + 1, start + size) if text[i] in " \n"]
                assert end == (late[-1] if late else start + size) and starts[at + 1] == max(end - overlap, start + 1)
            else:
                assert size <= 0 or len(text) - start <= size


def _long_text(entities):
    return "".join(f"[Page {i + 1}] some words and more of them, mail a{i}@example.com, call (212) 555-{i % 10000:04d}, then 078-05-1120. " + "filler words " * 32 for i in range(entities // 3))


@pytest.mark.parametrize("step", ["redact", "pages", "chunks"])
def test_long_texts_take_time_in_proportion(spark, step):
    def run(entities):
        text = _long_text(entities)
        one = spark.range(1).select(F.lit(0).alias("doc_id"), F.lit("").alias("text")).withColumn("text", F.concat_ws("", *[F.lit(text[i : i + 2_000_000]) for i in range(0, len(text), 2_000_000)]))
        path = one.cache()
        path.count()
        if step == "redact":
            job = rd.redact(path).select(F.length("text"), "span_count")
        elif step == "pages":
            spans = spark.range(entities).select(F.lit(0).alias("doc_id"), (F.col("id") * (len(text) // entities)).cast("int").alias("char_start"))
            job = tp.page_of_offset(spans, path).agg(F.max("page_number"), F.count("page_number"))
        else:
            job = tp.chunk_text(path, 400, 100).agg(F.count("*"))
        seconds = []
        for _ in range(2):
            began = time.perf_counter()
            got = job.first()
            seconds.append(time.perf_counter() - began)
        path.unpersist()
        return min(seconds), got, text

    run(300)
    small, _, _ = run(10_000)
    large, got, text = run(40_000)
    assert large < 4 * 2 * small + 2
    if step == "redact":
        assert got[0] == len(text) and got.span_count == 39_999
    elif step == "pages":
        last = 39_999 * (len(text) // 40_000)
        page = int(text[: last + 1].rpartition("[Page ")[2].split("]")[0])
        assert got[0] == page > 13_000 and got[1] == 40_000


def test_annotations_of_one_document_share_its_text(spark):
    text = _long_text(3_000)
    starts = [text.index(f"[Page {i + 1}]") + 12 for i in range(0, 1_000, 7)]
    notes = spark.createDataFrame([(0, "x", i, text[s : s + 9], s, s + 9, None) for i, s in enumerate(starts)] + [(1, "x", 0, "", 0, 0, None)],
                                  "doc_id int, extraction_class string, seq int, extraction_text string, char_start int, char_end int, attributes map<string,string>")
    defs = spark.createDataFrame([("x", "X", "text", None)], "field_name string, label string, data_type string, currency string")
    got = {r.seq: r for r in ex.ground_annotations(notes, spark.createDataFrame([(0, text)], "doc_id int, text string"), defs).collect()}
    assert len(got) == len(starts) and all(got[i].source_text == text[s : s + 9] and got[i].page_number == i * 7 + 1 for i, s in enumerate(starts))
