"""Whole plans: documents to reviewed-ready results, and the schema dry run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from docweft.functions import text as tx
from docweft.operators.calculate import complete_wide, result_envelope
from docweft.operators.extract import rule_extract
from docweft.operators.reconcile import reconcile_wide, rule_extract_wide
from docweft.operators.text_prep import chunk_text, label_chunks
from docweft.schema import Template

BLANK_SAMPLE = "Sample text is required for a dry run."
DRY_RUN_PROVIDER = {"provider_type": "mock", "api_style": "mock", "provider_label": "Dry run (mock)"}


def extract_documents(
    docs: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",), chunk_size: int | None = None
) -> DataFrame:
    """Documents to complete wide results with the rule extractor.

    Without chunking there is one candidate per field and the whole plan is one scan without a shuffle; with
    chunking the candidates of all chunks meet in a single aggregation on the document key.
    """
    if chunk_size is None:
        return complete_wide(rule_extract_wide(docs, template, keys), template, keys)
    chunks = chunk_text(docs.select(*keys, "text"), chunk_size)
    found = label_chunks(rule_extract(chunks, template, text="chunk"))
    ordered = found.withColumn("seq", F.col("chunk_index").cast("bigint"))
    return complete_wide(reconcile_wide(ordered, docs, template, keys), template, keys)


def schema_dry_run(docs: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Try a template on sample documents with the rule extractor: one row per sample.

    ok, schema_errors, document_level_notes, extracted_fields, calculated_fields, fields_requiring_review and, as summary, the whole
    result under the dry run's provider. A blank sample gives an error and no result. ok means that no field is invalid.
    """
    trial = replace(template, provider=template.provider | DRY_RUN_PROVIDER)
    samples = docs.select(*keys, tx.strip(F.col("text")).alias("text"))
    blank, none = tx.is_blank(F.col("text")), F.array().cast("array<string>")
    wide = complete_wide(rule_extract_wide(samples.withColumn("_blank", blank), trial, (*keys, "_blank")), trial, (*keys, "_blank"))
    envelope = result_envelope(wide, trial, (*keys, "_blank"))
    whole = [c for c in envelope.columns if c not in (*keys, "_blank")]
    invalid = F.exists("extracted_fields", lambda f: f["validation_status"] == "invalid")
    if trial.calcs:
        invalid = invalid | F.exists("calculated_fields", lambda f: F.size(f["validation_errors"]) > 0)
    shown = ["extracted_fields", "calculated_fields"]
    return envelope.select(
        *keys, (~F.col("_blank") & ~invalid).alias("ok"),
        F.when(F.col("_blank"), F.array(F.lit(BLANK_SAMPLE))).otherwise(none).alias("schema_errors"),
        *[F.when(F.col("_blank"), none).otherwise(F.col(c)).alias(c) for c in ("document_level_notes", "fields_requiring_review")],
        *[F.when(~F.col("_blank"), F.col(c)).alias(c) for c in shown],
        F.when(~F.col("_blank"), F.struct(*whole)).alias("summary"))


def review_queue(docs: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Flagship plan: one row per document with its result, status and the fields a person must check."""
    envelope = result_envelope(extract_documents(docs, template, keys), template, keys)
    return envelope.withColumn("needs_review", F.size("fields_requiring_review") > 0)
