"""Sinks: result envelopes, CSV exports, export manifests, parsed text, evaluation history."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from docweft.functions.text import python_bool
from docweft.operators.review import DEFAULT_REVIEWER

# ---- fixed values -------------------------------------------------------------------------------
EXPORT_COLUMNS = ("field_name", "label", "kind", "value", "status", "requires_review")


def write_results_json(envelopes: DataFrame, path: str, mode: str = "append", compression: str = "gzip") -> None:
    """Nested results as JSON lines, one directory per tenant when the rows carry one.

    Member names and notes repeat in every line, so the files are compressed (readers tell by their suffix); "none" gives plain files.
    """
    writer = envelopes.write.mode(mode).option("compression", compression)
    if "tenant_id" in envelopes.columns:
        writer = writer.partitionBy("tenant_id")
    writer.json(path)


def export_rows(envelopes: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The six export columns, extracted fields first, then calculated ones, with their `row_no`."""
    def row(f: Column, value: str) -> Column:
        return F.struct(
            f["field_name"].alias("field_name"), f["label"].alias("label"), f["field_kind"].alias("kind"),
            F.coalesce(f[value], F.lit("null")).alias("value"), f["validation_status"].alias("status"),
            python_bool(f["requires_review"]).alias("requires_review"))

    extracted = F.transform("extracted_fields", lambda f: row(f, "normalized_value"))
    has_calcs = dict(envelopes.dtypes)["calculated_fields"].startswith("array<struct")
    rows = F.concat(extracted, F.transform("calculated_fields", lambda f: row(f, "calculated_value"))) if has_calcs else extracted
    return envelopes.select(*keys, F.posexplode(rows).alias("row_no", "_r")).select(*keys, "row_no", "_r.*")


def write_results_csv(envelopes: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), mode: str = "append") -> None:
    """Export rows as CSV with a header; a document's rows stay together and in order."""
    export_rows(envelopes, keys).write.mode(mode).option("header", "true").csv(path)


def csv_field(text: Column) -> Column:
    """A CSV cell, quoted when it holds a comma, quote or line end."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.regexp_like(text, F.lit('[",\r\n]')), quoted).otherwise(text)


def csv_content(envelopes: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each document's whole CSV export as one text (bounded by its template), built inside its row."""
    def line(f: Column, value: str) -> Column:
        cells = [f["field_name"], f["label"], f["field_kind"], F.coalesce(f[value], F.lit("null")),
                 f["validation_status"], python_bool(f["requires_review"])]
        return F.concat_ws(",", *[csv_field(c) for c in cells])

    lines = F.transform("extracted_fields", lambda f: line(f, "normalized_value"))
    if dict(envelopes.dtypes)["calculated_fields"].startswith("array<struct"):
        lines = F.concat(lines, F.transform("calculated_fields", lambda f: line(f, "calculated_value")))
    head = F.array(F.lit(",".join(EXPORT_COLUMNS)))
    content = F.concat(F.array_join(F.concat(head, lines), "\r\n"), F.lit("\r\n"))
    return envelopes.withColumn("content", content)


def export_manifest(
    exports: DataFrame, jobs: DataFrame, reviewers: DataFrame, exported_at: datetime | str, export_format: str = "csv"
) -> DataFrame:
    """One manifest row per export (result_id, job_id, content, template_name, template_version)."""
    hashed = exports.select("result_id", "job_id", "template_name", "template_version",
                            F.sha2(F.col("content"), 256).alias("content_sha256"))
    joined = hashed.join(jobs.select("job_id", "template_version_id"), "job_id", "left").join(
        reviewers.select("result_id", "reviewer"), "result_id", "left")
    return joined.select(
        "result_id", "job_id", F.lit(export_format).alias("export_format"), "content_sha256",
        F.lit(exported_at).cast("timestamp").alias("exported_at"),
        F.coalesce("reviewer", F.lit(DEFAULT_REVIEWER)).alias("reviewer"),
        "template_version_id", "template_name", "template_version")


def write_parsed_text(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Keep parsed text for later citation checks."""
    docs.write.mode(mode).parquet(path)


def append_eval_history(
    report: DataFrame, cases: DataFrame, path: str, run_id: str, generated_at: datetime | str, source_path: str,
    label: str | None = None,
) -> None:
    """Append one run row and its case rows (with mismatches as JSON) under `runs` and `case_results`."""
    report.select(
        F.lit(run_id).alias("run_id"), F.lit(generated_at).cast("timestamp").alias("generated_at"),
        F.lit(label).cast("string").alias("label"), F.lit(source_path).alias("source_path"), *report.columns,
    ).write.mode("append").parquet(f"{path}/runs")
    cases.select(F.lit(run_id).alias("run_id"), *cases.columns).write.mode("append").parquet(f"{path}/case_results")
