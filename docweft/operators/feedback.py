"""Feedback mining: reviewer edits to reusable extraction examples.

A result keeps its fields in one array (bounded by its template), so finding the other fields inside an
edit's context window is a filter inside the row, not a join of fields with fields. Edits are counted per
result and field before they meet results or texts: a result with very many edits shrinks to a few rows.
Keys name the id before the tenant, as sorts compare by the first key and few tenants share very many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docweft.functions import text as tx
from docweft.functions.values import feedback_attributes

# ---- fixed values -------------------------------------------------------------------------------
CONTEXT_RADIUS = 160
SKIP_REASONS = (
    "missing_document_text", "missing_target_field", "missing_grounding", "span_override", "span_mismatch",
    "empty_context", "no_contextual_extractions",
)
KEY_LENGTH = 16
GROUNDING_PROVIDER = "langextract"


def result_fields(results: DataFrame, keys: Sequence[str] = ("tenant_id", "result_id")) -> DataFrame:
    """Long results to one row per result with its fields as an array, ordered by span start and name.

    Rows are dealt out by tenant and result alone, so that edits, which are counted per result, meet them where they are.
    """
    owner = [k for k in ("result_id", "tenant_id") if k in keys]
    start = F.coalesce("char_start", F.lit(10**9))
    field = F.struct(start.alias("order_start"), "field_name", "data_type", "extracted_value", "normalized_value",
                     "source_text", "char_start", "char_end")
    dealt = results.repartition(*owner) if owner else results
    order = [*owner, *[k for k in keys if k not in owner]]
    return dealt.groupBy(*order).agg(F.sort_array(F.collect_list(field)).alias("fields")).select(*keys, "fields")


def edit_counts(edits: DataFrame) -> DataFrame:
    """Edits per result and field."""
    return edits.groupBy("tenant_id", "result_id", "field_name").agg(F.count(F.lit(1)).alias("n_edits"))


def grounding_versions(templates: DataFrame) -> DataFrame:
    """tenant_id and template_version_id of the versions (with provider_type and api_style) whose provider grounds its extractions."""
    named = [F.coalesce(F.col(c) == GROUNDING_PROVIDER, F.lit(False)) for c in ("provider_type", "api_style")]
    return templates.filter(named[0] | named[1]).select("tenant_id", "template_version_id").distinct()


def reviewed_edits(results: DataFrame, jobs: DataFrame, docs: DataFrame, edits: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Edits joined to their result, job and document on ids and tenant.

    `results` has one row per result (`fields`, `reviewed_at`), `docs` the readable `text`. The counts go to the results first, as
    those are the widest rows and `result_fields` leaves them in place for it; job attributes follow and the text arrives last. With
    `templates`, only versions whose provider grounds its extractions are mined.
    """
    if templates is not None:
        jobs = jobs.join(grounding_versions(templates), ["tenant_id", "template_version_id"], "left_semi")
    edited = edit_counts(edits).join(results, ["result_id", "tenant_id"])
    owned = edited.join(jobs.select("tenant_id", "job_id", "document_id", "template_version_id"), ["job_id", "tenant_id"])
    return owned.join(
        docs.select("tenant_id", F.col("doc_id").alias("document_id"), "text"), ["document_id", "tenant_id"])


def grounded(f: Column) -> Column:
    return F.coalesce((f["char_start"] >= 0) & (f["char_end"] >= f["char_start"]), F.lit(False))


def overridden(f: Column) -> Column:
    return F.coalesce(tx.strip(f["extracted_value"]) != tx.strip(f["source_text"]), F.lit(False))


def matches_text(f: Column, text: Column) -> Column:
    inside = f["char_end"] <= F.length(text)
    same = tx.strip(tx.slice_text(text, f["char_start"], f["char_end"])) == tx.strip(f["source_text"])
    return F.coalesce(inside & same, F.lit(False))


def context_window(text: Column, start: Column, end: Column, radius: int = CONTEXT_RADIUS) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), start - radius), F.least(F.length(text), end + radius)


def contextual_extractions(fields: Column, text: Column, left: Column, right: Column) -> Column:
    """Usable fields entirely inside a window, as (class, text, attributes JSON), ordered by start and name."""
    def usable(f: Column) -> Column:
        in_window = (f["char_start"] >= left) & (f["char_end"] <= right)
        return (grounded(f) & F.coalesce(in_window, F.lit(False)) & matches_text(f, text)
                & (tx.strip(f["source_text"]) != "") & ~overridden(f))

    return F.transform(F.filter(fields, usable), lambda f: F.struct(
        F.concat(feedback_attributes(f["normalized_value"], f["data_type"])).alias("attributes"),
        f["field_name"].alias("extraction_class"), tx.strip(f["source_text"]).alias("extraction_text")))


def edit_candidates(edits: DataFrame, radius: int = CONTEXT_RADIUS) -> DataFrame:
    """Add `skip_reason` (first that applies, else null), `example_text`, `extractions` to reviewed edits."""
    text = F.col("text")
    target = F.get(F.filter("fields", lambda f: f["field_name"] == F.col("field_name")), F.lit(0))
    df = edits.withColumn("target", target)
    t = F.col("target")
    left, right = context_window(text, t["char_start"], t["char_end"], radius)
    context = tx.strip(tx.slice_text(text, left, right))
    df = df.withColumn("extractions", contextual_extractions(F.col("fields"), text, left, right))
    has_target = F.exists("extractions", lambda e: e["extraction_class"] == F.col("field_name"))
    reason = (
        F.when(tx.is_blank(text), SKIP_REASONS[0])
        .when(t.isNull(), SKIP_REASONS[1])
        .when(~grounded(t) | tx.is_blank(t["source_text"]), SKIP_REASONS[2])
        .when(overridden(t), SKIP_REASONS[3])
        .when(~matches_text(t, text), SKIP_REASONS[4])
        .when(context == "", SKIP_REASONS[5])
        .when(~F.coalesce(has_target, F.lit(False)), SKIP_REASONS[6])
    )
    others = [c for c in edits.columns if c not in ("fields", "text")]
    # one row of an inlined array: the optimizer cannot copy what makes it into the steps that filter and group by it
    made = F.array(F.struct(F.col("extractions"), reason.alias("skip_reason"), context.alias("example_text")))
    return df.select(*others, F.inline(made))


def suggestion_json(example_text: Column, extractions: Column) -> Column:
    """Canonical JSON of an example with sorted keys and no blanks."""
    def one(e: Column) -> Column:
        rest = F.to_json(F.struct(e["extraction_class"].alias("extraction_class"), e["extraction_text"].alias("extraction_text")))
        return F.concat(F.lit('{"attributes":'), e["attributes"], F.lit(","), F.substring(rest, 2, 2**31 - 1))

    head = F.to_json(F.struct(example_text.alias("example_text")))
    body = F.array_join(F.transform(extractions, one), ",")
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"extractions":['), body, F.lit("]}"))


def suggestion_key(example_text: Column, extractions: Column) -> Column:
    return F.substring(suggestion_digest(example_text, extractions), 1, KEY_LENGTH)


def suggestion_digest(example_text: Column, extractions: Column) -> Column:
    return F.sha2(suggestion_json(example_text, extractions), 256)


def mined(candidates: DataFrame) -> DataFrame:
    """Everything that suggestions and diagnostics count, from one pass over the candidates.

    One row per tenant, template version and either skip reason or suggestion: n_edits, n_source_results, field names, last review and, for a
    suggestion, its key and one example. The grouping key is the whole digest, shown by its first 16 characters.
    """
    keys = ["_digest", "tenant_id", "template_version_id", "skip_reason"]
    kept = F.col("skip_reason").isNull()
    digest = F.when(kept, suggestion_digest(F.col("example_text"), F.col("extractions")))
    keyed = candidates.withColumns({"_digest": digest, "_result": F.when(kept, F.col("result_id"))})
    # A popular example may come from a third of all results: counts per result first, then small sums.
    per_result = keyed.groupBy(*keys, "_result").agg(
        F.sum("n_edits").alias("n_edits"), F.max("reviewed_at").alias("reviewed_at"),
        F.collect_set("field_name").alias("names"),
        F.first("example_text").alias("example_text"), F.first("extractions").alias("extractions"))
    return per_result.groupBy(*keys).agg(
        F.sum("n_edits").alias("occurrence_count"),
        F.count(F.lit(1)).alias("n_source_results"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("source_field_names"),
        F.max("reviewed_at").alias("last_reviewed_at"),
        F.first("example_text").alias("example_text"),
        F.first("extractions").alias("extractions"),
    ).withColumn("suggestion_key", F.substring("_digest", 1, KEY_LENGTH)).drop("_digest")


def suggestions(candidates: DataFrame) -> DataFrame:
    """Candidates grouped by key within tenant and template version: occurrences, results, fields, last review, one example."""
    return suggestions_of(mined(candidates))


def suggestions_of(counted: DataFrame) -> DataFrame:
    return counted.filter("skip_reason IS NULL").select(
        "tenant_id", "template_version_id", "suggestion_key", "occurrence_count", "n_source_results", "source_field_names", "last_reviewed_at",
        "example_text", "extractions")


def suggestion_results(candidates: DataFrame) -> DataFrame:
    """The distinct source results of every suggestion, one row each (a list would be unbounded)."""
    kept = candidates.filter("skip_reason IS NULL").withColumn(
        "suggestion_key", suggestion_key(F.col("example_text"), F.col("extractions")))
    return kept.select("tenant_id", "template_version_id", "suggestion_key", "result_id").distinct()


def dismiss(decisions: DataFrame) -> DataFrame:
    """Latest decision per tenant, template version and key."""
    return decisions.groupBy("suggestion_key", "tenant_id", "template_version_id").agg(
        F.max_by("dismissed", "updated_at").alias("dismissed"), F.max("updated_at").alias("updated_at"))


def visible_suggestions(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions that are not dismissed, most frequent first."""
    dismissed = dismiss(decisions).filter("dismissed")
    keys = ["suggestion_key", "tenant_id", "template_version_id"]
    return found.join(dismissed.select(*keys), keys, "left_anti").orderBy(
        F.desc("occurrence_count"), F.coalesce(F.col("last_reviewed_at").cast("string"), F.lit("")), "suggestion_key")


def feedback_diagnostics(
    results: DataFrame, jobs: DataFrame, edits: DataFrame, candidates: DataFrame, found: DataFrame | None, decisions: DataFrame,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Twelve counters per tenant and template version.

    `reviewed_result_count` counts all results of the version, edited or not. Suggestions and skips come from one pass over the candidates;
    counted: the stored outcome of `mined`, so that they are not gone through again. `found` is not needed.
    """
    keys = ["tenant_id", "template_version_id"]
    counted = mined(candidates) if counted is None else counted
    versioned = results.join(jobs.select("tenant_id", "job_id", "template_version_id"), ["job_id", "tenant_id"])
    all_results = versioned.groupBy(*keys).agg(F.count(F.lit(1)).alias("reviewed_result_count"))
    all_edits = edit_counts(edits).join(versioned.select("tenant_id", "result_id", "template_version_id"), ["result_id", "tenant_id"])
    edit_totals = all_edits.groupBy(*keys).agg(F.sum("n_edits").alias("reviewed_edit_count"))
    dismissed = dismiss(decisions).filter("dismissed").withColumn("_gone", F.lit(True))
    kept, gone = F.col("skip_reason").isNull(), F.coalesce("_gone", F.lit(False))
    outcome = counted.select(*keys, "skip_reason", "suggestion_key", "occurrence_count").join(
        dismissed.select(*keys, "suggestion_key", "_gone"), ["suggestion_key", *keys], "left").groupBy(*keys).agg(
        F.count_if(kept).alias("generated_suggestion_count"),
        F.count_if(kept & gone).alias("dismissed_suggestion_count"),
        F.count_if(kept & ~gone).alias("visible_suggestion_count"),
        *[F.sum(F.when(F.col("skip_reason") == r, F.col("occurrence_count")).otherwise(0)).alias(f"skipped_{r}") for r in SKIP_REASONS])
    joined = all_results
    for part in (edit_totals, outcome):
        joined = joined.join(part, keys, "left")
    return joined.fillna(0)
