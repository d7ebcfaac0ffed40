"""Human review: approvals, edits, edit log, recalculation, export gate, reviewer drafts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweft.functions import text as tx
from docweft.functions.values import display_value, draft_value
from docweft.operators.calculate import calculated_fields
from docweft.operators.reconcile import RESULT_FIELDS
from docweft.schema import Template, value_json

# ---- fixed values -------------------------------------------------------------------------------
HIGH_CONFIDENCE = 0.85
DEFAULT_REVIEWER = "local-user"
NEEDS_CONFIRMATION = "This field needs confirmation before export."
EXPORT_BLOCKED = "Export blocked until review is cleared. Save review decisions for all fields requiring review."
REVIEW_POLICY_KEY = "export.require_review_cleared"
EDIT_REASON = "Updated from extraction workspace"


def is_high_confidence(minimum: float = HIGH_CONFIDENCE) -> Column:
    return F.coalesce(F.col("requires_review") & (F.col("validation_status") != "invalid")
                      & (F.col("confidence") >= minimum), F.lit(False))


def _approve(results: DataFrame, approved: Column) -> DataFrame:
    return results.withColumns({
        "validation_status": F.when(approved, "reviewed").otherwise(F.col("validation_status")),
        "requires_review": F.col("requires_review") & ~approved,
    })


def approve_high_confidence(results: DataFrame, minimum: float = HIGH_CONFIDENCE) -> DataFrame:
    """Mark flagged, not invalid fields at or above the confidence as reviewed."""
    return _approve(results, is_high_confidence(minimum))


def approve_all(results: DataFrame, edits: DataFrame, key: str = "result_id") -> DataFrame:
    """Mark every flagged field of results that have no edits as reviewed."""
    edited = edits.select(key).distinct().withColumn("_edited", F.lit(True))
    joined = results.join(edited, key, "left")
    return _approve(joined, F.col("_edited").isNull() & F.col("requires_review")).drop("_edited")


def last_edits(edits: DataFrame, key: str = "result_id") -> DataFrame:
    """The last edit per result and field; the extracted text is the last one that was given.

    Max-by aggregations combine on the map side, so a field edited very often stays cheap.
    """
    given = F.when(F.col("extracted_value").isNotNull(), F.struct("seq", "extracted_value"))
    last = edits.groupBy(key, "field_name").agg(
        F.max_by("new_value", "seq").alias("edit_value"), F.max(given).alias("_given"), F.lit(True).alias("_edited"))
    return last.select(key, "field_name", "edit_value", F.col("_given.extracted_value").alias("edit_extracted"), "_edited")


def apply_edits(results: DataFrame, edits: DataFrame, key: str = "result_id") -> DataFrame:
    """Results with the reviewers' values: last edit wins, status reviewed, flag cleared."""
    joined = results.join(last_edits(edits, key), [key, "field_name"], "left")
    edited = F.coalesce("_edited", F.lit(False))
    return joined.withColumns({
        "normalized_value": F.when(edited, F.col("edit_value")).otherwise(F.col("normalized_value")),
        "extracted_value": F.coalesce("edit_extracted", "extracted_value"),
        "validation_status": F.when(edited, "reviewed").otherwise(F.col("validation_status")),
        "requires_review": F.col("requires_review") & ~edited,
    }).drop("edit_value", "edit_extracted", "_edited")


def unknown_edits(edits: DataFrame, results: DataFrame, key: str = "result_id") -> DataFrame:
    """Edits of fields their result does not have."""
    return edits.join(results.select(key, "field_name"), [key, "field_name"], "left_anti")


def edit_log(edits: DataFrame, results: DataFrame, key: str = "result_id") -> DataFrame:
    """Every edit with the value it replaced: the previous edit's value, else the stored one."""
    order = Window.partitionBy(key, "field_name").orderBy("seq")
    chained = edits.withColumn("_first", F.row_number().over(order) == 1).withColumn(
        "_prior", F.lag("new_value").over(order))
    stored = results.select(key, "field_name", F.col("normalized_value").alias("_stored"))
    joined = chained.join(stored, [key, "field_name"], "inner")
    return joined.withColumn("previous_value", F.when(F.col("_first"), F.col("_stored")).otherwise(F.col("_prior"))).drop(
        "_first", "_prior", "_stored")


def widen(results: DataFrame, template: Template, keys: Sequence[str] = ("result_id",)) -> DataFrame:
    """Long results back to one row per result: one aggregation on the result key."""
    row = F.struct(*[F.col(c) for c in RESULT_FIELDS])
    return results.groupBy(*keys).agg(*[
        F.max(F.when(F.col("field_name") == name, row)).alias(name) for name in template.field_names])


def recalculate_after_review(
    results: DataFrame, template: Template, keys: Sequence[str] = ("result_id",)
) -> DataFrame:
    """Wide results with fresh calculated fields; clean ones count as reviewed, flagged ones stay open."""
    wide = calculated_fields(widen(results, template, keys), template, keys)

    def reviewed(name: str) -> Column:
        status = F.when(F.col(name)["requires_review"], F.col(name)["validation_status"]).otherwise("reviewed")
        return F.col(name).withField("validation_status", status)

    return wide.withColumns({c.name: reviewed(c.name) for c in template.calcs}).withColumn(
        "review_status", F.lit("reviewed"))


def latest_reviewer(results: DataFrame, edits: DataFrame, key: str = "result_id") -> DataFrame:
    newest = edits.groupBy(key).agg(F.max_by("reviewer", F.struct("created_at", "seq")).alias("reviewer"))
    return results.select(key).distinct().join(newest, key, "left").withColumn(
        "reviewer", F.coalesce("reviewer", F.lit(DEFAULT_REVIEWER)))


def tenant_flags(settings: DataFrame, name: str) -> DataFrame:
    """Tenant boolean settings `tenant:{id}:{name}`: the value itself or its `enabled` member."""
    parts = F.split("key", ":", 3)
    enabled = F.coalesce(F.get_json_object("value", "$.enabled"), F.col("value")).try_cast("boolean")
    return settings.filter((F.get(parts, F.lit(0)) == "tenant") & (F.get(parts, F.lit(2)) == name)).select(
        F.get(parts, F.lit(1)).alias("tenant_id"), F.coalesce(enabled, F.lit(False)).alias("enabled"))


def export_gate(results: DataFrame, policies: DataFrame) -> DataFrame:
    """Per result (tenant_id, review_status, open_fields) whether its export is blocked, and why."""
    joined = results.join(policies.select("tenant_id", "enabled"), "tenant_id", "left")
    blocked = F.coalesce("enabled", F.lit(False)) & ((F.col("review_status") == "pending") | (F.col("open_fields") > 0))
    return joined.withColumn("export_blocked", blocked).withColumn(
        "block_reason", F.when(blocked, EXPORT_BLOCKED)).drop("enabled")


def typed_edit_values(drafts: DataFrame) -> DataFrame:
    """Reviewer drafts (label, data_type, draft, existing_currency) to `new_value` and `draft_error`."""
    value, error = draft_value(F.col("label"), F.col("data_type"), F.col("draft"), F.col("existing_currency"))
    return drafts.withColumn("new_value", value).withColumn("draft_error", error)


def changed_edits(drafts: DataFrame) -> DataFrame:
    """Drop drafts whose value equals the field's normalized value, or its extracted text when it has none."""
    new = value_json(F.col("new_value"), F.col("data_type"))
    # An extracted text is a bare string, so only an empty draft of an empty field equals it.
    extracted = F.concat(F.lit('"'), F.col("extracted_value"), F.lit('"'))
    original = F.coalesce(value_json(F.col("normalized_value"), F.col("data_type")), extracted)
    # Expanding the kept row instead of filtering: a filter would be pushed below the draft parsing and
    # evaluate all of it a second time.
    kept = F.when(~new.eqNullSafe(original), F.array(F.struct(*drafts.columns, F.lit(EDIT_REASON).alias("reason"))))
    return drafts.select(F.inline(kept))


def review_reasons(results: DataFrame) -> DataFrame:
    """Distinct trimmed errors and notes of a field; flagged fields without any get a default."""
    noted = F.when(F.coalesce("notes", F.lit("")) != "", F.array("notes")).otherwise(F.array().cast("array<string>"))
    signals = F.concat("validation_errors", noted)
    default = F.when((F.size(signals) == 0) & F.col("requires_review"), F.array(F.lit(NEEDS_CONFIRMATION))).otherwise(signals)
    cleaned = F.filter(F.transform(default, tx.strip), lambda s: s != "")
    return results.withColumn("review_reasons", F.array_distinct(cleaned))


def with_display_value(results: DataFrame) -> DataFrame:
    return results.withColumn("display_value", display_value(F.col("normalized_value"), F.col("data_type")))
