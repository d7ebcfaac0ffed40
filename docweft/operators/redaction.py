"""Personal-data redaction: detect entity spans, merge them, mask the text, count, clear results.

A document and its spans stay in one row from detection to masking, so redacting is row-local: nothing
is shuffled, and a document with very many spans loads only its own row. Finding, merging and masking go over Arrow batches
(`functions/spans.py`) in time that grows with the text and the number of its spans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweft.functions import spans as sp, text as tx
from docweft.schema import null_value

# ---- fixed values -------------------------------------------------------------------------------
ENTITY_PATTERNS = {
    "EMAIL_ADDRESS": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}\b",
    "PHONE_NUMBER": r"(?:(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4})",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,16}\b",
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IBAN_CODE": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
}
MASK_CHAR = "*"
CLEARED_NOTE = (
    "External-provider evidence contained redacted spans, so the extracted value was cleared for review."
)
EXTERNAL_DISABLED = (
    "This deployment disables external provider processing. Choose a local provider or enable "
    "ALLOW_EXTERNAL_PROCESSING."
)
REDACTION_DISABLED = (
    "This deployment requires document redaction before external provider processing, but Presidio "
    "redaction is disabled. Enable PRESIDIO_REDACTION_ENABLED or disable "
    "REQUIRE_REDACTION_FOR_EXTERNAL_PROCESSING."
)
SPREADSHEET_UNSUPPORTED = (
    "This deployment requires redaction before external provider processing, and spreadsheet "
    "documents are not yet supported for that path. Use a local provider or export the sheet to PDF."
)
SPREADSHEET_PATTERN = r"(?i)\.(csv|xlsx|xls)\z"
SPREADSHEET_NOT_REDACTED = (
    "This deployment requires redaction before external provider processing, and spreadsheet "
    "documents are not yet supported by the Presidio redaction flow."
)
UNREDACTED_PATTERN = r"(?i)\.(csv|xlsx)\z"
#: What a text must hold for an entity of the type to be in it: this character, or a digit.
_NEEDED = {"EMAIL_ADDRESS": "@"}


def _patterns(types: Sequence[str]) -> dict[str, tuple[str, str]]:
    unknown = [t for t in types if t not in ENTITY_PATTERNS]
    if unknown:
        raise ValueError(f"Unsupported redaction entity type: {unknown[0]}.")
    return {t: (_NEEDED.get(t, "digit"), ENTITY_PATTERNS[t]) for t in types}


def entity_spans(text: Column, types: Sequence[str]) -> Column:
    """Array of (start, end, entity_type) of every match of the types' patterns; empty for a null text."""
    return sp.spans_of(text, _patterns(types)) if types else F.array().cast(sp.SPAN_ARRAY)


def detect_entities(docs: DataFrame, types: Sequence[str] = tuple(ENTITY_PATTERNS), text: str = "text") -> DataFrame:
    """One row per entity span: the document's columns without its text, start, end, entity type."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, entity_spans(F.col(text), types).alias("_spans")).select(*others, F.explode("_spans").alias("_s")).select(
        *others, F.col("_s.start").alias("char_start"), F.col("_s.end").alias("char_end"),
        F.col("_s.entity_type").alias("entity_type"))


def merge_spans(spans: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Merge overlapping or touching spans of a document; the earliest, then longest span names the type.

    For spans kept as a table. Group size is bounded by one document's text.
    """
    order = Window.partitionBy(*keys).orderBy("char_start", F.desc("char_end"), "entity_type")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce((F.col("char_start") > F.max("char_end").over(before)).cast("int"), F.lit(1))
    islands = spans.withColumn("_new", starts).withColumn("_island", F.sum("_new").over(order))
    first = F.min(F.struct("char_start", (-F.col("char_end")).alias("e"), "entity_type"))
    return (
        islands.groupBy(*keys, "_island")
        .agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), first.alias("_first"))
        .select(*keys, "char_start", "char_end", F.col("_first.entity_type").alias("entity_type"))
    )


def merged(spans: Column) -> Column:
    """`merge_spans` on the span array of one row."""
    return sp.merged_spans(spans)


def redaction_note(spans: Column) -> Column:
    n_types = F.size(F.array_distinct(F.transform(spans, lambda s: s["entity_type"])))
    return F.concat(F.lit("External provider text redaction applied for "), F.size(spans).cast("string"),
                    F.lit(" spans across "), n_types.cast("string"), F.lit(" entity types."))


def redact(docs: DataFrame, types: Sequence[str] = tuple(ENTITY_PATTERNS), text: str = "text") -> DataFrame:
    """Masked text plus the merged spans of every document, without any shuffle."""
    found = docs.withColumn("_redacted", sp.redacted(F.col(text), _patterns(types), MASK_CHAR))
    return found.withColumns({text: F.col("_redacted.text"), "spans": F.col("_redacted.spans")}).drop("_redacted").withColumns({
        "span_count": F.size("spans"), "redaction_note": redaction_note(F.col("spans"))})


def mask_spans(docs: DataFrame, spans: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Mask documents by a table of spans (any order, overlaps allowed)."""
    packed = spans.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("char_start").alias("start"), F.col("char_end").alias("end"), "entity_type")).alias("_spans"))
    joined = docs.join(packed, list(keys), "left")
    return joined.withColumn("text", sp.masked_by(F.col("text"), F.col("_spans"), MASK_CHAR)).drop("_spans")


def redaction_counts(spans: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Merged spans per entity type and in total, per document (or corpus with no keys)."""
    per_type = [F.count_if(F.col("entity_type") == t).alias(t.lower()) for t in ENTITY_PATTERNS]
    total = F.count(F.lit(1)).alias("span_count")
    kinds = reduce(lambda a, b: a + b, [(F.col(t.lower()) > 0).cast("int") for t in ENTITY_PATTERNS])
    return spans.groupBy(*keys).agg(*per_type, total).withColumn("note", F.concat(
        F.lit("External provider text redaction applied for "), F.col("span_count").cast("string"),
        F.lit(" spans across "), kinds.cast("string"), F.lit(" entity types.")))


def cleared(of: Callable[[str], Column]) -> dict[str, Column]:
    """What becomes of a candidate whose evidence or value holds a mask character: its value is cleared and flagged. of: a member by name."""
    masked = F.coalesce(F.contains(of("source_text"), F.lit(MASK_CHAR)), F.lit(False)) | F.coalesce(
        F.contains(of("extracted_value"), F.lit(MASK_CHAR)), F.lit(False))
    return {
        "extracted_value": F.when(~masked, of("extracted_value")),
        "normalized_value": F.when(masked, null_value()).otherwise(of("normalized_value")),
        "requires_review": masked | of("requires_review"),
        "notes": F.when(masked, tx.append_note(of("notes"), F.lit(CLEARED_NOTE))).otherwise(of("notes")),
    }


def clear_redacted_results(candidates: DataFrame) -> DataFrame:
    """Null the values of candidates whose evidence or value holds a mask character, and flag them."""
    return candidates.withColumns(cleared(F.col))


def external_processing_policy(
    jobs: DataFrame, allow_external: bool, require_redaction: bool, redaction_enabled: bool
) -> DataFrame:
    """Verdict per job from its provider's `allow_external_processing` and its document's filename."""
    wants = F.col("allow_external_processing")
    verdict = F.when(~wants, None)
    if not allow_external:
        verdict = verdict.when(wants, EXTERNAL_DISABLED)
    if require_redaction:
        if not redaction_enabled:
            verdict = verdict.when(wants, REDACTION_DISABLED)
        verdict = verdict.when(F.regexp_like("original_filename", F.lit(SPREADSHEET_PATTERN)), SPREADSHEET_UNSUPPORTED)
    return jobs.withColumn("block_reason", verdict).withColumn("blocked", F.col("block_reason").isNotNull())
