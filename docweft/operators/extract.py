"""Extraction: rule-based candidates, logged model replies, grounded annotations, pluggable extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docweft.functions import spans as sp, text as tx
from docweft.functions.values import first_match, normalize_value
from docweft.operators.text_prep import page_reference
from docweft.schema import CANDIDATE_DDL, FieldDef, Template, null_value, value_struct

# ---- fixed values -------------------------------------------------------------------------------
RULE_CURRENCY = r"\$?\s?(\d[\d,]*(?:\.\d{1,2})?)"
RULE_DATE = r"\b(20\d{2}-\d{2}-\d{2})\b"
RULE_NUMBER = r"\b(\d+(?:\.\d+)?)\b"
SNIPPET_CHARS = 240
CONFIDENCE = {"currency": 0.72, "date": 0.70, "boolean": 0.60, "number": 0.65, "snippet": 0.58, "miss": 0.35}
REVIEW_BELOW = 0.75
FOUND_NOTE = "Mock extraction used."
MISS_NOTE = "No value identified by mock extractor."
NO_CONTENT = "Provider response did not include choices[0].message.content."
NO_FIELD_LIST = "Provider response must include an extracted_fields list."
NOT_JSON = "Provider response content must be a JSON string or object."
UNGROUNDED_NOTE = "LangExtract returned an ungrounded extraction."


def rule_hit(text: Column, field: FieldDef, lowered: Column | None = None) -> Column:
    """The text a field's rule finds in a document, null when it finds nothing. The only pass over the text.

    lowered: the text in lower case, where it is at hand.
    """
    spoken_name = field.name.replace("_", " ")
    if field.type == "currency":
        return first_match(text, RULE_CURRENCY)
    if field.type == "date":
        return first_match(text, RULE_DATE, 1)
    if field.type == "number":
        return first_match(text, RULE_NUMBER, 1)
    lowered = F.lower(text) if lowered is None else lowered
    if field.type == "boolean":
        return F.when(F.contains(lowered, F.lit(spoken_name)), "true")
    named = F.contains(lowered, F.lit(field.label.lower())) | F.contains(lowered, F.lit(spoken_name))
    return F.when(named, tx.strip(F.substring(text, 1, SNIPPET_CHARS)))


def rule_candidate(hit: Column, field: FieldDef) -> dict[str, Column]:
    """The candidate columns of one field from its rule's hit."""
    source = hit
    if field.type == "currency":
        hit = source = tx.strip(hit)
        digits = F.translate(hit, "$," + tx.BLANKS, "")
        value = value_struct(amount=digits.try_cast("double"), currency=F.lit(field.rules.currency or "USD"), display_value=hit)
    elif field.type == "date":
        value = value_struct(text=hit, display_value=hit)
    elif field.type == "number":
        value = value_struct(number=hit.try_cast("double"))
    elif field.type == "boolean":
        source = F.when(hit.isNotNull(), field.name)
        value = value_struct(flag=F.lit(True))
    else:
        value = value_struct(text=hit)

    found, sourced = hit.isNotNull(), F.coalesce(source != "", F.lit(False))
    score = CONFIDENCE.get(field.type, CONFIDENCE["snippet"])
    return {
        "extracted_value": hit,
        "normalized_value": F.when(found, value).otherwise(null_value()),
        "confidence": F.when(found, score).otherwise(CONFIDENCE["miss"]),
        "source_text": F.coalesce(source, F.lit("")),
        "char_start": F.lit(None).cast("int"),
        "char_end": F.lit(None).cast("int"),
        "page_number": F.when(sourced, 1),
        "location_reference": F.when(sourced, "Page 1").otherwise(""),
        "notes": F.when(sourced, FOUND_NOTE).otherwise(MISS_NOTE),
        "requires_review": F.when(found, score < REVIEW_BELOW).otherwise(CONFIDENCE["miss"] < REVIEW_BELOW),
    }


def rule_hits(docs: DataFrame, template: Template, others: Sequence[str], text: str = "text") -> DataFrame:
    """Documents reduced to one short hit column per field, so that later steps never touch the text again."""
    return docs.select(*others, *[rule_hit(F.col(text), f).alias(f"_hit_{f.name}") for f in template.fields])


def rule_extract(docs: DataFrame, template: Template, text: str = "text") -> DataFrame:
    """One candidate per document (or chunk) and template field; the text itself is dropped.

    The fields are expanded inside the row, so no definitions table is joined.
    """
    others = [c for c in docs.columns if c != text]
    hits = rule_hits(docs, template, others, text)
    candidates = F.array(*[
        F.struct(F.lit(f.name).alias("field_name"), F.lit(0).cast("bigint").alias("seq"),
                 *[c.alias(n) for n, c in rule_candidate(F.col(f"_hit_{f.name}"), f).items()])
        for f in template.fields])
    return hits.select(*others, F.inline(candidates))


def parse_extraction_responses(responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Logged model replies (`response` JSON text) to one row per extracted field, or one error row.

    Replies carry their content as JSON text or as an object under `choices[0].message.content`.
    """
    content = F.get_json_object("response", "$.choices[0].message.content")
    body = F.try_parse_json(content)
    fields = F.try_variant_get(body, "$.extracted_fields", "array<variant>")
    error = (
        F.when(content.isNull(), NO_CONTENT)
        .when(body.isNull(), NOT_JSON)
        .when(fields.isNull(), NO_FIELD_LIST)
    )
    parsed = responses.select(key, error.alias("error"), F.posexplode_outer(fields).alias("seq", "item"))

    def member(name: str, kind: str) -> Column:
        return F.try_variant_get("item", f"$.{name}", kind)

    value = F.get_json_object(F.to_json("item"), "$.normalized_value")
    return parsed.select(
        key,
        F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"),
        member("field_name", "string").alias("field_name"),
        member("label", "string").alias("label"),
        member("data_type", "string").alias("data_type"),
        member("extracted_value", "string").alias("extracted_value"),
        value.alias("normalized_json"),
        F.coalesce(member("confidence_score", "double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(member("source_text", "string"), F.lit("")).alias("source_text"),
        F.coalesce(member("requires_review", "boolean"), F.lit(False)).alias("requires_review"),
        "error",
    )


def ground_annotations(
    annotations: DataFrame, docs: DataFrame, defs: DataFrame, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Annotations (class, text, attributes, char_start, char_end) to candidates grounded in their document.

    `defs` holds field_name, label, data_type, currency. A document's annotations are gathered before they meet its text, so a
    text is shuffled once, not once per annotation; its page markers are found once and looked up by binary search.
    """
    known = annotations.join(
        defs.select(F.col("field_name").alias("extraction_class"), "label", "data_type", "currency"),
        "extraction_class", "left")
    inside = [c for c in known.columns if c not in keys]
    gathered = known.groupBy(*keys).agg(F.collect_list(F.struct(*inside)).alias("_all"))
    spans = F.transform("_all", lambda a: F.struct(a["char_start"].alias("start"), a["char_end"].alias("end")))
    met = gathered.join(docs.select(*keys, "text"), list(keys)).withColumn("_cited", sp.cited(F.col("text"), spans))
    joined = met.select(*keys, F.explode(F.arrays_zip("_all", "_cited")).alias("_a")).select(
        *keys, "_a._all.*", F.col("_a._cited.source").alias("_source"), F.col("_a._cited.page").alias("_page"))
    start, end = F.col("char_start"), F.col("char_end")
    grounded = F.coalesce((start >= 0) & (end >= start), F.lit(False))
    extracted = tx.strip(F.col("extraction_text"))
    known = F.col("data_type").isNotNull()
    value = normalize_value(F.col("data_type"), extracted, F.col("attributes"), F.col("currency"))
    page = F.col("_page")
    span_note = F.concat(F.lit("LangExtract grounded chars "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("."))
    trusted = grounded & (value.isNotNull() | ~known)
    return joined.select(
        *keys,
        F.col("extraction_class").alias("field_name"),
        "seq",
        F.coalesce("label", "extraction_class").alias("label"),
        F.coalesce("data_type", F.lit("text")).alias("data_type"),
        F.when(known, F.nullif(extracted, F.lit(""))).otherwise(extracted).alias("extracted_value"),
        value.alias("normalized_value"),
        F.when(trusted, 1.0).otherwise(0.0).alias("confidence"),
        F.coalesce("_source", F.lit("")).alias("source_text"),
        F.when(grounded, start).alias("char_start"),
        F.when(grounded, end).alias("char_end"),
        page.alias("page_number"),
        page_reference(page).alias("location_reference"),
        F.when(grounded, span_note).otherwise(UNGROUNDED_NOTE).alias("notes"),
        (~grounded).alias("requires_review"),
    )


def extract_batches(
    docs: DataFrame, extractor: Callable[[pa.Array], pa.RecordBatch], keys: Sequence[str] = ("doc_id",), text: str = "text",
) -> DataFrame:
    """Candidates from a user-supplied function of a batch of texts to a batch of candidates, with an `error` column.

    The function's batch has `row` (the text's position in the batch), any of the candidate columns, of types that cast to
    theirs, and maybe seq (else the order within the text). If it raises, the batch is halved until the texts at fault are
    alone: each gives one row with the error. A column the contract does not know is an error of the whole job. The function must
    give the same answer when a task is retried.
    """
    key_fields = [f for f in docs.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + ", " + CANDIDATE_DDL + ", error string"
    types = to_arrow_schema(T._parse_datatype_string(schema))
    known = {"row", *types.names[len(key_fields) :]} - {"error"}

    def guarded(texts: pa.Array) -> list[tuple[int, pa.RecordBatch | str]]:
        """Pieces of the answer, each with the position of its first text, or the error of a text."""
        try:
            found = extractor(texts)
        except Exception as error:  # noqa: BLE001 - whatever it is, it becomes a row
            if len(texts) == 1:
                return [(0, f"{type(error).__name__}: {error}")]
            half = len(texts) // 2
            return guarded(texts[:half]) + [(at + half, piece) for at, piece in guarded(texts[half:])]
        if strange := set(found.schema.names) - known:
            raise _ContractError(f"extractor returned columns that candidates do not have: {sorted(strange)}")
        return [(0, found)]

    def rows_of(batch: pa.RecordBatch, at: int, piece: pa.RecordBatch | str) -> pa.RecordBatch:
        failed = isinstance(piece, str)
        rows = np.array([at]) if failed else piece.column("row").to_numpy(zero_copy_only=False).astype(np.int64) + at
        own = {k: batch.column(k).take(pa.array(rows)) for k in keys}
        if not failed:
            own |= {name: piece.column(name) for name in piece.schema.names if name != "row"}
            if "seq" not in own:
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                own["seq"] = pa.array(np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))))
        else:
            own["error"] = pa.array([piece])
        return pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(len(rows), f.type) for f in types], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in guarded(batch.column(text)) if batch.num_rows else []:
                yield rows_of(batch, at, piece)

    return docs.select(*keys, text).mapInArrow(run, schema)


class _ContractError(Exception):
    """Not caught with a text's own errors: it raises out of `run`."""


def extract_with(
    docs: DataFrame,
    extractor: Callable[[str], list[dict]],
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Candidates from a user-supplied `text -> [candidate dict]` function; a text it fails on ends the job.

    `extract_batches` is the form for functions that take many texts at a time. The function must give the same answer when a task
    is retried.
    """
    kinds = {f.name: f.type for f in to_arrow_schema(T._parse_datatype_string(CANDIDATE_DDL))}
    names = list(kinds)

    def batch(texts: pa.Array) -> pa.RecordBatch:
        columns: dict[str, list] = {name: [] for name in ("row", *names)}
        for row, body in enumerate(texts.to_pylist()):
            for seq, found in enumerate(extractor(body)):
                if unknown := set(found) - set(names):
                    raise ValueError(f"candidates have no {sorted(unknown)}")
                columns["row"].append(row)
                for name in names:
                    columns[name].append(found.get(name, seq if name == "seq" else None))
        return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds.get(name, pa.int64())) for name in columns], names=list(columns))

    found = extract_batches(docs, batch, keys, text)
    failed = F.raise_error(F.concat(F.lit("The extractor failed: "), F.col("error")))
    return found.withColumn("seq", F.when(F.col("error").isNull(), F.col("seq")).otherwise(failed.cast("bigint"))).drop("error")
