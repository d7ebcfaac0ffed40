"""The main plan: documents to result envelopes under a deployment's rules, in one pass over the rows.

Policy, redaction, chunks, extraction, clearing of masked values, reconciliation, validation, notes, calculation and envelope all
happen inside a document's row: a text is read once, reduced to short hits, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docweft.functions import spans as sp, text as tx
from docweft.operators import redaction as rd
from docweft.operators.calculate import complete_wide, result_envelope
from docweft.operators.extract import rule_candidate, rule_hit
from docweft.operators.reconcile import reconcile_in_rows, reconcile_offered, unexpected_notes
from docweft.operators.text_prep import DEFAULT_OVERLAP
from docweft.schema import CANDIDATE_COLUMNS, FieldDef, Template



@dataclass(frozen=True)
class Deployment:
    """What a deployment allows: external providers at all, and only with redacted texts."""

    allow_external: bool = True
    require_redaction: bool = False
    redaction_enabled: bool = True
    entities: tuple[str, ...] = tuple(rd.ENTITY_PATTERNS)

    def redacts(self, external: bool) -> bool:
        return external and self.require_redaction

    def refusal(self, external: bool, filename: Column | None) -> Column:
        """Why a document is not processed; null for those that are."""
        if external and not self.allow_external:
            return F.lit(rd.EXTERNAL_DISABLED)
        if self.redacts(external) and not self.redaction_enabled:
            return F.lit(rd.REDACTION_DISABLED)
        if self.redacts(external) and filename is not None:
            return F.when(F.regexp_like(filename, F.lit(rd.UNREDACTED_PATTERN)), rd.SPREADSHEET_NOT_REDACTED)
        return F.lit(None).cast("string")


def rule_candidates(hits: Column, field: FieldDef, masked: bool, label: bool) -> Column:
    """The candidates of one field from its hits, one per chunk of a row, with the label of their chunk; masked ones cleared."""
    def candidate(hit: Column, at: Column) -> Column:
        found = rule_candidate(hit, field)
        if label:
            note = F.concat(F.lit("Chunk "), (at + 1).cast("string"), F.lit("/"), F.size(hits).cast("string"), F.lit("."))
            found["notes"] = tx.append_note(found["notes"], note)
        if masked:
            found |= rd.cleared(found.__getitem__)
        return F.struct(*[found[c].alias(c) for c in CANDIDATE_COLUMNS], at.cast("bigint").alias("seq"))

    return F.transform(hits, candidate)


def extract_in_rows(
    docs: DataFrame, template: Template, others: Sequence[str], chunk_size: int = 0, overlap: int = DEFAULT_OVERLAP, masked: bool = False, text: str = "text",
) -> DataFrame:
    """Others and the reconciled fields of each document by the rule extractor; chunk_size 0 takes the text as one chunk."""
    body = tx.strip(F.coalesce(F.col(text), F.lit("")))
    chunked = docs.select(*others, sp.chunks_of(body, chunk_size, overlap).alias("_chunks")) if chunk_size > 0 else (
        docs.select(*others, F.array(F.struct(body.alias("chunk"))).alias("_chunks")))
    read = chunked.select(*others, F.transform("_chunks", lambda c: F.struct(c["chunk"].alias("text"), F.lower(c["chunk"]).alias("low"))).alias("_chunks"))

    def hits(field: FieldDef) -> Column:
        return F.transform("_chunks", lambda c: rule_hit(c["text"], field, c["low"])).alias(f"_hits_{field.name}")

    found = read.select(*others, *[hits(f) for f in template.fields])
    return reconcile_in_rows(found, {f.name: rule_candidates(F.col(f"_hits_{f.name}"), f, masked, chunk_size > 0) for f in template.fields}, others)


def process_documents(
    docs: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",), deployment: Deployment = Deployment(),
    chunk_size: int = 0, overlap: int = DEFAULT_OVERLAP, candidates: str | None = None,
) -> DataFrame:
    """One result envelope per document, with error_message; a refused document has status `failed` and no fields.

    docs: keys, text, optionally original_filename. candidates: a column with an array of candidates another extractor found (structs
    of field_name, seq and the candidate columns); without it the rule extractor reads the text. Document notes name
    fields that the template does not define, in the order of the candidates, and the redaction applied. A null text counts as empty.
    """
    external = bool(template.provider.get("allow_external_processing"))
    redacts = deployment.redacts(external)
    filename = F.col("original_filename") if "original_filename" in docs.columns else None
    base = docs.select(*keys, "text", deployment.refusal(external, filename).alias("_refused"), *([candidates] if candidates else []))
    none = F.array().cast("array<string>")
    notes = none
    others = [*keys, "_refused"]
    if redacts:
        base = rd.redact(base, deployment.entities)
        notes = F.array("redaction_note")
    if candidates is None:
        wide = extract_in_rows(base.withColumn("_notes", notes), template, [*others, "_notes"], chunk_size, overlap, redacts)
    else:
        offered = F.coalesce(F.col(candidates), F.array().cast(docs.schema[candidates].dataType))
        if redacts:
            offered = F.transform(offered, _cleared)
        base = base.select(*others, notes.alias("_later"), offered.alias("_all"))
        base = base.withColumn("_notes", F.concat(unexpected_notes(F.col("_all"), template), "_later"))
        wide = reconcile_offered(base, "_all", template.field_names, [*others, "_notes"])
    complete = complete_wide(wide, template, [*others, "_notes"])
    envelope = result_envelope(complete, template, others, F.col("_notes"))
    return refused(envelope, keys)


def _cleared(candidate: Column) -> Column:
    changed = rd.cleared(lambda name: candidate[name])
    return F.struct(*[changed.get(c, candidate[c]).alias(c) for c in ("field_name", "seq", *CANDIDATE_COLUMNS)])


def refused(envelope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Envelopes whose document was refused lose their results and get the reason."""
    done = F.col("_refused").isNull()
    kept = ("document_type", "template_name", "template_version", "llm_provider")
    members = [c for c in envelope.columns if c not in (*keys, *kept, "_refused", "extraction_status")]
    return envelope.select(
        *keys, *kept, F.when(done, F.col("extraction_status")).otherwise("failed").alias("extraction_status"),
        *[F.when(done, F.col(c)).alias(c) for c in members], F.col("_refused").alias("error_message"))
