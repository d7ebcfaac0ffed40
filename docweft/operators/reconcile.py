"""Reconcile candidates into one result per document and field, then validate the results.

The working layout is wide: one row per document, one struct column per template field. It is reached with
a single aggregation on the document key that keeps only the best candidate per field and task (map-side
combine), so a document that owns a third of all candidates costs no more than any other. Validation,
calculation, review lists and the result envelope are then row-local.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pyspark.sql import Column, DataFrame, functions as F

from docweft.functions import text as tx
from docweft.functions.contracts import as_variant, contract_error, variant_error
from docweft.operators.extract import rule_candidate, rule_hits
from docweft.schema import (
    CANDIDATE_COLUMNS, LIST_TYPES, FieldDef, Template, null_value, typed_value, value_json, value_struct,
)

# ---- fixed values -------------------------------------------------------------------------------
MISSING_FIELD_NOTE = "Provider response did not include this schema field."
REQUIRED_MISSING = "Required field is missing."
NULL_NOT_ALLOWED = "Null is not allowed."
OUTSIDE_ALLOWED = "Value is outside allowed values."
PATTERN_MISMATCH = "Value does not match required pattern."
TOO_LONG = "Value exceeds maximum length."
CITATION_MISSING = "Citation evidence is required."
DEFAULT_SIMILARITY = 0.85

RESULT_FIELDS = [*CANDIDATE_COLUMNS, "n_candidates", "validation_errors", "validation_status"]


def unexpected_fields(candidates: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Notes for candidates whose field the template does not define: one row per document and field name."""
    stray = candidates.filter(~F.col("field_name").isin(template.field_names))
    counted = stray.groupBy(*keys, "field_name").agg(F.count(F.lit(1)).alias("n_candidates"))
    return counted.withColumn(
        "note", F.concat(F.lit("Provider returned unexpected field '"), F.col("field_name"), F.lit("'.")))


def _rank(of: Callable[[str], Column] = F.col) -> Column:
    """Evidence first, then confidence, then length of the citation, then first arrival. of: a candidate's member by name."""
    value, cited = of("normalized_value").isNotNull(), F.coalesce(of("source_text") != "", F.lit(False))
    return F.struct(
        (value.cast("int") + cited.cast("int")).alias("evidence"),
        of("confidence").alias("confidence"),
        F.length(of("source_text")).alias("cited_length"),
        (-of("seq")).alias("arrival"),
    )


def best_candidates(candidates: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Best candidate per document and field in long form, with the number of candidates."""
    payload = F.struct(*[F.col(c) for c in CANDIDATE_COLUMNS])
    picked = candidates.groupBy(*keys, "field_name").agg(
        F.max(F.struct(_rank().alias("rank"), payload.alias("candidate"))).alias("_best"),
        F.count(F.lit(1)).cast("int").alias("n_candidates"),
    )
    note = F.concat(F.lit("Selected highest-confidence match from "), F.col("n_candidates").cast("string"),
                    F.lit(" chunk candidates."))
    several = F.col("n_candidates") > 1
    flat = picked.select(*keys, "field_name", "_best.candidate.*", "n_candidates")
    return flat.withColumns({
        "requires_review": F.col("requires_review") | several,
        "notes": F.when(several, tx.append_note(F.col("notes"), note)).otherwise(F.col("notes")),
    })


def missing_field() -> Column:
    """The candidate of a field nobody proposed."""
    fixed = {
        "normalized_value": null_value(), "confidence": F.lit(0.0), "source_text": F.lit(""),
        "location_reference": F.lit(""), "notes": F.lit(MISSING_FIELD_NOTE), "requires_review": F.lit(True),
    }
    return F.struct(*[fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in CANDIDATE_COLUMNS.items()])


def reconcile_wide(
    candidates: DataFrame, docs: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """One row per document, one struct column per template field: best candidate, count, missing filled in.

    Every document of `docs` appears, also without candidates: the document keys join the same aggregation
    as rows without a field, instead of a second join over documents times fields.
    """
    payload = F.struct(*[F.col(c) for c in CANDIDATE_COLUMNS])
    offered = candidates.filter(F.col("field_name").isin(template.field_names)).select(
        *keys, "field_name", F.struct(_rank().alias("rank"), payload.alias("candidate")).alias("_c"))
    anchors = docs.select(*keys)
    rows = offered.unionByName(anchors, allowMissingColumns=True)
    per_field = []
    for name in template.field_names:
        mine = F.col("field_name") == name
        per_field += [F.max(F.when(mine, F.col("_c"))).alias(f"_best_{name}"), F.count_if(mine).alias(f"_n_{name}")]
    grouped = rows.groupBy(*keys).agg(*per_field)
    return grouped.select(*keys, *[
        _settled(F.col(f"_best_{name}.candidate"), F.col(f"_n_{name}").cast("int")).alias(name)
        for name in template.field_names])


def unexpected_notes(candidates: Column, template: Template) -> Column:
    """Document notes on the candidates of a row's array whose field the template does not define, in their order."""
    stray = F.filter(candidates, lambda c: ~F.coalesce(c["field_name"].isin(template.field_names), F.lit(False)))
    return F.transform(stray, lambda c: F.concat(F.lit("Provider returned unexpected field '"), F.coalesce(c["field_name"], F.lit("None")), F.lit("'.")))


def candidates_of(candidates: Column, field_name: str) -> Column:
    return F.filter(candidates, lambda c: c["field_name"] == field_name)


def reconcile_in_rows(docs: DataFrame, candidates: Mapping[str, Column], others: Sequence[str]) -> DataFrame:
    """`reconcile_wide` for documents that hold all their candidates: others, and a struct column per field of candidates.

    candidates: by field, an array column of structs with the candidate columns and seq. The best one is picked inside the row,
    so nothing is shuffled; how large a row may get is bounded by one document's chunks.
    """
    gathered = docs.select(*others, *[c.alias(f"_all_{name}") for name, c in candidates.items()])
    counted = gathered.select("*", *[F.coalesce(F.size(f"_all_{name}"), F.lit(0)).cast("int").alias(f"_n_{name}") for name in candidates])
    return _picked(counted, {name: (F.col(f"_all_{name}"), F.get(f"_all_{name}", F.lit(0))) for name in candidates}, others)


def reconcile_offered(docs: DataFrame, offered: str, names: Sequence[str], others: Sequence[str]) -> DataFrame:
    """`reconcile_in_rows` for documents with the candidates of all fields in one array column: structs that also have field_name.

    A field's candidate is taken by its position; candidates are gathered by field only where a field has several.
    """
    listed = docs.select(*others, offered, F.col(offered)["field_name"].alias("_names"))
    counted = listed.select(*others, offered, *[
        part for name in names for part in (
            F.array_position("_names", name).cast("int").alias(f"_at_{name}"),
            F.coalesce(F.size("_names") - F.size(F.array_remove("_names", name)), F.lit(0)).cast("int").alias(f"_n_{name}"))])
    return _picked(counted, {
        name: (candidates_of(F.col(offered), name), F.get(F.col(offered), F.col(f"_at_{name}") - 1)) for name in names}, others)


def _picked(counted: DataFrame, candidates: Mapping[str, tuple[Column, Column]], others: Sequence[str]) -> DataFrame:
    """The settled best candidates. candidates: by field, all of them and the first; counted has their number as `_n_` and the field's name.

    Ranking goes through array functions, which are not generated code, and most fields have one candidate or none: those skip it.
    """
    def ranked(c: Column) -> Column:
        payload = F.struct(*[c[name].alias(name) for name in CANDIDATE_COLUMNS])
        return F.struct(_rank(lambda name: c[name]).alias("rank"), payload.alias("payload"), c.alias("candidate"))

    picked = counted.select(*others, *[
        part for name, (every, first) in candidates.items() for part in (
            F.when(F.col(f"_n_{name}") > 1, F.array_max(F.transform(every, ranked))["candidate"]).otherwise(first).alias(f"_best_{name}"),
            F.col(f"_n_{name}"))])
    return picked.select(*others, *[_settled(F.col(f"_best_{name}"), F.col(f"_n_{name}")).alias(name) for name in candidates])


def rule_extract_wide(docs: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`rule_extract` and `reconcile_wide` for unchunked documents: one candidate per field, no shuffle."""
    hits = rule_hits(docs, template, keys)
    return hits.select(*keys, *[
        F.struct(*[c.alias(n) for n, c in rule_candidate(F.col(f"_hit_{f.name}"), f).items()],
                 F.lit(1).alias("n_candidates")).alias(f.name)
        for f in template.fields])


def _settled(candidate: Column, n: Column) -> Column:
    chosen = F.when(n > 0, F.struct(*[candidate[c].alias(c) for c in CANDIDATE_COLUMNS])).otherwise(missing_field())
    several = n > 1
    note = F.concat(F.lit("Selected highest-confidence match from "), n.cast("string"), F.lit(" chunk candidates."))
    return F.struct(
        *[chosen[c].alias(c) for c in CANDIDATE_COLUMNS if c not in ("notes", "requires_review")],
        F.when(several, tx.append_note(chosen["notes"], note)).otherwise(chosen["notes"]).alias("notes"),
        (chosen["requires_review"] | several).alias("requires_review"),
        n.alias("n_candidates"),
    )


def allowed_key(text: Column) -> Column:
    """Comparison key of an allowed value: letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def canonical(candidates: Column, allowed: Sequence[str], similarity: float = DEFAULT_SIMILARITY) -> Column:
    """Array of structs (value, note) for an array of texts: exact, then same key, then most similar allowed value; else unchanged.

    Similarity is `1 - edit distance / longer length`. The allowed values are literals of the plan. Each step goes over the array of the
    step before, so that a key is made and distances are taken once a text, and only for texts that the steps before leave open.
    """
    by_key: dict[str, str] = {}
    for value in allowed:
        by_key.setdefault("".join(ch.lower() for ch in value if ch.isalnum()), value)
    pairs = [F.lit(part) for item in by_key.items() for part in item]

    def keyed(text: Column) -> Column:
        exact = F.coalesce(text.isin(*allowed), F.lit(False))
        same_key = F.try_element_at(F.create_map(*pairs), allowed_key(text))
        return F.struct(text.alias("text"), exact.alias("exact"), F.when(~exact, same_key).alias("same_key"))

    def scored(k: Column) -> Column:
        best = F.array_max(F.array(*[
            F.struct((1 - F.levenshtein(k["text"], F.lit(value)) / F.greatest(F.length(k["text"]), F.lit(max(len(value), 1)))).alias("score"),
                     F.lit(-rank).alias("rank"), F.lit(value).alias("value"))
            for rank, value in enumerate(allowed)]))
        return F.struct(k["text"].alias("text"), k["same_key"].alias("same_key"), F.when(~k["exact"] & k["same_key"].isNull(), best).alias("best"))

    def settled(s: Column) -> Column:
        close = F.when(s["best"]["score"] >= similarity, s["best"]["value"])

        def note(target: Column, how: str) -> Column:
            return F.concat(F.lit("Canonicalized allowed value from '"), s["text"], F.lit("' to '"), target, F.lit(f"' using {how}."))

        return F.struct(
            F.coalesce(s["same_key"], close, s["text"]).alias("value"),
            F.coalesce(note(s["same_key"], "normalized comparison"), note(close, "guarded fuzzy matching")).alias("note"))

    return F.transform(F.transform(F.transform(candidates, keyed), scored), settled)


def canonicalized(result: Column, field: FieldDef, similarity: float) -> Column:
    """The texts of a field with allowed values, canonical: its items, or its one text."""
    value = result["normalized_value"]
    return canonical(value["items"] if field.type in LIST_TYPES else F.array(value["text"]), field.allowed_values, similarity)


def canonicalize_field(result: Column, field: FieldDef, canonical_texts: Column) -> tuple[Column, Column, Column]:
    """(normalized value, note, allowed?) of a field with allowed values, from the column that `canonicalized` gave."""
    value = result["normalized_value"]
    others = {m: value[m] for m in ("number", "amount", "currency", "display_value", "flag", "object_json")}
    if field.type in LIST_TYPES:
        notes = F.array_join(canonical_texts["note"], " ")
        # A list is never itself one of the allowed scalars, so it is reported even when each item is one.
        changed = value_struct(items=canonical_texts["value"], text=value["text"], **others)
        return F.when(value.isNotNull(), changed), F.nullif(notes, F.lit("")), F.lit(False)
    picked = F.get(canonical_texts, F.lit(0))
    changed = F.when(value.isNotNull(), value_struct(text=picked["value"], items=value["items"], **others))
    return changed, picked["note"], picked["value"].isin(*field.allowed_values)


def prepared(result: Column, field: FieldDef, similarity: float) -> Column | None:
    """What the checks of a field use several times: its canonical texts, or its value as a variant for its contract. To be a column of its own step."""
    if field.allowed_values:
        return canonicalized(result, field, similarity)
    if field.contract:
        return as_variant(typed_value(result["normalized_value"], field.type), field.type)
    return None


def check_field(result: Column, field: FieldDef, min_confidence: float, review_low: bool, ready: Column | None = None) -> Column:
    """What validation changes in a field's result: notes, review flag, errors in rule order, and the value of a field with allowed values.

    ready: the column that `prepared` gave.
    """
    value, notes = result["normalized_value"], result["notes"]
    missing = value.isNull()
    review = result["requires_review"]
    checks: list[Column] = []
    if field.required:
        checks.append(F.when(missing, REQUIRED_MISSING))
    if not field.rules.allow_null:
        checks.append(F.when(missing, NULL_NOT_ALLOWED))
    if field.allowed_values:
        value, note, allowed = canonicalize_field(result, field, ready)
        notes, review = tx.append_note(notes, note), review | note.isNotNull()
        checks.append(F.when(~missing & ~F.coalesce(allowed, F.lit(False)), OUTSIDE_ALLOWED))
    if field.contract:
        own = contract_error(typed_value(value, field.type), field) if field.allowed_values else variant_error(ready, field)
        checks.append(F.when(~missing, own))
    extracted = result["extracted_value"]
    if field.rules.regex:
        checks.append(F.when(~F.regexp_like(extracted, F.lit(rf"\A(?:{field.rules.regex})")), PATTERN_MISMATCH))
    if field.rules.max_length:
        checks.append(F.when(F.length(extracted) > field.rules.max_length, TOO_LONG))
    if field.citation_required:
        checks.append(F.when(F.coalesce(result["source_text"], F.lit("")) == "", CITATION_MISSING))
    if review_low:
        unsure = F.coalesce(~missing & (result["confidence"] < min_confidence), F.lit(False))
        note = F.concat(F.lit("Confidence "), F.coalesce(tx.fixed_decimals(result["confidence"]), F.lit("")),  # never null, so written once
                        F.lit(f" is below the {min_confidence:.2f} review threshold."))
        notes, review = F.when(unsure, tx.append_note(notes, note)).otherwise(notes), review | unsure
    errors = F.array(*checks) if checks else F.array().cast("array<string>")
    changed = [value.alias("normalized_value")] if field.allowed_values else []
    return F.struct(*changed, notes.alias("notes"), review.alias("requires_review"), errors.alias("errors"))


def checked_field(result: Column, field: FieldDef, checked: Column, errors: Column) -> Column:
    """The validated result struct, from a field's result and what `check_field` found."""
    kept = [c for c in CANDIDATE_COLUMNS if c not in ("normalized_value", "notes", "requires_review")]
    failed = F.size(errors) > 0
    return F.struct(
        *[result[c].alias(c) for c in kept],
        (checked if field.allowed_values else result)["normalized_value"].alias("normalized_value"),
        checked["notes"].alias("notes"),
        (checked["requires_review"] | failed).alias("requires_review"),
        result["n_candidates"].alias("n_candidates"),
        errors.alias("validation_errors"),
        F.when(failed, "invalid").otherwise("valid").alias("validation_status"),
    )


def validate_wide(wide: DataFrame, template: Template, similarity: float = DEFAULT_SIMILARITY) -> DataFrame:
    """Validate every field of wide results.

    Four steps, so that each rule is evaluated once: canonical texts and parsed values, the checks (in generated code), the compacted error
    lists (an array function, which is not), and the assembled results.
    """
    names = template.field_names
    others = [c for c in wide.columns if c not in names]
    ready = {f.name: made for f in template.fields if (made := prepared(F.col(f.name), f, similarity)) is not None}
    wide = wide.select("*", *[made.alias(f"_ready_{name}") for name, made in ready.items()])
    checks = wide.select(*others, *names, *[
        check_field(F.col(f.name), f, template.min_confidence, template.review_low, F.col(f"_ready_{f.name}") if f.name in ready else None)
        .alias(f"_checked_{f.name}") for f in template.fields])
    compact = checks.select("*", *[F.array_compact(F.col(f"_checked_{n}")["errors"]).alias(f"_errors_{n}") for n in names])
    return compact.select(*others, *[
        checked_field(F.col(f.name), f, F.col(f"_checked_{f.name}"), F.col(f"_errors_{f.name}")).alias(f.name) for f in template.fields])


def long_form(wide: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Wide results to one row per document and field, in template order (`field_no`)."""
    rows = [
        F.struct(F.lit(i).alias("field_no"), F.lit(f.name).alias("field_name"), F.lit(f.label).alias("label"),
                 F.lit(f.type).alias("data_type"), *[F.col(f.name)[c].alias(c) for c in RESULT_FIELDS])
        for i, f in enumerate(template.fields)]
    return wide.select(*keys, F.inline(F.array(*rows)))


def reconcile(
    candidates: DataFrame, docs: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",),
    similarity: float = DEFAULT_SIMILARITY,
) -> DataFrame:
    """Candidates to validated results in long form, every template field present for every document."""
    wide = validate_wide(reconcile_wide(candidates, docs, template, keys), template, similarity)
    return long_form(wide, template, keys)


def fields_requiring_review(results: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Names of the fields to review per document, in template order (long results, calculated ones last)."""
    flagged = F.when(F.col("requires_review"), F.struct("field_no", "field_name"))
    listed = F.sort_array(F.collect_list(flagged))
    return results.groupBy(*keys).agg(
        F.transform(listed, lambda item: item["field_name"]).alias("fields_requiring_review"))


def has_error(results_errors: Column, message: str) -> Column:
    return F.exists(results_errors, lambda e: e == message)


def review_signals(results: DataFrame, calculated: DataFrame | None = None, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts of low-confidence, multi-candidate, citation and validation findings per document."""
    notes, review = F.lower("notes"), F.col("requires_review")
    rows = results.select(
        *keys,
        (review & F.contains(notes, F.lit("review threshold"))).cast("int").alias("low"),
        (review & F.contains(notes, F.lit("chunk candidates"))).cast("int").alias("multi"),
        has_error(F.col("validation_errors"), CITATION_MISSING).cast("int").alias("citation"),
        (F.size("validation_errors") > 0).cast("int").alias("invalid"),
    )
    if calculated is not None:
        zero = F.lit(0)
        rows = rows.unionByName(calculated.select(
            *keys, zero.alias("low"), zero.alias("multi"), zero.alias("citation"),
            (F.size("validation_errors") > 0).cast("int").alias("invalid")))
    return rows.groupBy(*keys).agg(
        F.sum("low").alias("low_confidence_review_count"),
        F.sum("multi").alias("multi_candidate_review_count"),
        F.sum("citation").alias("citation_gap_count"),
        F.sum("invalid").alias("validation_error_count"),
    )


def result_struct(field: FieldDef) -> Column:
    """One extracted field as it appears in a result envelope; the value is JSON text of its own shape."""
    r = F.col(field.name)
    return F.struct(
        F.lit(field.name).alias("field_name"), F.lit(field.label).alias("label"), F.lit("extracted").alias("field_kind"),
        F.lit(field.type).alias("data_type"), r["extracted_value"].alias("extracted_value"),
        value_json(r["normalized_value"], F.lit(field.type)).alias("normalized_value"),
        r["confidence"].alias("confidence_score"), r["source_text"].alias("source_text"),
        r["char_start"].alias("char_start"), r["char_end"].alias("char_end"), r["page_number"].alias("page_number"),
        r["location_reference"].alias("location_reference"), r["validation_status"].alias("validation_status"),
        r["validation_errors"].alias("validation_errors"), r["notes"].alias("extraction_notes"),
        r["requires_review"].alias("requires_review"),
    )

