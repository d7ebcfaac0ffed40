"""Calculated fields: formulas over wide results, error policies, currency shaping, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docweft.functions import text as tx
from docweft.functions.formula_terms import MISSING_INPUT, ZERO_DIVISOR, Term, compiled
from docweft.operators.reconcile import result_struct, validate_wide
from docweft.schema import FLAG_ON_ERROR, LIST_TYPES, OBJECT_TYPES, CalcDef, FieldDef, Template, typed_value

# ---- fixed values -------------------------------------------------------------------------------
DIVIDED_BY_ZERO = (ZERO_DIVISOR, "Division by zero returned null by policy.")
INPUT_MISSING = (MISSING_INPUT, "Missing input returned null by policy.")
BASE_NOTE = "Deterministic formula evaluation."
NULL_RESULT = "Calculated value is null."
BELOW_MINIMUM = "Calculated value is below minimum."
ABOVE_MAXIMUM = "Calculated value is above maximum."
_MEMBERS = {
    "currency": {"amount": "number", "currency": "text", "display_value": "text"},
    "date": {"value": "text", "display_value": "text"},
    "number": {"value": "number"},
}
_CURRENCY_RESULT = {"amount": "number", "currency": "text"}


def field_term(field: FieldDef, typed: Column) -> Term:
    """An extracted field as formulas see it."""
    if field.type == "boolean":
        return Term("flag", typed)
    if field.type in OBJECT_TYPES:
        return Term("object", typed)
    return Term("record", typed, members=_MEMBERS.get(field.type, {"value": "list" if field.type in LIST_TYPES else "text"}))


def shape_currency(number: Column, currency: str) -> Column:
    amount = tx.money(number.cast("double"))
    return F.when(number.isNotNull(), F.struct(amount.alias("amount"), F.lit(currency).alias("currency")))


def calculated_fields(wide: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add one struct column per calculated field, named after it, holding value, display, errors and notes.

    Fields are computed in dependency order; a formula sees every extracted field in the shape of its type
    (`total.amount`, `start.value`) and every earlier calculated field. A formula that cannot be read, or names an unknown field,
    gives a null result with that error in every row. All expressions are row-local.
    """
    calcs = template.ordered_calcs()
    kept = [c for c in wide.columns if c not in template.field_names]
    # Formula inputs shadow the wide columns, so results move aside under a prefix for the computation.
    df = wide.select(*kept, *[F.col(f.name).alias(f"_r_{f.name}") for f in template.fields],
                     *[typed_value(F.col(f.name)["normalized_value"], f.type).alias(f.name) for f in template.fields])
    inputs = {f.name: field_term(f, F.col(f.name)) for f in template.fields}
    kinds = {}
    for calc in calcs:
        made = compiled(calc.formula, inputs)
        money = calc.output_type == "currency" and made.kind in ("int", "number")
        df = df.withColumns({
            calc.name: shape_currency(made.value, calc.currency) if money else made.value,
            f"_fault_{calc.name}": F.lit(None).cast("string") if made.fault is None else made.fault})
        kinds[calc.name] = "currency" if money else made.kind
        inputs[calc.name] = Term("record", F.col(calc.name), members=_CURRENCY_RESULT) if money else Term(
            made.kind, F.col(calc.name), members=made.members)
    df = df.withColumns({f"_c_{calc.name}": _outcome(calc, kinds[calc.name]) for calc in calcs})
    return df.select(*kept, *[F.col(f"_r_{f.name}").alias(f.name) for f in template.fields],
                     *[F.col(f"_c_{c.name}").alias(c.name) for c in calcs])


def _outcome(calc: CalcDef, kind: str) -> Column:
    value, fault = F.col(calc.name), F.col(f"_fault_{calc.name}")
    errors, notes, silent = [], [], []
    for (error, note), policy in ((INPUT_MISSING, calc.on_missing_input), (DIVIDED_BY_ZERO, calc.on_divide_by_zero)):
        if policy != FLAG_ON_ERROR:
            silent.append(error)
            notes.append(F.when(fault == error, note))
    errors.append(F.when(~fault.isin(*silent), fault) if silent else fault)
    scalar = value["amount"] if kind == "currency" else value
    if not calc.rules.allow_null:
        errors.append(F.when(value.isNull(), NULL_RESULT))
    if kind in ("currency", "int", "number", "flag", "nothing"):
        number = scalar.cast("double")
        if calc.rules.min is not None:
            errors.append(F.when(number < calc.rules.min, BELOW_MINIMUM))
        if calc.rules.max is not None:
            errors.append(F.when(number > calc.rules.max, ABOVE_MAXIMUM))
    found = F.array_compact(F.array(*errors))
    whole = F.to_json(value) if kind in ("currency", "record", "object", "list") else value.cast("string")
    shown = {
        "currency": lambda: F.concat(F.lit(calc.currency + " "), tx.fixed_decimals(scalar, 2, grouped=True)),
        "number": lambda: tx.python_number(value), "flag": lambda: tx.python_bool(value),
    }.get(kind, lambda: whole)()
    return F.struct(
        value.alias("calculated_value"),
        whole.alias("value_json"),
        (scalar.cast("string") if kind == "currency" else whole).alias("value_text"),
        F.when(value.isNotNull(), shown).otherwise("").alias("display_value"),
        F.when(F.size(found) > 0, "invalid").otherwise("valid").alias("validation_status"),
        found.alias("validation_errors"),
        F.concat_ws(" ", F.lit(BASE_NOTE), *notes).alias("calculation_notes"),
        ((F.size(found) > 0) | F.lit(calc.requires_review)).alias("requires_review"),
    )


def calculated_long(wide: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Calculated results in long form with formula and inputs; `field_no` continues after the fields."""
    rows = []
    for i, calc in enumerate(template.ordered_calcs()):
        c = F.col(calc.name)
        depends = sorted(calc.references([*template.field_names, *[x.name for x in template.calcs]]))
        rows.append(F.struct(
            F.lit(len(template.fields) + i).alias("field_no"), F.lit(calc.name).alias("field_name"),
            F.lit(calc.label).alias("label"), F.lit(calc.output_type).alias("output_type"),
            F.lit(calc.formula).alias("formula"), F.array(*[F.lit(d) for d in depends]).cast("array<string>").alias("depends_on"),
            c["value_json"].alias("value_json"), c["value_text"].alias("value_text"), c["display_value"].alias("display_value"),
            c["validation_status"].alias("validation_status"), c["validation_errors"].alias("validation_errors"),
            c["calculation_notes"].alias("calculation_notes"), c["requires_review"].alias("requires_review")))
    return wide.select(*keys, F.inline(F.array(*rows)))


def all_fields_long(wide: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Extracted and calculated results in one long table with the columns both share, from one pass over the wide rows."""
    def rows(items: Sequence[FieldDef | CalcDef], kind: str, first: int) -> list[Column]:
        return [
            F.struct(F.lit(first + i).alias("field_no"), F.lit(f.name).alias("field_name"), F.lit(f.label).alias("label"),
                     *[F.col(f.name)[c].alias(c) for c in ("validation_status", "validation_errors", "requires_review")],
                     F.lit(kind).alias("field_kind"))
            for i, f in enumerate(items)]

    calcs = template.ordered_calcs() if template.calcs else []
    every = [*rows(template.fields, "extracted", 0), *rows(calcs, "calculated", len(template.fields))]
    return wide.select(*keys, F.inline(F.array(*every)))


def calc_struct(calc: CalcDef, template: Template) -> Column:
    c = F.col(calc.name)
    depends = sorted(calc.references([*template.field_names, *[x.name for x in template.calcs]]))
    return F.struct(
        F.lit(calc.name).alias("field_name"), F.lit(calc.label).alias("label"), F.lit("calculated").alias("field_kind"),
        F.lit(calc.output_type).alias("output_type"), F.lit(calc.formula).alias("formula"),
        F.array(*[F.lit(d) for d in depends]).cast("array<string>").alias("depends_on"),
        c["value_json"].alias("calculated_value"), c["display_value"].alias("display_value"),
        c["validation_status"].alias("validation_status"), c["validation_errors"].alias("validation_errors"),
        c["calculation_notes"].alias("calculation_notes"), c["requires_review"].alias("requires_review"),
    )


def review_list(template: Template) -> Column:
    """Names of the fields to review in the current wide row: extracted fields, then calculated ones."""
    names = [*template.field_names, *[c.name for c in template.ordered_calcs()]]
    return F.array_compact(F.array(*[F.when(F.col(n)["requires_review"], n) for n in names])).cast("array<string>")


def result_envelope(
    wide: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",), notes: Column | None = None
) -> DataFrame:
    """The nested result of every document, straight from the wide row."""
    calcs = template.ordered_calcs()
    calculated = F.array(*[calc_struct(c, template) for c in calcs]) if calcs else F.lit(None).cast("array<string>")
    provider = F.create_map(*[F.lit(str(x)) for kv in template.provider.items() for x in kv]) if template.provider else (
        F.lit(None).cast("map<string,string>"))
    return wide.select(
        *keys,
        F.lit(template.document_type).alias("document_type"),
        F.lit(template.name).alias("template_name"),
        F.lit(template.version).alias("template_version"),
        provider.alias("llm_provider"),
        F.lit("completed").alias("extraction_status"),
        F.array(*[result_struct(f) for f in template.fields]).alias("extracted_fields"),
        calculated.alias("calculated_fields"),
        (F.array().cast("array<string>") if notes is None else notes).alias("document_level_notes"),
        review_list(template).alias("fields_requiring_review"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
    )


def complete_wide(wide: DataFrame, template: Template, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Validate reconciled fields and add the calculated ones."""
    validated = validate_wide(wide, template)
    return calculated_fields(validated, template, keys) if template.calcs else validated
