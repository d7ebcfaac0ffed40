"""Declared contracts of structured field values: types, values, bounds, lengths, patterns and required members, per member and item."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, functions as F

from docweft.schema import OBJECT_TYPES, FieldDef

# ---- fixed values: contract type name to the prefixes of the variant's type name ----------------
TYPE_PREFIXES = {
    "object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "integer": ("BIGINT",),
}


def as_variant(value: Column, data_type: str) -> Column:
    if data_type in OBJECT_TYPES:
        return value
    if data_type == "boolean":
        return F.try_parse_json(value.cast("string"))
    return F.try_parse_json(F.to_json(value))


#: Clauses that say nothing about the value.
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}
_CLAUSES = {"type", "enum", "required", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern",
            "minItems", "maxItems", "properties", "items"}


def _checks(value: Column, contract: dict, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Column]]:
    """(path, message or null) for every clause of a contract, outer clauses first. Clauses it does not know raise an error."""
    unknown = set(contract) - _CLAUSES - _NOTES
    if unknown:
        raise ValueError(f"Contract clauses that cannot be checked: {', '.join(sorted(unknown))}")
    shape = F.schema_of_variant(value)
    shown = F.to_json(value)

    def is_a(kind: str) -> Column:
        fits = F.lit(False)
        for prefix in TYPE_PREFIXES[kind]:
            fits = fits | F.startswith(shape, F.lit(prefix))
        return fits

    def fails(when: Column, message: str) -> tuple[tuple[str, ...], Column]:
        return path, F.when(when, F.concat(shown, F.lit(message)))

    kinds = contract.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds:
        fits = F.lit(False)
        for kind in kinds:
            fits = fits | is_a(kind)
        yield fails(value.isNotNull() & ~fits, " is not of type " + ", ".join(f"'{k}'" for k in kinds))
    if "enum" in contract:
        known = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in contract["enum"]]
        yield fails(~shown.isin(known), f" is not one of {contract['enum']}")
    for name in contract.get("required", ()):
        member = F.try_variant_get(value, f"$.{name}", "variant")
        yield path, F.when(is_a("object") & member.isNull(), f"'{name}' is a required property")
    number = F.when(is_a("number"), F.try_variant_get(value, "$", "double"))
    for clause, over, words in (
        ("minimum", lambda x: number < x, "is less than the minimum of"), ("maximum", lambda x: number > x, "is greater than the maximum of"),
        ("exclusiveMinimum", lambda x: number <= x, "is less than or equal to the minimum of"),
        ("exclusiveMaximum", lambda x: number >= x, "is greater than or equal to the maximum of"),
    ):
        if clause in contract:
            yield fails(over(contract[clause]), f" {words} {contract[clause]}")
    text = F.when(is_a("string"), F.try_variant_get(value, "$", "string"))
    members = F.when(is_a("array"), F.try_variant_get(value, "$", "array<variant>"))
    for clause, over, words in (
        ("minLength", lambda x: F.char_length(text) < x, " is too short"), ("maxLength", lambda x: F.char_length(text) > x, " is too long"),
        ("pattern", lambda x: ~text.rlike(x), f" does not match '{contract.get('pattern')}'"),
        ("minItems", lambda x: F.size(members) < x, " is too short"), ("maxItems", lambda x: F.size(members) > x, " is too long"),
    ):
        if clause in contract:
            yield fails(over(contract[clause]), words)
    for name, inner in contract.get("properties", {}).items():
        yield from _checks(F.try_variant_get(value, f"$.{name}", "variant"), inner, (*path, name))
    if "items" in contract:
        def of_item(item: Column) -> Column:
            return F.coalesce(*[failure for _, failure in _checks(item, contract["items"])], F.lit(None).cast("string"))

        found = F.filter(F.transform(members, of_item), lambda m: m.isNotNull())
        yield (*path, "items"), F.get(found, F.lit(0))


def first_failure(value: Column, contract: dict) -> Column:
    """Message of the first failing clause in path order; null when the value satisfies the contract."""
    messages = []
    for path, failure in sorted(_checks(value, contract), key=lambda item: item[0]):
        where = f" at '{'.'.join(path)}'" if path else ""
        messages.append(F.concat(F.lit(f"Value does not satisfy schema{where}: "), failure))
    return F.coalesce(*messages, F.lit(None).cast("string"))


def contract_error(value: Column, field: FieldDef) -> Column:
    """The value itself or its `value` member may satisfy the contract; the value's own failure is reported."""
    return variant_error(as_variant(value, field.type), field)


def variant_error(whole: Column, field: FieldDef) -> Column:
    """`contract_error` of a value that is a variant already; it is looked at once per clause, so it had better be a column of its own step."""
    failure = first_failure(whole, field.contract)
    inner = F.try_variant_get(whole, "$.value", "variant")
    inner_fits = inner.isNotNull() & first_failure(inner, field.contract).isNull()
    return F.when(~F.coalesce(inner_fits, F.lit(False)), failure)
