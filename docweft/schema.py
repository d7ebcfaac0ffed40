"""Template definitions (driver side) and the column layouts shared by all operators.

A template is small, hand-written configuration (tens of fields), so it lives on the driver and is
compiled into column expressions: no definitions table has to be joined or broadcast at run time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, functions as F

from docweft.functions.formula_terms import FormulaError, names_in

# ---- fixed values -------------------------------------------------------------------------------
TEXT_TYPES = ("text", "paragraph", "category", "citation_backed_answer")
LIST_TYPES = ("list", "multi_select")
OBJECT_TYPES = ("json_object", "structured_object", "table")
FLAG_ON_ERROR = "return_null_and_flag_review"
NULL_ON_ERROR = "return_null"

# Both patterns mean the same to Python and to Spark. First what is no name of a field: a quoted text with the type before it
# (DATE '2001-01-01'), a type after AS, a member. Then a name that is not called.
NO_FIELD_NAME = r"""(?:\b[A-Za-z_]\w*\s*)?(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?i:\bas\s+[a-z_]\w*)|\.\s*[A-Za-z_]\w*"""
FIELD_NAME = r"(?<![\w.])([A-Za-z_]\w*)\b(?!\s*\()"

# ---- layouts ------------------------------------------------------------------------------------
# One struct holds every normalized shape; only the members of the field's data type are set. It has no
# map or variant member, so whole candidates stay orderable and `max` can pick the best one.
VALUE_DDL = (
    "struct<text:string,number:double,amount:double,currency:string,display_value:string,"
    "flag:boolean,items:array<string>,object_json:string>"
)
CANDIDATE_COLUMNS = {
    "extracted_value": "string",
    "normalized_value": VALUE_DDL,
    "confidence": "double",
    "source_text": "string",
    "char_start": "int",
    "char_end": "int",
    "page_number": "int",
    "location_reference": "string",
    "notes": "string",
    "requires_review": "boolean",
}
CANDIDATE_DDL = "field_name string, seq bigint, " + ", ".join(f"{k} {v}" for k, v in CANDIDATE_COLUMNS.items())


@dataclass(frozen=True)
class Rules:
    """Validation rules of one field; unset rules cost nothing in the plan."""

    allow_null: bool = True
    min: float | None = None
    max: float | None = None
    regex: str | None = None
    currency: str | None = None
    max_length: int | None = None


@dataclass(frozen=True)
class FieldDef:
    name: str
    label: str
    type: str = "text"
    description: str = ""
    required: bool = False
    citation_required: bool = True
    usable_in_formulas: bool = True
    allowed_values: tuple[str, ...] = ()
    rules: Rules = Rules()
    contract: dict | None = None


@dataclass(frozen=True)
class CalcDef:
    """A calculated field. `formula` is an expression over the template's fields, see `functions/formula_terms.py`."""

    name: str
    label: str
    output_type: str
    formula: str
    depends_on: tuple[str, ...] = ()
    description: str = ""
    currency: str = "USD"
    rules: Rules = Rules()
    on_divide_by_zero: str = FLAG_ON_ERROR
    on_missing_input: str = FLAG_ON_ERROR
    requires_review: bool = False

    def references(self, names: Iterable[str]) -> set[str]:
        """Which of `names` the formula mentions as identifiers; of a formula that cannot be read, what looks like one."""
        try:
            return names_in(self.formula) & set(names)
        except FormulaError:
            return set(re.findall(FIELD_NAME, re.sub(NO_FIELD_NAME, " ", self.formula))) & set(names)


@dataclass(frozen=True)
class Template:
    name: str
    version: str
    document_type: str
    fields: tuple[FieldDef, ...]
    calcs: tuple[CalcDef, ...] = ()
    provider: dict = field(default_factory=dict)
    examples: tuple[dict, ...] = ()
    prompt: str = ""
    min_confidence: float = 0.75
    review_low: bool = True

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> FieldDef:
        return next(f for f in self.fields if f.name == name)

    def ordered_calcs(self) -> list[CalcDef]:
        """Calculated fields, each after the calculated fields it refers to."""
        by_name = {c.name: c for c in self.calcs}
        graph = TopologicalSorter({c.name: sorted(c.references(by_name)) for c in self.calcs})
        try:
            return [by_name[name] for name in graph.static_order()]
        except CycleError as exc:
            raise ValueError(f"Circular dependency between calculated fields: {exc.args[1]}") from exc


def template_from_dict(definition: dict) -> Template:
    """Build a template from its JSON definition (the shape stored with each template version)."""

    def rules(raw: dict | None) -> Rules:
        raw = raw or {}
        return Rules(**{k: raw[k] for k in Rules.__dataclass_fields__ if raw.get(k) is not None})

    fields = tuple(
        FieldDef(
            name=f["name"],
            label=f["label"],
            type=f.get("type", "text"),
            description=f.get("description", ""),
            required=f.get("required", False),
            citation_required=f.get("citation_required", True),
            usable_in_formulas=f.get("usable_in_formulas", True),
            allowed_values=tuple(f.get("allowed_values") or ()),
            rules=rules(f.get("validation")),
            contract=f.get("schema"),
        )
        for f in definition.get("extracted_fields", [])
    )
    calcs = tuple(
        CalcDef(
            name=c["name"],
            label=c["label"],
            output_type=c["output_type"],
            formula=c["formula"],
            depends_on=tuple(c.get("depends_on") or ()),
            description=c.get("description", ""),
            currency=(c.get("format") or {}).get("currency") or "USD",
            rules=rules(c.get("validation")),
            on_divide_by_zero=(c.get("error_handling") or {}).get("on_divide_by_zero", FLAG_ON_ERROR),
            on_missing_input=(c.get("error_handling") or {}).get("on_missing_input", FLAG_ON_ERROR),
            requires_review=c.get("requires_review", False),
        )
        for c in definition.get("calculated_fields", [])
    )
    guide = definition.get("langextract_config") or {}
    return Template(
        name=definition["template_name"],
        version=definition.get("template_version", "1.0.0"),
        document_type=definition.get("document_type", ""),
        fields=fields,
        calcs=calcs,
        provider=definition.get("llm_provider_settings") or {},
        examples=tuple(guide.get("examples") or ()),
        prompt=guide.get("prompt_description", ""),
        min_confidence=definition.get("minimum_confidence_threshold", 0.75),
        review_low=definition.get("review_required_on_low_confidence", True),
    )


def value_struct(**members: Column) -> Column:
    """A normalized value with the given members set and all others null."""
    types = dict(part.split(":", 1) for part in re.findall(r"\w+:[\w<>]+", VALUE_DDL[7:-1]))
    return F.struct(
        *[members[name].cast(kind).alias(name) if name in members else F.lit(None).cast(kind).alias(name)
          for name, kind in types.items()]
    )


def null_value() -> Column:
    return F.lit(None).cast(VALUE_DDL)


def typed_value(value: Column, data_type: str) -> Column:
    """The normalized value in the shape of its data type, as formulas and exports see it."""
    if data_type == "currency":
        shaped = F.struct(value["amount"].alias("amount"), value["currency"].alias("currency"),
                          value["display_value"].alias("display_value"))
    elif data_type == "date":
        shaped = F.struct(value["text"].alias("value"), value["display_value"].alias("display_value"))
    elif data_type == "number":
        shaped = F.struct(value["number"].alias("value"))
    elif data_type == "boolean":
        return value["flag"]
    elif data_type in LIST_TYPES:
        shaped = F.struct(value["items"].alias("value"))
    elif data_type in OBJECT_TYPES:
        shaped = F.coalesce(F.try_parse_json(value["object_json"]),
                            F.try_parse_json(F.to_json(F.struct(value["text"].alias("value")))))
    else:
        shaped = F.struct(value["text"].alias("value"))
    return F.when(value.isNotNull(), shaped)


def value_json(value: Column, data_type: Column) -> Column:
    """JSON of a normalized value where the data type is itself a column (long tables)."""
    text = F.to_json(F.struct(value["text"].alias("value")))
    rendered = (
        F.when(data_type == "currency", F.to_json(F.struct(
            value["amount"].alias("amount"), value["currency"].alias("currency"),
            value["display_value"].alias("display_value"))))
        .when(data_type == "date", F.to_json(F.struct(
            value["text"].alias("value"), value["display_value"].alias("display_value"))))
        .when(data_type == "number", F.to_json(F.struct(value["number"].alias("value"))))
        .when(data_type == "boolean", value["flag"].cast("string"))
        .when(data_type.isin(*LIST_TYPES), F.to_json(F.struct(value["items"].alias("value"))))
        .when(data_type.isin(*OBJECT_TYPES), F.coalesce(value["object_json"], text))
        .otherwise(text)
    )
    return F.when(value.isNotNull(), rendered)
