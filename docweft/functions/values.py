"""Typed values: normalization of extracted text, rendering, reviewer drafts, feedback attributes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docweft.functions import text as tx
from docweft.functions.formulas import parse_date
from docweft.schema import LIST_TYPES, OBJECT_TYPES, VALUE_DDL, value_json, value_struct

# ---- fixed values -------------------------------------------------------------------------------
CURRENCY_PATTERN = r"[-+]?\$?\s?(\d[\d,]*(?:\.\d{1,2})?)"
NUMBER_PATTERN = r"[-+]?\d+(?:\.\d+)?"
TRUE_WORDS = ("true", "yes", "y", "1")
FALSE_WORDS = ("false", "no", "n", "0")
NO_VALUE = "—"


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern that never matches the empty text; null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def non_blank(text: Column) -> Column:
    """The stripped text, null when nothing is left."""
    return F.nullif(tx.strip(text), F.lit(""))


def parse_amount(text: Column) -> Column:
    return F.replace(first_match(text, CURRENCY_PATTERN, 1), F.lit(","), F.lit("")).try_cast("double")


def parse_number(text: Column) -> Column:
    return first_match(text, NUMBER_PATTERN).try_cast("double")


def parse_boolean(text: Column) -> Column:
    word = F.lower(tx.strip(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def split_list(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, ","), tx.strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def normalize_value(
    data_type: Column, extracted: Column, attributes: Column, currency: Column
) -> Column:
    """Normalized value of an annotation: its text, its `attributes` (string map) and the field's currency.

    `data_type` null stands for a class that is not in the template: the text is kept as it is.
    """
    attribute = F.try_element_at(attributes, F.lit("value"))
    raw = F.coalesce(attribute, extracted)
    text = non_blank(raw)
    plain = F.when(text.isNotNull(), value_struct(text=text))
    untyped = F.when(extracted != "", value_struct(text=extracted))
    iso = F.coalesce(F.date_format(parse_date(text), "yyyy-MM-dd"), text)
    amount = parse_amount(F.coalesce(F.nullif(raw, F.lit("")), extracted))
    unit = F.coalesce(non_blank(F.try_element_at(attributes, F.lit("currency"))), F.nullif(currency, F.lit("")), F.lit("USD"))
    shown = F.coalesce(F.nullif(extracted, F.lit("")),
                       F.concat(unit, F.lit(" "), tx.fixed_decimals(amount, 2, grouped=True)))
    number, flag, items = parse_number(raw), parse_boolean(raw), split_list(raw)
    has_attributes = F.coalesce(F.cardinality(attributes) > 0, F.lit(False))
    return (
        F.when(data_type.isNull(), untyped)
        .when(data_type == "date", F.when(text.isNotNull(), value_struct(text=iso, display_value=text)))
        .when(data_type == "number", F.when(number.isNotNull(), value_struct(number=number)))
        .when(data_type == "currency", F.when(amount.isNotNull(), value_struct(amount=amount, currency=unit, display_value=shown)))
        .when(data_type == "boolean", F.when(flag.isNotNull(), value_struct(flag=flag)))
        .when(data_type.isin(*LIST_TYPES), F.when(items.isNotNull(), value_struct(items=items)))
        .when(data_type.isin(*OBJECT_TYPES),
              F.when(has_attributes, value_struct(object_json=F.to_json(attributes))).otherwise(untyped))
        .otherwise(plain)
    )


def display_value(value: Column, data_type: Column) -> Column:
    """Human rendering of a normalized value."""
    amount = F.concat(F.coalesce(value["currency"], F.lit("USD")), F.lit(" "),
                      tx.fixed_decimals(value["amount"], 2, grouped=True))
    return (
        F.when(value.isNull(), NO_VALUE)
        .when(value["flag"].isNotNull(), F.when(value["flag"], "Yes").otherwise("No"))
        .when(F.length(value["display_value"]) > 0, value["display_value"])
        .when(value["text"].isNotNull(), value["text"])
        .when(value["number"].isNotNull(), plain_number(value["number"]))
        .when(value["amount"].isNotNull(), amount)
        .otherwise(value_json(value, data_type))
    )


def plain_number(number: Column) -> Column:
    """Number text without a trailing `.0`."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def draft_value(label: Column, data_type: Column, draft: Column, existing_currency: Column) -> tuple[Column, Column]:
    """Reviewer's text draft to a normalized value and an error message (null when it is fine)."""
    trimmed = tx.strip(draft)
    number = trimmed.try_cast("double")
    unit = F.coalesce(existing_currency, F.lit("USD"))
    shown = F.concat(unit, F.lit(" "), tx.fixed_decimals(number, 2, grouped=True))
    parsed = F.try_parse_json(trimmed)
    shape = F.schema_of_variant(parsed)
    is_array, is_object = F.startswith(shape, F.lit("ARRAY")), F.startswith(shape, F.lit("OBJECT"))
    structured, numeric = data_type.isin(*OBJECT_TYPES), data_type.isin("number", "currency")
    error = (
        F.when(trimmed == "", None)
        .when(structured & parsed.isNull(), F.concat(label, F.lit(" must be valid JSON.")))
        .when((data_type == "table") & ~is_array, F.concat(label, F.lit(" must be a JSON array of rows.")))
        .when(data_type.isin("json_object", "structured_object") & ~is_array & ~is_object,
              F.concat(label, F.lit(" must be a JSON object or array.")))
        .when(numeric & number.isNull(), F.concat(label, F.lit(" must be a valid number.")))
    )
    value = (
        F.when((trimmed == "") | error.isNotNull(), F.lit(None).cast(VALUE_DDL))
        .when(structured, value_struct(object_json=F.to_json(parsed)))
        .when(data_type == "currency", value_struct(amount=number, currency=unit, display_value=shown))
        .when(data_type == "date", value_struct(text=trimmed, display_value=trimmed))
        .when(data_type == "number", value_struct(number=number))
        .when(data_type == "boolean", value_struct(flag=trimmed == "true"))
        .when(data_type.isin(*LIST_TYPES), value_struct(items=F.array(draft)))
        .otherwise(value_struct(text=draft))
    )
    return value, error


def feedback_attributes(value: Column, data_type: Column) -> Column:
    """Attributes of a feedback example as JSON text with sorted keys; `{}` when there is nothing to say."""
    text, empty = non_blank(value["text"]), F.lit("{}")

    def only(item: Column) -> Column:
        return F.when(item.isNotNull(), F.to_json(F.struct(item.alias("value")))).otherwise(empty)

    items = F.filter(F.transform(value["items"], tx.strip), lambda i: i != "")
    money_text = F.coalesce(non_blank(value["display_value"]), value["amount"].cast("string"))
    money = F.to_json(F.struct(non_blank(value["currency"]).alias("currency"), money_text.alias("value")))
    flag = F.when(value["flag"], "true").otherwise("false")
    return (
        F.when(value.isNull() | data_type.isNull(), empty)
        .when(data_type == "currency", money)
        .when(data_type == "number", only(value["number"].cast("string")))
        .when((data_type == "boolean") & value["flag"].isNotNull(), only(flag))
        .when(data_type.isin(*LIST_TYPES), F.when(F.size(items) > 0, F.to_json(F.struct(items.alias("value")))).otherwise(empty))
        .when(data_type.isin(*OBJECT_TYPES), F.coalesce(object_attributes(value["object_json"]), only(text)))
        .otherwise(only(text))
    )


def object_attributes(object_json: Column) -> Column:
    """Members of a JSON object as trimmed strings, empty ones dropped, keys sorted."""
    members = F.from_json(object_json, "map<string,string>")
    kept = F.map_filter(F.transform_values(members, lambda _, v: tx.strip(v)), lambda _, v: v != "")
    ordered = F.map_from_entries(F.array_sort(F.map_entries(kept)))
    return F.to_json(ordered)
