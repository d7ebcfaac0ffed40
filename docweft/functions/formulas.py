"""Formula helpers as column functions, and the same helpers as SQL functions for formula strings.

Each keeps the meaning the name has in template formulas, where it differs from Spark's function of the
same name: `calc_round` rounds half to even, `calc_months_between` ignores the day, `calc_min`/`calc_max`
are null when any element is null.
"""

from __future__ import annotations

from weakref import WeakSet

from pyspark.sql import Column, SparkSession, functions as F

from docweft.functions import text as tx

# ---- fixed values -------------------------------------------------------------------------------
DATE_PATTERNS = (
    "yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
    "yyyy/MM/dd", "yyyyMMdd",
)
UNIT_FACTORS = {("days", "months"): (1.0, 30.0), ("months", "days"): (30.0, 1.0),
                ("years", "months"): (12.0, 1.0), ("months", "years"): (1.0, 12.0)}

# SQL bodies for formula strings; the session keeps them as temporary functions.
SQL_HELPERS = {
    "calc_sum(xs ARRAY<DOUBLE>) RETURNS DOUBLE":
        "if(exists(xs, x -> x IS NULL), NULL, aggregate(xs, 0D, (a, x) -> a + x))",
    "calc_avg(xs ARRAY<DOUBLE>) RETURNS DOUBLE":
        "try_divide(aggregate(filter(xs, x -> x IS NOT NULL), 0D, (a, x) -> a + x), "
        "CAST(size(filter(xs, x -> x IS NOT NULL)) AS DOUBLE))",
    "calc_min(xs ARRAY<DOUBLE>) RETURNS DOUBLE": "if(exists(xs, x -> x IS NULL), NULL, array_min(xs))",
    "calc_max(xs ARRAY<DOUBLE>) RETURNS DOUBLE": "if(exists(xs, x -> x IS NULL), NULL, array_max(xs))",
    "calc_count(xs ARRAY<STRING>) RETURNS INT": "coalesce(size(xs), 0)",
    "count_chars(s STRING) RETURNS INT": "coalesce(length(s), 0)",
    "calc_round(x DOUBLE, places INT DEFAULT 0) RETURNS DOUBLE":
        "CAST(bround(CAST(x * power(10D, places) AS DECIMAL(38,16)), 0) AS DOUBLE) / power(10D, places)",
    "calc_mod(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "a - b * floor(try_divide(a, b))",
    "calc_months_between(s DATE, e DATE) RETURNS INT": "(year(e) - year(s)) * 12 + month(e) - month(s)",
    "days_between(s DATE, e DATE) RETURNS INT": "datediff(e, s)",
    "years_between(s DATE, e DATE) RETURNS INT":
        "CAST(floor(((year(e) - year(s)) * 12 + month(e) - month(s)) / 12) AS INT)",
    "calc_contains(xs ARRAY<STRING>, x STRING) RETURNS BOOLEAN": "coalesce(array_contains(xs, x), false)",
    "text_contains(s STRING, x STRING) RETURNS BOOLEAN": "coalesce(contains(s, x), false)",
    "lookup(m MAP<STRING, STRING>, k STRING, d STRING DEFAULT NULL) RETURNS STRING":
        "if(coalesce(map_contains_key(m, k), false), try_element_at(m, k), d)",
    "format_currency(x DOUBLE, cur STRING DEFAULT 'USD') RETURNS STRING":
        "if(x IS NULL, '', concat(cur, ' ', format_number(x, 2)))",
    "format_percent(x DOUBLE, places INT DEFAULT 2) RETURNS STRING":
        "if(x IS NULL, '', concat(format_number(x, concat('0', if(places > 0, '.', ''), repeat('0', places))), '%'))",
    "iff(c BOOLEAN, a DOUBLE, b DOUBLE) RETURNS DOUBLE": "if(c, a, b)",
    "iff_text(c BOOLEAN, a STRING, b STRING) RETURNS STRING": "if(c, a, b)",
    "convert_unit(x DOUBLE, f STRING, t STRING) RETURNS DOUBLE":
        "CASE WHEN x IS NULL OR f = t THEN x "
        + " ".join(f"WHEN f = '{f}' AND t = '{t}' THEN x * {mul}D / {div}D" for (f, t), (mul, div) in UNIT_FACTORS.items())
        + " ELSE CAST(raise_error(concat('Unsupported unit conversion: ', f, ' -> ', t)) AS DOUBLE) END",
}


def register_formula_functions(spark: SparkSession) -> None:
    """Make the helpers callable by name inside formula strings of this session, once per session."""
    if spark in _registered:
        return
    for signature, body in SQL_HELPERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    _registered.add(spark)


_registered: WeakSet[SparkSession] = WeakSet()


def parse_date(text: Column) -> Column:
    """First pattern that fits; text in none of the known layouts gives null."""
    return F.coalesce(*[F.try_to_date(text, p) for p in DATE_PATTERNS])


def list_sum(values: Column) -> Column:
    return F.when(~has_null(values), F.aggregate(values, F.lit(0.0), lambda a, x: a + x))


def has_null(values: Column) -> Column:
    return F.exists(values, lambda x: x.isNull())


def list_avg(values: Column) -> Column:
    numbers = F.filter(values, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x), F.size(numbers).cast("double"))


def list_min(values: Column) -> Column:
    return F.when(~has_null(values), F.array_min(values))


def list_max(values: Column) -> Column:
    return F.when(~has_null(values), F.array_max(values))


def count_items(values: Column) -> Column:
    """Length of a list or map; 0 for null."""
    return F.when(values.isNull(), 0).otherwise(F.size(values))


def count_chars(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def count_scalar(value: Column) -> Column:
    return F.when(value.isNull(), 0).otherwise(1)


def round_half_even(number: Column, places: int = 0) -> Column:
    return F.bround(number.cast("decimal(38,16)"), places).cast("double")


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; null when the divisor is zero."""
    return a - b * F.floor(F.try_divide(a, b))


def months_between(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def years_between(start: Column, end: Column) -> Column:
    return F.floor(months_between(start, end) / 12).cast("int")


def list_contains(values: Column, item: Column) -> Column:
    return F.coalesce(F.array_contains(values, item), F.lit(False))


def text_contains(text: Column, item: Column) -> Column:
    return F.coalesce(F.contains(text, item), F.lit(False))


def lookup(mapping: Column, key: Column, default: Column | None = None) -> Column:
    """Value of a present key, even a null one; else the default."""
    fallback = F.lit(None) if default is None else default
    present = F.coalesce(F.map_contains_key(mapping, key), F.lit(False))
    return F.when(present, F.try_element_at(mapping, key)).otherwise(fallback)


def convert_unit(number: Column, from_unit: str, to_unit: str) -> Column:
    if from_unit == to_unit:
        return number
    if (from_unit, to_unit) not in UNIT_FACTORS:
        raise ValueError(f"Unsupported unit conversion: {from_unit} -> {to_unit}")
    times, over = UNIT_FACTORS[from_unit, to_unit]
    return number * times / over


def format_currency(amount: Column, currency: str = "USD") -> Column:
    rendered = F.concat(F.lit(currency + " "), tx.fixed_decimals(amount.cast("double"), 2, grouped=True))
    return F.coalesce(rendered, F.lit(""))


def format_percent(number: Column, places: int = 2) -> Column:
    return F.coalesce(F.concat(tx.fixed_decimals(number.cast("double"), places), F.lit("%")), F.lit(""))


def iff(condition: Column, when_true: Column, when_false: Column) -> Column:
    return F.when(condition, when_true).otherwise(when_false)

