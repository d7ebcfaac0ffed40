"""Formulas: values, and the reason where there is none."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from docweft.functions.formula_terms import MISSING_INPUT, ZERO_DIVISOR, Term, compiled
from docweft.functions.text import python_number

MONEY = {"amount": "number", "currency": "text", "display_value": "text"}
MISSING, ZERO = (None, MISSING_INPUT), (None, ZERO_DIVISOR)


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql("""SELECT named_struct('amount', 5.0D, 'currency', 'USD', 'display_value', '$5') AS a, CAST(NULL AS STRUCT<amount: DOUBLE, currency: STRING, display_value: STRING>) AS b,
      named_struct('amount', 0.0D, 'currency', 'USD', 'display_value', '$0') AS z, named_struct('value', '2024-03-05', 'display_value', 'x') AS d, named_struct('value', array('a', 'b')) AS xs,
      true AS flag, parse_json('{"q": 3, "s": "text", "l": [1, 2], "n": {"v": 2.5}}') AS o""").cache()


def inputs():
    records = {name: Term("record", F.col(name), members=MONEY) for name in "abz"}
    return records | {
        "d": Term("record", F.col("d"), members={"value": "text", "display_value": "text"}), "xs": Term("record", F.col("xs"), members={"value": "list"}),
        "flag": Term("flag", F.col("flag")), "o": Term("object", F.col("o"))}


CASES = [
    # arithmetic
    ("a.amount + 1", 6.0), ("2 * 3", 6), ("2 / 4", 0.5), ("-7 % 3", 2), ("7 % -3", -2), ("-a.amount", -5.0), ("True + 1", 2), ("'a' + 'b'", "ab"),
    ("b.amount + 1", MISSING), ("a + 1", MISSING), ("'a' + 1", MISSING), ("-None", MISSING),
    # division
    ("a.amount / z.amount", ZERO), ("a.amount / (1 / z.amount)", ZERO), ("b.amount / z.amount", MISSING), ("a.amount / (a.amount / 2)", 2.0), ("7.5 % 0", ZERO), ("None % 0", MISSING),
    ("None / 0", ZERO),
    # lists
    ("avg([])", None), ("avg([None])", None), ("calc_avg(array(None))", None), ("avg([a.amount, 3])", 4.0), ("avg([b.amount, 3])", MISSING), ("sum([1, 2.5])", 3.5), ("sum([])", 0),
    ("min(3, 2)", 2), ("max([1, 2.5])", 2.5), ("max([1, None])", MISSING), ("count(xs.value)", 2), ("count(None)", 0), ("count('abc')", 3), ("contains(xs.value, 'a')", True),
    ("sum(o.l)", 3.0), ("max(o.l)", 2.0), ("sum([o.q, o.n.v])", 5.5), ("sum([o.s])", MISSING),
    # rounding
    ("round(2.5)", 2), ("round(2.675, 2)", 2.67), ("round(1234, 2)", 1234), ("floor(-1.5)", -2), ("ceil(1.2)", 2), ("round(b.amount)", MISSING),
    # missing inputs and what may stand for them
    ("coalesce(b.amount, 7)", 7.0), ("coalesce(b.amount, None)", MISSING), ("b.amount", MISSING), ("coalesce(None, 'x')", "x"), ("days_between(None, '2024-03-10')", None),
    # dates
    ("days_between(d.value, '2024-03-10')", 5), ("days_between(d, DATE'2024-03-10')", 5), ("months_between('01/31/2024', d.value)", 2), ("years_between('2020-06-01', '2024-05-31')", 3),
    ("days_between('soon', d.value)", None),
    # conditions
    ("1 if flag else 1 / 0", 1.0), ("iff(flag, 1, 1 / 0)", ZERO), ("if(flag, 1, 2)", 1), ("a.amount if flag else b.amount", 5.0), ("b.amount if flag else 1", MISSING),
    ("1 < a.amount < 10", True), ("1 > 2 > b.amount", False), ("1 < 2 < b.amount", MISSING), ("5 == 5.0", True), ("'a' == 5", False), ("a.amount == None", False), ("a.amount > 'x'", MISSING),
    ("flag and a.amount > 4", True), ("flag and 0", False), ("z.amount or 0", False), ("d.value < '2025'", True),
    # texts
    ("contains('abc', 'b')", True), ("contains(None, 1)", False), ("contains('abc', None)", MISSING), ("lookup(o, 'q', 9)", 3.0), ("lookup(o, 'none', 9)", 9.0), ("lookup(a, 'currency', '-')", "USD"),
    ("convert_unit(60, 'days', 'months')", 2.0), ("convert_unit(2, 'months', 'days')", 60), ("format_currency(1234.5)", "USD 1,234.50"), ("format_currency(a.amount, currency='EUR')", "EUR 5.00"),
    ("format_currency(None)", ""), ("format_percent(12.345)", "12.35%"), ("format_percent(7, decimal_places=0)", "7%"),
    # formulas that cannot be computed
    ("convert_unit(2, 'months', 'weeks')", (None, "Unsupported unit conversion: months -> weeks")), ("zz + 1", (None, "Unknown field reference: zz")),
    ("coalesce(", (None, "Invalid formula syntax: '(' was never closed")), ("a._x", (None, "Private attribute access is not allowed in formulas.")),
    ("a['amount']", (None, "Unsupported formula syntax: Subscript")), ("2 ** 3", (None, "Unsupported binary operator")), ("not flag", (None, "Unsupported unary operator")),
    ("a.amount()", (None, "Only built-in formula helper functions are callable.")), ("o.s + 1", MISSING), ("round(1, 2, 3)", MISSING),
]


def test_formulas_give_values_or_reasons(row):
    made = [compiled(formula, inputs()) for formula, _ in CASES]
    for start in range(0, len(CASES), 25):
        part = made[start : start + 25]
        got = row.select(*[t.value.alias(f"v{i}") for i, t in enumerate(part)], *[(F.lit(None) if t.fault is None else t.fault).alias(f"e{i}") for i, t in enumerate(part)]).first()
        for i, (formula, want) in enumerate(CASES[start : start + 25]):
            want = want if isinstance(want, tuple) else (want, None)
            value = got[f"v{i}"]
            assert (value, got[f"e{i}"]) == want and type(value) is type(want[0]), (formula, value, got[f"e{i}"], want)


def test_plans_are_built_in_threads_without_touching_the_session(spark, row):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: row.select(compiled(f"{n} / z.amount + {n}", inputs()).fault.alias("e")).first()["e"], range(1, 13)))
    assert got == [ZERO_DIVISOR] * 12 and spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_numbers_are_written_as_python_writes_them(spark):
    rng = random.Random(4)
    numbers = [0.0, 1.0, 1325.0, 0.1, 12345678.9, 1e7, 1e15, 1e16, 1.5e16, 1e-3, 9.5e-4, 1e-4, 1.25e-5, 3e-7, 1e22, 1.5e300, -2.5e8, -1e-4]
    numbers += [float(f"{rng.uniform(1, 10):.{rng.randint(0, 8)}f}e{rng.randint(-8, 18)}") for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in numbers], "n double")
    for n, text in df.select("n", python_number(F.col("n"))).collect():
        # the JVM may write more digits than are needed to tell a number from its neighbours
        assert text == str(n) or float(text) == n and ("e" in text) == ("e" in str(n)) and len(text) > len(str(n))
