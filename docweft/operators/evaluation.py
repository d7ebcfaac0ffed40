"""Evaluation of results against golden expectations, and quality gates."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docweft.functions import text as tx

# ---- fixed values -------------------------------------------------------------------------------
NUMBER_TOLERANCE = 0.01
RELATIVE_TOLERANCE = 1e-9
FIELD_MISSING = "field missing from extraction output"
# family: (field accuracy at least, citation coverage at least, review rate at most)
SLO_TARGETS = {
    "invoice": (0.95, 0.90, 0.25),
    "receipt": (0.93, 0.85, 0.30),
    "lease": (0.92, 0.88, 0.30),
    "statement": (0.90, 0.85, 0.35),
}


def normalize_string(text: Column) -> Column:
    """Dashes and underscores to spaces, blanks collapsed, trimmed, case folded."""
    spaced = F.translate(text, "-_", "  ")
    return tx.fold_case(tx.strip(F.regexp_replace(spaced, tx.BLANK_CLASS + "+", " ")))


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    is_number = F.startswith(shape, F.lit("BIGINT")) | F.startswith(shape, F.lit("DECIMAL")) | F.startswith(
        shape, F.lit("DOUBLE")) | F.startswith(shape, F.lit("FLOAT"))
    return F.when(is_number, "number").otherwise(F.regexp_extract(shape, r"\A([A-Z]+)", 1))


def _loads(text: str | None):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return False, None


def _plain_string(text: str) -> str:
    return re.sub(tx.BLANK_CLASS + "+", " ", text.translate(_DASHES)).strip(_BLANKS).casefold()


_DASHES = str.maketrans("-_", "  ")
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if re.match(tx.BLANK_CLASS, c))


def _matches(expected, actual) -> bool:
    """Goes down both values side by side, on a list of open pairs, so any depth will do."""
    open_ = [(expected, actual)]
    while open_:
        e, a = open_.pop()
        if isinstance(e, dict) and isinstance(a, dict):
            if any(name not in a for name in e):
                return False
            open_ += [(inner, a[name]) for name, inner in e.items()]
        elif isinstance(e, list) and isinstance(a, list):
            if len(e) != len(a):
                return False
            open_ += zip(e, a)
        elif isinstance(e, str) and isinstance(a, str):
            if e != a and _plain_string(e) != _plain_string(a):
                return False
        elif e is None or isinstance(e, bool) or isinstance(a, bool):
            if e is not a:
                return False
        elif isinstance(e, int | float) and isinstance(a, int | float):
            if abs(e - a) > max(NUMBER_TOLERANCE, RELATIVE_TOLERANCE * max(abs(e), abs(a))):
                return False
        else:
            return False
    return True


@F.pandas_udf(T.BooleanType())
def _json_texts_match(expected: pd.Series, actual: pd.Series) -> pd.Series:
    sides = ((_loads(e), _loads(a)) for e, a in zip(expected, actual))
    return pd.Series([ok and too and _matches(e, a) for (ok, e), (too, a) in sides], dtype=bool)


def json_match(expected: Column, actual: Column) -> Column:
    """Tolerant comparison of two JSON texts.

    Strings after `normalize_string`, numbers within 0.01, lists element by element with equal length, objects on the expected
    members only, at any depth. Texts that are not JSON match only equal ones; those are never parsed.
    """
    same = F.coalesce(expected == actual, F.lit(False))
    return same | _json_texts_match(F.when(~same, expected), F.when(~same, F.coalesce(actual, F.lit("null"))))


def values_match(expected: Column, actual: Column) -> Column:
    """`json_match` of two JSON values (variants)."""
    return json_match(F.to_json(expected), F.to_json(actual))


def _pair_matches(p: Mapping[str, Column]) -> Column:
    """`json_match` with scalars in generated code; only lists and objects go through the batch function."""
    e, a = p["e"], p["a"]
    same_kind = p["kind"] == p["other"]
    number = [F.try_variant_get(side, "$", "double") for side in (e, a)]
    slack = F.greatest(F.lit(NUMBER_TOLERANCE), RELATIVE_TOLERANCE * F.greatest(F.abs(number[0]), F.abs(number[1])))
    text = [F.try_variant_get(side, "$", "string") for side in (e, a)]
    nested = p["kind"].isin("ARRAY", "OBJECT") & same_kind
    return (
        F.when(p["kind"] == "VOID", a.isNull() | same_kind)
        .when(~F.coalesce(same_kind, F.lit(False)), False)
        .when(p["kind"] == "number", F.abs(number[0] - number[1]) <= slack)
        .when(p["kind"] == "STRING", (text[0] == text[1]) | (normalize_string(text[0]) == normalize_string(text[1])))
        .when(p["kind"] == "BOOLEAN", text[0] == text[1])
        .otherwise(_json_texts_match(F.when(nested, F.to_json(e)), F.when(nested, F.to_json(a))))
    )


def compare_expectations(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ("case_name", "category", "field_name"), values: bool = False,
) -> DataFrame:
    """One row per expected check: extracted value, normalized value, review flag. values: with `expected` and `got` as JSON.

    `expected` holds JSON texts `extracted_json`, `normalized_json` and boolean `review` (null = no check);
    `actual` the same columns. A field missing from the results fails all its checks. For calculated fields
    the `normalized_json` of the results is the calculated value.
    """
    found = actual.select(*keys, F.col("extracted_json").alias("a_extracted"), F.col("normalized_json").alias("a_normalized"),
                          F.col("review").alias("a_review"), F.lit(True).alias("_found"))
    joined = expected.join(found, list(keys), "left")
    present = F.coalesce("_found", F.lit(False))
    # Parsed values, their kinds and the verdicts become columns of their own steps: each text is parsed and
    # compared once, scalars in generated code. Equal texts are never parsed.
    sides = {"extracted": ("extracted_json", "a_extracted"), "normalized": ("normalized_json", "a_normalized")}
    parsed = joined.withColumns({
        f"_{name}_{side}": F.when(~F.col(pair[0]).eqNullSafe(F.col(pair[1])), F.try_parse_json(pair[i]))
        for name, pair in sides.items() for i, side in enumerate(("e", "a"))})
    joined = parsed.withColumns({
        f"_{name}_{kind}": _kind(F.col(f"_{name}_{side}")) for name in sides for side, kind in (("e", "kind"), ("a", "other"))})

    def text_match(name: str) -> Column:
        members = {m: F.col(f"_{name}_{m}") for m in ("e", "a", "kind", "other")}
        same = F.col(sides[name][0]).eqNullSafe(F.col(sides[name][1]))
        return same | F.coalesce(_pair_matches(members), F.lit(False))

    joined = joined.withColumns({f"_{name}_match": present & text_match(name) for name in sides}).withColumn(
        "_review_match", present & F.coalesce(F.col("review") == F.col("a_review"), F.lit(False)))

    def check(name: str, wanted: Column, passed: Column, got: Column) -> Column:
        detail = F.when(~present, FIELD_MISSING).when(~passed, f"{name} mismatch")
        both = [wanted.cast("string").alias("expected"), F.when(present, got.cast("string")).alias("got")] if values else []
        return F.when(wanted.isNotNull(), F.struct(F.lit(name).alias("check"), passed.alias("matched"), detail.alias("detail"), *both))

    checks = F.array_compact(F.array(
        check("extracted_value", F.col("extracted_json"), F.col("_extracted_match"), F.col("a_extracted")),
        check("normalized_value", F.col("normalized_json"), F.col("_normalized_match"), F.col("a_normalized")),
        check("requires_review", F.col("review"), F.col("_review_match"), F.col("a_review")),
    ))
    return joined.select(*keys, F.inline(checks))


def review_flags_match(cases: DataFrame) -> DataFrame:
    """Set equality of `expected_flags` and `actual_flags`."""
    def as_set(name: str) -> Column:
        return F.array_sort(F.array_distinct(F.col(name)))

    return cases.withColumn("matched", as_set("expected_flags").eqNullSafe(as_set("actual_flags")))


def notes_match(cases: DataFrame) -> DataFrame:
    """One row per expected note of a case: is it part of any actual note after normalization?"""
    return cases.select(
        "case_name", F.explode("expected_notes").alias("expected_note"), "actual_notes").select(
        "case_name", "expected_note",
        F.coalesce(F.exists("actual_notes", lambda n: F.contains(normalize_string(n), normalize_string(F.col("expected_note")))),
                   F.lit(False)).alias("matched"))


def case_results(checks: DataFrame) -> DataFrame:
    """Per case: matched and failed checks, passed when nothing failed."""
    totals = checks.groupBy("case_name").agg(
        F.count_if("matched").alias("matched_checks"), F.count_if(~F.col("matched")).alias("failed_checks"))
    return totals.withColumn("passed", F.col("failed_checks") == 0)


def mismatches(checks: DataFrame) -> DataFrame:
    """Failed checks as JSON per case, for the history table (bounded by one case's expectations)."""
    item = F.struct(F.col("category"), F.col("field_name").alias("subject"), F.col("detail"))
    return checks.groupBy("case_name").agg(
        F.to_json(F.sort_array(F.collect_list(F.when(~F.col("matched"), item)))).alias("mismatches_json"))


CHECK_COLUMNS = ("case_name", "category", "subject", "check", "matched", "expected", "got")


def run_checks(field_checks: DataFrame, cases: DataFrame) -> DataFrame:
    """All checks of a run as one stream of rows: fields and calculated fields, review flags, document notes.

    field_checks: of `compare_expectations` with values. cases: case_name, expected_flags, actual_flags, expected_notes, actual_notes
    (null: none). A missing field's `got` is null. Lists are JSON.
    """
    none = F.array().cast("array<string>")
    held = cases.select("case_name", *[F.coalesce(c, none).alias(c) for c in ("expected_flags", "actual_flags", "expected_notes", "actual_notes")])
    fields = field_checks.withColumnRenamed("field_name", "subject").withColumn("missing", F.coalesce(F.col("detail") == FIELD_MISSING, F.lit(False)))
    as_set = lambda name: F.array_sort(F.array_distinct(F.col(name)))
    flags = held.select(
        "case_name", F.lit("review_flags").alias("category"), F.lit("fields_requiring_review").alias("subject"), F.lit("review_flags").alias("check"),
        as_set("expected_flags").eqNullSafe(as_set("actual_flags")).alias("matched"), F.to_json(as_set("expected_flags")).alias("expected"),
        F.to_json(as_set("actual_flags")).alias("got"), F.lit(False).alias("missing"))
    per_note = held.select("case_name", "actual_notes", F.explode("expected_notes").alias("note"))
    notes = per_note.select(
        "case_name", F.lit("document_note").alias("category"), F.col("note").alias("subject"), F.lit("document_note").alias("check"),
        F.coalesce(F.exists("actual_notes", lambda n: F.contains(normalize_string(n), normalize_string(F.col("note")))), F.lit(False)).alias("matched"),
        F.col("note").alias("expected"), F.to_json("actual_notes").alias("got"), F.lit(False).alias("missing"))
    columns = [*CHECK_COLUMNS, "missing"]
    return fields.select(*columns).unionByName(flags.select(*columns)).unionByName(notes.select(*columns))


def mismatch_detail() -> Column:
    """What a failed check says, with the expected and the actual value."""
    expected, got = F.coalesce("expected", F.lit("null")), F.coalesce("got", F.lit("null"))
    both = F.concat(F.lit("expected "), expected, F.lit(", got "), got)
    return (
        F.when(F.col("missing"), FIELD_MISSING).when(F.col("check") == "review_flags", both)
        .when(F.col("check") == "document_note", F.concat(F.lit("expected note containing "), expected, F.lit(", got "), got))
        .otherwise(F.concat(F.col("check"), F.lit(" mismatch: "), both)))


def case_run(checks: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case of a run, also those without checks: matched and failed checks, passed, mismatches_json and the other columns of cases.

    One aggregation; a case's mismatches are bounded by its expectations. All checks of a missing field count as failed, but it is one mismatch.
    """
    item = F.when(~F.col("matched"), F.struct("category", "subject", mismatch_detail().alias("detail")))
    totals = checks.groupBy("case_name").agg(
        F.count_if("matched").alias("matched_checks"), F.count_if(~F.col("matched")).alias("failed_checks"),
        F.to_json(F.sort_array(F.collect_set(item))).alias("mismatches_json"))
    about = [c for c in cases.columns if not c.startswith(("expected_", "actual_"))]
    joined = cases.select(*about).join(totals, "case_name", "left")
    return joined.fillna({"matched_checks": 0, "failed_checks": 0, "mismatches_json": "[]"}).withColumn("passed", F.col("failed_checks") == 0)


def eval_report(cases: DataFrame) -> DataFrame:
    """Run totals as one row."""
    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if("passed").alias("passed_cases"),
        F.count_if(~F.col("passed")).alias("failed_cases"),
        F.coalesce(F.sum("matched_checks"), F.lit(0)).alias("matched_checks"),
        F.coalesce(F.sum("failed_checks"), F.lit(0)).alias("failed_checks"))


def eval_trend(history: DataFrame) -> DataFrame:
    """Run-over-run change per label from the appended run history."""
    order = Window.partitionBy("label").orderBy("generated_at", "run_id")
    return history.withColumns({
        "passed_change": F.col("passed_cases") - F.lag("passed_cases").over(order),
        "failed_checks_change": F.col("failed_checks") - F.lag("failed_checks").over(order),
    })


def quality_slo(fields: DataFrame, key: str = "document_type") -> DataFrame:
    """Field accuracy of required fields, citation coverage and review rate per schema family."""
    def rate(flag: str, among: Column) -> Column:
        return F.round(F.try_divide(F.count_if(F.col(flag) & among).cast("double"), F.count_if(among).cast("double")), 6)

    cited = fields.withColumn("cited", F.coalesce("source_text", F.lit("")) != "")
    return cited.groupBy(key).agg(
        rate("is_correct", F.col("required")).alias("field_accuracy"),
        rate("cited", F.col("citation_required")).alias("citation_coverage"),
        rate("requires_review", F.lit(True)).alias("review_rate"))


def slo_gate(rates: DataFrame, targets: dict[str, tuple[float, float, float]] | None = None, key: str = "document_type") -> DataFrame:
    """Breaches of the family targets: one row per (family, metric, actual, target)."""
    limits = SLO_TARGETS if targets is None else targets

    def target(position: int) -> Column:
        pairs = [F.lit(x) for family, t in limits.items() for x in (family, t[position])]
        return F.try_element_at(F.create_map(*pairs), F.col(key))

    def breach(metric: str, position: int, at_least: bool) -> Column:
        actual, goal = F.col(metric), target(position)
        failed = actual < goal if at_least else actual > goal
        return F.when(failed, F.struct(F.lit(metric).alias("metric"), actual.alias("actual"), goal.alias("target")))

    breaches = F.array_compact(F.array(
        breach("field_accuracy", 0, True), breach("citation_coverage", 1, True), breach("review_rate", 2, False)))
    return rates.select(key, F.inline(breaches))
