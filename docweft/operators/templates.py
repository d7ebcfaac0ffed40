"""Template analytics: versions, diffs, contract violations, example coverage and quality.

Definition tables hold one row per field: `template_id`, `name`, `kind` (extracted/calculated), `label`,
`type`, `required`, `citation_required`, `usable_in_formulas`, `allowed_values`, `field_schema` (JSON),
`formula`, `depends_on`, `output_type`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweft.functions import text as tx
from docweft.schema import FIELD_NAME, NO_FIELD_NAME

# ---- fixed values -------------------------------------------------------------------------------
MIN_PROMPT_CHARS = 80
PROMPT_MISSING = (
    "Add a prompt that names the target facts, grounding expectations, and when ambiguous matches should stay "
    "review-required."
)
PROMPT_SHORT = (
    "Strengthen the prompt with edge cases or review guidance so the extraction rules are more specific than the "
    "field labels alone."
)
NO_EXAMPLE = "Finish at least one complete grounded example before saving this draft."
ONE_EXAMPLE = (
    "Add a second complete example with different wording or layout so LangExtract does not overfit a single "
    "document pattern."
)
READY = (
    "This draft has a usable prompt, multiple complete examples, and required field coverage. Next, vary layouts "
    "and phrasing before shipping."
)
INCOMPLETE_TAIL = " still need complete source text, field names, spans, or attribute values."
FORMULA_WORDS = (
    "and", "as", "between", "case", "distinct", "div", "else", "end", "false", "from", "if", "in", "interval", "is", "like",
    "not", "null", "or", "rlike", "then", "true", "when",
)


def latest_version(templates: DataFrame, versions: DataFrame) -> DataFrame:
    """Templates with the version created last, 'n/a' when there is none."""
    newest = versions.groupBy("template_id").agg(
        F.max_by("version", F.struct("created_at", "version_id")).alias("latest_version"))
    return templates.join(newest, "template_id", "left").withColumn(
        "latest_version", F.coalesce("latest_version", F.lit("n/a")))


def version_history(versions: DataFrame) -> DataFrame:
    """Versions of each template numbered from the newest."""
    order = Window.partitionBy("template_id").orderBy(F.desc("created_at"), F.desc("version_id"))
    return versions.withColumn("recency", F.row_number().over(order))


def version_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Field changes between two definition sets of the same templates: added, removed, modified with details."""
    keys = ["template_id", "kind", "name"]
    compared = ["label", "type", "required", "citation_required", "allowed_values", "field_schema", "formula",
                "depends_on", "output_type"]
    left = before.select(*keys, *[F.col(c).alias(f"b_{c}") for c in compared], F.lit(True).alias("_b"))
    right = after.select(*keys, *[F.col(c).alias(f"a_{c}") for c in compared], F.lit(True).alias("_a"))
    joined = left.join(right, keys, "full_outer")

    def pair(name: str) -> tuple[Column, Column]:
        return F.col(f"b_{name}"), F.col(f"a_{name}")

    def change(name: str, render=None) -> Column:
        b, a = pair(name)
        text = F.lit(f"{name} updated") if render is None else F.concat(
            F.lit(f"{name}: "), render(b), F.lit(" -> "), render(a))
        return F.when(~b.eqNullSafe(a), text)

    extracted = [change("label", tx.python_repr), change("type", lambda c: c), change("required", tx.python_bool),
                 change("citation_required", tx.python_bool), change("allowed_values"), change("field_schema")]
    calculated = [change("formula", tx.python_repr), change("depends_on", _repr_list), change("output_type", lambda c: c)]
    details = F.when(F.col("kind") == "extracted", F.array_compact(F.array(*extracted))).otherwise(
        F.array_compact(F.array(*calculated)))
    kind = (F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
            .when(F.size(details) > 0, "modified"))
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    return joined.select(*keys, kind.alias("change"),
                         F.when(both, details).otherwise(F.array().cast("array<string>")).alias("details")).filter(
        "change IS NOT NULL")


def _repr_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, tx.python_repr), ", "), F.lit("]"))


def diff_summary(diff: DataFrame, before: DataFrame, after: DataFrame, guides: DataFrame | None = None) -> DataFrame:
    """Per template: counts of changes, whether its examples changed, and `has_changes`.

    `guides` holds (template_id, before_guide, after_guide), the canonical JSON of prompt and examples.
    """
    counts = diff.groupBy("template_id").agg(*[
        F.count_if((F.col("kind") == kind) & (F.col("change") == change)).alias(f"{kind}_{change}")
        for kind in ("extracted", "calculated") for change in ("added", "removed", "modified")])
    every = before.select("template_id").union(after.select("template_id")).distinct()
    joined = every.join(counts, "template_id", "left").fillna(0)
    if guides is None:
        joined = joined.withColumn("examples_changed", F.lit(False))
    else:
        changed = guides.select("template_id", (~F.col("before_guide").eqNullSafe(F.col("after_guide"))).alias("examples_changed"))
        joined = joined.join(changed, "template_id", "left").fillna({"examples_changed": False})
    total = sum((F.col(c) for c in counts.columns[1:]), F.lit(0))
    return joined.withColumn("has_changes", (total > 0) | F.col("examples_changed"))


def formula_names(formula: Column) -> Column:
    """Distinct field names a formula mentions: names that are no calls, members, types, SQL words or lambda arguments."""
    bare = F.regexp_replace(formula, NO_FIELD_NAME, " ")
    words = F.regexp_extract_all(bare, F.lit(FIELD_NAME), F.lit(1))
    arguments = F.regexp_extract_all(bare, F.lit(r"\b([A-Za-z_]\w*)(?=\s*(?:,\s*[A-Za-z_]\w*\s*)?\)?\s*->)"), F.lit(1))
    names = F.filter(words, lambda w: ~F.lower(w).isin(*FORMULA_WORDS))
    return F.array_sort(F.array_except(names, arguments))


def template_contract(defs: DataFrame) -> DataFrame:
    """Contract violations per template: one row per (template, field, violation, detail)."""
    calcs = defs.filter("kind = 'calculated'").select("template_id", "name", "depends_on",
                                                      formula_names(F.col("formula")).alias("refs"))
    duplicates = defs.groupBy("template_id", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "template_id", "name", F.lit("duplicate_name").alias("violation"), F.col("n").cast("string").alias("detail"))
    known = defs.groupBy("template_id", "name").agg(
        F.bool_and(F.col("usable_in_formulas")).alias("usable"), F.lit(True).alias("known"))
    edges = calcs.select("template_id", "name", F.explode("refs").alias("ref")).join(
        known.select("template_id", F.col("name").alias("ref"), "usable", "known"), ["template_id", "ref"], "left")
    unknown = edges.filter("known IS NULL").select(
        "template_id", "name", F.lit("unknown_reference").alias("violation"), F.col("ref").alias("detail"))
    blocked = edges.filter("NOT usable").select(
        "template_id", "name", F.lit("not_usable_in_formulas").alias("violation"), F.col("ref").alias("detail"))
    usable = edges.filter("usable").groupBy("template_id", "name").agg(F.array_sort(F.collect_set("ref")).alias("used"))
    declared = calcs.join(usable, ["template_id", "name"], "left").filter(
        ~F.array_sort("depends_on").eqNullSafe(F.coalesce("used", F.array().cast("array<string>"))))
    mismatch = declared.select("template_id", "name", F.lit("depends_on_mismatch").alias("violation"),
                               F.array_join(F.array_sort("depends_on"), ",").alias("detail"))
    cycles = formula_cycles(calcs).select(
        "template_id", "name", F.lit("circular_dependency").alias("violation"), F.col("name").alias("detail"))
    return duplicates.union(unknown).union(blocked).union(mismatch).union(cycles)


def formula_cycles(calcs: DataFrame) -> DataFrame:
    """Calculated fields that take part in a circular dependency.

    A template's calculated fields fit in one row (they are stored as one definition), so the graph is peeled
    inside the row: fields whose references are all settled are dropped until none is left or a cycle remains,
    then fields nothing in the remainder refers to are dropped the same way.
    """
    graphs = calcs.groupBy("template_id").agg(F.collect_list(F.struct("name", "refs")).alias("graph"))
    rounds = F.sequence(F.lit(1), F.size("graph"))

    def names(graph: Column) -> Column:
        return F.transform(graph, lambda node: node["name"])

    def drop_settled(graph: Column, _: Column) -> Column:
        return F.filter(graph, lambda node: F.arrays_overlap(node["refs"], names(graph)))

    def drop_unreferenced(graph: Column, _: Column) -> Column:
        return F.filter(graph, lambda node: F.array_contains(
            F.flatten(F.transform(graph, lambda other: other["refs"])), node["name"]))

    unsettled = graphs.withColumn("graph", F.aggregate(rounds, F.col("graph"), drop_settled)).filter(F.size("graph") > 0)
    circular = unsettled.withColumn("graph", F.aggregate(rounds, F.col("graph"), drop_unreferenced))
    return circular.select("template_id", F.explode(F.array_distinct(names(F.col("graph")))).alias("name"))


def example_coverage(examples: DataFrame, defs: DataFrame) -> DataFrame:
    """Per template: covered fields, uncovered required fields, example classes the template does not define.

    `examples` holds one row per example extraction (template_id, extraction_class).
    """
    used = examples.select("template_id", tx.strip(F.col("extraction_class")).alias("name")).filter("name <> ''").distinct()
    fields = defs.filter("kind = 'extracted'").select("template_id", "name", "required")
    joined = fields.join(used.withColumn("_used", F.lit(True)), ["template_id", "name"], "full_outer")
    defined, covered = F.col("required").isNotNull(), F.col("_used").isNotNull()

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, F.col("name"))))

    return joined.groupBy("template_id").agg(
        names(defined & covered).alias("covered_fields"),
        names(F.col("required") & covered).alias("covered_required_fields"),
        names(F.col("required") & ~covered).alias("missing_required_fields"),
        names(~defined).alias("unknown_classes"),
    )


def example_complete(example: Column) -> Column:
    """A draft example is complete when text, classes, spans and every attribute are filled in."""

    def attribute_filled(a: Column) -> Column:
        listed = F.exists(F.split(a["value"], "\n"), lambda line: tx.strip(line) != "")
        filled = F.when(a["value_kind"] == "string_array", listed).otherwise(tx.strip(a["value"]) != "")
        return (tx.strip(a["key"]) != "") & filled

    def extraction_filled(e: Column) -> Column:
        return ((tx.strip(e["extraction_class"]) != "") & (tx.strip(e["extraction_text"]) != "")
                & F.forall(e["attributes"], attribute_filled))

    return (tx.strip(example["text"]) != "") & (F.size(example["extractions"]) > 0) & F.forall(
        example["extractions"], extraction_filled)


def example_quality(drafts: DataFrame) -> DataFrame:
    """Guidance for drafts (prompt, examples, required_fields): complete examples, messages, ready flag."""
    complete = F.filter("examples", example_complete)
    classes = F.flatten(F.transform(complete, lambda e: F.transform(e["extractions"], lambda x: tx.strip(x["extraction_class"]))))
    missing = F.array_except("required_fields", classes)
    prompt = tx.strip(F.col("prompt"))
    df = drafts.withColumns({
        "complete_examples": F.size(complete),
        "incomplete_examples": F.size("examples") - F.size(complete),
        "missing_required_fields": missing,
    })
    n, bad = F.col("complete_examples"), F.col("incomplete_examples")
    messages = F.array_compact(F.array(
        F.when(prompt == "", PROMPT_MISSING).when(F.length(prompt) < MIN_PROMPT_CHARS, PROMPT_SHORT),
        F.when(n == 0, NO_EXAMPLE).when(n == 1, ONE_EXAMPLE),
        F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" example draft"), F.when(bad == 1, "").otherwise("s"), F.lit(INCOMPLETE_TAIL))),
        F.when(F.size("missing_required_fields") > 0, F.concat(
            F.lit("Cover the remaining required fields in complete examples: "), F.array_join("missing_required_fields", ", "), F.lit("."))),
    ))
    df = df.withColumn("messages", messages)
    # Any single message counts as ready, also a single complaint.
    shown = F.when(F.size("messages") == 0, F.array(F.lit(READY))).otherwise(F.col("messages"))
    return df.withColumn("messages", shown).withColumn("is_ready", F.size("messages") == 1)


def comparable_example(text: Column, extractions: Column) -> Column:
    """Canonical JSON of an example after trimming: the same example always renders the same."""
    body = tx.strip(F.replace(text, F.lit("\r\n"), F.lit("\n")))

    def extraction(e: Column) -> Column:
        trimmed = F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(
            F.transform_keys(e["attributes"], lambda k, _: tx.strip(k)), lambda _, v: tx.strip(v)))))
        return F.struct(tx.strip(e["extraction_class"]).alias("extraction_class"),
                        tx.strip(e["extraction_text"]).alias("extraction_text"), trimmed.alias("attributes"))

    return F.to_json(F.struct(body.alias("text"), F.transform(extractions, extraction).alias("extractions")))


def applied_suggestions(examples: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggestions of a template that are already one of its complete draft examples."""
    def empty_part(e: Column) -> Column:
        blank_attribute = F.exists(F.map_entries(e["attributes"]), lambda kv: (tx.strip(kv["key"]) == "") | (tx.strip(kv["value"]) == ""))
        return (tx.strip(e["extraction_class"]) == "") | (tx.strip(e["extraction_text"]) == "") | blank_attribute

    usable = examples.filter((tx.strip(F.col("text")) != "") & (F.size("extractions") > 0) & ~F.exists("extractions", empty_part))
    drafts = usable.select("template_id", comparable_example(F.col("text"), F.col("extractions")).alias("_canonical"))
    offered = suggestions.withColumn("_canonical", comparable_example(F.col("example_text"), F.col("extractions")))
    return offered.join(drafts, ["template_id", "_canonical"], "left_semi").drop("_canonical")


def duplicate_template_names(templates: DataFrame) -> DataFrame:
    return templates.groupBy("tenant_id", "name").agg(F.count(F.lit(1)).alias("n_templates")).filter("n_templates > 1")
