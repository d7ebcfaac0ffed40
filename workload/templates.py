"""Template analytics queries: definitions, versions and examples derived from `part`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweft.operators import templates as tp
from workload import views as v
from workload.extraction import joined
from workload.registry import query

K = "p_partkey"


def name_of(key: Column) -> Column:
    return F.concat(F.lit("f_"), key.cast("string"))


def definitions(spark: SparkSession, sf_dir: str, after: bool = False) -> DataFrame:
    """Field definitions, 40 consecutive parts per template; the later version drops, adds and changes some."""
    k, size = F.col(K), F.col("p_size")
    part = v.table(spark, sf_dir, "part").select(K, "p_name", "p_type", "p_size").filter(k % 10 != (2 if after else 1))

    def changed(every: int, old: Column, new: Column) -> Column:
        return F.when(k % every == 0, new).otherwise(old) if after else old

    calculated = k % 4 == 0
    label = changed(5, F.col("p_name"), F.concat(F.col("p_name"), F.when(k % 15 == 0, " o'clock").otherwise(" v2")))
    kind = F.when(calculated, "calculated").otherwise("extracted")
    formula = F.when(calculated, F.concat(name_of(k - 4), F.lit(" * 2")))
    depends = F.when(calculated, F.array(name_of(k - 4)))
    return part.select(
        (F.floor(k / 40)).cast("bigint").alias("template_id"), kind.alias("kind"), name_of(k).alias("name"), label.alias("label"),
        changed(7, F.lower("p_type"), F.lit("number")).alias("type"), changed(9, size > 25, size <= 25).alias("required"),
        changed(11, size % 2 == 0, size % 2 == 1).alias("citation_required"), F.lit(True).alias("usable_in_formulas"),
        changed(13, F.array("p_type"), F.array("p_type", F.lit("OTHER"))).alias("allowed_values"),
        F.lit(None).cast("string").alias("field_schema"), changed(6, formula, F.concat(formula, F.lit(" + 1"))).alias("formula"),
        changed(8, depends, F.when(calculated, F.array().cast("array<string>"))).alias("depends_on"),
        changed(12, F.lit("number"), F.lit("currency")).alias("output_type"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per part; templates are brands."""
    k = F.col(K)
    return v.table(spark, sf_dir, "part").filter(k % 50 != 49).select(
        F.col("p_brand").alias("template_id"), k.alias("version_id"), F.concat(F.lit("1."), k.cast("string")).alias("version"),
        F.col("p_size").alias("created_at"))


def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = v.table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return brands.select(F.col("p_brand").alias("template_id"), F.col("p_type").alias("name"),
                         F.when(F.col("p_brand") < "Brand#2", "tenant_a").otherwise("tenant_b").alias("tenant_id"))


@query("g01_latest_version", """
WITH v AS (SELECT p_brand AS template_id, p_partkey AS version_id, '1.' || p_partkey AS version, p_size AS created_at FROM part WHERE p_partkey % 50 <> 49)
SELECT t.template_id, coalesce(first(version ORDER BY created_at DESC, version_id DESC), 'n/a') AS latest_version
FROM (SELECT DISTINCT p_brand AS template_id FROM part UNION SELECT 'Brand#none') t LEFT JOIN v ON v.template_id = t.template_id GROUP BY 1""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = v.table(spark, sf_dir, "part").select(F.explode(F.array("p_brand", F.lit("Brand#none"))).alias("template_id")).distinct()
    return tp.latest_version(brands, versions(spark, sf_dir))


@query("g02_version_history", """
SELECT p_brand AS template_id, p_partkey AS version_id, '1.' || p_partkey AS version,
  CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS INTEGER) AS recency FROM part WHERE p_partkey % 50 <> 49""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.version_history(versions(spark, sf_dir)).drop("created_at")


DIFF_SQL = """
WITH d AS (SELECT p_partkey AS k, p_partkey // 40 AS template_id, CASE WHEN p_partkey % 4 = 0 THEN 'calculated' ELSE 'extracted' END AS kind, 'f_' || p_partkey AS name,
  p_name, p_size, lower(p_type) AS t, p_size > 25 AS req, p_size % 2 = 0 AS cit FROM part),
diff AS (SELECT template_id, kind, name, CASE WHEN k % 10 = 1 THEN 'added' WHEN k % 10 = 2 THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN k % 10 IN (1, 2) THEN [] WHEN kind = 'extracted' THEN list_filter([
    CASE WHEN k % 5 = 0 THEN 'label: ''' || p_name || ''' -> ' || CASE WHEN k % 15 = 0 THEN '"' || p_name || ' o''clock"' ELSE '''' || p_name || ' v2''' END END,
    CASE WHEN k % 7 = 0 AND t <> 'number' THEN 'type: ' || t || ' -> number' END,
    CASE WHEN k % 9 = 0 THEN 'required: ' || CASE WHEN req THEN 'True -> False' ELSE 'False -> True' END END,
    CASE WHEN k % 11 = 0 THEN 'citation_required: ' || CASE WHEN cit THEN 'True -> False' ELSE 'False -> True' END END,
    CASE WHEN k % 13 = 0 THEN 'allowed_values updated' END], lambda x: x IS NOT NULL)
  ELSE list_filter([CASE WHEN k % 6 = 0 THEN 'formula: ''f_' || (k - 4) || ' * 2'' -> ''f_' || (k - 4) || ' * 2 + 1''' END,
    CASE WHEN k % 8 = 0 THEN 'depends_on: [''f_' || (k - 4) || '''] -> []' END, CASE WHEN k % 12 = 0 THEN 'output_type: number -> currency' END], lambda x: x IS NOT NULL) END AS details FROM d)
"""


@query("g03_version_diff", DIFF_SQL + """
SELECT template_id, kind, name, change, array_to_string(details, '|') AS details FROM diff WHERE change <> 'modified' OR len(details) > 0""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = tp.version_diff(definitions(spark, sf_dir), definitions(spark, sf_dir, after=True))
    return diff.withColumn("details", joined(F.col("details")))


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical prompt and examples of the templates; those with an even number of large parts change."""
    per = v.table(spark, sf_dir, "part").groupBy(F.floor(F.col(K) / 40).cast("bigint").alias("template_id")).agg(
        F.count_if(F.col("p_size") > 40).alias("n"))
    return per.select("template_id", F.lit("{}").alias("before_guide"), F.when(F.col("n") % 2 == 0, '{"a":1}').otherwise("{}").alias("after_guide"))


@query("g03_diff_summary", DIFF_SQL + """,
kept AS (SELECT * FROM diff WHERE change <> 'modified' OR len(details) > 0),
per AS (SELECT p_partkey // 40 AS template_id, count(*) FILTER (WHERE p_size > 40) % 2 = 0 AS examples_changed FROM part GROUP BY 1)
SELECT p.template_id, """ + ", ".join(f"count(*) FILTER (WHERE kind = '{k}' AND change = '{c}') AS {k}_{c}" for k in ("extracted", "calculated") for c in ("added", "removed", "modified")) + """,
  any_value(examples_changed) AS examples_changed, count(k.name) > 0 OR any_value(examples_changed) AS has_changes
FROM per p LEFT JOIN kept k ON k.template_id = p.template_id GROUP BY 1""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = definitions(spark, sf_dir), definitions(spark, sf_dir, after=True)
    return tp.diff_summary(tp.version_diff(before, after), before, after, guides(spark, sf_dir))


def contract_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with planted faults: duplicate names, ghosts, blocked and undeclared inputs, cycles."""
    k, size = F.col(K), F.col("p_size")
    calculated, group = k % 4 == 0, F.floor(k / 40)
    ref = F.when(k % 40 != 0, name_of(k - 4)).when(group % 5 == 0, name_of(k + 36)).otherwise(name_of(k + 1))
    ghost = F.when(size < 5, F.concat(F.lit("ghost_"), k.cast("string")))
    blocked = F.when(size % 6 == 0, name_of(k + 2))
    formula = F.concat_ws(" + ", F.concat(F.lit("coalesce("), ref, F.lit(".amount, 0) * 2")), ghost, blocked)
    declared = F.when(size % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(ref))
    name = F.when(k % 41 == 1, name_of(k + 1)).otherwise(name_of(k))
    nothing = F.lit(None).cast("string")
    return v.table(spark, sf_dir, "part").select(
        group.cast("bigint").alias("template_id"), F.when(calculated, "calculated").otherwise("extracted").alias("kind"), name.alias("name"),
        F.when(calculated, formula).otherwise(nothing).alias("formula"), F.when(calculated, declared).alias("depends_on"),
        (~(~calculated & (size % 5 == 0))).alias("usable_in_formulas"), (size > 25).alias("required"))


CONTRACT_SQL = """
WITH RECURSIVE d AS (SELECT p_partkey // 40 AS template_id, p_partkey AS k, p_size, p_partkey % 4 = 0 AS calc,
  'f_' || CASE WHEN p_partkey % 41 = 1 THEN p_partkey + 1 ELSE p_partkey END AS name, NOT (p_partkey % 4 <> 0 AND p_size % 5 = 0) AS usable,
  'f_' || CASE WHEN p_partkey % 40 <> 0 THEN p_partkey - 4 WHEN (p_partkey // 40) % 5 = 0 THEN p_partkey + 36 ELSE p_partkey + 1 END AS ref FROM part),
known AS (SELECT template_id, name, bool_and(usable) AS usable FROM d GROUP BY 1, 2),
edges AS (SELECT template_id, name, k, p_size, unnest(list_filter([ref, CASE WHEN p_size < 5 THEN 'ghost_' || k END, CASE WHEN p_size % 6 = 0 THEN 'f_' || (k + 2) END], lambda x: x IS NOT NULL)) AS ref FROM d WHERE calc),
checked AS (SELECT DISTINCT e.template_id, e.name, e.ref, k.name IS NULL AS unknown, k.usable FROM edges e LEFT JOIN known k ON k.template_id = e.template_id AND k.name = e.ref),
links AS (SELECT DISTINCT c.template_id, c.name, c.ref FROM checked c JOIN d ON d.template_id = c.template_id AND d.name = c.ref AND d.calc),
reach AS (SELECT template_id, name AS start, ref AS node FROM links UNION SELECT r.template_id, r.start, l.ref FROM reach r JOIN links l ON l.template_id = r.template_id AND l.name = r.node),
used AS (SELECT template_id, name, list_sort(list(ref)) AS used FROM checked WHERE usable GROUP BY 1, 2)
SELECT template_id, name, 'duplicate_name' AS violation, CAST(count(*) AS VARCHAR) AS detail FROM d GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT template_id, name, 'unknown_reference', ref FROM checked WHERE unknown
UNION ALL SELECT template_id, name, 'not_usable_in_formulas', ref FROM checked WHERE NOT usable
UNION ALL SELECT d.template_id, d.name, 'depends_on_mismatch', CASE WHEN p_size % 7 = 0 THEN '' ELSE ref END FROM d LEFT JOIN used u ON u.template_id = d.template_id AND u.name = d.name
  WHERE calc AND coalesce(used, []) <> CASE WHEN p_size % 7 = 0 THEN [] ELSE [ref] END
UNION ALL SELECT DISTINCT template_id, start, 'circular_dependency', start FROM reach WHERE start = node"""


@query("g04_template_contract", CONTRACT_SQL)
def template_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.template_contract(contract_definitions(spark, sf_dir))


@query("g05_example_coverage", """
WITH fields AS (SELECT p_partkey // 40 AS template_id, 'f_' || p_partkey AS name, p_size > 25 AS required FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 10 <> 1),
used AS (SELECT p_partkey // 40 AS template_id, CASE WHEN p_partkey % 17 = 0 THEN 'x_' || p_partkey ELSE 'f_' || p_partkey END AS name FROM part WHERE p_partkey % 3 <> 0),
j AS (SELECT coalesce(f.template_id, u.template_id) AS template_id, coalesce(f.name, u.name) AS name, f.required, f.name IS NOT NULL AS defined, u.name IS NOT NULL AS covered
  FROM fields f FULL OUTER JOIN used u ON u.template_id = f.template_id AND u.name = f.name)
SELECT template_id, coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE defined AND covered), '') AS covered_fields,
  coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE required AND covered), '') AS covered_required_fields,
  coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE required AND NOT covered), '') AS missing_required_fields,
  coalesce(string_agg(name, '|' ORDER BY name) FILTER (WHERE NOT defined), '') AS unknown_classes FROM j GROUP BY 1""")
def example_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(K)
    extraction_class = F.concat(F.when(k % 17 == 0, " x_").otherwise("f_"), k.cast("string"), F.lit(" "))
    examples = v.table(spark, sf_dir, "part").filter(k % 3 != 0).select(
        F.floor(k / 40).cast("bigint").alias("template_id"), extraction_class.alias("extraction_class"))
    covered = tp.example_coverage(examples, definitions(spark, sf_dir))
    return covered.select("template_id", *[joined(F.col(c)).alias(c) for c in covered.columns[1:]])


QUALITY_SQL = f"""
WITH d AS (SELECT p_partkey AS k, trim(repeat(p_name || ' ', CAST(p_partkey % 8 AS INTEGER))) AS prompt, p_partkey % 4 AS n FROM part),
q AS (SELECT *, n - CASE WHEN n > 0 AND k % 5 = 0 THEN 1 ELSE 0 END - CASE WHEN n > 1 AND k % 7 = 0 THEN 1 ELSE 0 END AS complete FROM d),
r AS (SELECT *, n - complete AS bad, list_filter(['f_0', 'f_1'], lambda f: NOT (
    (f = 'f_0' AND n > 0 AND k % 5 <> 0) OR (f = 'f_1' AND n > 1 AND k % 7 <> 0))) AS missing FROM q),
m AS (SELECT *, list_filter([CASE WHEN prompt = '' THEN '{tp.PROMPT_MISSING}' WHEN length(prompt) < 80 THEN '{tp.PROMPT_SHORT}' END,
  CASE complete WHEN 0 THEN '{tp.NO_EXAMPLE}' WHEN 1 THEN '{tp.ONE_EXAMPLE}' END,
  CASE WHEN bad > 0 THEN bad || ' example draft' || CASE WHEN bad = 1 THEN '' ELSE 's' END || '{tp.INCOMPLETE_TAIL}' END,
  CASE WHEN len(missing) > 0 THEN 'Cover the remaining required fields in complete examples: ' || array_to_string(missing, ', ') || '.' END], lambda x: x IS NOT NULL) AS ms FROM r)
SELECT k AS draft_id, CAST(complete AS INTEGER) AS complete_examples, CAST(bad AS INTEGER) AS incomplete_examples,
  CASE WHEN len(ms) = 0 THEN '{tp.READY}' ELSE array_to_string(ms, '|') END AS messages, len(ms) <= 1 AS is_ready FROM m"""


@query("g06_example_quality", QUALITY_SQL)
def example_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts with up to three examples: the first may lack its text, the second an attribute value."""
    k = F.col(K)

    def example(i: Column) -> Column:
        value = F.when((i == 1) & (k % 7 == 0), " \n ").otherwise("a\nb")
        attribute = F.struct(F.lit("value").alias("key"), F.when(i == 1, "string_array").otherwise("string").alias("value_kind"), value.alias("value"))
        extraction = F.struct(F.concat(F.lit(" f_"), i.cast("string")).alias("extraction_class"), F.lit("span").alias("extraction_text"),
                              F.array(attribute).alias("attributes"))
        return F.struct(F.when((i == 0) & (k % 5 == 0), " ").otherwise("text").alias("text"), F.array(extraction).alias("extractions"))

    numbers = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < k % 4)
    prompt = F.call_function("repeat", F.concat(F.col("p_name"), F.lit(" ")), (k % 8).cast("int"))
    drafts = v.table(spark, sf_dir, "part").select(
        k.alias("draft_id"), prompt.alias("prompt"), F.transform(numbers, example).alias("examples"),
        F.array(F.lit("f_0"), F.lit("f_1")).alias("required_fields"))
    return tp.example_quality(drafts).select(
        "draft_id", "complete_examples", "incomplete_examples", joined(F.col("messages")).alias("messages"), "is_ready")


@query("g07_applied_suggestions", """
SELECT p_partkey // 40 AS template_id, 'key_' || p_partkey AS suggestion_key FROM part WHERE p_partkey % 3 = 0 AND p_size % 4 <> 0 AND p_partkey % 5 <> 0""")
def applied_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples repeat every third suggestion with other blanks; some differ in an attribute or are incomplete."""
    k, size = F.col(K), F.col("p_size")
    template = F.floor(k / 40).cast("bigint").alias("template_id")

    def extractions(pad: str, brand: Column) -> Column:
        attributes = F.create_map(F.lit("value" + pad), F.concat(F.lit(pad), brand), F.lit("currency"), F.lit("USD"))
        return F.array(F.struct(F.lit("vendor").alias("extraction_class"), F.concat(F.col("p_type"), F.lit(pad)).alias("extraction_text"),
                                attributes.alias("attributes")))

    part = v.table(spark, sf_dir, "part")
    text = F.concat(F.col("p_name"), F.lit(" "), k.cast("string"))
    offered = part.select(template, F.concat(F.lit("key_"), k.cast("string")).alias("suggestion_key"), text.alias("example_text"),
                          extractions("", F.col("p_brand")).alias("extractions"))
    brand = F.when(k % 5 == 0, "other").otherwise(F.col("p_brand"))
    drafts = part.filter(k % 3 == 0).select(
        template, F.when(size % 4 == 0, " ").otherwise(F.concat(F.lit("\r\n "), text, F.lit(" "))).alias("text"), extractions(" ", brand).alias("extractions"))
    return tp.applied_suggestions(drafts, offered).select("template_id", "suggestion_key")


@query("g08_duplicate_template_names", """
WITH t AS (SELECT DISTINCT p_brand, p_type AS name, CASE WHEN p_brand < 'Brand#2' THEN 'tenant_a' ELSE 'tenant_b' END AS tenant_id FROM part)
SELECT tenant_id, name, count(*) AS n_templates FROM t GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_template_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.duplicate_template_names(template_rows(spark, sf_dir))
