"""Sources: document files, delimited files, definitions, event logs, metadata tables."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# ---- fixed values -------------------------------------------------------------------------------
SUFFIX_CLASSES = {
    "text": (".txt", ".md"),
    "spreadsheet": (".csv", ".xlsx", ".xls"),
    "layout": (".pdf", ".docx", ".pptx", ".html", ".htm", ".png", ".jpg", ".jpeg", ".tiff"),
}
FALLBACK_CLASS = "fallback"

RULES_DDL = "struct<allow_null:boolean,min:double,max:double,regex:string,currency:string,format:string,max_length:int,allowed_values:array<string>>"
FORMAT_DDL = "struct<currency:string,decimal_places:int,date_format:string,unit:string>"
DEFINITION_DDL = f"""
template_name string, template_version string, document_type string, description string,
extracted_fields array<struct<name:string,label:string,description:string,type:string,required:boolean,instructions:string,
  citation_required:boolean,usable_in_formulas:boolean,extract_mode:string,allow_null:boolean,example_values:array<string>,
  allowed_values:array<string>,output_format:{FORMAT_DDL},validation:{RULES_DDL},schema:variant>>,
calculated_fields array<struct<name:string,label:string,description:string,output_type:string,formula:string,
  depends_on:array<string>,format:{FORMAT_DDL},validation:{RULES_DDL},
  error_handling:struct<on_divide_by_zero:string,on_missing_input:string>,requires_review:boolean>>,
langextract_config struct<prompt_description:string,examples:array<struct<text:string,
  extractions:array<struct<extraction_class:string,extraction_text:string,attributes:string>>>>>,
llm_provider_settings variant, output_settings variant, review_required_on_low_confidence boolean,
minimum_confidence_threshold double, local_only_mode boolean
"""
DEFAULT_THRESHOLD = 0.75
CASE_DDL = f"""
name string, description string, tags array<string>, document_text string,
template_definition struct<{DEFINITION_DDL.replace(" string", ":string").replace("fields array", "fields:array").replace("config struct", "config:struct")}>,
expected_fields map<string,string>, expected_calculated_fields map<string,string>,
expected_review_flags array<string>, expected_document_level_note_substrings array<string>
"""


def suffix_of(path: Column) -> Column:
    """Lower-cased suffix of the file name, '' when it has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def route_by_suffix(files: DataFrame, path: str = "path") -> DataFrame:
    """Add `suffix` and `parser_class` (text, spreadsheet, layout, fallback)."""
    chosen = F.when(F.lit(False), FALLBACK_CLASS)
    for parser_class, suffixes in SUFFIX_CLASSES.items():
        chosen = chosen.when(F.col("suffix").isin(*suffixes), parser_class)
    return files.withColumn("suffix", suffix_of(F.col(path))).withColumn("parser_class", chosen.otherwise(FALLBACK_CLASS))


def read_text_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text files, one row per file: `path`, `text`. Bytes that are not UTF-8 are left out."""
    @F.arrow_udf("string")
    def without_bad_bytes(contents: pa.Array) -> pa.Array:
        return pa.array([None if c is None else c.decode("utf-8", "ignore") for c in contents.to_pylist()], pa.string())

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = F.col("content").cast("string")
    valid = F.is_valid_utf8(raw)
    # valid texts stay in the JVM
    return files.select("path", F.when(valid, raw).otherwise(without_bad_bytes(F.when(~valid, F.col("content")))).alias("text"))


def read_delimited_rows(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """Rows of CSV files with a header; give a schema to avoid the inference pass over the data."""
    reader = spark.read.option("header", "true").option("recursiveFileLookup", "true")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", "true")
    return reader.csv(path)


def read_delimited_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV files as documents: one row per file, its table written out again as CSV text."""
    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [pd.read_csv(io.BytesIO(content)).to_csv(index=False) for content in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(rewrite, "path string, text string")


def read_delimited_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV files of the same columns as normalized lines: path, line_number (0: the header), line.

    Files are read split by split, so a huge one is shared by many tasks; values stay the text they are, quoted where they must be.
    Rows may not hold line ends inside quotes.
    """
    reader = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("escape", '"')
    plain = reader.csv(path)
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows = plain.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"), F.to_csv(F.struct(*plain.columns), options).alias("line"))
    header = spark.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(c) for c in plain.columns]), options)).first()[0]
    files = rows.select("path").distinct().select("path", F.lit(0).cast("bigint").alias("line_number"), F.lit(header).alias("line"))
    return line_numbers(rows, rows).select("path", "line_number", "line").unionByName(files)


def _json_files(spark: SparkSession, path: str | Sequence[str], ddl: str, lines: bool = False) -> DataFrame:
    schema = T._parse_datatype_string(" ".join(ddl.split()))
    return (
        spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json").json(path)
        .withColumn("source_path", F.col("_metadata.file_path"))
    )


def read_templates(spark: SparkSession, path: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Template definitions from JSON files, found recursively, with their source path.

    lines: a file holds many definitions, one a line. A large store should be kept so, as listing and opening a file per definition
    takes far longer than reading it.
    """
    return _json_files(spark, path, DEFINITION_DDL, lines)


def read_eval_cases(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Golden cases from JSON files; expectations stay JSON text per field."""
    return _json_files(spark, path, CASE_DDL)


def definition_rows(templates: DataFrame, key: str = "template_name") -> DataFrame:
    """Template definitions to one row per field, the layout of the template analytics.

    field_schema is the field's contract as JSON with the order of its members kept; output_format (an extracted field's output format or a
    calculated one's format) and validation are JSON too.
    """
    def json(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.to_json(column))

    extracted = templates.select(key, F.explode("extracted_fields").alias("f")).select(
        F.col(key).alias("template_id"), F.lit("extracted").alias("kind"), "f.name", "f.label", "f.type",
        F.coalesce("f.required", F.lit(False)).alias("required"),
        F.coalesce("f.citation_required", F.lit(True)).alias("citation_required"),
        F.coalesce("f.usable_in_formulas", F.lit(True)).alias("usable_in_formulas"),
        F.coalesce("f.allowed_values", F.array().cast("array<string>")).alias("allowed_values"),
        F.when(F.coalesce(F.schema_of_variant("f.schema") != "VOID", F.lit(False)), F.to_json("f.schema")).alias("field_schema"),
        F.lit(None).cast("string").alias("formula"),
        F.lit(None).cast("array<string>").alias("depends_on"), F.lit(None).cast("string").alias("output_type"),
        json("f.output_format").alias("output_format"), json("f.validation").alias("validation"))
    calculated = templates.select(key, F.explode("calculated_fields").alias("f")).select(
        F.col(key).alias("template_id"), F.lit("calculated").alias("kind"), "f.name", "f.label",
        F.lit("calculated").alias("type"), F.lit(False).alias("required"), F.lit(False).alias("citation_required"),
        F.lit(True).alias("usable_in_formulas"), F.array().cast("array<string>").alias("allowed_values"),
        F.lit(None).cast("string").alias("field_schema"), "f.formula", "f.depends_on", "f.output_type",
        json("f.format").alias("output_format"), json("f.validation").alias("validation"))
    return extracted.unionByName(calculated)


def template_rows(templates: DataFrame, key: str = "template_name") -> DataFrame:
    """One row per template: its version, type, provider and thresholds; provider settings stay a variant, so that unknown ones survive."""
    settings = F.col("llm_provider_settings")
    return templates.select(
        F.col(key).alias("template_id"), F.coalesce("template_version", F.lit("1.0.0")).alias("version"), "document_type",
        F.try_variant_get(settings, "$.provider_type", "string").alias("provider_type"), F.try_variant_get(settings, "$.api_style", "string").alias("api_style"),
        F.try_variant_get(settings, "$.model", "string").alias("model"),
        F.coalesce(F.try_variant_get(settings, "$.allow_external_processing", "boolean"), F.lit(False)).alias("allow_external_processing"),
        settings.alias("provider"), F.coalesce("minimum_confidence_threshold", F.lit(DEFAULT_THRESHOLD)).alias("min_confidence"),
        F.coalesce("review_required_on_low_confidence", F.lit(True)).alias("review_low"), F.coalesce("local_only_mode", F.lit(True)).alias("local_only"))


def example_rows(templates: DataFrame, key: str = "template_name") -> DataFrame:
    """One row per example extraction of every template."""
    examples = templates.select(key, F.posexplode("langextract_config.examples").alias("example_no", "e"))
    return examples.select(F.col(key).alias("template_id"), "example_no", "e.text", F.posexplode("e.extractions").alias(
        "extraction_no", "x")).select("template_id", "example_no", "text", "extraction_no", "x.*")


def expectation_rows(cases: DataFrame) -> DataFrame:
    """Expected fields of every case: category, field, JSON expectations, expected review flag."""
    def rows(column: str, category: str) -> DataFrame:
        return cases.select(F.col("name").alias("case_name"), F.lit(category).alias("category"),
                            F.explode(column).alias("field_name", "e"))

    every = rows("expected_fields", "field").unionByName(rows("expected_calculated_fields", "calculated_field"))
    body = F.try_parse_json("e")

    def json_member(name: str) -> Column:
        member = F.try_variant_get(body, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(member) != "VOID", F.to_json(member))

    return every.select("case_name", "category", "field_name", json_member("extracted_value").alias("extracted_json"),
                        json_member("normalized_value").alias("normalized_json"),
                        F.try_variant_get(body, "$.requires_review", "boolean").alias("review"))


def read_event_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Log lines with their file: `path`, `line`, and the split of the file they came from.

    Files are read split by split, so one huge log is shared by many tasks; `line_numbers` restores the
    position in the file for the lines that need it.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"), F.col("value").alias("line"))


def line_numbers(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add the 1-based `line_number` within their file to some rows of `read_event_log`.

    Lines are counted per split, counts are summed up over the splits of a file (few), and only the wanted
    rows look up their split's offset: the log itself is not shuffled.
    """
    splits = lines.groupBy("path", "block_start").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"))
    earlier = F.expr("sum(n) over (partition by path order by block_start rows between unbounded preceding and 1 preceding)")
    offsets = splits.select("path", "block_start", "first_id", F.coalesce(earlier, F.lit(0)).alias("before"))
    return wanted.join(offsets, ["path", "block_start"]).withColumn(
        "line_number", F.col("before") + F.col("row_id") - F.col("first_id") + 1).drop("before", "first_id", "row_id", "block_start")


def read_metadata(
    spark: SparkSession, path: str, tenant_id: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Tenant-scoped scan of a metadata table; the tenant filter and the columns reach the scan."""
    table = spark.read.parquet(path)
    if tenant_id is not None:
        table = table.filter(F.col("tenant_id") == tenant_id)
    return table.select(*columns) if columns else table


def read_metadata_jdbc(spark: SparkSession, url: str, table: str, tenant_id: str, **options: str) -> DataFrame:
    """The same scan from a relational database, the filter pushed into its query."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return reader.options(**options).load().filter(F.col("tenant_id") == tenant_id)
