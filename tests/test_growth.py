"""Work and disk that grow with the input alone: compressed results, one pass over wide rows, definitions by line, few exchanges of wide rows."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import functions as F

from docweft.operators import calculate as ca, feedback as fb, reconcile as rc
from docweft.plans.dry_run import extract_documents
from docweft.schema import CANDIDATE_COLUMNS, CalcDef, FieldDef, Template, value_struct
from docweft.sources import readers as rd, writers as wr
from docweft.streaming import streams as st
from workload import plans, sources

TOTAL = Template("Totals", "1", "invoice", (FieldDef("total_amount", "Total Amount", "currency"), FieldDef("sent", "Sent", "date")),
                 (CalcDef("more", "More", "number", "total_amount.amount + 1", ("total_amount",)),))


def texts(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit("acme").alias("tenant_id"),
                                 F.concat(F.lit("Total Due: $"), F.col("id").cast("string"), F.lit(".50")).alias("text"))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_results_are_written_compressed_and_read_back_whole(spark, tmp_path):
    keys = ("tenant_id", "doc_id")
    envelopes = ca.result_envelope(extract_documents(texts(spark, 500), TOTAL, keys), TOTAL, keys)
    sizes, rows = {}, {}
    for kind, options in (("default", {}), ("plain", {"compression": "none"})):
        path = tmp_path / kind
        wr.write_results_json(envelopes, str(path), **options)
        sizes[kind] = sum(p.stat().st_size for p in Path(path).rglob("part-*"))
        rows[kind] = sorted(spark.read.schema(envelopes.schema).json(str(path)).collect())
    assert sizes["default"] * 5 < sizes["plain"]
    assert rows["default"] == rows["plain"] and len(rows["plain"]) == 500


def test_extracted_and_calculated_fields_are_listed_in_one_pass(spark):
    wide = extract_documents(texts(spark, 20), TOTAL)
    every = ca.all_fields_long(wide, TOTAL)
    assert plan_of(every).count("Range (") == 1
    shared = ["doc_id", "field_no", "field_name", "label", "validation_status", "validation_errors", "requires_review"]
    apart = [rc.long_form(wide, TOTAL).select(*shared, F.lit("extracted").alias("field_kind")),
             ca.calculated_long(wide, TOTAL).select(*shared, F.lit("calculated").alias("field_kind"))]
    assert sorted(every.collect()) == sorted(row for part in apart for row in part.collect()) and every.count() == 60
    fields_only = Template("T", "1", "invoice", TOTAL.fields)
    assert ca.all_fields_long(extract_documents(texts(spark, 5), fields_only), fields_only).count() == 10


def test_a_large_store_of_definitions_is_no_file_per_definition(spark, tmp_path):
    part = spark.range(8000).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.col("id").cast("string")).alias("p_name"), F.lit("SMALL").alias("p_type"),
        (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") + 0.5).alias("p_retailprice"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    templates = sources.whole_definitions(spark, str(tmp_path))
    assert len(templates.inputFiles()) < 40 and templates.count() == 200
    assert sources.contract_changes(spark, str(tmp_path)).count() == len(range(0, 8000, 6))


def test_definitions_by_line_are_those_of_single_files(spark, tmp_path):
    texts_of = [json.dumps({"template_name": f"T{i}", "extracted_fields": [{"name": f"f{i}", "label": "F", "type": "text", "schema": {"b": i, "a": [1]}}],
                            "llm_provider_settings": {"model": f"m{i}"}}) for i in range(7)]
    for i, text in enumerate(texts_of):
        (tmp_path / "single" / str(i)).mkdir(parents=True)
        (tmp_path / "single" / str(i) / "t.json").write_text(json.dumps(json.loads(text), indent=1))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "all.json").write_text("\n".join(texts_of) + "\n")
    single, lines = rd.read_templates(spark, str(tmp_path / "single")), rd.read_templates(spark, str(tmp_path / "lines"), lines=True)
    assert sorted(rd.definition_rows(single).collect()) == sorted(rd.definition_rows(lines).collect())
    models = F.to_json("provider").alias("provider")
    assert sorted(rd.template_rows(single).select("template_id", models).collect()) == sorted(rd.template_rows(lines).select("template_id", models).collect())
    assert lines.count() == 7


def test_edits_meet_the_fields_of_their_result_where_they_are(spark):
    """The widest rows, a result's fields, are dealt out once, then for jobs and documents alone; counts of edits come to them."""
    ids = spark.range(40).select(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("tenant_id"), F.col("id"))
    long = ids.select(
        "tenant_id", F.col("id").alias("result_id"), F.col("id").alias("job_id"), F.lit("d").alias("reviewed_at"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("field_name"),
        F.lit("text").alias("data_type"), F.lit("x").alias("extracted_value"), F.lit("x").alias("normalized_value"), F.lit("x").alias("source_text"),
        F.lit(3).alias("char_start"), F.lit(4).alias("char_end"))
    jobs = ids.select("tenant_id", F.col("id").alias("job_id"), F.col("id").alias("document_id"), (F.col("id") % 7).alias("template_version_id"))
    docs = ids.select("tenant_id", F.col("id").alias("doc_id"), F.lit("has x in it").alias("text"))
    edits = ids.filter("id % 4 = 0").select("tenant_id", F.col("id").alias("result_id"), F.explode(F.array(F.lit("a"), F.lit("a"), F.lit("z"))).alias("field_name"))
    keys = ("tenant_id", "result_id", "job_id", "reviewed_at")
    results = fb.result_fields(long, keys)
    assert results.columns == [*keys, "fields"] and [[f.field_name for f in r.fields] for r in results.collect()] == [["a", "b"]] * 40
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = fb.reviewed_edits(results, jobs, docs, edits)
        plan = met._jdf.queryExecution().sparkPlan().toString()
        got = sorted((r.tenant_id, r.result_id, r.document_id, r.template_version_id, r.field_name, r.n_edits, len(r.fields), r.text) for r in met.collect())
        executed = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted((f"t{i % 3}", i, i, i % 7, name, n, 2, "has x in it") for i in range(0, 40, 4) for name, n in (("a", 2), ("z", 1)))
    joins = [re.search(r"(document|job|result)_id#", line).group(1) for line in plan.splitlines() if "SortMergeJoin" in line]
    assert joins == ["document", "job", "result"]  # from the last to the first
    assert executed.split("== Initial Plan ==")[0].count("REPARTITION_BY_COL") == 1


def test_a_batch_of_one_file_is_spread_over_the_cores(spark, tmp_path):
    docs = spark.range(40_000, numPartitions=1).select(
        F.col("id").alias("job_id"), F.lit(1).alias("attempt"), F.col("id").alias("doc_id"),
        F.concat(F.lit("Total Due: $"), F.col("id").cast("string"), F.lit(".50 "), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    docs.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    st.stream_extract(source, TOTAL, out, str(tmp_path / "check")).awaitTermination()
    assert len(list(Path(out, "batch_id=0").glob("part-*.parquet"))) > 1
    newest = st.latest_results(spark, out)
    assert newest.select(F.count_distinct("job_id"), F.count("job_id")).first() == (40_000, 40_000)



def test_candidates_found_by_position_are_those_gathered_by_field(spark):
    """0 to 9 candidates a document, of known, unknown and null fields, with ties in every rank, null candidates and null arrays."""
    n, names = F.col("id"), ["a", "b", "c"]

    def candidate(i):
        k = (n * 7 + i * 5) % 11
        made = {
            "extracted_value": F.when(k != 3, k.cast("string")), "normalized_value": F.when(k % 3 > 0, value_struct(number=k.cast("double"))),
            "confidence": (k % 3) / 4, "source_text": F.when(k % 4 > 0, F.substring(F.lit("sss"), F.lit(1), k % 3)),
            "notes": F.concat(F.lit("n"), i.cast("string")), "requires_review": k % 2 == 0}
        name = F.get(F.array(*map(F.lit, [*names, "odd"])), (k % 5).cast("int"))
        return F.when(k != 7, F.struct(name.alias("field_name"), (i % 2).cast("bigint").alias("seq"), *[
            made.get(c, F.lit(None)).cast(t).alias(c) for c, t in CANDIDATE_COLUMNS.items()]))

    every = F.transform(F.sequence(F.lit(1), (n % 11).cast("int")), candidate)
    docs = spark.range(400).select(n.alias("doc_id"), F.when(n % 11 > 0, every).alias("found"))
    by_position = rc.reconcile_offered(docs, "found", names, ["doc_id"])
    by_field = rc.reconcile_in_rows(docs, {x: rc.candidates_of(F.col("found"), x) for x in names}, ["doc_id"])
    # And as the table of candidates, which knows nothing of arrays.
    rows = docs.select("doc_id", F.inline("found")).filter("field_name is not null")
    as_table = rc.reconcile_wide(rows, docs, Template("T", "1", "t", tuple(FieldDef(x, x.upper(), "number") for x in names)))
    got = sorted(by_position.collect())
    assert got == sorted(by_field.select(by_position.columns).collect()) == sorted(as_table.select(by_position.columns).collect())
    assert {r[x].n_candidates for r in got for x in names} >= {0, 1, 2, 3}


def test_gathered_candidates_are_dealt_out_once_and_only_shown_members_are_made(spark):
    done = plans.process_candidates(spark, "/root/testdata/sf0.001")
    executed = done._jdf.queryExecution().executedPlan().toString()
    rows_dealt = executed[executed.index("REPARTITION_BY_COL"):]
    assert "partial_collect_list" not in rows_dealt and "partial_collect_list" in executed
    assert executed.count("Exchange ") == 2
    assert "StructsToJson" not in executed and "transform(array(struct" not in executed
