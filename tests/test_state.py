"""Keyed state, compacted results, seek paging, batch extractors, evaluation runs, feedback in one pass."""

from __future__ import annotations

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweft.operators import evaluation as ev, extract as ex, feedback as fb, ops
from docweft.schema import FieldDef, Template
from docweft.streaming import streams as st

TOTAL = Template("Totals", "1", "invoice", (FieldDef("total_amount", "Total Amount", "currency"),))


def stream_of(spark, path, batches, ddl, transform, name):
    """Each batch is a file of its own, read in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{path}/{i:04d}")
        time.sleep(0.01)
    schema = spark.read.parquet(f"{path}/0000").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    query = transform(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_earliest_event_of_a_key_by_state(spark, tmp_path):
    rng = random.Random(11)
    ddl, minute = "tenant_id string, job_id int, ts string, note string", lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    timely = [("t", job, minute(10 * job + late), f"n{late}") for job in range(12) for late in rng.sample(range(8), 3)]
    batches = [[], [], [], []]
    for i, row in enumerate(sorted(timely, key=lambda r: (r[2], r[1]))):
        batches[i * 4 // len(timely)].append(row)
    for batch in batches:
        rng.shuffle(batch)  # out of order, within what the watermark allows
    batches.append([("t", 0, minute(200), "again")])  # a copy long after the job was emitted
    batches.append([("t", 5, minute(1), "too late")])
    batches.append([("t", 99, minute(700), "flush")])
    batches.append([("t", 98, minute(701), "flush")])
    streamed = stream_of(spark, str(tmp_path / "in"), batches, ddl, st.earliest_events, "earliest")
    static = spark.createDataFrame(timely, ddl).withColumn("ts", F.col("ts").cast("timestamp"))
    want = sorted(map(tuple, st.earliest_events(static).collect()))
    got = sorted(map(tuple, streamed.filter("job_id < 90").collect()))
    assert got == want and len(want) == 12


def test_newest_results_are_read_from_what_is_there_now(spark, tmp_path):
    path = str(tmp_path / "out")
    inbox = str(tmp_path / "in")
    want = {}
    for i in range(23):
        rows = [(j, i, j, f"Total Due: ${i}.{j:02d}") for j in range(4)] + [(100 + i, 0, 100 + i, f"Total Due: $7.{i:02d}")]
        rows += [(3, i - 2, 3, "Total Due: $99.99")] if i > 4 else []  # an older attempt that comes late
        spark.createDataFrame(rows, "job_id int, attempt int, doc_id int, text string").coalesce(1).write.parquet(f"{inbox}/{i:04d}")
        want |= {j: i for j in range(4)} | {100 + i: 0}
    source = spark.readStream.schema(spark.read.parquet(f"{inbox}/0000").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(inbox)
    st.stream_extract(source, TOTAL, path, str(tmp_path / "check"), compact_every=5).awaitTermination()
    newest = st.latest_results(spark, path)
    assert {r.job_id: r.attempt for r in newest.collect()} == want
    opened = {f.split("/out")[1].split("/part")[0] for f in newest.inputFiles()}
    assert opened == {".newest/upto=19", "/batch_id=20", "/batch_id=21", "/batch_id=22"}  # not the twenty batches before
    # a replayed batch, compaction included, leaves the same rows
    st.compact_results(spark, path, 19, 5)
    assert {r.job_id: r.attempt for r in st.latest_results(spark, path).collect()} == want
    assert st.latest_results(spark, path).filter("job_id = 3 AND size(extracted_fields) = 1").count() == 1


def test_seek_pages_are_whole_and_bounded(spark):
    rng = random.Random(2)
    rows = [(i, f"a{i}", f"2024-01-01 00:00:{rng.randint(0, 20):02d}") for i in range(500)]
    df = spark.createDataFrame(rows, "event_id int, action string, ts string").select("event_id", "action", F.col("ts").cast("timestamp").alias("created_at"))
    order = sorted(((r[2], r[0]) for r in rows), reverse=True)
    after, seen = None, []
    while page := ops.seek_page(df, 60, after).collect():
        seen += [r.event_id for r in page]
        after = (page[-1].created_at, page[-1].event_id)
    assert seen == [i for _, i in order]
    plan = ops.seek_page(df, 60, after)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=60" in plan
    empty = ops.page_result(df, 60, after).first()
    assert (empty.total, empty["items"]) == (500, [])
    first = ops.page_result(df, 60).first()
    assert [r.event_id for r in first["items"]] == seen[:60] and first.total == 500


def test_batch_extractors_give_rows_or_errors(spark):
    def extractor(texts: pa.Array) -> pa.RecordBatch:
        plain = texts.to_pylist()
        if any("bad" in t for t in plain):
            raise ValueError("cannot read this")
        rows = [i for i, t in enumerate(plain) for _ in t.split()]
        return pa.RecordBatch.from_pydict({"row": rows, "field_name": [w for t in plain for w in t.split()], "confidence": [1] * len(rows)})

    docs = spark.createDataFrame([(i, "bad one" if i % 7 == 3 else " ".join(f"w{j}" for j in range(i % 4))) for i in range(40)], "doc_id int, text string").coalesce(2)
    got = ex.extract_batches(docs, extractor).collect()
    assert {r.doc_id for r in got if r.error} == {i for i in range(40) if i % 7 == 3} and all(r.error == "ValueError: cannot read this" for r in got if r.error)
    assert sorted((r.doc_id, r.seq, r.field_name) for r in got if not r.error) == sorted((i, j, f"w{j}") for i in range(40) if i % 7 != 3 for j in range(i % 4))
    assert all(r.confidence == 1.0 for r in got if not r.error)
    with pytest.raises(Exception, match="columns that candidates do not have"):
        ex.extract_batches(docs.filter("doc_id = 1"), lambda texts: pa.RecordBatch.from_pydict({"row": [0], "colour": ["red"]})).collect()
    with pytest.raises(Exception, match="cannot read this"):
        ex.extract_with(docs, lambda text: [{"field_name": "x"}] if "bad" not in text else (_ for _ in ()).throw(ValueError("cannot read this"))).collect()


def test_case_runs_count_all_kinds_of_checks(spark):
    cases = spark.createDataFrame([("one", ["a", "b"], ["b", "a", "a"], ["re-DACTED"], ["was redacted."], "mock"), ("two", [], ["x"], ["Straße"], ["STRASSE 5"], "mock"), ("three", None, None, None, None, "mock")],
                                  "case_name string, expected_flags array<string>, actual_flags array<string>, expected_notes array<string>, actual_notes array<string>, provider_type string")
    wanted = spark.createDataFrame([("one", "field", "f", '"Acme"', '{"amount": 5}', True), ("one", "field", "gone", '"x"', "1", False), ("two", "calculated_field", "g", None, '"big"', None)],
                                   "case_name string, category string, field_name string, extracted_json string, normalized_json string, review boolean")
    actual = spark.createDataFrame([("one", "field", "f", '"acme"', '{"amount": 6}', False), ("two", "calculated_field", "g", None, '"BIG"', False)], wanted.schema)
    checks = ev.run_checks(ev.compare_expectations(wanted, actual, values=True), cases)
    got = {r.case_name: r for r in ev.case_run(checks, cases).collect()}
    assert (got["one"].matched_checks, got["one"].failed_checks, got["one"].passed) == (2, 6, False)
    assert [(m["category"], m["subject"], m["detail"]) for m in json.loads(got["one"].mismatches_json)] == [
        ("document_note", "re-DACTED", 'expected note containing re-DACTED, got ["was redacted."]'),
        ("field", "f", 'normalized_value mismatch: expected {"amount": 5}, got {"amount": 6}'), ("field", "f", "requires_review mismatch: expected true, got false"),
        ("field", "gone", ev.FIELD_MISSING)]
    assert (got["two"].matched_checks, got["two"].failed_checks) == (2, 1) and json.loads(got["two"].mismatches_json)[0]["detail"] == 'expected [], got ["x"]'
    assert (got["three"].matched_checks, got["three"].passed, got["three"].mismatches_json, got["three"].provider_type) == (1, True, "[]", "mock")


@pytest.mark.parametrize("left,right,same", [("Straße", "STRASSE", True), ("ΟΔΟΣ", "οδος", True), ("İstanbul", "i̇stanbul", True), ("ﬁne", "FINE", True), ("a", "b", False)])
def test_texts_compare_by_folded_case(spark, left, right, same):
    rows = spark.createDataFrame([(json.dumps(left), json.dumps(right))], "e string, a string")
    pair = spark.createDataFrame([(left, right)], "l string, r string").select(ev.normalize_string(F.col("l")) == ev.normalize_string(F.col("r")))
    assert rows.select(ev.json_match(F.col("e"), F.col("a"))).first()[0] == same and pair.first()[0] == same


def test_deep_json_is_no_match_but_no_error(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = spark.createDataFrame([(deep, deep + " ")], "e string, a string")
    assert rows.select(ev.json_match(F.col("e"), F.col("a"))).first()[0] is False


def test_candidates_are_gone_through_once(spark):
    kinds = "tenant_id string, template_version_id int, result_id int, field_name string, n_edits bigint, reviewed_at string, text string, fields array<struct<field_name:string,data_type:string,extracted_value:string,normalized_value:string,source_text:string,char_start:int,char_end:int>>"
    edits = spark.createDataFrame([], kinds)
    plain = edits.withColumn("fields", F.transform("fields", lambda f: f.withField("normalized_value", F.lit(None).cast("struct<text:string,number:double,amount:double,currency:string,display_value:string,flag:boolean,items:array<string>,object_json:string>"))))
    plan = fb.suggestions(fb.edit_candidates(plain))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("span_override") == 1


def test_bad_bytes_go_and_replacement_characters_stay(spark, tmp_path):
    from docweft.sources import readers as rd

    (tmp_path / "x.txt").write_bytes("kept \ufffd, ".encode() + b"gone \xff\xc3(")
    (tmp_path / "y.txt").write_text("all \ufffd fine")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in rd.read_text_documents(spark, str(tmp_path)).collect()}
    assert got == {"x.txt": "kept \ufffd, gone (", "y.txt": "all \ufffd fine"}


def test_lines_of_large_delimited_files_are_split(spark, tmp_path):
    from docweft.sources import readers as rd

    rows = [f'{i},"a ""quoted"" {i}, b",007,{" " * (i % 3)}x' for i in range(3000)]
    (tmp_path / "a.csv").write_text("\n".join(["id,text,code,pad", *rows]) + "\n")
    (tmp_path / "b.csv").write_text('id,text,code,pad\n1,,"x",y\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        lines = rd.read_delimited_lines(spark, str(tmp_path))
        got = {(r.path.rsplit("/", 1)[1], r.line_number): r.line for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3003 and got["a.csv", 0] == "id,text,code,pad" and got["b.csv", 1] == "1,,x,y"
    assert [got["a.csv", i + 1] for i in range(3000)] == rows
