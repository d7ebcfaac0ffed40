"""Text preparation and redaction on literals, and against plain statements of the rules."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweft.functions import spans as sp, text as tx
from docweft.operators import redaction as rd, text_prep as tp
from workload.fixed import INVOICE


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_normalize_follows_python_line_rules(spark):
    samples = ["a  \nb\t\r\nc\x0b d \x1c e f \n\n", "  \n ", "x", "a\x85b  　", "", "tail\n\n\n"]
    want = ["\n".join(line.rstrip() for line in s.splitlines()).strip() for s in samples]
    rows = tp.normalize(docs(spark, *samples)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == want


def test_meaningful_text_counts_visible_characters(spark):
    kept = tp.meaningful_text(docs(spark, "a" * 24, "a " * 23, " \n" * 40 + "b" * 24)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2]


def test_first_usable_parse_prefers_the_earliest(spark):
    attempts = spark.createDataFrame(
        [(1, 1, "short"), (1, 2, "x" * 30), (2, 1, "y" * 30), (2, 2, "z" * 40), (3, 1, " ")], "doc_id int, attempt_no int, text string")
    got = {r.doc_id: (r.attempt_no, r.status) for r in tp.first_usable_parse(attempts).collect()}
    assert got == {1: (2, "parsed"), 2: (1, "parsed"), 3: (None, "failed")}


def test_assemble_pages_drops_blanks_and_falls_back(spark):
    items = spark.createDataFrame(
        [(1, 2, 1, "second"), (1, 1, 2, "b "), (1, 1, 1, "a"), (1, None, 3, "lost"), (1, 3, 1, "  "), (2, None, 1, "x")],
        "doc_id int, page_no int, seq int, text string")
    whole = docs(spark, "unused", "unused", "whole text \n").withColumn("doc_id", F.col("doc_id").cast("int"))
    got = {r.doc_id: r.text for r in tp.assemble_pages(items, whole).collect()}
    assert got[1] == "[Page 1]\na\nb\n\n[Page 2]\nsecond"
    assert got[2] == "[Page 1]\nwhole text"


def plain_chunks(text: str, size: int, overlap: int) -> list[str]:
    """The chunking rule in plain words: cut at the last break of the window's second half, step back, strip."""
    body = text.strip()
    if not body or len(body) <= size:
        return [body]
    found, at = [], 0
    while True:
        end = min(at + size, len(body))
        if end < len(body):
            breaks = [i for i in range(at + size // 2 + 1, end) if body[i] in "\n "]
            end = breaks[-1] if breaks else end
        piece = body[at:end].strip()
        found += [piece] if piece else []
        if end >= len(body):
            return found
        at = max(end - overlap, at + 1)


@pytest.mark.parametrize("size,overlap", [(50, 10), (101, 30), (64, 0), (40, 500), (80, 50)])
def test_chunks_match_the_plain_rule(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab c\n d") for _ in range(rng.randint(0, 600))) for _ in range(60)] + ["x" * 500, "", "   "]
    rows = tp.chunk_text(docs(spark, *texts), size, overlap).orderBy("doc_id", "chunk_index").collect()
    got = {i: [r.chunk for r in rows if r.doc_id == i] for i in range(len(texts))}
    assert got == {i: plain_chunks(t, size, overlap) for i, t in enumerate(texts)}
    assert all(r.n_chunks == len(got[r.doc_id]) for r in rows)


def test_page_of_offset(spark):
    text = "[Page 1]\nVendor: Acme Corp\n[Page 2]\nTotal: $1,200.00"
    spans = spark.createDataFrame([(0, text.index("Acme")), (0, text.index("$")), (0, 0), (0, None), (0, text.index("[Page 2]"))],
                                  "doc_id int, char_start int")
    got = {r.char_start: (r.page_number, r.location_reference) for r in tp.page_of_offset(spans, docs(spark, text)).collect()}
    assert got == {text.index("Acme"): (1, "Page 1"), text.index("$"): (2, "Page 2"), 0: (1, "Page 1"), None: (None, ""),
                   text.index("[Page 2]"): (2, "Page 2")}


def test_page_before_any_marker_is_unknown(spark):
    spans = spark.createDataFrame([(0, 2)], "doc_id int, char_start int")
    row = tp.page_of_offset(spans, docs(spark, "intro [Page 1]")).first()
    assert (row.page_number, row.location_reference) == (None, "")


def test_highlight_segments(spark):
    spans = spark.createDataFrame([(0, 0, 3), (1, 2, 2), (2, 1, 99)], "doc_id int, char_start int, char_end int")
    rows = tp.highlight_segments(spans, docs(spark, "abcdef", "abcdef", "abc")).orderBy("doc_id", "segment_no").collect()
    assert [(r.doc_id, r.segment, r.highlighted) for r in rows] == [
        (0, "abc", True), (0, "def", False), (1, "abcdef", False), (2, "abc", False)]


def test_requests_carry_text_and_template(spark):
    row = tp.prompt_requests(docs(spark, "Hello"), INVOICE, text="text").first()
    assert "Document:\nHello\n" in row.request and '"vendor_name"' in row.request


def test_readable_text_source(spark):
    rows = spark.createDataFrame(
        [(1, "p", "raw", "text/plain"), (2, " ", "raw", "text/plain"), (3, None, "raw", "application/pdf"), (4, None, " ", "text/csv")],
        "doc_id int, parsed_text string, raw_text string, content_type string")
    got = {r.doc_id: (r.text, r.text_source) for r in tp.readable_text(rows).collect()}
    assert got == {1: ("p", "parsed_file"), 2: ("raw", "upload"), 3: (None, None), 4: (None, None)}


# ---- redaction ----------------------------------------------------------------------------------
SENSITIVE = "Mail ann@example.com or call 555-123-4567.\nSSN 123-45-6789, IBAN DE89370400440532013000, host 10.0.0.1"


def test_redaction_masks_and_keeps_length(spark):
    row = rd.redact(docs(spark, SENSITIVE)).first()
    assert len(row.text) == len(SENSITIVE)
    for secret in ("ann@example.com", "555-123-4567", "123-45-6789", "DE89370400440532013000", "10.0.0.1"):
        assert secret not in row.text
    assert row.text.startswith("Mail *************** or call ************.\nSSN ")
    assert row.redaction_note == f"External provider text redaction applied for {row.span_count} spans across 5 entity types."


def test_blanks_inside_a_span_survive(spark):
    row = rd.redact(docs(spark, "call (555) 123 4567 now"), ["PHONE_NUMBER"]).first()
    assert row.text == "call ***** *** **** now"


def test_unknown_entity_type_is_an_error(spark):
    with pytest.raises(ValueError):
        rd.redact(docs(spark, "x"), ["SHOE_SIZE"])


def plain_merge(spans):
    done = []
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if done and start <= done[-1][1]:
            done[-1] = (done[-1][0], max(done[-1][1], end), done[-1][2])
        else:
            done.append((start, end, kind))
    return done


def test_merging_matches_the_plain_rule_in_rows_and_tables(spark):
    rng = random.Random(7)
    groups = {g: [(s, s + rng.randint(1, 6), rng.choice("ABC")) for s in (rng.randint(0, 40) for _ in range(rng.randint(1, 12)))] for g in range(40)}
    flat = spark.createDataFrame([(g, *s) for g, spans in groups.items() for s in spans], "doc_id int, char_start int, char_end int, entity_type string")
    want = {(g, *s) for g, spans in groups.items() for s in plain_merge(spans)}
    assert {tuple(r) for r in rd.merge_spans(flat).collect()} == want
    packed = flat.groupBy("doc_id").agg(F.collect_list(F.struct(
        F.col("char_start").alias("start"), F.col("char_end").alias("end"), "entity_type")).alias("s"))
    in_rows = packed.select("doc_id", F.inline(rd.merged(F.col("s"))))
    assert {tuple(r) for r in in_rows.collect()} == want


def test_policy_messages(spark):
    jobs = spark.createDataFrame([(1, True, "a.pdf"), (2, False, "b.csv"), (3, True, "c.CSV")],
                                 "job_id int, allow_external_processing boolean, original_filename string")

    def reasons(*flags):
        return {r.job_id: r.block_reason for r in rd.external_processing_policy(jobs, *flags).collect()}

    assert reasons(False, False, False) == {1: rd.EXTERNAL_DISABLED, 2: None, 3: rd.EXTERNAL_DISABLED}
    assert reasons(True, True, False) == {1: rd.REDACTION_DISABLED, 2: None, 3: rd.REDACTION_DISABLED}
    assert reasons(True, True, True) == {1: None, 2: None, 3: rd.SPREADSHEET_UNSUPPORTED}


def test_fixed_decimals_round_the_binary_value(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (1234.5,)], "x double")
    got = [r[0] for r in df.select(tx.fixed_decimals(F.col("x"))).collect()]
    assert got == [f"{x:.2f}" for x in (0.125, 2.675, 1234.5)]


def test_arrow_functions_see_short_stretches(spark):
    """A batch of 30 MB reaches the functions in pieces of about a megabyte, rows in order; a longer row and no rows at all are fine."""
    docs = spark.range(0, 9_001, 1, 1).select("id", F.when(F.col("id") == 5, F.repeat(F.lit("b"), 3_000_000)).when(
        F.col("id") != 7, F.repeat(F.lit("a b"), 1_000)).alias("text"))
    own = docs.select("id", sp.in_stretches(lambda t: pa.array([t.nbytes] * len(t)), "long", F.col("text")).alias("n"))
    sizes = {r.id: r.n for r in own.collect()}
    assert len(sizes) == 9_001 and sizes[5] > 3_000_000
    assert max(n for i, n in sizes.items() if i != 5) <= sp.STRETCH_BYTES
    chunks = docs.select("id", F.length("text").alias("n"), sp.chunks_of(F.col("text"), 700, 100).alias("c"), sp.spans_of(F.col("text"), {}).alias("s"))
    wrong = chunks.filter("id = 7 AND c IS NOT NULL OR id != 7 AND (c[0].start != 0 OR element_at(c, -1).end != n) OR size(s) != 0")
    assert wrong.count() == 0 and chunks.count() == 9_001 and chunks.filter("id < 0").count() == 0
    long = pa.array(["a" * 600_000, None, "b" * 600_000, "c"])
    assert pa.concat_arrays([c[0] for c in sp.stretches([long])]) == long and max(c[0].nbytes for c in sp.stretches([long])) <= sp.STRETCH_BYTES
    assert [len(c[0]) for c in sp.stretches([pa.array([], pa.string())])] == [0]
