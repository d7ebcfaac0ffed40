"""Text preparation and redaction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docweft.functions.text import BLANKS
from docweft.operators import redaction as rd, text_prep as tp
from workload import views as v
from workload.fixed import INVOICE
from workload.registry import query


def _chars(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


BLANK_SQL = f"({_chars(BLANKS)})"
LINE_SPLIT_SQL = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
NON_BLANK_RUN = r"'[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'"


def norm_sql(text: str) -> str:
    return (f"trim(array_to_string(list_transform(string_split_regex({text}, {LINE_SPLIT_SQL}), "
            f"lambda x: rtrim(x, {BLANK_SQL})), chr(10)), {BLANK_SQL})")


def visible_sql(text: str) -> str:
    return f"length(regexp_replace({text}, {NON_BLANK_RUN}, '', 'g'))"


@query("b01_normalize_text", f"SELECT doc_id, md5({norm_sql('text')}) AS text_md5, length({norm_sql('text')}) AS n_chars FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.normalize(v.documents(spark, sf_dir)).select(
        "doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@query("b02_meaningful_text", f"SELECT conv_id, turn, {visible_sql('text')} AS n_visible FROM conversations WHERE {visible_sql('text')} >= 120")
def meaningful_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tp.meaningful_text(v.table(spark, sf_dir, "conversations"), threshold=120)
    return kept.select("conv_id", "turn", tp.tx.visible_length(F.col("text")).cast("bigint").alias("n_visible"))


@query("b03_first_usable_parse", f"""
WITH usable AS (SELECT conv_id, min(turn) AS attempt_no FROM conversations WHERE {visible_sql('text')} >= 180 GROUP BY conv_id)
SELECT d.conv_id AS doc_id, u.attempt_no, md5(c.text) AS text_md5, CASE WHEN u.attempt_no IS NULL THEN 'failed' ELSE 'parsed' END AS status,
  CASE WHEN u.attempt_no IS NULL THEN '{tp.NO_USABLE_TEXT}' END AS error_message
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN usable u ON u.conv_id = d.conv_id
LEFT JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.attempt_no""")
def first_usable_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = v.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("attempt_no"), "text")
    return tp.first_usable_parse(attempts, threshold=180).withColumn("text_md5", F.md5("text")).drop("text")


@query("b04_assemble_pages", f"""
WITH kept AS (SELECT doc_id, page_no, seq, {norm_sql('text')} AS t FROM v_items),
pages AS (SELECT doc_id, page_no, {norm_sql("string_agg(t, chr(10) ORDER BY seq, t)")} AS page FROM kept WHERE t <> '' GROUP BY 1, 2)
SELECT doc_id, md5(trim(string_agg('[Page ' || page_no || ']' || chr(10) || page, chr(10) || chr(10) ORDER BY page_no), {BLANK_SQL})) AS text_md5
FROM pages WHERE page <> '' GROUP BY doc_id""")
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.assemble_pages(v.items(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


HTML_SQL = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"
for _entity, _char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    HTML_SQL = f"replace({HTML_SQL}, '{_entity}', {_char})"
HTML_SQL = (f"array_to_string(list_filter(list_transform(string_split_regex({HTML_SQL}, {LINE_SPLIT_SQL}), "
            f"lambda x: trim(x, {BLANK_SQL})), lambda x: x <> ''), chr(10))")


@query("b05_html_to_text", f"""
SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {HTML_SQL} AS t FROM pages) WHERE {visible_sql('t')} >= 24""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.html_to_text(v.table(spark, sf_dir, "pages")).select(
        "page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


CHUNK_SQL = f"""
WITH RECURSIVE base AS (SELECT doc_id, trim(text, {BLANK_SQL}) AS t FROM documents),
walk AS (
  SELECT doc_id, t, 0 AS s, 0 AS e, 0 AS idx, length(t) <= {{size}} AS done, length(t) AS total FROM base
  UNION ALL
  SELECT doc_id, t, CASE WHEN idx = 0 THEN 0 ELSE greatest(e - {{overlap}}, s + 1) END AS s,
    CASE WHEN hard < total AND length(regexp_extract(tail, '(?s)^(.*)[\\n ]', 0)) > 0
         THEN begin + {{half}} + 1 + length(regexp_extract(tail, '(?s)^(.*)[\\n ]', 1)) ELSE hard END AS e,
    idx + 1, false, total
  FROM (SELECT *, least(begin + {{size}}, total) AS hard,
          substring(t, begin + {{half}} + 2, least(begin + {{size}}, total) - begin - {{half}} - 1) AS tail
        FROM (SELECT *, CASE WHEN idx = 0 THEN 0 ELSE greatest(e - {{overlap}}, s + 1) END AS begin FROM walk)
        WHERE NOT done AND (idx = 0 OR e < total))
),
pieces AS (
  SELECT doc_id, idx, s, e, trim(substring(t, s + 1, e - s), {BLANK_SQL}) AS chunk FROM walk WHERE idx > 0
  UNION ALL SELECT doc_id, 1, 0, length(t), t FROM base WHERE length(t) <= {{size}})
"""


def chunk_sql(size: int, overlap: int) -> str:
    return CHUNK_SQL.format(size=size, overlap=overlap, half=size // 2)


@query("b06_chunk_text", chunk_sql(4000, 500) + """
SELECT doc_id, idx AS chunk_index, s AS chunk_start, e AS chunk_end, md5(chunk) AS chunk_md5 FROM pieces""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.chunk_text(v.documents(spark, sf_dir), 4000).select(
        "doc_id", "chunk_index", "chunk_start", "chunk_end", F.md5("chunk").alias("chunk_md5"))


@query("b06_chunk_text_short", chunk_sql(800, 500) + """
SELECT doc_id, count(*) AS n_chunks, min(s) AS first_start, max(e) AS last_end, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM pieces GROUP BY doc_id""")
def chunk_text_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks shorter than twice the overlap."""
    return tp.chunk_text(v.documents(spark, sf_dir), 800, 500).groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.min("chunk_start").alias("first_start"), F.max("chunk_end").alias("last_end"),
        F.sum(F.length("chunk")).alias("chars"))


@query("b07_label_chunks", chunk_sql(2000, 200) + """
SELECT doc_id, 'Found. Chunk ' || idx || '/' || count(*) OVER (PARTITION BY doc_id) || '.' AS notes FROM pieces""")
def label_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = tp.chunk_text(v.documents(spark, sf_dir), 2000, 200).withColumn("notes", F.lit("Found."))
    return tp.label_chunks(chunks).select("doc_id", "notes")


@query("b08_reject_oversized", """
SELECT doc_id, length(text) AS n_document_chars, length(text) <= 3000 AS accepted,
  CASE WHEN length(text) > 3000 THEN 'document_too_large' END AS reject_reason FROM documents""")
def reject_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = tp.reject_oversized(v.documents(spark, sf_dir), 3000).drop("text")
    return split.withColumn("n_document_chars", F.col("n_document_chars").cast("bigint"))


PAGED_SQL = """
WITH paged AS (
  SELECT doc_id, string_agg('[Page ' || page_no || ']' || chr(10) || t, chr(10) ORDER BY page_no) AS text
  FROM (SELECT conv_id AS doc_id, turn + 1 AS page_no, text AS t FROM conversations) GROUP BY doc_id),
spans AS (SELECT conv_id AS doc_id, turn, CAST(abs(turn * 37 - 20) AS INTEGER) AS char_start FROM conversations),
"""


@query("b09_page_of_offset", PAGED_SQL + r"""
marks AS (SELECT doc_id, CAST(regexp_extract(piece, '^(\d+)\]', 1) AS INTEGER) AS page, pos FROM (
  SELECT doc_id, unnest(string_split(text, '[Page ')) AS piece, unnest(list_transform(range(len(string_split(text, '[Page '))), lambda i:
    length(array_to_string(list_slice(string_split(text, '[Page '), 1, i), '[Page ')))) AS pos FROM paged) WHERE regexp_matches(piece, '^\d+\]'))
SELECT s.doc_id, s.turn, max(m.page) FILTER (WHERE m.pos <= s.char_start) AS page_number,
  coalesce('Page ' || max(m.page) FILTER (WHERE m.pos <= s.char_start), '') AS location_reference
FROM spans s LEFT JOIN marks m ON m.doc_id = s.doc_id GROUP BY 1, 2""")
def page_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = v.table(spark, sf_dir, "conversations")
    spans = conversations.select(F.col("conv_id").alias("doc_id"), "turn", F.abs(F.col("turn") * 37 - 20).cast("int").alias("char_start"))
    return tp.page_of_offset(spans, paged_documents(spark, sf_dir)).select("doc_id", "turn", "page_number", "location_reference")


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = v.table(spark, sf_dir, "conversations")
    page = F.concat(F.lit("[Page "), (F.col("turn") + 1).cast("string"), F.lit("]\n"), F.col("text"))
    return conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"]), "\n").alias("text"))


@query("b10_highlight_segments", """
WITH spans AS (SELECT doc_id, text, CAST(doc_id % 11 AS INTEGER) AS s, CAST(doc_id % 11 + doc_id % 4 AS INTEGER) AS e FROM documents)
SELECT doc_id, segment_no, md5(segment) AS segment_md5, highlighted FROM (
  SELECT doc_id, 0 AS segment_no, text AS segment, false AS highlighted FROM spans WHERE NOT (e > s AND e <= length(text))
  UNION ALL
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1, segment, highlighted FROM (
    SELECT doc_id, 0 AS n, substring(text, 1, s) AS segment, false AS highlighted FROM spans WHERE e > s AND e <= length(text) AND s > 0
    UNION ALL SELECT doc_id, 1, substring(text, s + 1, e - s), true FROM spans WHERE e > s AND e <= length(text)
    UNION ALL SELECT doc_id, 2, substring(text, e + 1), false FROM spans WHERE e > s AND e < length(text)))""")
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.documents(spark, sf_dir)
    key = F.col("doc_id")
    spans = docs.select("doc_id", (key % 11).cast("int").alias("char_start"), (key % 11 + key % 4).cast("int").alias("char_end"))
    return tp.highlight_segments(spans, docs).select(
        "doc_id", F.col("segment_no").cast("bigint").alias("segment_no"), F.md5("segment").alias("segment_md5"), "highlighted")


@query("b11_prompt_requests", f"""
SELECT doc_id, md5('{tp.REQUEST_HEAD}' || text || '{tp.REQUEST_TEMPLATE_HEAD}' || '{tp.template_payload(INVOICE).replace("'", "''")}' || chr(10)) AS request_md5
FROM v_invoices""")
def prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tp.prompt_requests(v.invoices(spark, sf_dir).select("doc_id", "text"), INVOICE, text="text")
    return requests.select("doc_id", F.md5("request").alias("request_md5"))


@query("b12_readable_text", """
SELECT doc_id, md5(CASE WHEN doc_id % 3 > 0 THEN text WHEN doc_id % 5 < 3 THEN text END) AS text_md5,
  CASE WHEN doc_id % 3 > 0 THEN 'parsed_file' WHEN doc_id % 5 < 3 THEN 'upload' END AS text_source FROM documents""")
def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    docs = v.documents(spark, sf_dir).select(
        "doc_id", F.when(key % 3 > 0, F.col("text")).otherwise(" \n").alias("parsed_text"), F.col("text").alias("raw_text"),
        F.when(key % 5 < 3, "text/plain").otherwise("application/pdf").alias("content_type"))
    return tp.readable_text(docs).select("doc_id", F.md5("text").alias("text_md5"), "text_source")


# ---- redaction ----------------------------------------------------------------------------------
SPANS_SQL = "WITH RECURSIVE found AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS entity_type, unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i,
  regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM documents
  WHERE regexp_matches(text, '{pattern}')""" for kind, pattern in rd.ENTITY_PATTERNS.items()) + """),
spans AS (SELECT doc_id, entity_type, CAST(list_sum(list_transform(gaps[1:i + 1], lambda g: length(g)))
    + coalesce(list_sum(list_transform(hits[1:i], lambda h: length(h))), 0) AS INTEGER) AS char_start, hits[i + 1] AS hit FROM found),
ranged AS (SELECT doc_id, entity_type, char_start, CAST(char_start + length(hit) AS INTEGER) AS char_end FROM spans),
islands AS (SELECT *, sum(CASE WHEN prior IS NULL OR char_start > prior THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY char_start, char_end DESC, entity_type) AS island
  FROM (SELECT *, max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end DESC, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM ranged)),
merged AS (SELECT doc_id, min(char_start) AS char_start, max(char_end) AS char_end,
  first(entity_type ORDER BY char_start, char_end DESC, entity_type) AS entity_type FROM islands GROUP BY doc_id, island)
"""


@query("c01_detect_entities", SPANS_SQL + "SELECT doc_id, entity_type, char_start, char_end FROM ranged")
def detect_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.detect_entities(v.documents(spark, sf_dir))


@query("c02_merge_spans", SPANS_SQL + "SELECT * FROM merged")
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.merge_spans(rd.detect_entities(v.documents(spark, sf_dir)))


MASKED_SQL = SPANS_SQL + """,
ordered AS (SELECT m.*, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) AS n,
  lag(char_end, 1, 0) OVER (PARTITION BY doc_id ORDER BY char_start) AS prior_end FROM merged m),
masked AS (SELECT o.doc_id, string_agg(substring(d.text, prior_end + 1, char_start - prior_end) ||
    regexp_replace(substring(d.text, char_start + 1, char_end - char_start), '\\S', '*', 'g'), '' ORDER BY n) AS head, max(char_end) AS last_end
  FROM ordered o JOIN documents d ON d.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT d.doc_id, md5(coalesce(head || substring(d.text, last_end + 1), d.text)) AS text_md5, length(d.text) AS n_chars
FROM documents d LEFT JOIN masked m ON m.doc_id = d.doc_id"""


@query("c03_mask_spans", MASKED_SQL)
def mask_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.documents(spark, sf_dir)
    return rd.mask_spans(docs, rd.detect_entities(docs)).select(
        "doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@query("c03_redact", MASKED_SQL)
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.redact(v.documents(spark, sf_dir)).select(
        "doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@query("c04_redaction_counts", SPANS_SQL + "SELECT doc_id, " + ", ".join(
    f"count(*) FILTER (WHERE entity_type = '{k}') AS {k.lower()}" for k in rd.ENTITY_PATTERNS) + """, count(*) AS span_count,
  'External provider text redaction applied for ' || count(*) || ' spans across ' || count(DISTINCT entity_type) || ' entity types.' AS note
FROM merged GROUP BY doc_id""")
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.redaction_counts(rd.merge_spans(rd.detect_entities(v.documents(spark, sf_dir))))


@query("c05_clear_redacted_results", f"""
SELECT result_id, field_name, seq, CASE WHEN NOT m THEN extracted_value END AS extracted_value, CASE WHEN NOT m THEN amount END AS amount,
  m OR requires_review AS requires_review, CASE WHEN m THEN notes || ' {rd.CLEARED_NOTE}' ELSE notes END AS notes
FROM (SELECT *, seq % 10 = 0 OR seq % 7 = 0 AS m FROM v_candidates)""")
def clear_redacted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    masked = v.candidates(spark, sf_dir).withColumns({
        "source_text": F.when(seq % 10 == 0, "R **").otherwise(F.col("source_text")),
        "extracted_value": F.when(seq % 7 == 0, "1*").otherwise(F.col("extracted_value"))})
    return rd.clear_redacted_results(masked).select(
        "result_id", "field_name", "seq", "extracted_value", F.col("normalized_value.amount").alias("amount"), "requires_review", "notes")


@query("c06_external_processing_policy", f"""
SELECT job_id, wants AND ext IN ('.csv', '.xls', '.XLSX') AS blocked,
  CASE WHEN wants AND ext IN ('.csv', '.xls', '.XLSX') THEN '{rd.SPREADSHEET_UNSUPPORTED}' END AS block_reason
FROM (SELECT job_id, job_id % 3 = 0 AS wants, CASE job_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.pdf' WHEN 2 THEN '.XLSX' WHEN 3 THEN '.txt' ELSE '.xls' END AS ext FROM v_jobs)""")
def external_processing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("job_id")
    jobs = v.jobs(spark, sf_dir).select("job_id", (key % 3 == 0).alias("allow_external_processing"), F.concat(
        F.lit("doc"), v.choose(key % 5, (".csv", ".pdf", ".XLSX", ".txt", ".xls"))).alias("original_filename"))
    return rd.external_processing_policy(jobs, allow_external=True, require_redaction=True, redaction_enabled=True).select(
        "job_id", "blocked", "block_reason")
