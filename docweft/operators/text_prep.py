"""Text preparation: cleaning, page assembly, chunking, page lookup, request rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweft.functions import spans as sp, text as tx
from docweft.schema import Template

# ---- fixed values -------------------------------------------------------------------------------
MEANINGFUL_THRESHOLD = 24
DEFAULT_OVERLAP = 500
NO_USABLE_TEXT = "Docling PDF parsing produced no usable text, including OCR retry."
REQUEST_HEAD = (
    "You are an expert document extraction engine.\n\n"
    "Return only valid JSON. Do not calculate formula fields.\n\nDocument:\n"
)
REQUEST_TEMPLATE_HEAD = "\n\nExtraction Template:\n"


def normalize(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, tx.normalize_text(F.col(text)))


def meaningful_text(docs: DataFrame, threshold: int = MEANINGFUL_THRESHOLD, text: str = "text") -> DataFrame:
    """Keep documents with at least `threshold` non-blank characters."""
    return docs.filter(tx.visible_length(F.col(text)) >= threshold)


def first_usable_parse(
    attempts: DataFrame,
    threshold: int = MEANINGFUL_THRESHOLD,
    key: str = "doc_id",
    failure_message: str = NO_USABLE_TEXT,
) -> DataFrame:
    """Per document the earliest parse attempt with enough text, else a failed row with a message.

    One aggregation with map-side combine: only the best attempt per document and task is shuffled,
    and documents without a usable attempt fall out of the same pass.
    """
    usable = F.when(tx.visible_length(F.col("text")) >= threshold, F.struct("attempt_no", "text"))
    best = attempts.groupBy(key).agg(F.min(usable).alias("best"))
    return best.select(
        key,
        F.col("best.attempt_no").alias("attempt_no"),
        F.col("best.text").alias("text"),
        F.when(F.col("best").isNull(), "failed").otherwise("parsed").alias("status"),
        F.when(F.col("best").isNull(), failure_message).alias("error_message"),
    )


def assemble_pages(items: DataFrame, fallback: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Join (doc, page, seq, text) items to one text per document with `[Page N]` markers.

    `fallback` (doc, text) supplies the whole-document text, used as page 1 where no item is left.
    """
    cleaned = items.select(key, "page_no", "seq", tx.normalize_text(F.col("text")).alias("text"))
    kept = cleaned.filter((F.col("text") != "") & F.col("page_no").isNotNull())
    pages = kept.groupBy(key, "page_no").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("items"))
    page_text = tx.normalize_text(F.array_join(F.transform("items", lambda item: item["text"]), "\n"))
    marked = pages.select(
        key, "page_no",
        F.concat(F.lit("[Page "), F.col("page_no").cast("string"), F.lit("]\n"), page_text).alias("page"),
    )
    docs = marked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page_no", "page"))).alias("pages"))
    texts = docs.select(
        key, tx.strip(F.array_join(F.transform("pages", lambda page: page["page"]), "\n\n")).alias("text"))
    if fallback is None:
        return texts
    whole = tx.normalize_text(F.col("whole"))
    return (
        fallback.select(key, F.col("text").alias("whole"))
        .join(texts, key, "left")
        .select(key, F.coalesce("text", F.when(whole != "", F.concat(F.lit("[Page 1]\n"), whole)), F.lit(""))
                .alias("text"))
    )


def html_text(html: Column) -> Column:
    """Visible text of an HTML page: scripts, styles and comments dropped, tags become line ends."""
    body = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "\n")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(tx.split_lines(body), tx.strip), lambda line: line != "")
    return F.array_join(lines, "\n")


def html_to_text(pages: DataFrame, threshold: int = MEANINGFUL_THRESHOLD, html: str = "html") -> DataFrame:
    """HTML pages to text; pages without enough visible text are dropped."""
    texts = pages.withColumn("text", html_text(F.col(html))).drop(html)
    return texts.filter(tx.visible_length(F.col("text")) >= threshold)


def chunk_text(docs: DataFrame, chunk_size: int, overlap: int = DEFAULT_OVERLAP, text: str = "text") -> DataFrame:
    """One row per overlapping chunk of every document; a blank document yields one empty chunk.

    A window ends at the last line end or space of its second half when there is one; the next window starts `overlap`
    characters earlier, but one character on at least, so any chunk size will do (0: one chunk).
    Adds `chunk_index` (1-based), `n_chunks`, `chunk_start`, `chunk_end` and replaces the text by `chunk`.
    Offsets refer to the stripped text. Entirely row-local: no shuffle.
    """
    others = [c for c in docs.columns if c != text]
    return (
        docs.select(*others, sp.chunks_of(tx.strip(F.col(text)), chunk_size, overlap).alias("_chunks"))
        .select(*others, F.size("_chunks").alias("n_chunks"), F.posexplode("_chunks").alias("_pos", "_c"))
        .select(*others, (F.col("_pos") + 1).alias("chunk_index"), "n_chunks",
                F.col("_c.start").alias("chunk_start"), F.col("_c.end").alias("chunk_end"),
                F.col("_c.chunk").alias("chunk"))
    )


def label_chunks(candidates: DataFrame) -> DataFrame:
    """Append `Chunk i/n.` to the notes of candidates that carry `chunk_index` and `n_chunks`."""
    label = F.concat(F.lit("Chunk "), F.col("chunk_index").cast("string"), F.lit("/"),
                     F.col("n_chunks").cast("string"), F.lit("."))
    return candidates.withColumn("notes", tx.append_note(F.col("notes"), label))


def reject_oversized(docs: DataFrame, max_chars: int | None, text: str = "text") -> DataFrame:
    """Add `n_document_chars`, `accepted` and `reject_reason`; no limit accepts everything."""
    n_chars = F.length(text)
    too_large = F.lit(False) if max_chars is None else F.col("n_document_chars") > max_chars
    return (
        docs.withColumn("n_document_chars", n_chars)
        .withColumn("accepted", ~too_large)
        .withColumn("reject_reason", F.when(too_large, "document_too_large"))
    )


def page_reference(page: Column) -> Column:
    return F.when(page.isNull(), "").otherwise(F.concat(F.lit("Page "), page.cast("string")))


def page_of_offset(spans: DataFrame, docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add `page_number` and `location_reference` to spans: the page of the last marker at or before `char_start`.

    Markers and spans of a document become one sequence in order of position, along which the last marker is carried: one sort,
    however many there are of either. The documents are reduced to their markers first, so no text is shuffled. Spans
    with a null key or start, or before the first marker, have no page.
    """
    found = docs.select(*keys, sp.markers_of(F.col("text")).alias("_markers")).select(*keys, F.explode("_markers").alias("_m"))
    marks = found.select(*keys, F.col("_m.pos").alias("_at"), F.col("_m.page").alias("_page"), F.lit(0).alias("_span"))
    for key in keys:
        marks = marks.filter(F.col(key).isNotNull())
    stream = spans.withColumns({"_at": F.col("char_start"), "_span": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_at"), "_span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        stream.withColumn("page_number", F.last("_page", ignorenulls=True).over(before))
        .filter("_span = 1")
        .withColumn("location_reference", page_reference(F.col("page_number")))
        .select(*spans.columns, "page_number", "location_reference")
    )


def highlight_segments(spans: DataFrame, docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Text before, inside and after each span, empty parts dropped; an invalid span shows plain text."""
    body, start, end = F.col("text"), F.col("char_start"), F.col("char_end")
    valid = F.coalesce((F.length(body) > 0) & (start >= 0) & (end > start) & (end <= F.length(body)), F.lit(False))

    def part(content: Column, lit: bool) -> Column:
        return F.struct(content.alias("segment"), F.lit(lit).alias("highlighted"))

    parts = F.filter(
        F.array(part(tx.slice_text(body, F.lit(0), start), False), part(tx.slice_text(body, start, end), True),
                part(tx.slice_text(body, end, F.length(body)), False)),
        lambda p: p["segment"] != "")
    segments = F.when(valid, parts).otherwise(F.array(part(F.coalesce(body, F.lit("")), False)))
    joined = spans.join(docs.select(*keys, "text"), list(keys), "left")
    others = spans.columns
    return joined.select(*others, F.posexplode(segments).alias("segment_no", "_s")).select(
        *others, "segment_no", F.col("_s.segment").alias("segment"), F.col("_s.highlighted").alias("highlighted"))


def template_payload(template: Template) -> str:
    """The template as the indented JSON that extraction requests carry."""
    return json.dumps(asdict(template), indent=2)


def prompt_requests(chunks: DataFrame, template: Template, text: str = "chunk") -> DataFrame:
    """One extraction request per chunk: instruction, document text and template."""
    request = F.concat(F.lit(REQUEST_HEAD), F.col(text), F.lit(REQUEST_TEMPLATE_HEAD),
                       F.lit(template_payload(template) + "\n"))
    return chunks.withColumn("request", request).drop(text)


def readable_text(docs: DataFrame) -> DataFrame:
    """Text a person can read: the parsed text, else the upload if its content type is textual."""
    parsed = F.when(~tx.is_blank(F.col("parsed_text")), F.col("parsed_text"))
    upload = F.when(F.contains("content_type", F.lit("text")) & ~tx.is_blank(F.col("raw_text")), F.col("raw_text"))
    return (
        docs.withColumn("text", F.coalesce(parsed, upload))
        .withColumn("text_source", F.when(parsed.isNotNull(), "parsed_file").when(upload.isNotNull(), "upload"))
        .drop("parsed_text", "raw_text")
    )
