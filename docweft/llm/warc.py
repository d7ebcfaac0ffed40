"""WARC archives: writing captures, reading records, and assembling the records of each capture.

A capture is a request, a response (or a revisit, when its payload is stored elsewhere) and a metadata record. Request and metadata
name the response in WARC-Concurrent-To. Archives are gzip files of WARC/1.1 records in the shared folder, written and read by
Spark's text source with the blank lines after a record as the separator, so any store that Spark reaches will do and no file
is held as a whole: the reader goes through the pieces of a file in order and joins them by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docweft.llm.shared import new_path, written

GAP = "\r\n\r\n"
CRLF = "\r\n"
RECORD_DDL = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
              "page_id long, payload_bytes long, payload_digest string, intact boolean, payload string")
#: Fixed values of RFC 4648: the digits of base 32 numbers, and the letters that base32 writes for them.
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_sha1(text: Column) -> Column:
    """Five hexadecimal digits are four base32 letters, so 40 digits need no padding."""
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, LETTERS)


def _uuid(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *parts))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: str, record_id: Column, uri: Column, date: str, fields: dict[str, Column], content_type: str, block: Column) -> Column:
    """One record without the blank lines that end it."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), record_id, F.lit(f"{CRLF}WARC-Date: {date}{CRLF}")]
    lines += [F.when(uri != "", F.concat(F.lit("WARC-Target-URI: "), uri, F.lit(CRLF))).otherwise("")]
    for name, value in fields.items():
        lines += [F.lit(f"{name}: "), value, F.lit(CRLF)]
    lines += [F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(GAP), block]
    return F.concat(*lines)


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per row of pages: page_id, url, payload, payload_bytes, payload_digest, is_response, response_id, capture_key.

    Of payloads (null html: empty) of at least least_bytes that are equal, the row with the largest page_id (null lowest) is the
    response; the rest revisit it, its own repeated rows too. Smaller payloads are all responses. Winners are found on ids and
    digests alone; each page then meets its own winner by page_id and digest, a key that no two different pages share.
    """
    html = F.coalesce("html", F.lit(""))
    page = pages.select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "").alias("url"), html.alias("payload"),
        F.sha1(html).alias("sha1"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"))
    winners = page.groupBy("sha1").agg(F.max("page_id").alias("winner"))
    keys = page.select("id", "sha1").distinct().join(winners, "sha1")
    number = F.row_number().over(Window.partitionBy("id", "sha1").orderBy("url"))
    one = page.join(keys, ["id", "sha1"]).withColumns({"copy": number, "payload_bytes": F.octet_length("payload").cast("long")})
    small, winner = F.col("payload_bytes") < least_bytes, F.coalesce(F.col("winner").cast("string"), F.lit(""))
    first = (F.col("id") == winner) & (F.col("copy") == 1)
    return one.select(
        "page_id", "url", "payload", "payload_bytes", base32_of_sha1(F.col("payload")).alias("payload_digest"), (small | first).alias("is_response"),
        _uuid(F.lit("response"), winner, F.lit("1"), F.col("sha1")).alias("response_id"),
        F.concat_ws("|", "id", F.col("copy").cast("string"), "sha1").alias("capture_key"))


def write_archives(captured: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """A request, a response or revisit, and a metadata record for each row of captures(), next to each other, one file per task."""
    key, uri = F.col("capture_key"), F.col("url")
    parts = F.split(key, r"\|")
    own = _uuid(F.lit("response"), parts[0], parts[1], parts[2])
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(GAP))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    message = "application/http; msgtype="
    host, place = F.regexp_extract(uri, r"^\w+://([^/?#]*)", 1), F.regexp_extract(uri, r"^\w+://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(GAP))
    about = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(CRLF))).otherwise("")
    answer = F.when(
        F.col("is_response"), _record("response", own, uri, date, {"WARC-Payload-Digest": digest}, message + "response", F.concat(http, F.col("payload")))).otherwise(
        _record("revisit", own, uri, date, {
            "WARC-Payload-Digest": digest, "WARC-Profile": F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            "WARC-Refers-To": F.col("response_id")}, message + "response", http))
    records = F.array(
        _record("request", _uuid(F.lit("request"), key), uri, date, {"WARC-Concurrent-To": own}, message + "request", asked), answer,
        _record("metadata", _uuid(F.lit("metadata"), key), uri, date, {"WARC-Concurrent-To": own}, "application/warc-fields", about))
    captured.select(F.explode(records).alias("value")).write.option("lineSep", GAP).option("compression", "gzip").text(path)


def _raw_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record, from the pieces between blank lines, file by file and in order."""
    file, head, parts, missing = None, None, [], 0
    for path, piece in pieces:
        if path != file:
            if head is not None:
                raise ValueError(f"{file} ends inside a record")
            file = path
        while piece is not None:
            if head is None:
                if not piece.strip():
                    break
                length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", piece)
                if not piece.lstrip().startswith(b"WARC/") or not length:
                    raise ValueError(f"{path} holds no record where one should start: {piece[:60]!r}")
                head, parts, missing = piece.lstrip(), [], int(length[1])
                break
            parts.append(piece)
            missing -= len(piece)
            if missing > 0:  # the block goes on after these blank lines
                parts.append(b"\r\n\r\n")
                missing -= 4
                break
            block = b"".join(parts)
            end = len(block) + missing
            yield head, block[:end]
            piece, head = block[end + 4 :] if missing < 0 else None, None
    if head is not None:
        raise ValueError(f"{file} ends inside a record")


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return {name.decode("latin-1").strip().lower(): value.decode("utf-8", "replace").strip() for name, value in pairs}


def _parsed(head: bytes, block: bytes, with_payload: bool) -> dict:
    fields = _fields(head)
    kind, payload, number, claimed = fields.get("warc-type"), None, None, fields.get("warc-payload-digest", "").removeprefix("sha1:")
    row = {
        "record_id": fields.get("warc-record-id"), "type": kind, "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "page_id": None, "payload_bytes": None, "payload_digest": None,
        "intact": None, "payload": None}
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            row |= {"payload_bytes": len(payload), "payload_digest": digest, "intact": claimed in ("", digest)}
            row["payload"] = payload.decode("utf-8", "replace") if with_payload else None
        else:
            row |= {"payload_bytes": int(_fields(http).get("content-length", 0)), "payload_digest": claimed}
    elif kind == "metadata":
        number = _fields(b"\r\n" + block).get("pageid")
        row["page_id"] = None if number is None else int(number)
    return row


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record (see RECORD_DDL) of the archives in a folder. An archive that is cut off raises an error.

    payload_bytes and payload_digest of a response are those of the payload as read; a revisit names those of the full payload.
    """
    columns = [c.split()[0] for c in RECORD_DDL.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        held = 0
        for head, block in _raw_records((p, v) for b in batches for p, v in zip(b["path"], b["piece"])):
            rows.append(_parsed(head, block, with_payload))
            held += len(block) if with_payload else 0
            if len(rows) >= 2000 or held > 1 << 24:
                yield _typed(rows, columns)
                rows, held = [], 0
        yield _typed(rows, columns)

    pieces = spark.read.option("lineSep", GAP).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInPandas(parse, RECORD_DDL)


def _typed(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    kinds = {"page_id": "Int64", "payload_bytes": "Int64", "intact": "boolean"}
    return pd.DataFrame({c: pd.array([r[c] for r in rows], dtype=kinds.get(c, "object")) for c in columns})


def assembled(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response (struct), requests and metadata (sorted arrays of structs, null if none).

    A request or metadata record belongs to the response or revisit that its WARC-Concurrent-To names. Without one, or if that
    record is not there, it makes a capture of its own without a response, so no record is lost.
    """
    def others(kind: str, name: str, *columns: str) -> DataFrame:
        own = records.filter(F.col("type") == kind).select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), F.struct("record_id", *columns).alias("r"))
        return own.groupBy("capture_id").agg(F.sort_array(F.collect_list("r")).alias(name))

    answers = records.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.struct("type", "refers_to", "target_uri", "date", "payload_bytes", "payload_digest", "intact", "payload").alias("response"))
    requests = others("request", "requests", "target_uri", "date")
    return answers.join(requests, "capture_id", "full_outer").join(others("metadata", "metadata", "page_id"), "capture_id", "full_outer")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages written as archives into the shared folder, read back and assembled; payloads are checked against their digests, not returned."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(captures(pages, least_bytes), path)
    return written(assembled(written(read_records(spark, path), "records")), "captures")
