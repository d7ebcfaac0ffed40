"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docweft.llm import chat, exact_dedup, fingerprints, grid_join, hard_negatives, language_id, merkle, mixing, near_dedup, packing, quality, sharding, warc
from docweft.llm.shared import small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all docs in sequences of 4096 tokens, with the checksum of each piece's ids."""
    import public_tokenizers

    pieces = packing.token_pieces(docs, str(public_tokenizers.path("word_bpe_49k.json")), 4096)
    with small_batches(docs.sparkSession):
        return packing.packed(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), 4096)


@query("op1_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@query("op3_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
  w AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w""")
def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query("op4_chat_formatting", r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
  e AS (SELECT *, regexp_replace(text, '(<' || chr(8288) || '*)(\||s>|/s>)|(\[' || chr(8288) || '*)(/?INST\])', '\1\3' || chr(8288) || '\2\4', 'g') AS safe,
      coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS again FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN again THEN 7 ELSE 8 + length(role) + 8 + 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def chat_formatting_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    made = chat.formatted_conversations(table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra))
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_read(F.col("formatted")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


#: The crc32 of a text's UTF-8 bytes, byte by byte, with a table made by its rule.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1))))"
_TEXT_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),"
    " lambda h: CAST('0x' || h AS BIGINT))), lambda a, b: xor(a >> 8, crcs[CAST(xor(a, b) & 255 AS INT) + 1])))")


@query("op5_sharding", f"""
WITH d AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 8 AS size, {_TEXT_CRC32} AS crc FROM documents, (SELECT {_CRC_TABLE} AS crcs)),
  h AS (SELECT *, coalesce('s' || source, '') AS stratum, substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || crc || '|' || size), 1, 16) AS hash FROM d),
  r AS (SELECT *, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM h WINDOW w AS (PARTITION BY stratum ORDER BY hash, doc_id NULLS FIRST, crc, size)),
  p AS (SELECT *, row_number() OVER (ORDER BY (rank + 0.5::DOUBLE) / n, stratum, rank) - 1 AS place, count(*) OVER () AS total FROM r),
  s AS (SELECT *, CAST(place * 24 // total AS INT) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s""")
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_fingerprints")
def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op7_mixing", r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
  s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source),
  r AS (SELECT *, s * 2 AS cap, sum(s) OVER () * 1.5::DOUBLE AS budget, sum(w) OVER () AS all_w, coalesce(sum(s * 2) OVER b, 0) AS caps, coalesce(sum(w) OVER b, 0) AS spent
    FROM s WINDOW b AS (ORDER BY s * 2 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  k AS (SELECT *, cap * (all_w - spent) <= (budget - caps) * w AS capped FROM r),
  t AS (SELECT source, s, CASE WHEN capped THEN cap ELSE w * ((budget - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER ()) END AS target FROM k),
  u AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), 2) ELSE 0 END AS whole FROM t),
  c AS (SELECT d.*, u.s, u.target, u.whole, u.target - u.whole * u.s AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
  p AS (SELECT *, min(CASE WHEN upto > budget THEN h END) OVER (PARTITION BY source) AS edge FROM c),
  q AS (SELECT *, sum(CASE WHEN h = edge THEN size ELSE 0 END) OVER (PARTITION BY source) AS lump, max(CASE WHEN h = edge THEN upto END) OVER (PARTITION BY source) AS reached FROM p)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
  CAST(size * least(whole + CASE WHEN budget > 0 AND (edge IS NULL OR h < edge OR (h = edge AND reached - budget < budget - (reached - lump))) THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM q""")
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
  w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS winner FROM p)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM w""")
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"), 0).select(
        "capture_id", F.get("metadata", F.lit(0))["page_id"].alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("response_id"))
    responses = found.filter("record_type = 'response'").select(F.col("capture_id").alias("response_id"), F.col("page_id").alias("refers_to"))
    return found.join(responses, "response_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


@query("op10_near_dedup")
def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


_MERKLE_LEAF = "sha256(" + " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", "TEXT")) + ")"
#: The crc32 of a decimal number, bit by bit: each byte enters with the first of its eight steps.
_DECIMAL_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
    " lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))))")


@query("op11_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_MERKLE_LEAF.replace('TEXT', 'text')} AS leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    CASE WHEN doc_id IS NOT NULL AND {_DECIMAL_CRC32} % 2 = 0 THEN {_MERKLE_LEAF.replace('TEXT', "replace(text, chr(10), '')")} END AS tampered FROM documents),
  t AS (SELECT 0 AS l, source, i, n, leaf AS h FROM d UNION ALL
    SELECT l + 1, source, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY l, source, i // 3),
  s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
  u AS (SELECT 0 AS l, i, n, h FROM s UNION ALL SELECT l + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY l, i // 3),
  runs AS (SELECT source, l, i // 3 AS run, list({{'i': i, 'h': h}} ORDER BY i) AS nodes FROM t WHERE n > 1 GROUP BY ALL),
  tops AS (SELECT l, i // 3 AS run, list({{'i': i, 'h': h}} ORDER BY i) AS nodes FROM u WHERE n > 1 GROUP BY ALL),
  p AS (SELECT doc_id, source, 0 AS l, i, n, coalesce(tampered, leaf) AS h, '' AS proof FROM d UNION ALL
    SELECT doc_id, p.source, p.l + 1, run, (n + 2) // 3,
      sha256(array_to_string([x.h for x in nodes if x.i < p.i], '') || p.h || array_to_string([x.h for x in nodes if x.i > p.i], '')),
      proof || array_to_string([x.h for x in nodes if x.i <> p.i], '')
    FROM p JOIN runs ON runs.source IS NOT DISTINCT FROM p.source AND runs.l = p.l AND runs.run = p.i // 3 WHERE n > 1),
  q AS (SELECT doc_id, p.source, 0 AS l, s.i, s.n, p.h, proof FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source WHERE p.n = 1 UNION ALL
    SELECT doc_id, q.source, q.l + 1, run, (n + 2) // 3,
      sha256(array_to_string([x.h for x in nodes if x.i < q.i], '') || q.h || array_to_string([x.h for x in nodes if x.i > q.i], '')),
      proof || array_to_string([x.h for x in nodes if x.i <> q.i], '')
    FROM q JOIN tops ON tops.l = q.l AND tops.run = q.i // 3 WHERE n > 1)
SELECT d.doc_id, d.leaf, s.h AS subroot, u.h AS root, sha256(q.proof) AS proof_sha256, q.h AS folded_root, q.h = u.h AS verified
FROM d JOIN q ON q.doc_id = d.doc_id AND q.n = 1 JOIN s ON s.source IS NOT DISTINCT FROM d.source JOIN u ON u.n = 1""")
def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


@query("op12_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
    coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
  links AS (SELECT a.r, b.r AS o FROM v a JOIN v b ON a.ok AND b.ok AND a.r <> b.r AND len(a.e) = len(b.e) WHERE CASE WHEN a.ok AND b.ok AND len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 END),
  reach AS (SELECT r, r AS o FROM v UNION SELECT reach.r, links.o FROM reach JOIN links ON links.r = reach.o),
  c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.o GROUP BY reach.r),
  n AS (SELECT r, count(*) AS n_links FROM links GROUP BY r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)""")
def embedding_near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_hard_negatives", """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.e) = len(b.e)),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, o) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.r, p.o ORDER BY s.score DESC, s.vec_id NULLS LAST, s.o) QUALIFY row_number() OVER w <= 3""")
def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)
