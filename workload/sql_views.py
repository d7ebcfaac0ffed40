"""The views of `views.py` in SQL, as bodies of common table expressions."""

from workload.fixed import FAILURE_MESSAGES

_messages = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(FAILURE_MESSAGES))

SQL_VIEWS = {
    "v_jobs": f"""
SELECT c_mktsegment AS tenant_id, o_orderkey AS job_id, o_orderkey AS document_id, o_orderkey % 7 AS template_version_id,
  CASE WHEN o_orderstatus = 'F' THEN 'completed'
       WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'cancelled' ELSE 'failed' END
       WHEN o_orderpriority = '1-URGENT' THEN 'running' ELSE 'queued' END AS status,
  o_orderdate AS created_at, o_orderdate + to_hours(CAST(o_orderkey % 48 AS INTEGER)) AS updated_at,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' THEN CASE o_orderkey % 7 {_messages} END END AS error_message,
  CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
       THEN CASE o_orderkey % 4 WHEN 0 THEN 'parsing' WHEN 1 THEN 'extracting' WHEN 2 THEN 'validating' ELSE 'post_checks' END
  END AS progress_stage,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 300 AS DOUBLE) - 50.5 END AS progress_pct
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_invoices": """
SELECT o_orderkey AS doc_id, c_mktsegment AS tenant_id, o_orderkey % 7 AS template_version_id, o_totalprice, o_orderdate,
  'Vendor Name: ' || c_mktsegment || chr(10) || 'Total Due: $' || format('{:,.2f}', o_totalprice) || chr(10) ||
  'Order Date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'Invoice ' || CAST(o_orderkey AS VARCHAR) AS text
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_candidates": """
SELECT l_orderkey AS result_id, 'field_' || CAST(l_linenumber AS VARCHAR) AS field_name, l_linenumber,
  l_partkey * 1000000 + l_suppkey AS seq,
  CASE WHEN NOT (l_linestatus = 'F' AND l_returnflag = 'A') THEN l_extendedprice END AS amount,
  CAST(l_extendedprice AS VARCHAR) AS extracted_value, 1 - l_discount * 5 AS confidence,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS source_text,
  l_returnflag = 'R' AS requires_review, 'Line ' || CAST(l_linenumber AS VARCHAR) || '.' AS notes
FROM lineitem""",
    "v_best": """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY result_id, field_name) AS n_candidates,
  row_number() OVER (PARTITION BY result_id, field_name ORDER BY
    (amount IS NOT NULL)::INT + (source_text <> '')::INT DESC, confidence DESC, length(source_text) DESC, seq ASC,
    extracted_value DESC) AS rn FROM v_candidates) WHERE rn = 1""",
    "v_results": """
SELECT l_orderkey AS result_id, 'field_' || CAST(l_linenumber AS VARCHAR) AS field_name, l_linenumber,
  max(l_extendedprice) AS amount, CAST(max(l_extendedprice) AS VARCHAR) AS extracted_value, max(1 - l_discount * 5) AS confidence,
  CASE WHEN bool_or(l_linestatus = 'F' AND l_returnflag = 'A') THEN 'invalid' ELSE 'valid' END AS validation_status,
  bool_or(l_returnflag <> 'N') AS requires_review
FROM lineitem GROUP BY 1, 2, 3""",
    "v_edits": """
SELECT l_orderkey AS result_id, 'field_' || CAST(l_linenumber AS VARCHAR) AS field_name, l_extendedprice AS new_amount,
  CASE WHEN l_linestatus = 'F' THEN 'edited ' || CAST(l_partkey AS VARCHAR) END AS edit_extracted,
  'reviewer_' || CAST(l_suppkey AS VARCHAR) AS reviewer, l_shipdate AS created_at,
  CAST(epoch(l_shipdate) / 86400 AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS seq
FROM lineitem WHERE l_returnflag = 'R'""",
    "v_audit": """
SELECT event_id, 'tenant_' || CAST(user_id % 5 AS VARCHAR) AS tenant_id, event_type AS action, props AS metadata, ts AS created_at,
  user_id
FROM events""",
    "v_items": """
SELECT conv_id AS doc_id, CAST(floor(turn / 2) AS INTEGER) + 1 AS page_no, turn AS seq, text FROM conversations""",
}
