"""The driver's tables as facts, edges, evidence, spans, reviews and files: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")

#: Each view may use those before it.  Words in braces differ by engine.
VIEWS = """
WITH b_run AS (
  SELECT * FROM (VALUES ('R1', ''), ('R2', 'R1')) AS t(run_id, baseline_id)
),
b_entity AS (
  SELECT 'region:' || r_regionkey AS stable_key, 'COMPONENT' AS kind, r_name AS name, '' AS owner_key, CAST(r_regionkey AS BIGINT) AS k, 'region' AS src FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'MODULE', n_name, 'region:' || n_regionkey, CAST(n_nationkey AS BIGINT), 'nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'ENDPOINT', c_name, 'nation:' || c_nationkey, c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'order:' || o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN 'METHOD' WHEN 'O' THEN 'CONDITION' ELSE 'VALIDATION_RULE' END,
    o_orderpriority, 'customer:' || o_custkey, o_orderkey, 'orders' FROM orders
  UNION ALL SELECT 'part:' || p_partkey, CASE WHEN p_size % 2 = 0 THEN 'DATA_READ' ELSE 'DATA_WRITE' END,
    p_name, '', p_partkey, 'part' FROM part WHERE p_partkey % 50 <> 49
  UNION ALL SELECT 'supplier:' || s_suppkey, 'TABLE', s_name, '', s_suppkey, 'supplier' FROM supplier
),
b_relation AS (
  SELECT DISTINCT 'order:' || l_orderkey AS source_key, 'part:' || l_partkey AS target_key,
    CASE l_returnflag WHEN 'A' THEN 'READS' WHEN 'N' THEN 'CALLS' ELSE 'WRITES' END AS edge_kind, l_orderkey AS k,
    (l_orderkey * 100000000 + l_partkey) * 16 + CASE l_returnflag WHEN 'A' THEN 8 WHEN 'N' THEN 9 ELSE 10 END AS line FROM lineitem
  UNION ALL
  SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'READS', l_partkey, (l_partkey * 100000000 + l_suppkey) * 16 + 11
  FROM lineitem WHERE l_linenumber = 1
),
b_fact_raw AS (
  SELECT r.run_id, 'alpha' AS analyzer, 'STATIC_EXACT' AS origin, CAST(1.0 AS DOUBLE) AS confidence, e.kind,
    CASE WHEN r.run_id = 'R2' AND e.src = 'orders' AND e.k % 13 = 0 THEN e.stable_key || ':v2' ELSE e.stable_key END AS stable_key,
    e.name, e.owner_key,
    CASE WHEN e.src = 'part' AND e.k % 10 = 9 THEN 'sym::part:' || (e.k - 1) ELSE 'sym::' || e.stable_key END AS symbol,
    CASE WHEN e.src <> 'orders' THEN 0 WHEN r.run_id = 'R2' AND e.k % 11 = 0 THEN 300 ELSE 500 END AS threshold,
    '' AS source_key, '' AS target_key, '' AS edge_kind, e.k AS doc_key,
    e.k * 16 + CASE e.src WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 WHEN 'orders' THEN 3 WHEN 'part' THEN 4 ELSE 5 END AS line_number
  FROM b_run r CROSS JOIN b_entity e
  WHERE NOT (r.run_id = 'R2' AND e.src = 'orders' AND e.k % 17 = 3)
  UNION ALL
  SELECT r.run_id, 'beta', 'STATIC_SYNTAX', CAST(0.8 AS DOUBLE), e.kind, e.stable_key, e.name, e.owner_key, 'sym::' || e.stable_key,
    CASE WHEN e.k % 14 = 0 THEN 499 ELSE 500 END, '', '', '', e.k, e.k * 16 + 3
  FROM b_run r CROSS JOIN b_entity e WHERE e.src = 'orders' AND e.k % 7 = 0
  UNION ALL
  SELECT r.run_id, 'alpha', 'STATIC_TYPED', CAST(1.0 AS DOUBLE), 'RELATION',
    'relation:' || x.edge_kind || ':' || x.source_key || '->' || x.target_key, x.edge_kind, '', '', 0,
    x.source_key, x.target_key, x.edge_kind, x.k, x.line
  FROM b_run r CROSS JOIN b_relation x
),
b_fact AS (
  SELECT run_id, run_id || ':' || analyzer AS execution_id, analyzer, origin, confidence, kind, stable_key, name, owner_key, symbol, threshold,
    source_key, target_key, edge_kind, doc_key, stable_key AS fact_id, line_number
  FROM b_fact_raw
),
b_shape AS (
  SELECT execution_id, fact_id, source_key, target_key, owner_key, CASE WHEN doc_key % 53 = 1 THEN '2.0' ELSE '1.0' END AS contract_version,
    CAST(doc_key % 40 AS INTEGER) AS evidence_count, CASE WHEN doc_key % 59 = 2 THEN 1.5 ELSE confidence END AS confidence,
    CASE WHEN doc_key % 61 = 3 THEN repeat(stable_key, 60) WHEN doc_key % 67 = 4 THEN ' ' ELSE stable_key END AS stable_key
  FROM b_fact
),
b_line AS (
  SELECT execution_id, line_number, CAST(doc_key % 101 AS INTEGER) AS flaw,
    '{"contractVersion":"1.0","factId":' || CASE doc_key % 101 WHEN 4 THEN '7' ELSE '"' || fact_id || '"' END || ',"kind":"' || kind || '","stableKey":"' || stable_key
    || '","subject":{"kind":"S","stableKey":"s"},"properties":{' || CASE WHEN kind = 'RELATION' AND doc_key % 101 <> 7
      THEN '"sourceKey":"' || source_key || '","targetKey":"' || target_key || '","edgeKind":"' || edge_kind || '"' ELSE '"name":"' || name || '"' END
    || '},' || CASE doc_key % 101 WHEN 3 THEN '' WHEN 5 THEN '"origin":"GUESSED",' ELSE '"origin":"' || origin || '",' END || CASE doc_key % 101 WHEN 2 THEN '"more":1,' ELSE '' END
    || '"confidence":0.9,"evidence":[{"filePath":"a","startLine":1,"startColumn":1,"endLine":1,"endColumn":1,"snippetHash":"sha256:'
    || CASE doc_key % 101 WHEN 6 THEN 'none' ELSE {sha256}(fact_id{sha256_arg}) END || '"}]}' || CASE doc_key % 101 WHEN 1 THEN '}' ELSE '' END AS raw
  FROM b_fact
),
b_rule AS (
  SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'AUTHORIZATION_RULE' WHEN 1 THEN 'TECHNICAL_GUARD' WHEN 2 THEN 'VALIDATION_RULE' WHEN 3 THEN 'BUSINESS_RULE' ELSE 'CONDITION' END AS kind,
    CAST(o_orderkey % 5 AS INTEGER) AS cond, CAST(o_orderkey % 4 AS INTEGER) AS outcome, o_orderkey % 7 = 0 AS entered, CAST(o_orderkey % 3 AS INTEGER) AS vocabulary,
    o_orderkey % 11 = 0 AS writes, CAST(o_orderkey % 13 % 5 AS INTEGER) AS ambiguities, o_orderkey % 17 = 0 AS typed FROM orders
),
b_exec AS (
  SELECT o_orderkey AS execution_id, 'R' || (o_orderkey % 200) AS run_id, 'org' || (o_custkey % 25) AS org_id, 'p' || (o_custkey % 40) AS project_id,
    CASE WHEN o_orderkey % 10 = 0 THEN 10 ELSE 0 END AS exit_code, CASE o_orderstatus WHEN 'P' THEN 'PARTIALLY_SUCCEEDED' ELSE 'SUCCEEDED' END AS manifest_status,
    CASE WHEN o_orderkey % 17 = 0 THEN 'other' ELSE 'java' END AS analyzer_id, CASE WHEN o_orderkey % 19 = 0 THEN 'd2' ELSE 'd1' END AS digest,
    CAST(o_orderkey % 30 AS INTEGER) AS files_discovered, CAST(o_orderkey % 30 - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS files_parsed,
    CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS files_failed, CAST(o_orderkey % 4 AS INTEGER) AS asked, CAST(o_orderkey % 3 AS INTEGER) AS done,
    CASE WHEN o_orderkey % 23 = 0 THEN 'ERROR' WHEN o_orderkey % 5 = 0 THEN 'WARNING' END AS severity, o_orderdate AS created_at, o_custkey AS k
  FROM orders
),
b_raw_span AS (
  SELECT event_id, CASE WHEN event_id % 31 = 1 THEN '00000000000000000000000000000000' WHEN event_id % 31 = 2 THEN 'xyz' ELSE md5('t' || user_id) END AS trace_id,
    CASE WHEN event_id % 37 = 1 THEN 'short' ELSE substr(md5('s' || event_id), 1, 16) END AS span_id,
    CASE WHEN event_id % 41 = 1 THEN substr(md5('s' || event_id), 1, 16) WHEN event_id % 41 = 2 THEN '0000000000000000' WHEN event_id % 2 = 0 THEN substr(md5('p' || event_id), 1, 16) END AS parent_span_id,
    CASE WHEN event_id % 43 = 1 THEN ' ' ELSE event_type END AS name, CASE WHEN event_id % 47 = 1 THEN '18446744073709551616' ELSE CAST(1000 + event_id AS STRING) END AS start_nanos,
    CASE WHEN event_id % 53 = 1 THEN '999' ELSE CAST(2000 + event_id AS STRING) END AS end_nanos,
    CASE event_id % 59 WHEN 1 THEN 'SPAN_KIND_SERVER' WHEN 2 THEN '9' WHEN 3 THEN 'ODD' ELSE '1' END AS kind,
    CASE event_id % 61 WHEN 1 THEN 'STATUS_CODE_ERROR' WHEN 2 THEN '7' END AS status, CAST(event_id % 67 * 2 AS INTEGER) AS n_events, CAST(event_id % 71 * 2 AS INTEGER) AS n_links
  FROM events
),
b_step AS (
  SELECT 'order:' || l_orderkey AS scenario_key, 'part:' || l_partkey || ':' || l_linenumber AS stable_key, CASE WHEN l_returnflag = 'A' THEN 'DATABASE_READ' WHEN l_returnflag = 'N' THEN 'METHOD' ELSE 'VALIDATION_RULE' END AS kind,
    'src/' || CASE l_linenumber % 5 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'repository' WHEN 3 THEN 'validator' ELSE 'other' END || '/F' || (l_suppkey % 7) || '.java' AS file_path,
    CAST(l_quantity AS INTEGER) * 10 + l_linenumber AS start_line, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST({whole}l_extendedprice{whole_arg} AS BIGINT) END AS call_line, l_linenumber AS place, l_suppkey AS k
  FROM lineitem
),
b_repo AS (
  SELECT p_partkey AS k, CAST(p_partkey % 12 AS INTEGER) AS what, CASE WHEN p_partkey % 12 IN (0, 2, 3, 4, 8, 10) THEN 'c' || p_partkey ELSE 'c' || (p_partkey - p_partkey % 12) END AS component,
    CASE p_partkey % 12 WHEN 0 THEN 'c' || p_partkey || '/pom.xml' WHEN 2 THEN 'c' || p_partkey || '/package.json' WHEN 3 THEN 'c' || p_partkey || '/package.json' WHEN 4 THEN 'c' || p_partkey || '/build.gradle'
      WHEN 8 THEN 'c' || p_partkey || '/go.mod' WHEN 10 THEN 'c' || p_partkey || '/Cargo.toml' ELSE 'c' || (p_partkey - p_partkey % 12) || '/src/' || CASE p_partkey % 12 WHEN 1 THEN 'A' || p_partkey || '.java' WHEN 5 THEN 'f.py'
      WHEN 6 THEN 'migration/V1__x.sql' WHEN 7 THEN 'run' WHEN 9 THEN 'readme.md' ELSE 'x.ts' END END AS path,
    CASE p_partkey % 12 WHEN 0 THEN '<project><dependency><groupId>org.postgresql</groupId><artifactId>postgresql</artifactId></dependency></project>' WHEN 1 THEN 'import org.springframework.web.' || p_name
      WHEN 2 THEN '{"dependencies":{"react":"1","' || p_name || '":"2"},"devDependencies":{"vite":"3"}}' WHEN 3 THEN '{"dependencies":[' || p_partkey || ']' WHEN 4 THEN 'implementation "org.flywaydb:core:' || p_partkey || '"'
      WHEN 5 THEN 'from Django import x' || p_partkey WHEN 7 THEN '#!/usr/bin/env python3' || chr(10) || p_name WHEN 8 THEN 'require gorm.io/gorm v' || p_partkey ELSE 'text ' || p_partkey || ' ' || p_name END AS text
  FROM part
),
b_source AS (
  SELECT doc_id, 'docs/' || source || '/' || doc_id || '.txt' AS file_path, text, {lines} AS lines FROM documents
),
b_cite AS (
  SELECT s.doc_id, s.file_path, s.lines, j.j, (s.doc_id * 3 + j.j) % 23 AS flaw, 1 + (s.doc_id + j.j) % {size}(s.lines) AS first_line,
    least({size}(s.lines), 1 + (s.doc_id + j.j) % {size}(s.lines) + j.j) AS last_line
  FROM b_source s CROSS JOIN (VALUES (0), (1), (2)) AS j(j) WHERE s.text IS NOT NULL
),
b_evidence AS (
  SELECT 'R1' AS run_id, 'order:' || doc_id AS fact_id, doc_id || ':' || j AS evidence_id,
    CASE flaw WHEN 1 THEN '../' || file_path WHEN 2 THEN file_path || '.gone' ELSE file_path END AS file_path,
    CAST(CASE flaw WHEN 7 THEN 0 ELSE first_line END AS INTEGER) AS start_line,
    CAST(CASE flaw WHEN 3 THEN {size}(lines) + 1 ELSE last_line END AS INTEGER) AS end_line,
    CASE flaw WHEN 6 THEN 0 ELSE 1 END AS start_column, CASE flaw WHEN 4 THEN 1000000 ELSE 1 END AS end_column,
    CASE flaw WHEN 5 THEN '' ELSE 'sha256:' END || {sha256}(CASE flaw WHEN 0 THEN 'stale text' ELSE {cited} END{sha256_arg}) AS snippet_hash
  FROM b_cite
),
b_span_once AS (
  SELECT 'R1' AS run_id, md5('t' || user_id || ':' || (event_id - event_id % 500)) AS trace_id,
    substr(md5('s' || event_id), 1, 16) AS span_id,
    substr(md5('s' || lag(event_id) OVER (PARTITION BY user_id, event_id - event_id % 500 ORDER BY event_id)), 1, 16) AS parent_span_id,
    event_type AS name, CAST(1704067200000000000 + event_id * 1000000000 AS DECIMAL(20,0)) AS start_nanos, value,
    CASE event_type WHEN 'click' THEN 'customer:' || (event_id % 100) WHEN 'view' THEN 'order:' || (event_id % 1000) END AS attr_stable_key,
    CASE event_type WHEN 'purchase' THEN 'sym::part:' || (event_id % 200) WHEN 'signup' THEN 'plain' END AS attr_symbol,
    event_id
  FROM events
),
b_span AS (
  SELECT 1 AS upload, s.* FROM b_span_once s
  UNION ALL
  SELECT 2 AS upload, run_id, trace_id, span_id, parent_span_id, CASE WHEN event_id % 230 = 0 THEN 'changed' ELSE name END,
    start_nanos, value, attr_stable_key, attr_symbol, event_id FROM b_span_once WHERE event_id % 23 = 0
),
b_review AS (
  SELECT 'R1' AS run_id, 'order:' || doc_id AS stable_key, 1 AS seq,
    CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 1 THEN 'CONFIRMED' ELSE 'NEEDS_REVIEW' END AS decision FROM labels
  UNION ALL SELECT 'R1', 'order:' || doc_id, 2, 'EDITED' FROM labels WHERE doc_id % 5 = 0
),
b_enrichment AS (
  SELECT 'R1' AS run_id, 'customer:' || conv_id AS stable_key, turn AS seq, substr(text, 1, 60) AS title, text AS description
  FROM conversations WHERE role = 'assistant'
),
b_task AS (
  SELECT event_id AS task_id, 'R' || (event_id % 20) AS run_id,
    CASE event_type WHEN 'error' THEN 'FAILED_PERMANENTLY' WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status,
    CASE WHEN event_id % 3 <> 0 THEN event_id - 1 END AS depends_on, event_id % 2 = 0 AS accept_failed, ts AS created_at, value AS seconds
  FROM events
),
b_file AS (
  SELECT page_id AS file_id, regexp_replace(url, '^https?://[^/]+/', '') AS path, html AS text FROM pages
),
b_searched AS (
  SELECT 'customer:' || c_custkey AS stable_key, CASE c_custkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'Delete' END AS method,
    '/' || c_mktsegment || CASE c_custkey % 5 WHEN 0 THEN '/cameras' WHEN 1 THEN '/live/stream' ELSE '/items' END AS path, c_name || ' ' || n_name AS label,
    'org.nation.' || n_name || CASE WHEN c_custkey % 7 = 0 THEN 'AuthController' ELSE 'Controller' END AS owner_key, p_name AS title, text AS description
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN part ON p_partkey = c_custkey LEFT JOIN documents ON doc_id = c_custkey
),
b_asked AS (
  SELECT item_id * 4 AS query_id, split_part(split_part(text, chr(10), 1), '.', 1) AS text FROM benchmark
  UNION ALL SELECT CAST(n_nationkey * 4 + 1 AS BIGINT), n_name || ' Видеопоток, Удалить' FROM nation
  UNION ALL SELECT CAST(n_nationkey * 4 + 2 AS BIGINT), ' камер auth ' || n_name || '; камер' FROM nation
  UNION ALL SELECT CAST(row_number() OVER (ORDER BY p_name) * 4 + 3 AS BIGINT), p_name FROM (SELECT DISTINCT p_name FROM part)
)
"""


#: What the two engines call by other names.  DuckDB's casts to whole numbers round to even, Spark's cut.
SPARK = {"whole": "rint(", "whole_arg": ")", "sha256": "sha2", "sha256_arg": ", 256", "lines": r"split(text, '\n')", "size": "size", "cited": r"array_join(slice(lines, first_line, last_line - first_line + 1), '\n')"}
DUCKDB = {"whole": "", "whole_arg": "", "sha256": "sha256", "sha256_arg": "", "lines": "string_split(text, chr(10))", "size": "len", "cited": "array_to_string(list_slice(lines, first_line, last_line), chr(10))"}


#: Views that Spark builds otherwise, with the same rows: relations are made distinct while they are numbers, before they
#: become text.
NARROW = {
    "b_relation": """SELECT 'order:' || l_orderkey AS source_key, 'part:' || l_partkey AS target_key,
    CASE flag WHEN 8 THEN 'READS' WHEN 9 THEN 'CALLS' ELSE 'WRITES' END AS edge_kind, l_orderkey AS k, (l_orderkey * 100000000 + l_partkey) * 16 + flag AS line
  FROM (SELECT DISTINCT l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 8 WHEN 'N' THEN 9 ELSE 10 END AS flag FROM lineitem)
  UNION ALL
  SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'READS', l_partkey, (l_partkey * 100000000 + l_suppkey) * 16 + 11
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1)"""
}


def _sql(words: dict[str, str]) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: words[m[1]], VIEWS.strip())


def duckdb(query: str) -> str:
    """A query over the views, for DuckDB."""
    rest = query.strip()
    return _sql(DUCKDB) + (",\n" + rest[5:] if rest[:5].upper() == "WITH " else "\n" + rest)


def _views() -> list[tuple[str, str]]:
    found = re.split(r"(?:^WITH |^)(b_\w+) AS \(\n", _sql(SPARK), flags=re.MULTILINE)
    return [(name, re.sub(r"\n\),?\s*$", "", body)) for name, body in zip(found[1::2], found[2::2], strict=True)]


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views by name.  They are named after the folder in the catalog, so that two folders do not mix."""
    mark = re.sub(r"\W", "_", sf_dir)
    names = {t: f"{t}__{mark}" for t in TABLES}
    for t, n in names.items():
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(n)
    out = {}
    for name, body in _views():
        body = NARROW.get(name, body)
        for t, n in names.items():
            body = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {n}", body)
        df = spark.sql(body)
        names[name] = f"{name}__{mark}"
        df.createOrReplaceTempView(names[name])
        out[name] = df
    return out
