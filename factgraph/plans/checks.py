"""Queries of validation, sources and scalar functions, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import semantics as S
from factgraph.operators import enrich, validate
from factgraph.operators.reach import shared_folder
from factgraph.plans.base import query
from factgraph.plans.tables import Tables
from factgraph.sources import corpus, facts, outputs

#: The reason against each raw line, by DuckDB's own JSON functions.
LINE_REASON = """WITH q_line AS (
  SELECT execution_id, line_number, raw, CASE WHEN json_valid(raw) THEN raw END AS j FROM b_line
), q_judged AS (
  SELECT execution_id, line_number, raw, CASE WHEN j IS NULL THEN 'INVALID_JSON'
    WHEN list_sort(json_keys(j)) <> ['confidence', 'contractVersion', 'evidence', 'factId', 'kind', 'origin', 'properties', 'stableKey', 'subject'] THEN 'SCHEMA_VALIDATION_FAILED'
    WHEN json_type(j, '$.factId') <> 'VARCHAR' OR NOT (json_extract_string(j, '$.origin') IN ('STATIC_EXACT', 'STATIC_TYPED', 'STATIC_SYNTAX')) THEN 'SCHEMA_VALIDATION_FAILED'
    WHEN NOT regexp_full_match(json_extract_string(j, '$.evidence[0].snippetHash'), 'sha256:[0-9a-f]{64}') THEN 'SCHEMA_VALIDATION_FAILED'
    WHEN json_extract_string(j, '$.kind') = 'RELATION' AND json_extract_string(j, '$.properties.sourceKey') IS NULL THEN 'SCHEMA_VALIDATION_FAILED' END AS reason FROM q_line
)"""


def _lines(t: Tables) -> DataFrame:
    return t.b_line.select("execution_id", "line_number", "raw", F.lit(False).alias("oversized"), F.lit(False).alias("invalid_utf8"))


@query(LINE_REASON + " SELECT execution_id, line_number, coalesce(reason, 'OK') AS reason FROM q_judged")
def val1_fact_schema(t: Tables) -> DataFrame:
    return validate.check_fact_schema(_lines(t)).select("execution_id", "line_number", F.coalesce("reason", F.lit("OK")).alias("reason"))


@query(LINE_REASON + " SELECT execution_id, line_number, reason, raw FROM q_judged WHERE reason IS NOT NULL")
def src3_quarantine_rows(t: Tables) -> DataFrame:
    return validate.quarantine_rows(validate.refused_lines(_lines(t)))


@query("SELECT sha256(raw) AS line, count(*) AS n FROM b_line GROUP BY 1")
def src1_read_fact_lines(t: Tables) -> DataFrame:
    """Lines written as files and read again: each is there, once, with a number of its own in its file."""
    path = f"{shared_folder(t.spark)}/lines-{uuid.uuid4().hex}"
    t.b_line.select("raw").write.option("compression", "gzip").text(path)
    read = facts.read_fact_lines(t.spark, path).where("NOT oversized AND NOT invalid_utf8")
    # a line goes on as the bytes of its hash: its text, an order of magnitude longer, is not shuffled; rows are dealt once, by this
    # hash, so that what a file has under a number is made distinct where it is counted
    one = read.select(F.unhex(F.sha2("raw", 256)).alias("hash"), F.xxhash64("execution").alias("file"), "line_number").repartition("hash").dropDuplicates()
    return one.groupBy("hash").agg(F.count("*").alias("n")).select(F.lower(F.hex("hash")).alias("line"), "n")


@query("SELECT DISTINCT run_id, fact_id FROM b_fact")
def src2_append_new(t: Tables) -> DataFrame:
    """Facts appended twice are there once."""
    path = f"{shared_folder(t.spark)}/appended-{uuid.uuid4().hex}"
    for half in (t.facts.where("analyzer = 'alpha'"), t.facts):
        facts.append_new(half.select("run_id", "fact_id"), path, ["run_id", "fact_id"])
    return t.spark.read.parquet(path).select("run_id", "fact_id")


@query("SELECT event_id AS sequence FROM events WHERE user_id = 7 AND event_id > 100 ORDER BY 1 LIMIT 50")
def src8_replay_events(t: Tables) -> DataFrame:
    log = t.table("events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("sequence"))
    return facts.replay_events(log, "7", 100, 50).select("sequence")


@query("""WITH q AS (SELECT trace_id, span_id, event_id, name FROM b_raw_span WHERE event_id % 100 <> 5)
SELECT span_id, trace_id, name, 'svc' AS scope_name, '{"k":' || event_id || '}' AS attributes FROM q""")
def src4_read_otlp(t: Tables) -> DataFrame:
    """One payload for each event, of which every hundredth is broken; spans with their scope and attributes."""
    path = f"{shared_folder(t.spark)}/otlp-{uuid.uuid4().hex}"
    attribute = F.concat(F.lit('{"key":"k","value":{"intValue":"'), F.col("event_id"), F.lit('"}}'))
    span = F.concat(F.lit('{"traceId":"'), F.col("trace_id"), F.lit('","spanId":"'), F.col("span_id"), F.lit('","name":"'), F.col("name"), F.lit('","attributes":['), attribute, F.lit("]}"))
    payload = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"scope":{"name":"svc"},"spans":['), span, F.lit("]}]}]}"))
    broken = F.when(F.col("event_id") % 100 == 5, F.concat(payload, F.lit("}"))).otherwise(payload)
    t.b_raw_span.select(broken).write.text(path)
    spans, _ = facts.parse_otlp(t.spark.read.text(path).select(F.lit("u").alias("upload"), F.col("value").alias("payload")))
    return spans.select("span_id", "trace_id", "name", "scope_name", validate.normalize_otlp_attributes("attributes").alias("attributes"))


@query("SELECT CASE event_id % 5 WHEN 1 THEN 'DUPLICATE_KEY' WHEN 2 THEN 'INVALID_JSON' WHEN 3 THEN 'TOO_DEEP' WHEN 4 THEN 'STRING_TOO_LONG' ELSE 'OK' END AS reason, count(*) AS n FROM events GROUP BY 1")
def val12_strict_json(t: Tables) -> DataFrame:
    n = F.col("event_id") % 5
    deep = F.concat(F.lit('{"a":'), F.lit("[" * 40), F.col("event_id"), F.lit("]" * 40 + "}"))
    long = F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 17000), F.lit('"}'))
    text = F.when(n == 1, F.concat(F.lit('{"a":1,"a":'), F.col("event_id"), F.lit("}"))).when(n == 2, F.concat(F.col("props"), F.lit(" x"))).when(n == 3, deep).when(n == 4, long).otherwise(F.col("props"))
    judged = t.table("events").select(F.coalesce(validate.strict_json(text), F.lit("OK")).alias("reason"))
    return judged.groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"n":' || event_id || ',"t":"' || event_type || '"}' WHEN 1 THEN '{"l":["' || event_type || '",true]}' END AS attributes FROM events""")
def val11_normalize_attributes(t: Tables) -> DataFrame:
    c, n = F.col, F.col("event_id") % 4
    good = F.concat(F.lit('[{"key":"t","value":{"stringValue":"'), c("event_type"), F.lit('"}},{"key":"n","value":{"intValue":"'), c("event_id"), F.lit('"}}]'))
    nested = F.concat(F.lit('[{"key":"l","value":{"arrayValue":{"values":[{"stringValue":"'), c("event_type"), F.lit('"},{"boolValue":true}]}}}]'))
    twice = F.concat(F.lit('[{"key":"k","value":{"intValue":"1","stringValue":"'), c("event_type"), F.lit('"}}]'))
    part = F.concat(F.lit('[{"key":"k","value":{"intValue":"'), c("event_id"), F.lit('.5"}}]'))
    items = F.when(n == 0, good).when(n == 1, nested).when(n == 2, twice).otherwise(part)
    return t.table("events").select("event_id", validate.normalize_otlp_attributes(items).alias("attributes"))


@query("""SELECT event_id, CASE WHEN NOT regexp_full_match(trace_id, '[0-9a-f]{32}') OR regexp_full_match(trace_id, '0+') THEN 'INVALID_TRACE_ID' WHEN NOT regexp_full_match(span_id, '[0-9a-f]{16}') THEN 'INVALID_SPAN_ID'
  WHEN parent_span_id = span_id THEN 'INVALID_PARENT_SPAN_ID' WHEN CAST(start_nanos AS HUGEINT) > 18446744073709551615 THEN 'INVALID_NANOS' WHEN CAST(end_nanos AS HUGEINT) < CAST(start_nanos AS HUGEINT) THEN 'END_BEFORE_START'
  WHEN trim(name) = '' THEN 'INVALID_NAME' WHEN kind IN ('9', 'ODD') THEN 'INVALID_KIND' WHEN status = '7' THEN 'INVALID_STATUS' WHEN n_events > 128 OR n_links > 128 THEN 'TOO_MANY_EVENTS' ELSE 'OK' END AS reason,
  CASE kind WHEN 'SPAN_KIND_SERVER' THEN 2 WHEN '9' THEN 9 WHEN '1' THEN 1 END AS kind, CASE WHEN regexp_full_match(parent_span_id, '0+') THEN NULL ELSE parent_span_id END AS parent_span_id FROM b_raw_span""")
def val10_check_span(t: Tables) -> DataFrame:
    return validate.check_span(t.b_raw_span).select("event_id", F.coalesce("reason", F.lit("OK")).alias("reason"), "kind", "parent_span_id")


EXEC_STATUS = """CASE WHEN analyzer_id = 'other' THEN 'ANALYZER_IDENTITY_MISMATCH' WHEN digest = 'd2' THEN 'ANALYZER_DIGEST_MISMATCH'
  WHEN files_parsed + files_failed > files_discovered OR least(files_discovered, files_parsed, files_failed) < 0 THEN 'INCONSISTENT_ANALYZER_COVERAGE' END"""


@query(f"""SELECT execution_id, {EXEC_STATUS} AS error, CASE WHEN {EXEC_STATUS} IS NULL THEN CASE WHEN exit_code = 10 OR manifest_status <> 'SUCCEEDED' OR done < asked OR files_failed > 0 OR files_parsed < files_discovered OR severity = 'ERROR'
  THEN 'PARTIALLY_SUCCEEDED' ELSE 'SUCCEEDED' END END AS status FROM b_exec""")
def val8_execution_status(t: Tables) -> DataFrame:
    return validate.derive_execution_status(_executions(t)).select("execution_id", "error", "status")


def _executions(t: Tables) -> DataFrame:
    """b_exec with lists: capabilities c1, c2, ... asked for, of which the first `done` were completed, and diagnostics."""
    cap = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("c"), i))
    none = F.array().cast("array<string>")
    told = F.when(F.col("severity").isNotNull(), F.array(F.struct(F.lit("D1").alias("code"), F.col("severity").alias("severity"), F.lit("text").alias("message"))))
    capabilities = F.array(F.struct(F.lit("c1").alias("name"), F.lit("COMPLETED").alias("status")))
    return t.b_exec.select(
        "*", F.slice(cap, 1, F.col("asked")).alias("requested"), F.slice(cap, 1, F.col("done")).alias("completed"), none.alias("capabilities_partial"),
        F.slice(cap, F.col("done") + 1, F.greatest(F.col("asked") - F.col("done"), F.lit(0))).alias("capabilities_failed"), capabilities.alias("capabilities"),
        F.coalesce(told, F.array().cast("array<struct<code:string,severity:string,message:string>>")).alias("diagnostics"), F.lit("java").alias("expected_id"), F.lit("d1").alias("expected_digest"),
    )


@query("SELECT execution_id, 'c' || i AS capability FROM b_exec, range(1, 5) r(i) WHERE i <= asked AND i > done")
def val9_missing_capabilities(t: Tables) -> DataFrame:
    return validate.missing_capabilities(_executions(t)).select("execution_id", "capability")


@query("SELECT DISTINCT run_id FROM b_run WHERE run_id IN (SELECT run_id FROM b_fact WHERE kind = 'ENDPOINT')")
def val7_sealed_runs(t: Tables) -> DataFrame:
    asked = t.b_run.select("run_id").union(t.b_run.select(F.lit("R3")))
    return validate.sealed_runs(asked, t.nodes).distinct()


REVIEW = """WITH q_node AS (SELECT DISTINCT stable_key FROM b_entity WHERE kind = 'ENDPOINT' OR src = 'orders'),
q_last AS (SELECT stable_key, CASE WHEN stable_key LIKE '%3' THEN 'MERGED' WHEN stable_key LIKE '%4' THEN 'REJECTED' ELSE 'UNREVIEWED' END AS decision,
  CASE WHEN stable_key LIKE '%3' THEN substr(stable_key, 1, length(stable_key) - 1) || '5' END AS target_key FROM q_node),
q_new AS (SELECT 'order:' || doc_id AS stable_key, CASE doc_id % 7 WHEN 0 THEN 'ODD' WHEN 1 THEN 'EDITED' WHEN 2 THEN 'CONFIRMED' ELSE 'MERGED' END AS decision,
  CASE WHEN quality = 1 THEN 'a title' ELSE ' ' END AS title, CASE doc_id % 7 WHEN 3 THEN 'order:' || doc_id WHEN 4 THEN 'nobody' ELSE 'order:' || (doc_id + 1) END AS target_key FROM labels)"""


@query(REVIEW + """ SELECT n.stable_key, CASE WHEN n.decision = 'ODD' THEN 'INVALID_DECISION' WHEN n.decision = 'EDITED' AND trim(title) = '' THEN 'EDIT_NEEDS_TEXT' WHEN n.decision <> 'MERGED' THEN 'OK' WHEN n.target_key = n.stable_key THEN 'MERGE_TARGET_REQUIRED'
  WHEN l.stable_key IS NULL THEN 'MERGE_TARGET_NOT_FOUND' WHEN l.decision IN ('MERGED', 'REJECTED') THEN 'MERGE_TARGET_NOT_ACTIVE' WHEN n.stable_key IN (SELECT target_key FROM q_last WHERE decision = 'MERGED') THEN 'NODE_IS_MERGE_TARGET' ELSE 'OK' END AS reason
FROM q_new n LEFT JOIN q_last l ON l.stable_key = n.target_key""")
def val13_check_review(t: Tables) -> DataFrame:
    c, key, n = F.col, F.col("stable_key"), F.col("doc_id") % 7
    node = t.b_entity.where("kind = 'ENDPOINT' OR src = 'orders'").select("stable_key").distinct()
    decision = F.when(key.endswith("3"), "MERGED").when(key.endswith("4"), "REJECTED").otherwise("UNREVIEWED")
    last = node.select(F.lit("R1").alias("run_id"), "stable_key", decision.alias("decision"), F.when(key.endswith("3"), F.regexp_replace(key, ".$", "5")).alias("target_key"))
    made = t.table("labels").select(
        F.lit("R1").alias("run_id"), F.concat(F.lit("order:"), c("doc_id")).alias("stable_key"), F.when(n == 0, "ODD").when(n == 1, "EDITED").when(n == 2, "CONFIRMED").otherwise("MERGED").alias("decision"),
        F.when(c("quality") == 1, "a title").otherwise(" ").alias("title"), F.lit(None).cast("string").alias("description"),
        F.when(n == 3, F.concat(F.lit("order:"), c("doc_id"))).when(n == 4, "nobody").otherwise(F.concat(F.lit("order:"), c("doc_id") + 1)).alias("target_key"),
    )
    return validate.check_review(made, last).select("stable_key", F.coalesce("reason", F.lit("OK")).alias("reason"))


# --- scalar functions


@query("""SELECT event_id, 'sha256:' || sha256('{"a":' || event_id || ',"z":{"b":[1,2],"k":"' || event_type || '"}}') AS hash FROM events""")
def fn2_content_hash(t: Tables) -> DataFrame:
    text = F.concat(F.lit('{ "z": {"k":"'), F.col("event_type"), F.lit('", "b":[1, 2]}, "a": '), F.col("event_id"), F.lit("}"))
    return t.table("events").select("event_id", S.content_hash(text).alias("hash"))


@query("SELECT o_orderkey, list_sort(list_distinct([o_orderstatus, o_orderpriority] || CASE WHEN o_orderkey % 2 = 0 THEN [o_orderstatus, 'x'] ELSE [] END)) AS items FROM orders")
def fn10_list_union(t: Tables) -> DataFrame:
    more = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus", F.lit("x")))
    return t.table("orders").select("o_orderkey", F.array_sort(S.list_union(F.array("o_orderstatus", "o_orderpriority"), more)).alias("items"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode('{"name":"n","text":"' || t || '"}')) <= 600 THEN '{"name":"n","text":"' || t || '"}' ELSE '{"name":"n"}' END AS slim
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g') AS t FROM documents)""")
def fn12_slim_properties(t: Tables) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", "")
    props = F.concat(F.lit('{"text":"'), text, F.lit('","name":"n","factAlternatives":[1]}'))
    return t.table("documents").select("doc_id", S.slim_properties(props, 600).alias("slim"))


@query("SELECT p_partkey, 'C' || p_partkey AS owner, 'a.b' AS package FROM part")
def fn13_owner_name(t: Tables) -> DataFrame:
    key = F.concat(F.lit("java:a.b.C"), F.col("p_partkey"))
    return t.table("part").select("p_partkey", S.owner_name(key).alias("owner"), S.owner_package(key).alias("package"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'public class A' || doc_id || ' {' WHEN doc_id % 3 = 1 THEN 'void m' || doc_id || '()' ELSE trim(split_part(text, chr(10), 1), ' ') END AS declaration FROM documents WHERE text IS NOT NULL""")
def fn14_declaration_of(t: Tables) -> DataFrame:
    n, i = F.col("doc_id") % 3, F.col("doc_id")
    typed = F.concat(F.lit("@Entity\n  public class A"), i, F.lit(" {\n int x; }"))
    body = F.concat(F.lit("void m"), i, F.lit("() { return; }"))
    snippet = F.when(n == 0, typed).when(n == 1, body).otherwise(F.regexp_replace("text", r"\{", ""))
    kind = F.when(n == 0, "CLASS").otherwise("METHOD")
    return t.table("documents").where("text IS NOT NULL").select("doc_id", S.declaration_of(kind, snippet).alias("declaration"))


@query("""SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT c_custkey, md5(c_name || ':return') AS h FROM customer)""")
def fn15_return_node_id(t: Tables) -> DataFrame:
    return t.table("customer").select("c_custkey", S.return_node_id(F.col("c_name")).alias("id"))


@query("""SELECT stable_key, CASE WHEN contains(lower(kind || ' ' || name), 'urgent') THEN 'Handle at once' WHEN kind = 'CONDITION' THEN 'Check' ELSE name END AS title FROM b_entity""")
def fn16_business_label(t: Tables) -> DataFrame:
    nodes = t.b_entity.select("stable_key", "kind", F.col("name").alias("label"), F.lit(None).cast("string").alias("title"))
    return enrich.business_label(nodes, [("urgent", "Handle at once", "s"), ("^condition ", "Check", "s")]).select("stable_key", "title")


@query("""SELECT o_orderkey, CASE WHEN m = 'GET' AND detail THEN 'Order details' WHEN m = 'GET' THEN 'List of orders' WHEN m = 'POST' THEN 'Create: order' WHEN m = 'DELETE' THEN 'Delete: order' ELSE 'Update: order' END AS title
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'DELETE' ELSE 'PATCH' END AS m, o_orderkey % 3 = 0 AS detail FROM orders) WHERE o_orderkey % 5 > 1
UNION ALL SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Place the order' ELSE 'Look up by name' END FROM orders WHERE o_orderkey % 5 <= 1""")
def fn17_endpoint_title(t: Tables) -> DataFrame:
    c, k = F.col, F.col("o_orderkey")
    verb = F.when(k % 4 == 0, "GET").when(k % 4 == 1, "POST").when(k % 4 == 2, "DELETE").otherwise("PATCH")
    path = F.when(k % 3 == 0, "/api/v1/orders/{id}").otherwise("/api/v1/orders")
    rows = t.table("orders").select("o_orderkey", verb.alias("method"), path.alias("path"), F.when(k % 5 == 1, "findByName").alias("method_name"), F.when(k % 5 == 0, "Place the order").when(k % 5 == 2, "missing required field x").alias("title"))
    names = {"findByName": "Look up by name"}
    return rows.select("o_orderkey", enrich.endpoint_title(c("title"), c("method"), c("path"), c("method_name"), methods=names, entities={"orders": ("order", "orders")}).alias("title"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(text, '(authorization\\s*[:=]\\s*)(bearer|basic)?\\s*\\S+', '\\1[REDACTED]', 'gi'), '((?:password|secret|api[-_]?key|token)\\s*[:=]\\s*)\\S+', '\\1[REDACTED]', 'gi') AS text FROM documents""")
def fn18_redact_secrets(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", S.redact_secrets(F.col("text")).alias("text"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'DATABASE' WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN 'BACKEND' WHEN s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0 THEN 'FRONTEND' END AS layer FROM supplier")
def fn19_source_layer(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    used = F.array_compact(F.array(F.when(k % 2 == 0, "spring"), F.when(k % 3 == 0, "react"), F.lit("junit")))
    return t.table("supplier").select("s_suppkey", S.source_layer(used, F.when(k % 5 == 0, "DATABASE_DERIVED").otherwise("STATIC_EXACT")).alias("layer"))


# --- extractors


@query("""SELECT DISTINCT doc_id, w AS stable_key, sha256(w) AS fact_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS w FROM documents)""")
def udf1_extract_facts(t: Tables) -> DataFrame:
    """Capitalized words as facts of each document."""
    files = t.table("documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return facts.extract_facts(files, _capitalized).select(F.col("path").cast("bigint").alias("doc_id"), "stable_key", "fact_id")


def _capitalized(path: str, text: str) -> list[dict]:
    import re

    return [{"kind": "WORD", "stable_key": m[0], "properties": "{}", "start": m.start(), "end": m.end()} for m in re.finditer("[A-Z][a-z]+", text)]


@query("""SELECT doc_id, 1 + length(head) - length(replace(head, chr(10), '')) AS start_line, 'sha256:' || sha256(lines[1 + length(head) - length(replace(head, chr(10), ''))]) AS snippet_hash
FROM (SELECT doc_id, lines, substr(text, 1, strpos(text, w) - 1) AS head FROM (SELECT doc_id, lines, text, regexp_extract(text, '[A-Z][a-z]+') AS w FROM b_source) WHERE w <> '')""")
def udf2_make_evidence(t: Tables) -> DataFrame:
    """The line of each document's first capitalized word."""
    w = F.regexp_extract("text", "([A-Z][a-z]+)", 1)
    at = F.expr("locate(regexp_extract(text, '([A-Z][a-z]+)', 1), text)") - 1
    found = t.b_source.where(w != "").select(F.col("doc_id").alias("path"), at.alias("start"), (at + F.length(w)).alias("end"))
    files = t.b_source.select(F.col("doc_id").alias("path"), "text")
    return facts.make_evidence(found, files).select(F.col("path").alias("doc_id"), F.col("start_line").cast("long").alias("start_line"), "snippet_hash")


# --- corpora


@query("SELECT path FROM b_file WHERE (path NOT LIKE 'en/%' OR path LIKE 'en/1%') AND NOT regexp_matches(path, '(^|/)(target|build|dist)(/|$)')")
def src6_ignore_filter(t: Tables) -> DataFrame:
    return corpus.ignore_filter(t.b_file.select("path"), ["en/**", "!en/1*"]).select("path")


class SameFirstWord:
    """An extractor that needs several files: each file follows the last one of its component that has its first word."""

    def __init__(self):
        self.last, self.n = {}, 0

    def file(self, path: str, text: str):
        self.n += 1
        word = text.split(" ", 1)[0]
        if word in self.last:
            yield {"kind": "RELATION", "stable_key": f"{self.last[word]}->{path}", "properties": word}
        self.last[word] = path

    def end(self):
        yield {"kind": "COMPONENT", "stable_key": "files", "properties": str(self.n)}


@query("""WITH q AS (SELECT source AS component, lpad(doc_id::VARCHAR, 12, '0') AS path, split_part(coalesce(text, ''), ' ', 1) AS word FROM documents)
SELECT component, path, 'RELATION' AS kind, before || '->' || path AS stable_key, word AS properties FROM (SELECT *, lag(path) OVER (PARTITION BY component, word ORDER BY path) AS before FROM q) WHERE before IS NOT NULL
UNION ALL SELECT component, NULL, 'COMPONENT', 'files', count(*)::VARCHAR FROM q GROUP BY component""")
def udf1_component_facts(t: Tables) -> DataFrame:
    """Documents as files, their sources as components."""
    files = t.table("documents").select(F.col("source").alias("component"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "text")
    return facts.extract_component_facts(files, SameFirstWord).drop("fact_id")


# --- files of a corpus


def _on_disk(t: Tables, root: str) -> bool:
    """Whether tasks may write files below root themselves: it is a folder of the local or of a mounted file system."""
    return root.startswith("file:") or ("://" not in root and t.spark.conf.get("spark.hadoop.fs.defaultFS", "file:///").startswith("file:"))


@query("""WITH q AS (SELECT 'doc=' || doc_id AS path, octet_length(encode(coalesce(text, ''))) + 1 + CASE WHEN doc_id % 50 = 3 THEN 1 ELSE 0 END AS bytes, doc_id % 50 = 3 AS nul FROM documents),
q_c AS (SELECT *, row_number() OVER w AS n, sum(bytes) OVER w AS b FROM q WHERE bytes <= 5000 AND NOT nul WINDOW w AS (ORDER BY sha256(path)))
SELECT path, bytes, CASE WHEN n > 150 THEN 'FILES_LIMIT' WHEN b > 60000 THEN 'BYTES_LIMIT' ELSE 'kept' END AS verdict, n AS files_so_far, CAST(b AS BIGINT) AS bytes_so_far FROM q_c
UNION ALL SELECT path, bytes, CASE WHEN bytes > 5000 THEN 'FILE_SIZE_LIMIT' ELSE 'BINARY' END, NULL, NULL FROM q WHERE bytes > 5000 OR nul""")
def src5_read_corpus(t: Tables) -> DataFrame:
    """Documents written as a file each, one in fifty with a NUL byte, read again within limits."""
    k = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(k % 50 == 3, F.lit("\x00")).otherwise(""))
    root = f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"
    if not _on_disk(t, root):
        t.table("documents").select(k.alias("doc"), text.alias("value")).repartition("doc").write.partitionBy("doc").text(root)
    else:
        # dealt into folders, so that they are listed side by side
        place = F.concat(F.lit("part"), F.pmod(F.hash(k), F.lit(256)), F.lit("/doc="), k)
        rows = t.table("documents").select(place.alias("path"), F.concat(text, F.lit("\n")).cast("binary").alias("content"))
        corpus.write_files(rows.repartition("path"), root)
    files = corpus.read_files(t.spark, root)
    # what follows a document's number is not its path: Spark names the file of a folder anew on each run
    named = F.regexp_extract("path", r"(doc=-?\d+)(/[^/]*)?$", 1)
    return corpus.corpus_verdicts(files.withColumn("path", named), file_bytes=5000, files_most=150, bytes_most=60_000)


# --- documents of executions


@query("""WITH q AS (SELECT s_suppkey AS k, s_suppkey % 23 AS flaw, s_suppkey % 7 AS parsed FROM supplier)
SELECT CAST(k AS VARCHAR) AS execution_id, CASE flaw WHEN 1 THEN 'ANALYZER_EXECUTION_FAILED' WHEN 2 THEN 'MISSING_ANALYZER_OUTPUT' WHEN 3 THEN 'DOUBLED_ANALYZER_OUTPUT' WHEN 4 THEN 'INVALID_ANALYZER_MANIFEST' WHEN 5 THEN 'INVALID_ANALYZER_COVERAGE'
  WHEN 6 THEN 'INVALID_ANALYZER_STATISTICS' WHEN 7 THEN 'ANALYZER_IDENTITY_MISMATCH' WHEN 8 THEN 'ANALYZER_DIGEST_MISMATCH' WHEN 9 THEN 'ANALYZER_EXECUTION_FAILED' WHEN 10 THEN 'INVALID_ANALYZER_DIAGNOSTIC' WHEN 11 THEN 'INCONSISTENT_ANALYZER_COVERAGE' WHEN 12 THEN 'ANALYZER_METADATA_LIMIT' WHEN 13 THEN 'ANALYZER_IDENTITY_MISMATCH' END AS error,
  CASE WHEN flaw BETWEEN 1 AND 13 THEN NULL WHEN flaw IN (14, 15, 16) OR parsed < 6 THEN 'PARTIALLY_SUCCEEDED' ELSE 'SUCCEEDED' END AS status, CASE WHEN flaw IN (0, 10, 14) THEN 2 ELSE 1 END AS n_diagnostics FROM q""")
def val8_from_documents(t: Tables) -> DataFrame:
    """Documents of an execution for each supplier, written, read again and judged; flaws by the supplier's key."""
    k = F.col("s_suppkey")
    flaw = k % 23

    def text(template: str, *values: Column) -> Column:
        return F.format_string(template, *values)

    analyzer = F.to_json(F.struct(F.when(flaw == 7, "other").otherwise("java").alias("id"), F.when(flaw == 13, "2").otherwise("1").alias("version"), F.when(flaw == 8, "d2").otherwise("d1").alias("imageDigest")))
    status = F.when(flaw == 9, "FAILED").otherwise("SUCCEEDED")
    partial = F.when(flaw == 15, '"c1"').otherwise("")
    manifest = F.when(flaw == 4, '{"status":').otherwise(text('{"analyzer":%s,"status":"%s","capabilitiesCompleted":[],"capabilitiesPartial":[%s],"capabilitiesFailed":[],"factCount":1,"diagnosticCount":1}', analyzer, status, partial))
    failed = F.when(flaw == 11, 9).otherwise(0)
    coverage = F.when(flaw == 5, '{"filesParsed":1,"filesParsed":1}').otherwise(text('{"filesDiscovered":6,"filesParsed":%d,"filesFailed":%d,"capabilities":[]%s}', k % 7, failed, F.when(flaw == 12, F.concat(F.lit(',"metadata":"'), F.repeat(F.lit("x"), 1 << 20), F.lit('"'))).otherwise("")))
    statistics = F.when(flaw == 6, '{"factCount":"many"}').otherwise('{"factCount":1,"diagnosticCount":1}')
    diagnostic = F.concat(F.lit('{"code":"D","severity":"INFO","message":"m"}\n'), F.when(flaw == 0, '{"code":"E","severity":"WARNING","message":"m"}\n').when(flaw == 10, '{"code":"E"}\n').when(flaw == 14, '{"code":"E","severity":"FATAL","message":"m"}\n').otherwise(""))
    whole = {"manifest.json": manifest, "coverage.json": coverage, "statistics.json": statistics, "diagnostics.ndjson": diagnostic, "facts.ndjson": F.lit("{}")}
    docs = F.explode(F.array(*[F.struct(F.lit(name).alias("document"), x.alias("value")) for name, x in whole.items()])).alias("d")
    # keys are dealt before there are texts, so that these are not shuffled
    rows = t.table("supplier").repartition(256, "s_suppkey").select(k.cast("string").alias("execution_id"), flaw.alias("flaw"), docs).select("execution_id", "flaw", "d.*").where("NOT (flaw = 2 AND document = 'statistics.json')")
    root = f"{shared_folder(t.spark)}/outputs-{uuid.uuid4().hex}"
    doubled = "flaw = 3 AND document = 'coverage.json'"
    if _on_disk(t, root):
        # a document that comes twice lies there as a file and in a folder
        names = F.array_compact(F.array("document", F.when(F.expr(doubled), F.concat(F.lit("again="), "document", F.lit("/copy")))))
        named = rows.withColumn("name", F.explode(names))
        corpus.write_files(named.select(F.concat_ws("/", "execution_id", "name").alias("path"), F.concat("value", F.lit("\n")).cast("binary").alias("content")), root)
    else:
        for tries, chosen in enumerate((rows, rows.where(doubled))):
            chosen.drop("flaw").write.mode("append" if tries else "error").partitionBy("execution_id", "document").text(root)
    asked = t.table("supplier").select(k.cast("string").alias("execution_id"), F.when(flaw == 1, 3).when(flaw == 16, 10).otherwise(0).alias("exit_code"), F.lit("java").alias("expected_id"), F.lit("1").alias("expected_version"), F.lit("d1").alias("expected_digest"))
    return outputs.execution_results(asked, outputs.read_documents(t.spark, root), outputs.read_diagnostics(t.spark, root))
