"""Queries of enrichments, technologies and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators import enrich, reports, search
from factgraph.plans.base import query
from factgraph.plans.checks import _executions
from factgraph.plans.queries import EDGE, contained
from factgraph.plans.tables import Tables
from factgraph.sources import corpus

# --- enrichment


@query(EDGE + """, q_with AS (SELECT DISTINCT run_id, source_key FROM q_edge WHERE kind = 'CONTAINS')
SELECT n.run_id, n.stable_key, CASE WHEN w.source_key IS NULL THEN n.stable_key ELSE 'scenario:' || n.stable_key END AS target_key FROM q_node n LEFT JOIN q_with w ON w.run_id = n.run_id AND w.source_key = n.stable_key WHERE n.kind = 'ENDPOINT'""")
def en1_enrichment_targets(t: Tables) -> DataFrame:
    scenarios = contained(t).select("run_id", "entry_key", F.concat(F.lit("scenario:"), "entry_key").alias("stable_key")).distinct()
    return enrich.enrichment_targets(t.nodes.where("kind = 'ENDPOINT'"), scenarios)


HIDE = "regexp_replace(regexp_replace({}, '(authorization\\s*[:=]\\s*)(bearer|basic)?\\s*\\S+', '\\1[REDACTED]', 'gi'), '((?:password|secret|api[-_]?key|token)\\s*[:=]\\s*)\\S+', '\\1[REDACTED]', 'gi')"
CITED = """'[' || string_agg('{"evidence_id":"' || evidence_id || '","end_line":' || i || ',"path":"' || path || '","snippet":' || to_json({}) || ',"start_line":' || i || '}', ',' ORDER BY evidence_id) || ']'"""
WHOLE = """'{"evidence":' || {} || ',"factId":"' || fact_id || '","kind":"' || kind || '","properties":' || props || '}'"""


@query(f"""WITH q_f AS (SELECT * FROM (SELECT doc_id, 'n' || (doc_id - doc_id % 40) AS node_key, lpad(doc_id::VARCHAR, 12, '0') AS fact_id, CASE WHEN doc_id % 9 = 0 THEN 'BUSINESS_RULE' ELSE 'CONDITION' END AS kind, text,
  '{{"condition":"' || lang || ' token=[REDACTED]","name":"' || source || '"' || CASE doc_id % 4 WHEN 3 THEN '' ELSE ',"ownerKey":"own' || (doc_id % 4) || '"' END || '}}' AS props, row_number() OVER (PARTITION BY doc_id - doc_id % 40 ORDER BY doc_id % 9 <> 0, doc_id) AS place FROM documents) WHERE place <= 32),
q_l AS (SELECT q_f.*, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM q_f WHERE text IS NOT NULL),
q_s AS (SELECT * EXCLUDE (line), fact_id || ':' || lpad(i::VARCHAR, 9, '0') AS evidence_id, CASE WHEN doc_id % 240 = 7 THEN 'docs/.env' ELSE 'docs/' || doc_id || '.txt' END AS path,
  CASE WHEN doc_id % 4 = 0 AND NOT regexp_matches(line, '\\{{|public |private ') THEN '// in method: void run()' || chr(10) || line ELSE line END AS line FROM q_l WHERE i <= 8),
q_c AS (SELECT *, {HIDE.format("CASE WHEN length(line) > 4000 THEN substr(line, 1, 3900) || chr(10) || '// ... [snippet truncated for AI context]' ELSE line END")} AS long FROM q_s),
q_d AS (SELECT *, CASE WHEN length(long) > 1000 THEN substr(long, 1, 950) || chr(10) || '// ... [truncated]' ELSE long END AS short FROM q_c),
q_e AS (SELECT node_key, fact_id, place, kind, props, count(*) AS n, bool_or(path LIKE '%.env') AS bad, {CITED.replace("{}", "long")} AS long, {CITED.replace("{}", "short")} AS short FROM q_d GROUP BY 1, 2, 3, 4, 5),
q_g AS (SELECT node_key, fact_id, place, n, bad, {WHOLE.replace("{}", "long")} AS long, {WHOLE.replace("{}", "short")} AS short FROM q_e),
q_t AS (SELECT *, '],"fingerprint":"f","nodeId":"' || node_key || '"}}' AS tail, sum(octet_length(encode(long)) + 1) OVER (PARTITION BY node_key) - 1 AS whole FROM q_g),
q_h AS (SELECT *, CASE WHEN whole + 10 + octet_length(encode(tail)) > 48000 THEN short ELSE long END AS x FROM q_t),
q_r AS (SELECT *, row_number() OVER (PARTITION BY node_key ORDER BY place) AS k, sum(octet_length(encode(x)) + 1) OVER (PARTITION BY node_key ORDER BY place) - 1 + 10 + octet_length(encode(tail)) AS so_far, bool_or(bad) OVER (PARTITION BY node_key) AS refused FROM q_h),
q_b AS (SELECT node_key, refused, '{{"facts":[' || string_agg(x, ',' ORDER BY place) || any_value(tail) AS bundle, string_agg(fact_id, ',' ORDER BY place) AS facts, sum(n) AS n FROM q_r WHERE k <= 8 OR so_far <= 48000 GROUP BY 1, 2),
q_n AS (SELECT DISTINCT node_key FROM q_f UNION ALL SELECT 'none'),
q_o AS (SELECT node_key, bundle, facts, n, CASE WHEN node_key = 'none' THEN 'NO_FACTS' WHEN refused THEN 'PATH' WHEN octet_length(encode(bundle)) > 48000 THEN 'TOO_LARGE' END AS refusal FROM q_n LEFT JOIN q_b USING (node_key))
SELECT node_key, CASE WHEN refusal IS NULL THEN octet_length(encode(bundle)) END AS bundle_bytes, CASE WHEN refusal IS NULL THEN facts END AS fact_ids, CASE WHEN refusal IS NULL THEN CAST(n AS BIGINT) END AS n_evidence, CASE WHEN refusal IS NULL THEN sha256(bundle) END AS request_hash, refusal FROM q_o""")
def en2_evidence_bundle(t: Tables) -> DataFrame:
    """Documents as facts of nodes, their lines as evidence; some lines get an owner's declaration, some paths are refused."""
    k = F.col("doc_id")
    own = t.table("documents").select(F.lit("R1").alias("run_id"), "doc_id", F.concat(F.lit("n"), k - k % 40).alias("node_key"), F.lpad(k.cast("string"), 12, "0").alias("fact_id"), "text", "lang", "source")
    owner = F.when(k % 4 < 3, F.concat(F.lit("own"), k % 4))
    props = F.to_json(F.struct(F.lit("x").alias("hidden"), owner.alias("ownerKey"), F.concat("lang", F.lit(" token=abc")).alias("condition"), F.col("source").alias("name")))
    facts = own.select("run_id", "node_key", "fact_id", F.when(k % 9 == 0, "BUSINESS_RULE").otherwise("CONDITION").alias("kind"), props.alias("properties"))
    lines = own.select("run_id", "doc_id", "fact_id", F.posexplode(F.split("text", "\n")).alias("i", "snippet")).withColumn("i", F.col("i") + 1)
    path = F.when(k % 240 == 7, "docs/.env").otherwise(F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")))
    seen = lines.select("run_id", "fact_id", F.concat("fact_id", F.lit(":"), F.lpad(F.col("i").cast("string"), 9, "0")).alias("evidence_id"), path.alias("file_path"), F.col("i").alias("start_line"), F.col("i").alias("end_line"), "snippet")
    nodes = own.select("run_id", "node_key").distinct().union(own.agg(F.lit("R1"), F.lit("none"))).withColumn("fingerprint", F.lit("f"))
    heads = F.when(F.col("owner_key") == "own0", " void run() { token = 1 }").when(F.col("owner_key") == "own1", "no brace")
    owners = own.select("run_id", owner.alias("owner_key")).distinct().select("run_id", "owner_key", F.lit("e").alias("evidence_id"), heads.alias("snippet")).where("snippet IS NOT NULL")
    out = enrich.evidence_bundle(nodes, facts, seen, F.when(F.col("kind") == "BUSINESS_RULE", 0).otherwise(1), owners)
    return out.select("node_key", "bundle_bytes", F.array_join("fact_ids", ",").alias("fact_ids"), "n_evidence", "request_hash", "refusal")


@query("""SELECT k % 500 AS node_key, bool_or(path LIKE '%.sql' OR what = 7 OR what = 3) AS refused FROM b_repo GROUP BY 1""")
def en3_path_policy(t: Tables) -> DataFrame:
    path = F.when(F.col("what") == 7, F.concat(F.lit("../"), "path")).when(F.col("what") == 3, F.concat("path", F.lit("/.env.local"))).otherwise(F.col("path"))
    e = t.b_repo.select(F.lit("R1").alias("run_id"), (F.col("k") % 500).alias("node_key"), path.alias("file_path"))
    return enrich.path_policy(e, r"^(?!.*\.sql$).*").select("node_key", "refused")




@query("""WITH m AS (SELECT max(ts) AS m FROM events), q AS (SELECT 'h' || (user_id % 20) || event_type AS h, bool_or(event_id % 9 = 0) AS done, bool_or(event_id % 9 <> 0 AND ts >= m - INTERVAL 2 MINUTE) AS busy FROM events, m WHERE event_id % 2 = 0 GROUP BY 1)
SELECT event_id, CASE WHEN q.done THEN 'hit' WHEN q.busy THEN 'running' ELSE 'miss' END AS cache FROM events LEFT JOIN q ON q.h = 'h' || (user_id % 20) || event_type WHERE event_id % 2 = 1""")
def en4_cache_split(t: Tables) -> DataFrame:
    """Odd events ask for what even ones have made or are making."""
    e = t.table("events")
    at = e.agg(F.max("ts").alias("now"))  # one row, by its aggregate
    key = {"org_id": F.lit("o"), "provider": F.lit("p"), "model": F.lit("m"), "prompt_key": F.lit("k"), "prompt_version": F.lit(1), "request_hash": F.concat(F.lit("h"), F.col("user_id") % 20, "event_type")}
    e = e.withColumns(key).withColumn("status", F.when(F.col("event_id") % 9 == 0, "SUCCEEDED").otherwise("RUNNING")).withColumnRenamed("ts", "started_at").join(F.broadcast(at))
    return enrich.cache_split(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), F.col("now")).select("event_id", "cache")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 2 + user_id % 3 <= 20 AS granted FROM events""")
def en5_quota_reserve(t: Tables) -> DataFrame:
    r = t.table("events").select("event_id", F.col("user_id").alias("org_id"), F.lit("d").alias("day"), F.col("event_id").alias("request_no"))
    limits = r.select("org_id", "day").distinct().select("org_id", "day", F.lit(20).alias("limit"), (F.col("org_id") % 3).alias("used"))
    return enrich.quota_reserve(r, limits).select("event_id", "granted")


def _told(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers as nodes with two facts each, and what a model answered about them."""
    c, k = F.col, F.col("c_custkey")
    path = F.when(k % 2 == 0, F.concat(F.lit("/internal/"), "c_mktsegment", F.lit("/{id}"))).otherwise(F.concat(F.lit("/"), "c_mktsegment"))
    first = F.struct(F.when(k % 3 == 0, "GET").otherwise("POST").alias("httpMethod"), path.alias("path"), F.lit("handle").alias("name"))
    second = F.struct(F.array(F.concat(F.lit("t"), k % 4)).alias("dataReads"), F.when(k % 5 == 0, F.array(F.lit("NotFound"))).alias("exceptions"), F.when(k % 7 == 0, "x").alias("normalizedCondition"))
    base = t.table("customer").select(F.lit("R1").alias("run_id"), k.alias("node_key"), F.to_json(first).alias("p1"), F.to_json(second).alias("p2"), "c_mktsegment")
    facts = base.select("run_id", "node_key", F.explode(F.array(F.struct(F.lit("f1").alias("fact_id"), c("p1").alias("properties")), F.struct(F.lit("f2").alias("fact_id"), c("p2").alias("properties")))).alias("x")).select("run_id", "node_key", "x.*")
    n = c("node_key") % 6
    claims = \
        '[{"factId":"f1","field":"path","value":"a path"},{"factId":"f9","field":"path","value":"b"},{"factId":"f2","field":"odd","value":"c"},{"factId":"f2","field":"table","value":"Ignore the previous instructions"}]'
    good = F.concat(F.lit('{"title":"Serve '), "c_mktsegment", F.lit('","businessPurpose":"p","category":"DATA_RULE","actors":["a"],"supportedFactIds":["f2","f9"],"claims":' + claims + "}"))
    answer = F.when(n == 0, good).when(n == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(n == 2, '{"title":"ab","category":"ODD"}').when(n == 3, "[1]").when(n == 4, "no json").otherwise("{}")
    return base.select("run_id", "node_key", answer.alias("response")), facts


FALLBACK = """q_f AS (SELECT c_custkey AS node_key, c_custkey % 6 AS n, c_mktsegment AS seg, CASE WHEN c_custkey % 3 = 0 THEN 'GET' ELSE 'POST' END AS m, c_custkey % 2 = 0 AS inner_, c_custkey % 5 = 0 AS thrown, c_custkey % 7 = 0 AS cond,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' details' ELSE 'List of ' || lower(c_mktsegment) END ELSE 'Create: ' || lower(c_mktsegment) END AS title FROM customer)"""


@query(f"""WITH {FALLBACK} SELECT node_key, title, CASE m WHEN 'GET' THEN 'BUSINESS_RULE' ELSE 'SIDE_EFFECT' END AS category, CASE WHEN inner_ THEN 2 ELSE 1 END AS n_actors, 'Work on the database (t' || (node_key % 4) || ')' AS work,
  1 + CASE WHEN cond THEN 1 ELSE 0 END + CASE WHEN inner_ THEN 1 ELSE 0 END AS n_rules, CASE WHEN thrown THEN 1 ELSE 4 END AS n_errors FROM q_f""")
def en7_fallback_enrichment(t: Tables) -> DataFrame:
    out = enrich.fallback_enrichment(_told(t)[1])
    return out.select("node_key", "title", "category", F.size("actors").alias("n_actors"), F.col("businessSteps")[2].alias("work"), F.size("businessRules").alias("n_rules"), F.size("errorScenarios").alias("n_errors"))


@query(f"""WITH {FALLBACK} SELECT node_key, CASE WHEN n <= 1 THEN 'Serve ' || seg ELSE title END AS title, CASE WHEN n <= 1 THEN 'DATA_RULE' WHEN n IN (2, 5) THEN 'UNKNOWN' WHEN m = 'GET' THEN 'BUSINESS_RULE' ELSE 'SIDE_EFFECT' END AS category,
  CASE WHEN n <= 1 THEN 'a' WHEN m = 'GET' THEN 'User' ELSE 'Administrator or client' END AS first_actor, 'f1,f2' AS facts, CASE WHEN n <= 1 THEN 1 ELSE 0 END AS n_claims, CASE WHEN n IN (3, 4) THEN 'HEURISTIC' ELSE 'LLM_ENRICHMENT' END AS origin FROM q_f""")
def en6_validate_enrichment(t: Tables) -> DataFrame:
    out = enrich.validate_enrichment(*_told(t))
    return out.select("node_key", "title", "category", F.col("actors")[0].alias("first_actor"), F.array_join("supportedFactIds", ",").alias("facts"), F.size("claims").alias("n_claims"), "origin")


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS thrown, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'A' ORDER BY l_linenumber, 'm' || l_linenumber) AS i FROM lineitem)
SELECT l_orderkey, 'm' || l_linenumber AS member_key, CASE WHEN thrown THEN 'Error ' ELSE 'Step ' END || i AS title FROM q WHERE i <= CASE WHEN thrown THEN 2 ELSE 3 END""")
def en8_propagate_steps(t: Tables) -> DataFrame:
    li = t.table("lineitem")
    members = li.select(F.lit("R1").alias("run_id"), F.col("l_orderkey").alias("entry_key"), F.concat(F.lit("m"), "l_linenumber").alias("member_key"), F.when(F.col("l_returnflag") == "A", "EXCEPTION").otherwise("METHOD").alias("kind"), (F.col("l_linenumber") + 1).alias("depth"))
    lists = [F.array(*[F.lit(f"{i}. {word} {i}") for i in range(1, n + 1)]).alias(name) for word, n, name in (("Step", 3, "steps"), ("Error", 2, "errors"))]
    told = members.select("run_id", "entry_key").distinct().select("run_id", "entry_key", *lists)
    return enrich.propagate_steps(told, members).select(F.col("entry_key").alias("l_orderkey"), "member_key", "title")


@query("""WITH q_last AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1)
SELECT c_nationkey AS run_id, count(*) AS total, count(*) FILTER (WHERE s = 'F') AS ready, count(*) FILTER (WHERE s = 'O') AS running, count(*) FILTER (WHERE s = 'P') AS failed, CAST(floor(count(*) FILTER (WHERE s = 'F') * 100 / count(*)) AS BIGINT) AS percent
FROM customer LEFT JOIN q_last ON o_custkey = c_custkey GROUP BY 1""")
def en9_enrichment_progress(t: Tables) -> DataFrame:
    ends = t.table("customer").select(F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("stable_key"))
    status = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    done = t.table("orders").select(F.col("o_custkey").alias("stable_key"), F.col("o_orderkey").alias("seq"), status.alias("status")).join(ends, "stable_key")
    return enrich.enrichment_progress(ends, done)




@query("""WITH q_head AS (SELECT * FROM (VALUES """ + ", ".join(f"('{head}', {i}, {list(others)})" for i, (head, others) in enumerate(search.SYNONYMS.items())) + """) AS t(head, entry, others)),
q_e AS (SELECT stable_key, lower(coalesce(method, '')) AS m, lower(path) AS p, lower(label) AS l, lower(owner_key) AS o, lower(coalesce(title, '')) AS t, lower(coalesce(description, '')) AS d FROM b_searched),
q_q AS (SELECT query_id, lower(trim(text)) AS whole, list_filter(string_split_regex(lower(trim(text)), '[\\s,;.:!?"''()\\[\\]{}]+'), lambda x: x <> '') AS words FROM b_asked),
q_w AS (SELECT * FROM (SELECT query_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM q_q) WHERE length(word) >= 2),
q_best AS (SELECT word, arg_min(others, CASE WHEN head = word THEN -1 ELSE entry END) AS others FROM (SELECT DISTINCT word FROM q_w) JOIN q_head ON starts_with(word, head) OR starts_with(head, word) GROUP BY word),
q_s AS (SELECT query_id, word, place, unnest(others) AS syn, unnest(range(len(others))) + 1 AS nth FROM q_w JOIN q_best USING (word)),
q_hit AS (
  SELECT query_id, stable_key, -1 AS place, 0 AS nth, 0 AS step, CASE WHEN contains(t, whole) THEN 50 WHEN contains(d, whole) THEN 35 ELSE 30 END AS pts, CASE WHEN contains(t, whole) THEN 'WHOLE_TITLE' WHEN contains(d, whole) THEN 'WHOLE_DESCRIPTION' ELSE 'WHOLE_PLACE' END AS reason
    FROM q_q CROSS JOIN q_e WHERE len(words) > 0 AND (contains(t, whole) OR contains(d, whole) OR contains(p, whole) OR contains(l, whole))
  UNION ALL SELECT query_id, stable_key, place, 0, 0, 25, 'WORD_TITLE:' || word FROM q_w CROSS JOIN q_e WHERE contains(t, word)
  UNION ALL SELECT query_id, stable_key, place, 0, 1, 15, 'WORD_DESCRIPTION:' || word FROM q_w CROSS JOIN q_e WHERE contains(d, word)
  UNION ALL SELECT query_id, stable_key, place, 0, 2, 20, 'WORD_PLACE:' || word FROM q_w CROSS JOIN q_e WHERE contains(p, word) OR contains(l, word)
  UNION ALL SELECT query_id, stable_key, place, 0, 3, 15, 'WORD_OWNER:' || word FROM q_w CROSS JOIN q_e WHERE contains(o, word)
  UNION ALL SELECT query_id, stable_key, place, nth, 4, 30, 'SYNONYM_PATH:' || word || '=' || syn FROM q_s CROSS JOIN q_e WHERE contains(p, syn)
  UNION ALL SELECT query_id, stable_key, place, nth, 5, 20, 'SYNONYM_OWNER:' || word || '=' || syn FROM q_s CROSS JOIN q_e WHERE contains(o, syn)
  UNION ALL SELECT query_id, stable_key, place, nth, 6, 25, 'SYNONYM_METHOD:' || word || '=' || syn FROM q_s CROSS JOIN q_e WHERE m = syn),
q_all AS (SELECT query_id, stable_key, CAST(least(100, sum(pts)) AS INTEGER) AS score, list(reason ORDER BY place, nth, step) AS r FROM q_hit GROUP BY 1, 2)
SELECT query_id, stable_key, score, r[1] AS reason, array_to_string(r, '|') AS reasons FROM q_all QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stable_key) <= 100""")
def en10_semantic_search(t: Tables) -> DataFrame:
    """Customers as endpoints, with documents as descriptions; passages, nations and parts as queries."""
    one = F.lit("R1").alias("run_id")
    out = search.semantic_search(t.b_searched.select(one, "*"), t.b_asked.select(one, "*"))
    return out.select("query_id", "stable_key", "score", "reason", F.array_join("reasons", "|").alias("reasons"))


# --- technologies


@query("SELECT DISTINCT 'c' || k AS root FROM b_repo WHERE what IN (0, 2, 3, 4, 8, 10) UNION ALL SELECT '.'")
def td1_component_roots(t: Tables) -> DataFrame:
    return corpus.component_roots(t.b_repo)


@query("SELECT path, component FROM b_repo")
def td2_assign_component(t: Tables) -> DataFrame:
    files = t.b_repo.select("path")
    return corpus.assign_component(files, corpus.component_roots(files)).select("path", "component")


@query("SELECT path, CASE what WHEN 1 THEN 'JAVA' WHEN 5 THEN 'PYTHON' WHEN 6 THEN 'SQL' WHEN 7 THEN 'PYTHON' WHEN 11 THEN 'TYPESCRIPT' END AS language FROM b_repo")
def td3_file_language(t: Tables) -> DataFrame:
    return t.b_repo.select("path", corpus.file_language(F.col("path"), F.substring_index("text", "\n", 1)).alias("language"))


#: What each file of b_repo speaks for.
TAGS = """q_tag(what, tag_kind, tag) AS (VALUES (0, 'build', 'MAVEN'), (0, 'database', 'POSTGRESQL'), (1, 'language', 'JAVA'), (1, 'framework', 'SPRING_BOOT'), (2, 'build', 'NPM'), (2, 'framework', 'REACT'), (2, 'build', 'VITE'), (3, 'build', 'NPM'),
  (4, 'build', 'GRADLE'), (4, 'database', 'FLYWAY'), (5, 'language', 'PYTHON'), (5, 'framework', 'DJANGO'), (6, 'language', 'SQL'), (6, 'database', 'POSTGRESQL'), (6, 'database', 'FLYWAY'), (7, 'language', 'PYTHON'),
  (8, 'build', 'GO_MODULES'), (8, 'language', 'GO'), (8, 'framework', 'GORM'), (10, 'build', 'CARGO'), (10, 'language', 'RUST'), (11, 'language', 'TYPESCRIPT'))"""


@query(f"WITH {TAGS} SELECT path, component, tag_kind, tag FROM b_repo JOIN q_tag USING (what)")
def td4_technology_tags(t: Tables) -> DataFrame:
    return corpus.technology_tags(t.b_repo).select("path", "component", "tag_kind", "tag")


ROLLUP = TAGS + """, q_leaf AS (SELECT component, substr(sha256(path), 1, 3) AS leaf, sha256(string_agg(path || chr(0) || sha256(text), chr(10) ORDER BY path)) AS h FROM b_repo GROUP BY ALL),
q_print AS (SELECT component, 'sha256:' || sha256(string_agg(leaf || ':' || h, chr(10) ORDER BY leaf)) AS fingerprint FROM q_leaf GROUP BY 1),
q_set AS (SELECT component, list_sort(list_distinct(list(tag) FILTER (WHERE tag_kind = 'language'))) AS languages, list_sort(list_distinct(list(tag) FILTER (WHERE tag_kind = 'framework'))) AS frameworks,
  list_sort(list_distinct(list(tag) FILTER (WHERE tag_kind = 'build'))) AS builds, list_sort(list_distinct(list(tag) FILTER (WHERE tag_kind = 'database'))) AS databases FROM b_repo JOIN q_tag USING (what) GROUP BY 1)"""


def _components(t: Tables) -> DataFrame:
    files = t.b_repo.withColumn("sha256", F.sha2("text", 256))
    return corpus.component_rollup(corpus.technology_tags(t.b_repo), files, corpus.malformed_manifests(t.b_repo))


@query(f"""WITH {ROLLUP} SELECT component, array_to_string(coalesce(languages, []), ',') AS languages, array_to_string(coalesce(frameworks, []), ',') AS frameworks, array_to_string(coalesce(builds, []), ',') AS builds, array_to_string(coalesce(databases, []), ',') AS databases,
  fingerprint, CASE WHEN CAST(substr(component, 2) AS BIGINT) % 12 = 3 THEN 1 ELSE 0 END AS n_malformed FROM q_set JOIN q_print USING (component) WHERE len(languages) > 0 OR len(builds) > 0""")
def td5_component_rollup(t: Tables) -> DataFrame:
    lists = [F.array_join(c, ",").alias(c) for c in ("languages", "frameworks", "builds", "databases")]
    return _components(t).select("component", *lists, "fingerprint", F.coalesce(F.size("diagnostics"), F.lit(0)).alias("n_malformed"))


@query("""WITH q AS (SELECT substr(sha256(path), 1, 3) AS leaf, sha256(string_agg(path || chr(0) || sha256(text), chr(10) ORDER BY path)) AS h FROM b_repo GROUP BY 1)
SELECT 'sha256:' || sha256(string_agg(leaf || ':' || h, chr(10) ORDER BY leaf)) AS fingerprint, 'local-' || substr(sha256(string_agg(leaf || ':' || h, chr(10) ORDER BY leaf)), 1, 40) AS revision FROM q""")
def td6_corpus_fingerprint(t: Tables) -> DataFrame:
    return corpus.corpus_fingerprint(t.b_repo.withColumn("sha256", F.sha2("text", 256)))


DEFINITIONS = [
    ("java-spring", "2", 2, ["JAVA"], ["SPRING_BOOT"], True, "1.0", "DENY", False), ("java-spring", "1", 1, ["JAVA"], [], True, "1.0", "DENY", False), ("py", "1", 1, ["PYTHON", "RUBY"], ["FASTAPI"], True, "1.2", "DENY", False),
    ("postgresql", "1", 1, ["SQL"], [], True, "1.0", "DENY", False), ("go", "1", 1, ["GO"], ["GORM"], True, "1.0", "DENY", False), ("rust", "1", 1, ["RUST"], [], True, "2.0", "DENY", False), ("net", "1", 1, ["TYPESCRIPT"], [], True, "1.0", "ALLOW", False),
]


def _definitions(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(DEFINITIONS, "analyzer_key string, version string, created_at int, languages array<string>, frameworks array<string>, enabled boolean, contract_version string, network string, resolves_dependencies boolean")
    return rows.withColumn("retired_at", F.lit(None).cast("timestamp"))


@query(f"""WITH {ROLLUP} SELECT component, 'java-spring' AS analyzer_key, '2' AS version FROM q_set WHERE list_contains(languages, 'JAVA') UNION ALL SELECT component, 'go', '1' FROM q_set WHERE list_contains(languages, 'GO') AND list_contains(frameworks, 'GORM')
UNION ALL SELECT component, 'postgresql', '1' FROM q_set WHERE list_contains(languages, 'SQL') OR len(databases) > 0""")
def td7_plan_analyzers(t: Tables) -> DataFrame:
    return corpus.plan_analyzers(_components(t), _definitions(t)).select("component", "analyzer_key", "version")


@query(f"""WITH {ROLLUP}, q_l AS (SELECT component, unnest(languages) AS l FROM q_set) SELECT component, array_to_string(list_sort(list(l)), ',') AS languages FROM q_l
WHERE NOT (l = 'JAVA' OR l = 'GO' OR l = 'SQL') GROUP BY component""")
def td8_coverage_gaps(t: Tables) -> DataFrame:
    own = _components(t)
    gaps = corpus.coverage_gaps(own, corpus.plan_analyzers(own, _definitions(t)), _definitions(t))
    return gaps.select("component", F.array_join("languages", ",").alias("languages"))


# --- reports


@query("""SELECT execution_id FROM b_exec WHERE execution_id % 8 <> 0 AND (org_id IN ('org1', 'org2') OR (org_id, project_id) IN (('org3', 'p3'), ('org4', 'p29')))""")
def ops1_visible_rows(t: Tables) -> DataFrame:
    members = t.spark.createDataFrame([("u", "org1", "p1", "ORG_ADMIN"), ("u", "org2", "p9", "ORG_ADMIN"), ("u", "org3", "p3", "VIEWER"), ("u", "org4", "p29", "EDITOR"), ("v", "org5", "p5", "ORG_ADMIN")], "user_id string, org_id string, project_id string, role string")
    return reports.visible_rows(t.b_exec.withColumn("deleted", F.col("execution_id") % 8 == 0), members, "u").select("execution_id")


@query("""WITH q AS (SELECT run_id, count(*) AS n, bool_and(files_failed = 0 AND files_parsed >= files_discovered AND manifest_status = 'SUCCEEDED') AS complete FROM b_exec GROUP BY 1)
SELECT run_id, CAST(n AS INTEGER) AS n_executions, complete, 'c' || substr(run_id, 2) AS component FROM q""")
def ops2_coverage_report(t: Tables) -> DataFrame:
    e = t.b_exec.withColumnRenamed("manifest_status", "status")
    parts = e.select("run_id", F.concat(F.lit("c"), F.substring("run_id", 2, 9)).alias("root")).distinct()
    return reports.coverage_report(e, parts).select("run_id", F.size("coverage").alias("n_executions"), "complete", F.col("components")[0].alias("component"))


@query("""SELECT run_id, 'EXECUTION' AS origin, CAST(execution_id AS STRING) AS of, severity FROM b_exec WHERE severity IS NOT NULL UNION ALL SELECT DISTINCT run_id, 'COMPONENT', 'root', 'INFO' FROM b_exec
UNION ALL SELECT DISTINCT run_id, 'RUN', run_id, 'FATAL' FROM b_exec WHERE run_id LIKE '%7'""")
def ops3_diagnostics_report(t: Tables) -> DataFrame:
    executions = _executions(t).withColumn("execution_id", F.col("execution_id").cast("string"))
    runs = t.b_exec.select("run_id").distinct()
    info = F.array(F.struct(F.lit("C").alias("code"), F.lit("INFO").alias("severity"), F.lit("t").alias("message")))
    failed = F.when(F.col("run_id").endswith("7"), "F").alias("failure_code")
    out = reports.diagnostics_report(executions, runs.select("run_id", F.lit("root").alias("root"), info.alias("diagnostics")), runs.select("run_id", failed, F.lit("m").alias("failure_message")))
    return out.select("run_id", "origin", "of", "severity")


@query("""SELECT 'R' || (l_suppkey % 50) AS execution_id, count(*) AS discovered, count(*) FILTER (WHERE l_returnflag = 'A') AS parsed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1""")
def ops5_coverage_counts(t: Tables) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "A", "PARSED").when(F.col("l_returnflag") == "R", "FAILED").otherwise("SKIPPED")
    files = t.table("lineitem").select(F.concat(F.lit("R"), F.col("l_suppkey") % 50).alias("execution_id"), state.alias("state"))
    return reports.coverage_counts(files, _capabilities(t))[0]


def _capabilities(t: Tables) -> DataFrame:
    state = F.when(F.col("l_quantity") > 45, "FAILED").otherwise("COMPLETED")
    return t.table("lineitem").select(F.col("l_suppkey").alias("execution_id"), F.concat(F.lit("cap"), "l_linenumber").alias("capability"), state.alias("state"), F.when(F.col("l_quantity") < 2, "small").alias("limitation"))


@query("""SELECT l_suppkey AS execution_id, 'cap' || l_linenumber AS capability, CASE WHEN count(*) FILTER (WHERE l_quantity > 45) = 0 THEN CASE WHEN count(*) FILTER (WHERE l_quantity < 2) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END
  WHEN count(*) FILTER (WHERE l_quantity <= 45) = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM lineitem GROUP BY ALL""")
def ops5_capability_status(t: Tables) -> DataFrame:
    files = t.table("lineitem").select(F.col("l_suppkey").alias("execution_id"), F.lit("PARSED").alias("state"))
    return reports.coverage_counts(files, _capabilities(t))[1].select("execution_id", "capability", "status")


@query("""WITH m AS (SELECT max(created_at) AS m FROM b_exec) SELECT org_id, count(*) FILTER (WHERE manifest_status = 'PARTIALLY_SUCCEEDED') AS active, count(*) FILTER (WHERE created_at > m - INTERVAL 1 HOUR) AS last_hour,
  count(*) FILTER (WHERE manifest_status = 'PARTIALLY_SUCCEEDED') < 300 AND count(*) FILTER (WHERE created_at > m - INTERVAL 1 HOUR) < 5 AS admitted FROM b_exec, m GROUP BY 1""")
def ops8_org_quota(t: Tables) -> DataFrame:
    at = t.b_exec.agg(F.max("created_at").alias("now"))  # one row, by its aggregate
    runs = t.b_exec.withColumn("status", F.when(F.col("manifest_status") == "PARTIALLY_SUCCEEDED", "RUNNING").otherwise("SUCCEEDED")).join(F.broadcast(at))
    return reports.org_quota(runs, F.col("now"), 300, 5)


EXPIRED = """WITH m AS (SELECT max(created_at) AS m FROM b_exec), q_old AS (SELECT execution_id, org_id FROM b_exec, m WHERE manifest_status = 'SUCCEEDED' AND created_at + INTERVAL 1 DAY * (10 * CAST(substr(org_id, 4) AS INTEGER)) < m)"""


def _expired(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    at = t.b_exec.agg(F.max("created_at").alias("now"))  # one row, by its aggregate
    status = F.when(F.col("manifest_status") == "SUCCEEDED", "SUCCEEDED").otherwise("RUNNING")
    runs = t.b_exec.select(F.col("execution_id").alias("run_id"), "org_id", status.alias("status"), F.col("created_at").alias("finished_at")).join(F.broadcast(at))
    policy = runs.select("org_id").distinct().withColumn("retention_days", F.substring("org_id", 4, 9).cast("int") * 10)
    evidence = t.table("lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", F.lit("text").alias("snippet"), F.lit(True).alias("source_available"))
    lines = t.b_exec.select(F.col("execution_id").alias("run_id"), F.lit("raw").alias("raw"))
    return reports.expire_sources(evidence, lines, runs, policy, F.col("now"))


@query(EXPIRED + " SELECT l_orderkey AS run_id, l_linenumber, CASE WHEN o.execution_id IS NULL THEN 'text' ELSE '' END AS snippet, o.execution_id IS NULL AS source_available FROM lineitem LEFT JOIN q_old o ON o.execution_id = l_orderkey")
def ops9_expire_sources(t: Tables) -> DataFrame:
    return _expired(t)[0]


@query(EXPIRED + " SELECT e.execution_id AS run_id, CASE WHEN o.execution_id IS NULL THEN 'raw' ELSE '' END AS raw, o.org_id AS audited FROM b_exec e LEFT JOIN q_old o ON o.execution_id = e.execution_id")
def ops9_expire_quarantine(t: Tables) -> DataFrame:
    _, lines, audit = _expired(t)
    return lines.join(audit.select("run_id", F.col("org_id").alias("audited")), "run_id", "left")


@query("SELECT execution_id AS event_id FROM b_exec WHERE org_id = 'org7' ORDER BY created_at DESC, execution_id DESC LIMIT 100")
def ops10_audit_page(t: Tables) -> DataFrame:
    return reports.audit_page(t.b_exec.withColumnRenamed("execution_id", "event_id"), "org7").select("event_id")
