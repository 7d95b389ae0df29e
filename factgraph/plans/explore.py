"""Queries of graph building, scenarios, projections and diffs that the plain graph does not feed, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import semantics as S
from factgraph.operators import diff, graph, projections, reach, runtime
from factgraph.plans.base import query
from factgraph.plans.queries import ALL, EDGE, NODE, SPANS, contained
from factgraph.plans.tables import Tables

KEY = ["run_id", "stable_key"]


# --- graph building


def _provenance(t: Tables) -> DataFrame:
    frameworks = F.when(F.col("analyzer") == "alpha", F.array(F.lit("spring"))).otherwise(F.array(F.lit("react"), F.lit("junit")))
    more = {"version": F.lit("1"), "digest": F.lit("d"), "component_path": F.lit("."), "frameworks": frameworks, "languages": F.array(F.lit("JAVA"))}
    return graph.with_provenance(t.facts.where("kind <> 'RELATION'").withColumns(more))


@query("SELECT run_id, fact_id, execution_id, CASE analyzer WHEN 'alpha' THEN 'BACKEND' ELSE 'FRONTEND' END AS source_layer FROM b_fact WHERE kind <> 'RELATION'")
def gb2_with_provenance(t: Tables) -> DataFrame:
    return _provenance(t).select("run_id", "fact_id", "execution_id", "source_layer")


@query("SELECT run_id, stable_key, count(DISTINCT analyzer) AS n, list_sort(list_distinct(list(analyzer))) AS analyzers, list_sort(list_distinct(list(origin))) AS origins FROM b_fact WHERE kind <> 'RELATION' GROUP BY ALL")
def gb3_merge_provenance(t: Tables) -> DataFrame:
    return graph.merge_provenance(_provenance(t)).select("run_id", "stable_key", F.size("provenance").cast("long").alias("n"), "analyzers", "origins")


@query("""WITH q AS (SELECT doc_id, 'sha256:' || sha256('x' || (doc_id % 7)) AS h, j FROM b_cite)
SELECT doc_id, 'sha256:' || sha256('[' || string_agg('{"snippet_hash":"' || h || '","analyzer":"a' || j || '","version":"1","digest":"d","origin":"STATIC_EXACT"}', ',' ORDER BY j) || ']') AS evidence_fingerprint FROM q GROUP BY doc_id""")
def gb7_evidence_fingerprint(t: Tables) -> DataFrame:
    e = t.b_cite.select(
        F.concat_ws(":", "doc_id", "j").alias("evidence_id"), F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("x"), F.col("doc_id") % 7), 256)).alias("snippet_hash"),
        F.concat(F.lit("a"), F.col("j")).alias("analyzer"), F.lit("1").alias("version"), F.lit("d").alias("digest"), F.lit("STATIC_EXACT").alias("origin"),
    )
    ids = F.array(*[F.concat(F.col("doc_id"), F.lit(f":{j}")) for j in (2, 0, 1, 0)])
    subjects = t.b_source.where("text IS NOT NULL").select(F.lit("R1").alias("run_id"), F.col("doc_id").alias("subject"), ids.alias("evidence_ids"))
    return graph.evidence_fingerprint(subjects, e).select(F.col("subject").alias("doc_id"), "evidence_fingerprint")


@query(NODE + " SELECT run_id, stable_key, label, CASE WHEN confidence >= 0.9 THEN 'PROVEN' ELSE 'SUPPORTED' END AS support FROM q_node")
def gb8_finish_nodes(t: Tables) -> DataFrame:
    prints = t.nodes.select("run_id", F.col("stable_key").alias("subject"), F.lit("p").alias("evidence_fingerprint"))
    return graph.finish_nodes(t.nodes.drop("fingerprint", "structural_fingerprint"), prints).select("run_id", "stable_key", "label", "support")


@query("""WITH q AS (SELECT DISTINCT l_suppkey AS relation_key, 'f' || (l_partkey % 50) AS file_path, CAST(l_quantity AS INTEGER) AS start_line, 'h' || l_returnflag AS snippet_hash FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY relation_key ORDER BY file_path, start_line, snippet_hash) AS place, count(*) OVER (PARTITION BY relation_key) > 32 AS truncated FROM q)
SELECT relation_key, file_path, start_line, snippet_hash, truncated FROM r WHERE place <= 32""")
def gb13_merge_relation_evidence(t: Tables) -> DataFrame:
    rows = t.table("lineitem").select(F.col("l_suppkey").alias("relation_key"), F.concat(F.lit("f"), F.col("l_partkey") % 50).alias("file_path"), F.col("l_quantity").cast("int").alias("start_line"), F.concat(F.lit("h"), "l_returnflag").alias("snippet_hash"))
    return graph.merge_relation_evidence(rows).drop("place")


METHODS = "q_m AS (SELECT p_brand AS owner, p_size AS arity, count(*) AS n, min(p_name) AS method_key FROM part GROUP BY ALL)"


@query(f"""WITH {METHODS} SELECT l_orderkey, l_linenumber, CASE WHEN m.n = 1 THEN m.method_key END AS method_key, coalesce(m.n, 0) AS candidates
FROM lineitem LEFT JOIN q_m m ON m.owner = 'Brand#' || (l_suppkey % 5 + 1) || (l_partkey % 5 + 1) AND m.arity = CAST(l_quantity AS INTEGER)""")
def gb14_resolve_unique_target(t: Tables) -> DataFrame:
    methods = t.table("part").select(F.col("p_name").alias("method_key"), F.col("p_brand").alias("owner"), F.lit("m").alias("name"), F.col("p_size").alias("arity"))
    receiver = F.concat(F.lit("Brand#"), F.col("l_suppkey") % 5 + 1, F.col("l_partkey") % 5 + 1)
    calls = t.table("lineitem").select("l_orderkey", "l_linenumber", receiver.alias("receiver"), F.lit("m").alias("name"), F.col("l_quantity").cast("int").alias("arity"))
    found, lost = graph.resolve_unique_target(calls, methods)
    keys = ["l_orderkey", "l_linenumber"]
    return found.select(*keys, "method_key", F.lit(1).cast("long").alias("candidates")).union(lost.select(*keys, F.lit(None).cast("string"), "candidates"))


@query("""WITH q_run AS (SELECT DISTINCT run_id FROM b_exec), q_n AS (SELECT DISTINCT run_id FROM b_exec WHERE k % 2 = 0), q_bad AS (SELECT DISTINCT run_id FROM b_exec WHERE execution_id % 97 = 0 OR severity = 'ERROR' AND execution_id % 2 = 1 OR files_failed > 5)
SELECT r.run_id, CASE WHEN r.run_id NOT IN (SELECT run_id FROM q_n) THEN 'FAILED' WHEN r.run_id IN (SELECT run_id FROM q_bad) THEN 'PARTIALLY_SUCCEEDED' ELSE 'SUCCEEDED' END AS status FROM q_run r""")
def gb15_finalize_run(t: Tables) -> DataFrame:
    e = t.b_exec
    executions = e.select("run_id", F.when(F.col("files_failed") > 5, "FAILED").otherwise("SUCCEEDED").alias("status"))
    told = e.where("severity = 'ERROR' AND execution_id % 2 = 1")
    return graph.finalize_run(e.select("run_id").distinct(), e.where("k % 2 = 0"), e.where("execution_id % 97 = 0"), executions, told).select("run_id", "status")


@query("""SELECT DISTINCT o_custkey AS commit, o_orderstatus AS fingerprint, 0 AS ordinal, 'p' || o_custkey AS parent FROM orders WHERE o_custkey % 3 <> 0
UNION ALL SELECT DISTINCT o_custkey, o_orderstatus, 1, 'q' FROM orders WHERE o_custkey % 3 <> 0""")
def gb16_revision_upsert(t: Tables) -> DataFrame:
    r = t.table("orders").select(F.col("o_custkey").alias("commit"), F.col("o_orderstatus").alias("fingerprint"), F.array(F.concat(F.lit("p"), "o_custkey"), F.lit("q")).alias("parents"))
    return graph.revision_upsert(r, r.where("commit % 3 = 0"))[1]


# --- scenarios


@query(EDGE + """, q_kid AS (
  SELECT e.run_id, e.source_key AS entry_key, e.target_key AS member_key, min(e.kind) AS edge_kind, min_by(e.confidence, e.kind) AS edge_confidence FROM q_edge e JOIN q_node o ON o.run_id = e.run_id AND o.stable_key = e.source_key AND o.kind = 'ENDPOINT'
  JOIN q_node n ON n.run_id = e.run_id AND n.stable_key = e.target_key GROUP BY ALL
), q_place AS (SELECT *, row_number() OVER (PARTITION BY run_id, entry_key ORDER BY member_key) + 1 AS position FROM q_kid)
SELECT run_id, stable_key AS entry_key, stable_key AS member_key, 0 AS depth, CAST(1 AS BIGINT) AS position, CAST(round(confidence * 100) AS BIGINT) AS confidence FROM q_node WHERE kind = 'ENDPOINT'
UNION ALL SELECT p.run_id, entry_key, member_key, 1, position, CAST(round(least(o.confidence, edge_confidence, n.confidence) * 100) AS BIGINT) FROM q_place p JOIN q_node n ON n.run_id = p.run_id AND n.stable_key = p.member_key
JOIN q_node o ON o.run_id = p.run_id AND o.stable_key = p.entry_key WHERE position <= 6""")
def sc1_one_step(t: Tables) -> DataFrame:
    """Scenarios of one step and six members: the budget falls on the first by key."""
    members, _ = reach.scenario_members(*t.graph, max_depth=1, max_nodes=6)
    return members.select("run_id", "entry_key", "member_key", "depth", F.col("position").cast("long").alias("position"), F.round(F.col("confidence") * 100).cast("long").alias("confidence"))


KIDS = EDGE + """, q_kid AS MATERIALIZED (
  SELECT e.run_id, e.source_key AS entry_key, e.target_key AS member_key, n.kind, n.confidence, n.symbol, n.first_threshold FROM q_edge e
  JOIN q_node o ON o.run_id = e.run_id AND o.stable_key = e.source_key AND o.kind = 'ENDPOINT' JOIN q_node n ON n.run_id = e.run_id AND n.stable_key = e.target_key WHERE e.kind = 'CONTAINS'
)"""


@query(KIDS + """ SELECT run_id, 'scenario:' || entry_key AS stable_key, count(*) AS n_members, list_sort(list(member_key)) AS member_keys, CAST(round(min(confidence) * 100) AS BIGINT) AS confidence FROM q_kid GROUP BY run_id, entry_key""")
def sc4_scenario_nodes(t: Tables) -> DataFrame:
    out = reach.scenario_nodes(contained(t), t.nodes.select("run_id", "stable_key", "fingerprint").join(graph.gathered(t.node_facts, KEY, "fact_id"), KEY))
    return out.select("run_id", "stable_key", F.size("member_keys").cast("long").alias("n_members"), "member_keys", F.round(F.col("confidence") * 100).cast("long").alias("confidence"))


@query(KIDS + """ SELECT run_id, member_key AS source_key, 'scenario:' || entry_key AS target_key, 'PART_OF_SCENARIO' AS kind FROM q_kid
UNION ALL SELECT DISTINCT run_id, 'scenario:' || entry_key, entry_key, 'ENTRY_TO' FROM q_kid""")
def sc5_scenario_edges(t: Tables) -> DataFrame:
    kids = contained(t).select("run_id", "entry_key", "member_key", "depth")
    # an entry comes with the first of its members, so that these are found once
    first = F.row_number().over(Window.partitionBy("run_id", "entry_key").orderBy("member_key")) == 1
    rows = F.array_compact(F.array(F.struct("member_key", "depth"), F.when(first, F.struct(F.col("entry_key").alias("member_key"), F.lit(0).alias("depth")))))
    return reach.scenario_edges(kids.withColumn("m", rows).select("run_id", "entry_key", F.explode("m").alias("m")).select("run_id", "entry_key", "m.*")).drop("depth")


# --- diffs


@query("""SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'ADDED' WHEN a.path IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change
FROM (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0) b FULL JOIN (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0) a ON a.path = b.path
WHERE b.path IS NULL OR a.path IS NULL OR a.h <> b.h""")
def df8_changed_files(t: Tables) -> DataFrame:
    d, c = t.table("documents"), F.col("doc_id")
    before = d.where(c % 11 != 0).select(c.alias("path"), F.sha2("text", 256).alias("sha256"))
    after = d.where(c % 13 != 0).select(c.alias("path"), F.sha2(F.when(c % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return diff.changed_files(before, after)


@query("""SELECT o_orderkey AS run_id, (SELECT max_by(o2.o_orderkey, (o2.o_orderdate, o2.o_orderkey)) FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_orderstatus = 'F' AND o2.o_orderdate < o.o_orderdate) AS baseline_id FROM orders o""")
def df9_default_baseline(t: Tables) -> DataFrame:
    runs = t.table("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("completed"))
    return diff.default_baseline(runs).select("run_id", "baseline_id")


CHANGE = """WITH q_change AS (SELECT 'order:' || l_orderkey AS stable_key, CASE l_returnflag WHEN 'A' THEN 'ADDED' WHEN 'N' THEN 'MOVED' ELSE 'MODIFIED' END AS change_type, 'I' || l_linenumber AS impact FROM lineitem)"""


def _changes(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "ADDED").when(F.col("l_returnflag") == "N", "MOVED").otherwise("MODIFIED")
    return t.table("lineitem").select(F.concat(F.lit("order:"), "l_orderkey").alias("stable_key"), kind.alias("change_type"), F.concat(F.lit("I"), "l_linenumber").alias("impact"))


@query(CHANGE + " SELECT * FROM q_change WHERE contains(lower(stable_key || ' ' || change_type || ' ' || impact), 'added i2') ORDER BY stable_key, change_type, impact LIMIT 500")
def df10_list_changes(t: Tables) -> DataFrame:
    return diff.list_changes(_changes(t), "Added I2", 500)


# --- projections


@query(NODE + ", " + CHANGE[5:] + " SELECT run_id, stable_key FROM q_node WHERE run_id = 'R1' AND stable_key IN (SELECT stable_key FROM q_change WHERE change_type = 'MOVED')")
def qry7_only_changed(t: Tables) -> DataFrame:
    changed = _changes(t).where("change_type = 'MOVED'").withColumn("run_id", F.lit("R1"))
    return projections.only_changed(t.nodes, changed).select(*KEY)


@query(NODE + " SELECT run_id, stable_key FROM q_node n SEMI JOIN (SELECT run_id, stable_key FROM b_fact WHERE analyzer = 'beta') f USING (run_id, stable_key)")
def qry8_execution_filter(t: Tables) -> DataFrame:
    executions = t.facts.select("execution_id", "analyzer").distinct()
    return projections.execution_filter(t.nodes, t.node_facts, t.facts, executions, F.col("analyzer") == "beta").select(*KEY)


@query(NODE + " SELECT run_id, stable_key FROM q_node WHERE kind = 'TABLE'")
def qry9_layer_filter(t: Tables) -> DataFrame:
    layer = F.when(F.col("kind") == "TABLE", "DATABASE").otherwise("BACKEND")
    return projections.layer_filter(t.nodes.withColumn("properties", F.to_json(F.struct(layer.alias("sourceLayer")))), "DATABASE").select(*KEY)


@query(EDGE + """, q_near AS MATERIALIZED (SELECT DISTINCT run_id, source_key AS here, target_key AS at_ FROM q_edge UNION SELECT DISTINCT run_id, target_key, source_key FROM q_edge),
q_root AS (SELECT run_id, stable_key AS root_key FROM q_node WHERE kind = 'TABLE'),
q_one AS MATERIALIZED (SELECT run_id, root_key, at_ AS stable_key FROM (SELECT r.run_id, r.root_key, n.at_, row_number() OVER (PARTITION BY r.run_id, r.root_key ORDER BY n.at_) AS place FROM q_root r
  JOIN q_near n ON n.run_id = r.run_id AND n.here = r.root_key JOIN q_node k ON k.run_id = n.run_id AND k.stable_key = n.at_ WHERE n.at_ <> r.root_key) WHERE place <= 20),
q_two AS (SELECT run_id, root_key, at_ AS stable_key FROM (SELECT x.run_id, x.root_key, x.at_, row_number() OVER (PARTITION BY x.run_id, x.root_key ORDER BY x.at_) AS place FROM (
  SELECT DISTINCT o.run_id, o.root_key, n.at_ FROM q_one o JOIN q_near n ON n.run_id = o.run_id AND n.here = o.stable_key JOIN q_node k ON k.run_id = n.run_id AND k.stable_key = n.at_) x
  ANTI JOIN (SELECT run_id, root_key, stable_key AS at_ FROM q_one UNION ALL SELECT run_id, root_key, root_key FROM q_root) y USING (run_id, root_key, at_)) WHERE place <= 20)
SELECT run_id, root_key, root_key AS stable_key, 0 AS depth FROM q_root UNION ALL SELECT run_id, root_key, stable_key, 1 FROM q_one UNION ALL SELECT run_id, root_key, stable_key, 2 FROM q_two""")
def qry10_neighborhood(t: Tables) -> DataFrame:
    roots = t.nodes.where("kind = 'TABLE'").select("run_id", F.col("stable_key").alias("root_key"))
    return reach.neighborhood(t.nodes, t.edge_facts, roots, depth=2, limit=20).select("run_id", "root_key", "stable_key", "depth")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 5 AND (l_linenumber = 0 OR l_returnflag <> 'A')")
def qry11_scenario_selection(t: Tables) -> DataFrame:
    members = t.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("depth"), F.when(F.col("l_returnflag") == "A", "ENDPOINT").otherwise("METHOD").alias("kind"))
    return reach.scenario_selection(members, 2).select("l_orderkey", "l_linenumber")


#: A step's layer by what its path and kind say, as projections.layer_rank() has it.
RANK = """CASE WHEN file_path LIKE '%/controller/%' THEN 0 WHEN file_path LIKE '%/validator/%' OR kind = 'VALIDATION_RULE' THEN 1 WHEN file_path LIKE '%/service/%' THEN 2 WHEN file_path LIKE '%/repository/%' OR kind = 'DATABASE_READ' THEN 3 ELSE 4 END"""
STEP = f"WITH q_step AS (SELECT *, {RANK} AS layer_rank FROM b_step)"


def _steps(t: Tables) -> DataFrame:
    return t.b_step.withColumn("layer_rank", projections.layer_rank(F.col("file_path"), F.col("kind")))


@query(STEP + """ SELECT * FROM (SELECT scenario_key, stable_key AS source_key, lead(stable_key) OVER w AS target_key, row_number() OVER w AS place FROM q_step WINDOW w AS (PARTITION BY scenario_key ORDER BY layer_rank, call_line NULLS LAST, file_path, start_line, stable_key)) WHERE target_key IS NOT NULL""")
def qry15_pipeline_spine(t: Tables) -> DataFrame:
    return projections.pipeline_spine(_steps(t)).select("scenario_key", "source_key", "target_key", F.col("place").cast("long").alias("place"))


@query("""WITH e AS (SELECT scenario_key, stable_key, file_path, start_line FROM b_step WHERE place % 4 = 0), s AS (SELECT scenario_key, stable_key, file_path, start_line FROM b_step WHERE place % 4 <> 0)
SELECT e.scenario_key, e.stable_key AS target_key, coalesce((SELECT max_by(s.stable_key, (s.start_line, s.stable_key)) FROM s WHERE s.scenario_key = e.scenario_key AND s.file_path = e.file_path AND s.start_line <= e.start_line),
  (SELECT max_by(s.stable_key, (s.file_path, s.start_line, s.stable_key)) FROM s WHERE s.scenario_key = e.scenario_key)) AS source_key FROM e""")
def qry16_attach_exceptions(t: Tables) -> DataFrame:
    return projections.attach_exceptions(t.b_step.where("place % 4 <> 0"), t.b_step.where("place % 4 = 0")).select("scenario_key", "target_key", "source_key")


@query("""WITH q_t AS (SELECT DISTINCT scenario_key, 'supplier:' || k AS stable_key FROM b_step), q_e AS (SELECT DISTINCT 'flag:' || l_returnflag AS source_key, 'supplier:' || l_suppkey AS target_key FROM lineitem WHERE l_suppkey % 2 = 0),
q_first AS (SELECT scenario_key, min_by(stable_key, (place, stable_key)) AS source_key FROM b_step WHERE kind = 'DATABASE_READ' GROUP BY 1)
SELECT t.scenario_key, e.source_key, t.stable_key AS target_key, 'READS' AS kind FROM q_t t JOIN q_e e ON e.target_key = t.stable_key
UNION ALL SELECT t.scenario_key, f.source_key, t.stable_key, 'READS' FROM q_t t JOIN q_first f USING (scenario_key) WHERE t.stable_key NOT IN (SELECT target_key FROM q_e)""")
def qry17_attach_tables(t: Tables) -> DataFrame:
    tables = t.b_step.select("scenario_key", F.concat(F.lit("supplier:"), "k").alias("stable_key")).distinct()
    own = t.table("lineitem").where("l_suppkey % 2 = 0")
    edges = own.select(F.concat(F.lit("flag:"), "l_returnflag").alias("source_key"), F.concat(F.lit("supplier:"), "l_suppkey").alias("target_key"), F.lit("READS").alias("kind")).distinct()
    return projections.attach_tables(tables, edges, t.b_step)


@query(NODE + " SELECT run_id, stable_key AS endpoint_key, CASE WHEN length(stable_key) % 2 = 0 THEN 'List<OrderDto>' ELSE 'void' END AS label FROM q_node WHERE kind = 'ENDPOINT'")
def qry18_return_nodes(t: Tables) -> DataFrame:
    kind = F.when(F.length("stable_key") % 2 == 0, F.to_json(F.struct(F.lit("java.util.List<com.shop.OrderDto>").alias("responseType")))).otherwise("{}")
    return projections.return_nodes(t.nodes.where("kind = 'ENDPOINT'").withColumn("properties", kind)).select("run_id", "endpoint_key", "label")


@query(NODE + """, q_f AS (SELECT run_id, stable_key, count(*) AS n_facts_shown, min(execution_id) AS first_execution FROM b_fact GROUP BY ALL), q_r AS (SELECT run_id, stable_key, count(*) AS n_reviews, max_by(decision, seq) AS newest FROM b_review GROUP BY ALL)
SELECT n.run_id, n.stable_key, CAST(f.n_facts_shown AS INTEGER) AS n_facts, CAST(coalesce(r.n_reviews, 0) AS INTEGER) AS n_reviews, r.newest, CASE WHEN first_threshold <> 0 THEN 1 ELSE 0 END AS n_rules FROM q_node n JOIN q_f f USING (run_id, stable_key) LEFT JOIN q_r r USING (run_id, stable_key)""")
def qry20_node_detail(t: Tables) -> DataFrame:
    rules, _ = graph.build_assertions(t.nodes, t.node_evidence)
    out = projections.node_detail(t.nodes, t.facts, t.b_review, rules, contained(t), t.b_enrichment)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.select(*KEY, size("facts").alias("n_facts"), size("reviews").alias("n_reviews"), F.try_element_at("reviews", F.lit(1))["decision"].alias("newest"), size("rules").alias("n_rules"))


@query("""SELECT doc_id, evidence_id, place FROM (SELECT doc_id, doc_id || ':' || j AS evidence_id, row_number() OVER (PARTITION BY doc_id ORDER BY file_path, first_line, doc_id || ':' || j) AS place FROM b_cite) WHERE place <= 2""")
def qry21_evidence_of(t: Tables) -> DataFrame:
    ids = F.array(*[F.concat(F.col("doc_id"), F.lit(f":{j}")) for j in (2, 0, 1, 2)])
    subjects = t.b_source.where("text IS NOT NULL").select(F.lit("R1").alias("run_id"), F.col("doc_id").alias("subject"), ids.alias("evidence_ids"))
    e = t.b_cite.select(F.concat_ws(":", "doc_id", "j").alias("evidence_id"), "file_path", F.col("first_line").alias("start_line"))
    return projections.evidence_of(subjects, e, 2).select(F.col("subject").alias("doc_id"), "evidence_id", F.col("place").cast("long").alias("place"))


@query(NODE + """ SELECT run_id, stable_key, CASE WHEN owner_key LIKE 'customer:%' THEN 'class ' || substr(owner_key, 10) || ' {' END AS declaration FROM q_node WHERE kind <> 'TABLE'""")
def qry22_enclosing_declaration(t: Tables) -> DataFrame:
    """Customers as classes, nations and regions as packages."""
    owners = t.nodes.where("kind IN ('ENDPOINT', 'MODULE', 'COMPONENT')").select(
        "run_id", F.col("stable_key").alias("owner_key"), F.when(F.col("kind") == "ENDPOINT", "CLASS").otherwise("PACKAGE").alias("owner_kind"),
        F.concat(F.lit("// head\nclass "), F.substring_index("stable_key", ":", -1), F.lit(" {\n}")).alias("owner_snippet"), F.lit(1).alias("owner_start"), F.lit(3).alias("owner_end"),
    )
    own = t.nodes.where("kind <> 'TABLE'").select(*KEY)
    return projections.enclosing_declaration(own, t.nodes, owners).select(*KEY, "declaration")


@query("SELECT execution_id, line_number FROM b_line WHERE flaw BETWEEN 1 AND 7 ORDER BY execution_id, line_number LIMIT 40 OFFSET 7")
def qry23_quarantine_page(t: Tables) -> DataFrame:
    return projections.quarantine_page(t.b_line.where("flaw BETWEEN 1 AND 7"), 40, 7).select("execution_id", "line_number")


@query(ALL + " SELECT stable_key FROM q_all WHERE run_id = 'R1' AND unresolved = 1 ORDER BY stable_key LIMIT 100")
def qry23_unresolved_page(t: Tables) -> DataFrame:
    return projections.unresolved_page(t.all_nodes, "R1").select("stable_key")


@query("SELECT fact_id, execution_id FROM b_fact WHERE run_id = 'R2' ORDER BY kind, stable_key, fact_id, execution_id LIMIT 500")
def qry23_fact_page(t: Tables) -> DataFrame:
    return projections.fact_page(t.facts, "R2", 9999).select("fact_id", "execution_id")


@query("SELECT execution_id AS run_id FROM b_exec ORDER BY created_at DESC, execution_id DESC LIMIT 200")
def qry23_list_runs(t: Tables) -> DataFrame:
    return projections.list_runs(t.b_exec.select(F.col("execution_id").alias("run_id"), "created_at")).select("run_id")


def _marked(t: Tables) -> DataFrame:
    """Nodes with decision, title, and what badges and facets look at."""
    n = projections.latest_review(t.titled, t.b_review)
    return n.withColumns({"edited_title": F.when(F.col("decision") == "EDITED", F.lit("Edited")), "tested": F.col("stable_key").endswith("7"), "analyzers": F.when(F.col("kind") == "METHOD", F.array(F.lit("beta"))).otherwise(F.array(F.lit("alpha")))})


@query(ALL + """ SELECT n.run_id, n.stable_key, CASE r.decision WHEN 'EDITED' THEN 'Edited' ELSE substr(label, 1, 300) END AS shown,
  concat_ws(',', CASE WHEN unresolved = 1 THEN 'UNRESOLVED' END, CASE WHEN fact_conflict = 1 THEN 'FACT_CONFLICT' END, CASE WHEN e.title IS NOT NULL THEN 'AI_ENRICHED' END) AS badges
FROM q_all n LEFT JOIN q_review r USING (run_id, stable_key) LEFT JOIN q_title e USING (run_id, stable_key)""")
def qry26_node_badges(t: Tables) -> DataFrame:
    return projections.node_badges(_marked(t)).select(*KEY, "shown", F.array_join("badges", ",").alias("badges"))


@query(ALL + """ SELECT n.run_id, n.stable_key FROM q_all n LEFT JOIN q_review r USING (run_id, stable_key) WHERE r.decision IS NULL AND n.kind = 'VALIDATION_RULE' AND n.confidence < 0.7 AND n.stable_key NOT LIKE '%7'""")
def qry27_facet_filter(t: Tables) -> DataFrame:
    return projections.facet_filter(_marked(t), unreviewed=True, low_confidence=True, untested=True, business=True, analyzer="alpha").select(*KEY)


@query(EDGE + """ SELECT n.run_id, n.stable_key FROM q_node n SEMI JOIN b_enrichment e USING (run_id, stable_key) WHERE n.kind = 'ENDPOINT' AND contains(lower(n.owner_key || ' ' || n.stable_key), 'nation:1') AND CAST(substr(n.stable_key, 10) AS BIGINT) % 2 = 0""")
def qry30_endpoint_catalog(t: Tables) -> DataFrame:
    ends = t.nodes.where("kind = 'ENDPOINT'").withColumn("owner_key", S.prop(F.col("properties"), "ownerKey"))
    ends = ends.withColumn("method", F.when(F.substring_index("stable_key", ":", -1).cast("long") % 2 == 0, "GET").otherwise("POST"))
    return projections.endpoint_catalog(projections.controllers_rollup(ends, contained(t), t.b_enrichment), "Nation:1", ready_only=True, method="get").select(*KEY)


@query(SPANS + """ SELECT 1 AS upload, count(*) AS accepted, CAST(0 AS BIGINT) AS duplicate, CAST(0 AS BIGINT) AS conflict, count(node_key) AS matched, count(*) - count(node_key) AS unresolved FROM q_span
UNION ALL SELECT 2, 0, count(*) FILTER (WHERE event_id % 230 <> 0), count(*) FILTER (WHERE event_id % 230 = 0), 0, 0 FROM b_span WHERE upload = 2""")
def rt5_ingest_summary(t: Tables) -> DataFrame:
    keys = ["run_id", "trace_id", "span_id", "upload"]
    return runtime.ingest_summary(t.judged.join(t.matched.select(*keys, "node_key"), keys, "left"))


@query("""SELECT span_id, upload, sha256('{"name":"' || name || '","span_id":"' || span_id || '","value":' || CAST(CAST(event_id % 7 AS INTEGER) AS STRING) || '}') AS hash FROM b_span""")
def rt1_span_hash(t: Tables) -> DataFrame:
    own = t.b_span.withColumn("value", (F.col("event_id") % 7).cast("int"))
    return own.select("span_id", "upload", runtime.span_hash(["value", "span_id", "name"]).alias("hash"))
