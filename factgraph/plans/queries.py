"""One query for each operator that the driver's tables can feed, with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import semantics as S
from factgraph.functions import vocabulary as V
from factgraph.operators import diff, graph, projections, reach, reports, runtime, validate
from factgraph.plans.base import in_list as _in
from factgraph.plans.base import query
from factgraph.plans.tables import Tables
from factgraph.sources import corpus

#: Nodes, edges, latest reviews and titles in SQL; each uses those before it.
NODE = """WITH q_node AS MATERIALIZED (
  SELECT run_id, stable_key, CASE max(kind) WHEN 'DATA_READ' THEN 'DATABASE_READ' WHEN 'DATA_WRITE' THEN 'DATABASE_WRITE' ELSE max(kind) END AS kind,
    min(name) AS label, min(owner_key) AS owner_key, max(symbol) AS symbol, max(CASE WHEN analyzer = 'alpha' THEN threshold END) AS threshold,
    CASE WHEN count(DISTINCT threshold) > 1 THEN 1 ELSE 0 END AS fact_conflict, count(*) AS n_facts,
    CASE WHEN count(DISTINCT threshold) > 1 THEN 0.45 ELSE min(CASE origin WHEN 'STATIC_SYNTAX' THEN 0.75 ELSE 1.0 END) END AS confidence,
    CASE WHEN max(CASE WHEN analyzer = 'alpha' THEN 1 ELSE 0 END) = 0 THEN max(threshold) ELSE max(CASE WHEN analyzer = 'alpha' THEN threshold END) END AS first_threshold
  FROM b_fact WHERE kind <> 'RELATION' GROUP BY run_id, stable_key
)"""
EDGE = NODE + """,
q_end AS MATERIALIZED (
  SELECT run_id, source_key, target_key, edge_kind AS kind, confidence FROM b_fact WHERE kind = 'RELATION'
  UNION ALL SELECT run_id, owner_key, stable_key, 'CONTAINS', confidence FROM b_fact WHERE kind <> 'RELATION' AND owner_key <> ''
),
q_missing AS MATERIALIZED (
  SELECT DISTINCT run_id, stable_key FROM (SELECT run_id, source_key AS stable_key FROM q_end UNION ALL SELECT run_id, target_key FROM q_end) x
  ANTI JOIN q_node n ON n.run_id = x.run_id AND n.stable_key = x.stable_key
),
q_edge AS MATERIALIZED (
  SELECT e.run_id, e.source_key, e.target_key, e.kind, count(*) AS n_facts, CASE WHEN max(CASE WHEN m.stable_key IS NOT NULL OR o.stable_key IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 0.0 ELSE min(confidence) END AS confidence
  FROM q_end e LEFT JOIN q_missing m ON m.run_id = e.run_id AND m.stable_key = e.source_key LEFT JOIN q_missing o ON o.run_id = e.run_id AND o.stable_key = e.target_key GROUP BY e.run_id, e.source_key, e.target_key, e.kind
)"""
ALL = EDGE + """,
q_all AS MATERIALIZED (
  SELECT run_id, stable_key, kind, confidence, label, fact_conflict, 0 AS unresolved FROM q_node
  UNION ALL SELECT run_id, stable_key, 'UNRESOLVED_SYMBOL', 0.0, stable_key, 0, 1 FROM q_missing
),
q_review AS (SELECT run_id, stable_key, decision FROM b_review QUALIFY row_number() OVER (PARTITION BY run_id, stable_key ORDER BY seq DESC, decision DESC) = 1),
q_title AS (SELECT run_id, stable_key, title FROM b_enrichment QUALIFY row_number() OVER (PARTITION BY run_id, stable_key ORDER BY seq DESC, title DESC, description DESC) = 1)"""
PAIRS = NODE + """,
q_b AS (SELECT * FROM q_node WHERE run_id = 'R1'), q_a AS (SELECT * FROM q_node WHERE run_id = 'R2'),
q_one AS (SELECT b.stable_key AS before_key, a.stable_key AS after_key, 1 AS tier FROM q_b b JOIN q_a a ON a.stable_key = b.stable_key),
q_sym AS (SELECT kind, symbol, min(stable_key) AS after_key FROM q_a GROUP BY kind, symbol HAVING count(*) = 1),
q_two AS (
  SELECT min(b.stable_key) AS before_key, s.after_key, 2 AS tier FROM q_b b JOIN q_sym s ON s.kind = b.kind AND s.symbol = b.symbol
  WHERE b.stable_key NOT IN (SELECT before_key FROM q_one) AND s.after_key NOT IN (SELECT after_key FROM q_one) GROUP BY s.after_key
),
q_old AS (SELECT kind, first_threshold AS shape, min(stable_key) AS before_key FROM q_b GROUP BY ALL HAVING count(*) = 1),
q_new AS (SELECT kind, first_threshold AS shape, min(stable_key) AS after_key FROM q_a ANTI JOIN (SELECT stable_key AS sk FROM q_b) x ON x.sk = stable_key GROUP BY ALL HAVING count(*) = 1),
q_three AS (
  SELECT before_key, after_key, 3 AS tier FROM q_old JOIN q_new USING (kind, shape)
  WHERE before_key NOT IN (SELECT before_key FROM q_one UNION ALL SELECT before_key FROM q_two) AND after_key NOT IN (SELECT after_key FROM q_one UNION ALL SELECT after_key FROM q_two)
),
q_match AS MATERIALIZED (SELECT * FROM q_one UNION ALL SELECT * FROM q_two UNION ALL SELECT * FROM q_three)"""
SPANS = NODE + """,
q_first AS (SELECT * FROM b_span QUALIFY row_number() OVER (PARTITION BY run_id, trace_id, span_id ORDER BY upload) = 1),
q_symbol AS (SELECT symbol, count(*) AS n, min(stable_key) AS node_key FROM q_node WHERE run_id = 'R1' GROUP BY symbol),
q_span AS (
  SELECT s.run_id, s.trace_id, s.span_id, s.parent_span_id, s.start_nanos,
    CASE WHEN attr_stable_key IS NOT NULL THEN CASE WHEN n.stable_key IS NOT NULL THEN 'MATCHED_STABLE_KEY' ELSE 'UNRESOLVED' END
      WHEN attr_symbol LIKE '%::%' AND y.n = 1 THEN 'MATCHED_SYMBOL' WHEN attr_symbol LIKE '%::%' AND y.n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status,
    CASE WHEN attr_stable_key IS NOT NULL THEN n.stable_key WHEN y.n = 1 THEN y.node_key END AS node_key
  FROM q_first s LEFT JOIN q_node n ON n.run_id = 'R1' AND n.stable_key = s.attr_stable_key LEFT JOIN q_symbol y ON y.symbol = s.attr_symbol
)"""


@query(NODE + " SELECT run_id, stable_key, kind, fact_conflict, n_facts, CAST(round(confidence * 100) AS BIGINT) AS confidence FROM q_node")
def gb6_merge_nodes(t: Tables) -> DataFrame:
    return t.nodes.select("run_id", "stable_key", "kind", F.col("fact_conflict").cast("int").alias("fact_conflict"), "n_facts", F.round(F.col("confidence") * 100).cast("long").alias("confidence"))


def contained(t: Tables) -> DataFrame:
    """What entry points contain, in the shape of scenario members one step deep."""
    ends = t.nodes.where("kind = 'ENDPOINT'").select("run_id", F.col("stable_key").alias("source_key"))
    inside = t.edges.where("kind = 'CONTAINS'").join(ends, ["run_id", "source_key"], "left_semi")
    of = t.nodes.select("run_id", F.col("stable_key").alias("target_key"), F.col("kind").alias("member_kind"), "confidence")
    # a left join on the whole key of a grouping, which Spark leaves out for readers without evidence
    of = of.join(t.evidence_lists.withColumnRenamed("stable_key", "target_key"), ["run_id", "target_key"], "left")
    found = inside.select("run_id", "source_key", "target_key").join(of, ["run_id", "target_key"])
    flags = (F.lit(1).alias("depth"), (F.col("member_kind") == "CONDITION").alias("unresolved"), "confidence", "evidence_ids")
    return found.select("run_id", F.col("source_key").alias("entry_key"), F.col("target_key").alias("member_key"), F.col("member_kind").alias("kind"), *flags)


@query(EDGE + """, q_in AS (
  SELECT e.run_id, e.source_key, count(*) AS steps, count(*) FILTER (WHERE n.kind = 'CONDITION') AS unresolved FROM q_edge e
  JOIN q_node n ON n.run_id = e.run_id AND n.stable_key = e.target_key JOIN q_node o ON o.run_id = e.run_id AND o.stable_key = e.source_key AND o.kind = 'ENDPOINT' WHERE e.kind = 'CONTAINS' GROUP BY ALL
), q_told AS (SELECT DISTINCT run_id, stable_key FROM b_enrichment)
SELECT n.run_id, n.owner_key, count(*) AS endpoints, CAST(sum(coalesce(steps, 0)) AS BIGINT) AS steps, CAST(sum(coalesce(unresolved, 0)) AS BIGINT) AS unresolved,
  count(*) FILTER (WHERE t.stable_key IS NOT NULL) AS ready, count(*) FILTER (WHERE t.stable_key IS NULL AND coalesce(steps, 0) > 0) AS static_ready
FROM q_node n LEFT JOIN q_in i ON i.run_id = n.run_id AND i.source_key = n.stable_key LEFT JOIN q_told t ON t.run_id = n.run_id AND t.stable_key = n.stable_key
WHERE n.kind = 'ENDPOINT' GROUP BY n.run_id, n.owner_key""")
def qry19_controllers_rollup(t: Tables) -> DataFrame:
    """Endpoints by owner; what an endpoint contains stands for its steps, conditions among them for unresolved ones."""
    ends = t.nodes.where("kind = 'ENDPOINT'").withColumn("owner_key", S.prop(F.col("properties"), "ownerKey"))
    out = projections.controllers_rollup(ends, contained(t), t.b_enrichment)
    own = out.withColumn("unresolved", F.aggregate("endpoint_list", F.lit(0).cast("long"), lambda a, e: a + e["unresolved"]))
    return own.select("run_id", "owner_key", "endpoints", "steps", "unresolved", "ready", "static_ready")


@query("SELECT DISTINCT run_id, stable_key, fact_id, execution_id || '|' || fact_id AS evidence_id FROM b_fact WHERE kind <> 'RELATION'")
def gb6_node_links(t: Tables) -> DataFrame:
    """The facts and evidence of each node, joined where an evidence id names its fact."""
    said = F.substring_index("evidence_id", "|", -1)
    found = graph.node_evidence(t.facts).withColumn("fact_id", said)
    return found.join(t.node_facts, [*graph.RUN_KEY, "fact_id"]).select(*graph.RUN_KEY, "fact_id", "evidence_id")


@query(NODE + """ SELECT DISTINCT n.run_id, n.stable_key, count(DISTINCT f.threshold) AS n_alternatives FROM q_node n JOIN b_fact f ON f.run_id = n.run_id AND f.stable_key = n.stable_key AND f.kind <> 'RELATION'
WHERE n.fact_conflict = 1 AND f.threshold <> n.first_threshold GROUP BY n.run_id, n.stable_key""")
def gb6_fact_alternatives(t: Tables) -> DataFrame:
    return graph.fact_alternatives(t.facts, t.nodes).groupBy(*graph.RUN_KEY).agg(F.count("*").alias("n_alternatives"))


@query("""SELECT DISTINCT run_id, source_key, target_key, edge_kind AS kind, execution_id || '|' || fact_id AS evidence_id FROM b_fact WHERE kind = 'RELATION'
UNION SELECT run_id, owner_key, stable_key, 'CONTAINS', execution_id || '|' || fact_id FROM b_fact WHERE kind <> 'RELATION' AND owner_key <> ''""")
def gb11_edge_evidence(t: Tables) -> DataFrame:
    return t.edge_evidence


@query(EDGE + " SELECT run_id, source_key, target_key, kind, n_facts, CAST(round(confidence * 100) AS BIGINT) AS confidence FROM q_edge")
def gb11_merge_edges(t: Tables) -> DataFrame:
    return t.edges.select("run_id", "source_key", "target_key", "kind", "n_facts", F.round(F.col("confidence") * 100).cast("long").alias("confidence"))


@query(EDGE + " SELECT run_id, stable_key FROM q_missing")
def gb10_missing_nodes(t: Tables) -> DataFrame:
    return t.missing.select("run_id", "stable_key")


@query("SELECT run_id, kind, count(*) AS n FROM (SELECT run_id, edge_kind AS kind FROM b_fact WHERE kind = 'RELATION' UNION ALL SELECT run_id, 'CONTAINS' FROM b_fact WHERE kind <> 'RELATION' AND owner_key <> '') GROUP BY ALL")
def gb9_derive_edges(t: Tables) -> DataFrame:
    return t.edge_facts.groupBy("run_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT run_id, stable_key, fact_id, execution_id, row_number() OVER (PARTITION BY run_id, stable_key ORDER BY CASE origin WHEN 'STATIC_EXACT' THEN 0 WHEN 'STATIC_TYPED' THEN 1 ELSE 4 END, analyzer) AS place FROM b_fact")
def gb1_ordered_facts(t: Tables) -> DataFrame:
    # without their prints, which are made where facts have met
    return graph.ordered_facts(t.facts.drop("content", "behaves", "fingerprint")).select("run_id", "stable_key", "fact_id", "execution_id", F.col("place").cast("long").alias("place"))


@query(NODE + " SELECT run_id, stable_key, kind AS rule_kind, first_threshold AS threshold FROM q_node WHERE first_threshold <> 0")
def gb12_assertions(t: Tables) -> DataFrame:
    rules, _ = graph.build_assertions(t.nodes, t.node_evidence)
    return rules.select("run_id", "stable_key", "rule_kind", F.get_json_object("condition", "$.right.value").cast("int").alias("threshold"))


@query("""WITH q_x AS (
  SELECT *, outcome IN (1, 3) AS impact, cond = 2 AS plumbing, NOT (outcome IN (1, 3)) AND (cond IN (0, 2) OR kind = 'TECHNICAL_GUARD') AS technical, kind = 'AUTHORIZATION_RULE' OR cond = 4 AS auth FROM b_rule
), q_y AS (
  SELECT *, CASE WHEN technical THEN 'TECHNICAL_GUARD' WHEN auth THEN 'AUTHORIZATION_RULE' WHEN kind LIKE '%_RULE' THEN kind WHEN impact THEN 'BUSINESS_CONSTRAINT' ELSE 'UNKNOWN_RULE' END AS category,
    20 + CASE WHEN entered THEN 12 ELSE 0 END + CASE vocabulary WHEN 1 THEN 8 ELSE 0 END + CASE WHEN typed THEN 10 ELSE 0 END + CASE WHEN impact THEN 35 ELSE 0 END + CASE WHEN writes THEN 12 ELSE 0 END
    + CASE WHEN auth THEN 30 ELSE 0 END - CASE WHEN technical THEN 65 WHEN plumbing THEN 15 ELSE 0 END - CASE WHEN cond = 3 THEN 25 ELSE least(30, 10 * ambiguities) END AS points FROM q_x
)
SELECT k, category, CAST(greatest(0, least(100, points)) AS BIGINT) AS score, CASE WHEN cond = 3 OR category = 'UNKNOWN_RULE' THEN 45 WHEN category <> kind AND kind <> 'BUSINESS_RULE' THEN 85 ELSE 100 END AS ceiling FROM q_y""")
def gb4_classify_rules(t: Tables) -> DataFrame:
    """Rules of every shape: null checks, comparisons, log guards, texts and role checks, with outcomes that matter or not."""
    c, when = F.col, F.when
    null = '{"type":"BINARY","operator":"EQUAL","left":{"type":"REFERENCE"},"right":{"type":"LITERAL","value":null}}'
    less = '{"type":"BINARY","operator":"LESS_THAN","left":{"type":"REFERENCE"},"right":{"type":"LITERAL","value":5}}'
    trees = (null, less, '{"type":"CALL","method":"isDebugEnabled"}', '"a < b"', '{"type":"ROLE_CHECK"}')
    tree = when(c("cond") == 0, trees[0]).when(c("cond") == 1, trees[1]).when(c("cond") == 2, trees[2]).when(c("cond") == 3, trees[3]).otherwise(trees[4])
    outcome = when(c("outcome") == 1, '["REJECT"]').when(c("outcome") == 2, '[{"kind":"THROW","exception":"NullPointerException"}]').when(c("outcome") == 3, '[{"kind":"CONDITIONAL","falseOutcomes":["DENY"]}]').otherwise("[]")
    parts = [
        F.concat(F.lit('"condition":'), tree), F.concat(F.lit('"trueOutcomes":'), outcome), when(c("entered"), '"entryPointKey":"e"'), when(c("typed"), '"domainType":"D"'), when(c("writes"), '"dataWrites":["t"]'),
        when(c("vocabulary") == 1, '"businessVocabulary":true').when(c("vocabulary") == 2, '"businessVocabulary":"true"'),
        F.concat(F.lit('"ambiguities":['), F.array_join(F.array_repeat(F.lit("1"), c("ambiguities")), ","), F.lit("]")),
    ]
    rules = graph.assertion_ceiling(graph.classify_rules(t.b_rule.withColumn("properties", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))))
    return rules.select("k", "category", F.round(c("score") * 100).cast("long").alias("score"), F.round(c("ceiling") * 100).cast("int").alias("ceiling"))


@query("""SELECT e.evidence_id, CASE WHEN e.file_path LIKE '../%' THEN 'PATH_ESCAPE' WHEN s.doc_id IS NULL THEN 'SOURCE_NOT_REGULAR_FILE'
  WHEN start_line < 1 OR end_line < start_line OR end_line > len(lines) OR least(start_column, end_column) < 1 THEN 'INVALID_RANGE'
  WHEN list_max([octet_length(encode(x)) for x in list_slice(lines, 1, end_line)]) > 65536 THEN 'SOURCE_ENCODING_OR_LINE_LIMIT'
  WHEN start_column > length(lines[start_line]) + 1 OR end_column > length(lines[end_line]) + 1 THEN 'INVALID_COLUMN_RANGE'
  WHEN octet_length(encode(array_to_string(list_slice(lines, start_line, end_line), chr(10)))) > 65536 THEN 'SNIPPET_LIMIT'
  WHEN snippet_hash <> 'sha256:' || sha256(array_to_string(list_slice(lines, start_line, end_line), chr(10))) THEN 'SNIPPET_HASH_MISMATCH' ELSE 'OK' END AS reason
FROM b_evidence e LEFT JOIN b_source s USING (file_path)""")
def val5_check_evidence(t: Tables) -> DataFrame:
    return validate.check_evidence(t.b_evidence, t.b_source).select("evidence_id", F.coalesce("reason", F.lit("OK")).alias("reason"))


@query("""WITH q_first AS (SELECT run_id, fact_id, min(line_number * 10 + CASE analyzer WHEN 'alpha' THEN 0 ELSE 1 END) AS line FROM b_fact WHERE doc_key % 97 <> 5 GROUP BY run_id, fact_id),
q_x AS (SELECT f.run_id, f.fact_id, f.line_number * 10 + CASE analyzer WHEN 'alpha' THEN 0 ELSE 1 END AS line, f.threshold, f.kind, f.doc_key FROM b_fact f)
SELECT x.run_id, x.fact_id, x.line, CASE WHEN x.doc_key % 97 = 5 THEN 'INVALID_EVIDENCE' WHEN x.line = f.line THEN 'KEPT' ELSE 'DUPLICATE_ID_CONFLICT' END AS verdict
FROM q_x x LEFT JOIN q_first f ON f.run_id = x.run_id AND f.fact_id = x.fact_id LEFT JOIN q_x y ON y.run_id = f.run_id AND y.fact_id = f.fact_id AND y.line = f.line
WHERE x.doc_key % 97 = 5 OR x.line = f.line OR x.threshold <> y.threshold""")
def val6_dedup_facts(t: Tables) -> DataFrame:
    line = F.col("line_number") * 10 + F.when(F.col("analyzer") == "alpha", 0).otherwise(1)
    one = t.facts.select(F.col("run_id").alias("execution_id"), "fact_id", line.alias("line_number"), S.hash_bytes(F.col("fingerprint")).alias("fingerprint"), (F.col("doc_key") % 97 == 5).alias("bad"))
    judged = validate.judge_facts(one).where("verdict <> 'DUPLICATE'")
    return judged.select(F.col("execution_id").alias("run_id"), "fact_id", F.col("line_number").alias("line"), "verdict")


@query("""SELECT execution_id, fact_id, CASE WHEN contract_version <> '1.0' THEN 'CONTRACT_VERSION_MISMATCH' WHEN evidence_count NOT BETWEEN 1 AND 32 THEN 'EVIDENCE_REQUIRED_OR_LIMIT'
  WHEN confidence NOT BETWEEN 0 AND 1 OR trim(stable_key) = '' THEN 'INVALID_FACT_FIELDS'
  WHEN greatest(length(stable_key), length(fact_id), length(source_key), length(target_key), length(owner_key)) > 512 THEN 'FACT_KEY_LIMIT' ELSE 'OK' END AS reason FROM b_shape""")
def val2_fact_fields(t: Tables) -> DataFrame:
    return validate.check_fact_fields(t.b_shape).select("execution_id", "fact_id", F.coalesce("reason", F.lit("OK")).alias("reason"))


@query("SELECT execution_id, kind, count(*) AS n FROM b_fact GROUP BY ALL")
def ops4_facts_by_kind(t: Tables) -> DataFrame:
    return reports.facts_by_kind(t.facts)


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string").alias("evidence_fingerprint")
    shaped = t.stored_nodes.select("*", none)
    return tuple(shaped.where(F.col("run_id") == r).drop("run_id") for r in ("R1", "R2"))


@query(PAIRS + " SELECT before_key, after_key, tier FROM q_match")
def df1_match_nodes(t: Tables) -> DataFrame:
    return diff.match_nodes(*_runs(t))


@query(PAIRS + """, q_both AS (
  SELECT b.stable_key AS bk, a.stable_key AS ak, b.kind AS bkind, a.kind AS akind, b.owner_key AS bo, a.owner_key AS ao, b.symbol AS bs, a.symbol AS asy, b.first_threshold AS bt, a.first_threshold AS at_, b.confidence AS bc, a.confidence AS ac
  FROM q_match m JOIN q_b b ON b.stable_key = m.before_key JOIN q_a a ON a.stable_key = m.after_key
)
SELECT ak AS stable_key, 'RENAMED' AS change_type, 'NAME_CHANGED' AS impact FROM q_both WHERE ak <> bk
UNION ALL SELECT ak, 'MODIFIED', CASE WHEN bt <> at_ THEN 'THRESHOLD_CHANGED' ELSE 'BEHAVIOR_CHANGED' END FROM q_both WHERE bkind <> akind OR bt <> at_ OR bs <> asy OR bo <> ao
UNION ALL SELECT ak, 'CONFIDENCE_CHANGED', 'CONFIDENCE_CHANGED' FROM q_both WHERE bc <> ac
UNION ALL SELECT stable_key, 'REMOVED', kind || '_REMOVED' FROM q_b WHERE stable_key NOT IN (SELECT before_key FROM q_match)
UNION ALL SELECT stable_key, 'ADDED', kind || '_ADDED' FROM q_a WHERE stable_key NOT IN (SELECT after_key FROM q_match)""")
def df6_diff_nodes(t: Tables) -> DataFrame:
    before, after = _runs(t)
    return diff.diff_nodes(before, after, diff.match_nodes(before, after)).select("stable_key", "change_type", "impact")


@query(EDGE + """ SELECT source_key, target_key, kind,
  CASE WHEN max(run_id) = 'R1' THEN 'REMOVED' WHEN min(run_id) = 'R2' THEN 'ADDED' ELSE 'CONFIDENCE_CHANGED' END AS change_type
FROM q_edge GROUP BY source_key, target_key, kind HAVING count(*) = 1 OR min(confidence) <> max(confidence)""")
def df5_diff_edges(t: Tables) -> DataFrame:
    shaped = t.edges.withColumn("evidence_fingerprint", F.lit(None).cast("string"))
    return diff.diff_edges(shaped.where("run_id = 'R1'"), shaped.where("run_id = 'R2'")).select("source_key", "target_key", "kind", "change_type")


@query(PAIRS + """, q_review AS (SELECT stable_key, decision FROM b_review QUALIFY row_number() OVER (PARTITION BY stable_key ORDER BY seq DESC, decision DESC) = 1)
SELECT m.after_key AS stable_key, CASE WHEN b.kind = a.kind AND b.owner_key = a.owner_key AND b.symbol = a.symbol AND b.first_threshold = a.first_threshold THEN r.decision ELSE 'STALE' END AS decision
FROM q_review r JOIN q_match m ON m.before_key = r.stable_key JOIN q_b b ON b.stable_key = m.before_key JOIN q_a a ON a.stable_key = m.after_key""")
def df7_carry_reviews(t: Tables) -> DataFrame:
    before, after = _runs(t)
    latest = projections.latest(t.b_review.where("run_id = 'R1'"), "decision").drop("run_id")
    own = projections.latest(t.b_review.where("run_id = 'R2'"), "decision").drop("run_id")
    return diff.carry_reviews(latest, diff.match_nodes(before, after), before, after, own).select("stable_key", "decision")


SAME = "{0}.kind = {1}.kind AND {0}.owner_key = {1}.owner_key AND {0}.symbol = {1}.symbol AND {0}.first_threshold = {1}.first_threshold"


@query(
    PAIRS
    + f""", q_merge AS (SELECT 'order:' || o_orderkey AS stable_key, CASE WHEN o_orderkey % 4 = 0 THEN 'CONFIRMED' ELSE 'MERGED' END AS decision,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'order:' || (o_orderkey * 7 % 1009) END AS target, o_orderkey % 9 = 0 AS early FROM orders),
q_carry AS (
  SELECT m.after_key AS stable_key, r.decision, CASE WHEN {SAME.format("x", "y")} THEN r.target END AS merge_target, coalesce({SAME.format("b", "a")}, false) AND NOT r.early AND (r.target IS NULL OR coalesce({SAME.format("x", "y")}, false)) AS same
  FROM q_merge r JOIN q_match m ON m.before_key = r.stable_key JOIN q_b b ON b.stable_key = m.before_key JOIN q_a a ON a.stable_key = m.after_key
  LEFT JOIN q_b x ON x.stable_key = r.target LEFT JOIN q_a y ON y.stable_key = r.target
  WHERE m.after_key NOT IN (SELECT 'order:' || doc_id FROM labels)
)
SELECT stable_key, CASE WHEN same THEN decision ELSE 'STALE' END AS decision, merge_target, CASE WHEN NOT same THEN 'REVIEW_BECAME_STALE' END AS change_type FROM q_carry"""
)
def df7_carry_merges(t: Tables) -> DataFrame:
    """Reviews of all orders, most of them merged into another one that may have changed, gone or been renamed since."""
    before, after = _runs(t)
    k = F.col("o_orderkey")
    latest = t.table("orders").select(
        F.concat(F.lit("order:"), k).alias("stable_key"),
        F.when(k % 4 == 0, "CONFIRMED").otherwise("MERGED").alias("decision"),
        F.when(k % 4 != 0, F.concat(F.lit("order:"), k * 7 % 1009)).alias("merge_target"),
        F.when(k % 9 == 0, "of an earlier text").alias("fingerprint"),
    )
    own = t.table("labels").select(F.concat(F.lit("order:"), "doc_id").alias("stable_key"))
    return diff.carry_reviews(latest, diff.match_nodes(before, after), before, after, own)


#: For each remainder of doc_id by 12: a property that changes between two runs, and what that means.
TURNS = ["", "operator", "threshold", *(key for key, _ in V.IMPACT_KEYS)]


def _told(turn: str, run: int) -> str:
    """SQL of a node's properties in one of two runs over documents."""
    operator, value = ("GREATER_THAN" if run and turn == "operator" else "LESS_THAN"), (300 if run and turn == "threshold" else 500)
    more = f',"{turn}":"run {run}"' if turn in dict(V.IMPACT_KEYS) else f',"other":"run {run}"' if turn == "other" else ""
    return f"""'{{"normalizedCondition":{{"type":"COMPARISON","operator":"{operator}","right":{{"type":"LITERAL","value":{value}}}}}{more},"filePath":"'"""


def _states(run: int) -> str:
    turns = [*TURNS, "other"]
    props = "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN {_told(x, run)}" for k, x in enumerate(turns)) + f" ELSE {_told('', run)} END"
    path = "CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE 'src/' END" if run else "'src/'"
    text = "CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END" if run else "text"
    return f"SELECT 'doc:' || doc_id AS stable_key, 'METHOD' AS kind, {props} || {path} || doc_id || '\"}}' AS properties, CASE WHEN doc_id % 11 = {run} THEN 0.5 ELSE 0.9 END AS confidence, {text} AS cited FROM documents"


IMPACTS = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(["", "OPERATOR_CHANGED", "THRESHOLD_CHANGED", *(name for _, name in V.IMPACT_KEYS), "BEHAVIOR_CHANGED"]) if k)


@query(f"""WITH q_pair AS (SELECT b.stable_key, CAST(substr(b.stable_key, 5) AS BIGINT) AS k, b.properties AS bp, a.properties AS ap, b.confidence AS bc, a.confidence AS ac, b.cited AS bt, a.cited AS at_ FROM ({_states(0)}) b JOIN ({_states(1)}) a ON a.stable_key = b.stable_key)
SELECT stable_key, 'MOVED' AS change_type, 'SOURCE_MOVED' AS impact FROM q_pair WHERE bp LIKE '%"filePath":"src/%' AND ap LIKE '%"filePath":"moved/%'
UNION ALL SELECT stable_key, 'MODIFIED', CASE k % 12 {IMPACTS} END FROM q_pair WHERE split_part(bp, ',"filePath"', 1) <> split_part(ap, ',"filePath"', 1)
UNION ALL SELECT stable_key, 'CONFIDENCE_CHANGED', 'CONFIDENCE_CHANGED' FROM q_pair WHERE bc <> ac
UNION ALL SELECT stable_key, 'EVIDENCE_CHANGED', 'SOURCE_EVIDENCE_CHANGED' FROM q_pair WHERE bt <> at_""")
def df2_compare_pairs(t: Tables) -> DataFrame:
    """Every kind of change and impact, between two runs whose nodes cite the documents."""
    t.table("documents").createOrReplaceTempView("documents_of_runs")
    shaped = []
    for run in (0, 1):
        found = t.spark.sql(_states(run).replace("FROM documents", "FROM documents_of_runs"))
        prints = F.sha2("cited", 256).alias("evidence_fingerprint")
        shaped.append(found.select("stable_key", "kind", "properties", F.col("confidence").cast("double").alias("confidence"), S.fingerprint(F.col("kind"), F.col("properties")).alias("fingerprint"), S.structural(F.col("kind"), F.col("properties")).alias("structural_fingerprint"), prints))
    return diff.diff_nodes(*shaped, diff.match_nodes(*shaped)).select("stable_key", "change_type", "impact")


@query(ALL + " SELECT n.run_id, n.stable_key, coalesce(r.decision, 'UNREVIEWED') AS decision FROM q_all n LEFT JOIN q_review r ON r.run_id = n.run_id AND r.stable_key = n.stable_key")
def qry1_latest_review(t: Tables) -> DataFrame:
    return projections.latest_review(t.all_nodes, t.b_review).select("run_id", "stable_key", "decision")


@query(ALL + " SELECT n.run_id, n.stable_key, e.title FROM q_all n JOIN q_title e ON e.run_id = n.run_id AND e.stable_key = n.stable_key")
def qry2_latest_enrichment(t: Tables) -> DataFrame:
    return t.titled.where("title IS NOT NULL").select("run_id", "stable_key", "title")


@query(ALL + f" SELECT n.run_id, n.stable_key FROM q_all n LEFT JOIN q_review r ON r.run_id = n.run_id AND r.stable_key = n.stable_key WHERE n.kind IN {_in(V.VIEW_KINDS['BUSINESS'])} AND coalesce(r.decision, '') NOT IN {_in(V.HIDDEN_DECISIONS)}")
def qry6_business_view(t: Tables) -> DataFrame:
    return projections.hide_rejected(projections.lod_filter(projections.view_filter(t.all_nodes, "BUSINESS"), 3, "BUSINESS"), t.b_review).select("run_id", "stable_key")


@query(ALL + """ SELECT stable_key, total, 1 AS truncated FROM (SELECT stable_key, row_number() OVER (ORDER BY CASE kind WHEN 'COMPONENT' THEN 0 WHEN 'MODULE' THEN 1 WHEN 'BUSINESS_SCENARIO' THEN 2 WHEN 'ENDPOINT' THEN 3 ELSE CASE WHEN kind IN ('CONDITION', 'VALIDATION_RULE') THEN 4 ELSE 5 END END, stable_key) AS place, count(*) OVER () AS total FROM q_all WHERE run_id = 'R1') WHERE place <= 250""")
def qry12_bounded_page(t: Tables) -> DataFrame:
    return projections.bounded_page(projections.projection_filter(t.all_nodes, "R1"), 2).select("stable_key", "total", F.col("truncated").cast("int").alias("truncated"))


@query(EDGE + " SELECT source_key, target_key, kind FROM q_edge e JOIN q_node a ON a.run_id = e.run_id AND a.stable_key = e.source_key JOIN q_node b ON b.run_id = e.run_id AND b.stable_key = e.target_key WHERE e.run_id = 'R1' AND a.kind IN ('COMPONENT', 'MODULE', 'ENDPOINT') AND b.kind IN ('COMPONENT', 'MODULE', 'ENDPOINT') ORDER BY e.run_id, source_key, target_key, e.kind LIMIT 2000".replace("SELECT source_key, target_key, kind FROM", "SELECT e.source_key, e.target_key, e.kind FROM"))
def qry13_induced_edges(t: Tables) -> DataFrame:
    chosen = projections.lod_filter(t.nodes.where("run_id = 'R1'"), 1, "BUSINESS")
    return projections.induced_edges(t.edges, chosen).select("source_key", "target_key", "kind")


@query(ALL + f""" SELECT n.run_id, n.stable_key, coalesce(r.decision, 'UNREVIEWED') AS decision FROM q_all n LEFT JOIN q_review r ON r.run_id = n.run_id AND r.stable_key = n.stable_key
WHERE n.kind IN {_in((*V.RULE_KINDS, 'BUSINESS_SCENARIO'))} AND coalesce(r.decision, 'UNREVIEWED') IN ('UNREVIEWED', 'NEEDS_REVIEW', 'STALE') ORDER BY n.confidence, n.run_id, n.stable_key LIMIT 200""")
def qry24_review_queue(t: Tables) -> DataFrame:
    return projections.review_queue(t.all_nodes, t.b_review).select("run_id", "stable_key", "decision")


@query(ALL + " SELECT stable_key, kind FROM q_all WHERE run_id = 'R2' AND contains(lower(label || ' ' || stable_key), 'er:1') ORDER BY stable_key LIMIT 200")
def qry25_search_nodes(t: Tables) -> DataFrame:
    return projections.search_nodes(t.all_nodes, "R2", "ER:1").select("stable_key", "kind")


@query(ALL + f""" SELECT n.run_id, count(*) AS nodes, count(*) FILTER (WHERE kind IN {_in(V.RULE_KINDS)}) AS rules, count(*) FILTER (WHERE kind IN ('DATABASE_READ', 'DATABASE_WRITE')) AS data_effects,
count(*) FILTER (WHERE confidence < 0.7 OR unresolved = 1) AS risks, count(e.title) AS enriched, count(*) FILTER (WHERE kind <> 'TABLE') AS grounded, CAST(floor(count(*) FILTER (WHERE kind <> 'TABLE') * 100 / count(*)) AS BIGINT) AS grounded_percent FROM q_all n LEFT JOIN q_title e ON e.run_id = n.run_id AND e.stable_key = n.stable_key GROUP BY n.run_id""")
def qry28_overview_metrics(t: Tables) -> DataFrame:
    # tables stand for nodes that have lost their evidence
    return projections.overview_metrics(t.titled.withColumn("n_evidence", F.when(F.col("kind") != "TABLE", F.col("n_evidence"))))


@query(ALL + """ SELECT n.run_id, n.stable_key, CASE WHEN e.title IS NULL THEN 0 ELSE 5 END + 10 * (CASE WHEN contains(lower(label || ' ' || n.stable_key || ' ' || kind || coalesce(' ' || title, '')), 'urgent') THEN 1 ELSE 0 END + CASE WHEN contains(lower(label || ' ' || n.stable_key || ' ' || kind || coalesce(' ' || title, '')), 'the') THEN 1 ELSE 0 END) + CAST(floor(confidence * 10) AS INTEGER) AS score
FROM q_all n LEFT JOIN q_title e ON e.run_id = n.run_id AND e.stable_key = n.stable_key WHERE contains(lower(label || ' ' || n.stable_key || ' ' || kind || coalesce(' ' || title, '')), 'urgent') OR contains(lower(label || ' ' || n.stable_key || ' ' || kind || coalesce(' ' || title, '')), 'the')""")
def qry29_rank_insights(t: Tables) -> DataFrame:
    return projections.rank_insights(t.titled, ["urgent", "the"]).select("run_id", "stable_key", "score")


@query("SELECT upload, run_id, trace_id, span_id, CASE WHEN upload = 1 THEN 'new' WHEN event_id % 230 = 0 AND name = 'changed' THEN 'conflict' ELSE 'duplicate' END AS verdict FROM b_span")
def rt2_dedup_spans(t: Tables) -> DataFrame:
    return t.judged.select("upload", "run_id", "trace_id", "span_id", "verdict")


@query(SPANS + " SELECT trace_id, span_id, status, node_key FROM q_span")
def rt3_match_spans(t: Tables) -> DataFrame:
    return t.matched.select("trace_id", "span_id", "status", "node_key")


@query(SPANS + " SELECT run_id, trace_id, span_id, node_key, status FROM q_span WHERE node_key IS NOT NULL")
def rt4_observations(t: Tables) -> DataFrame:
    return runtime.observations(t.matched)


@query(SPANS + " SELECT run_id, count(*) AS spans, count(DISTINCT trace_id) AS traces, count(node_key) AS matched, count(*) - count(node_key) AS unmatched, count(DISTINCT node_key) AS observed_nodes FROM q_span GROUP BY run_id")
def rt6_runtime_summary(t: Tables) -> DataFrame:
    return runtime.runtime_summary(t.matched)


@query(SPANS + " SELECT DISTINCT c.run_id, p.node_key AS parent_node, c.node_key AS child_node FROM q_span c JOIN q_span p ON p.run_id = c.run_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE c.node_key IS NOT NULL AND p.node_key IS NOT NULL")
def rt7_observed_paths(t: Tables) -> DataFrame:
    return runtime.observed_paths(t.matched)


@query(SPANS + " SELECT stable_key AS node_key FROM q_node WHERE run_id = 'R1' AND stable_key NOT IN (SELECT node_key FROM q_span WHERE node_key IS NOT NULL)")
def rt8_unobserved_nodes(t: Tables) -> DataFrame:
    return runtime.unobserved_nodes(t.span_nodes, t.matched.where("node_key IS NOT NULL")).select("node_key")


@query(SPANS + """, q_path AS (SELECT DISTINCT c.run_id, p.node_key AS parent_node, c.node_key AS child_node FROM q_span c JOIN q_span p ON p.run_id = c.run_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE c.node_key IS NOT NULL AND p.node_key IS NOT NULL)
SELECT run_id, parent_node, child_node, row_number() OVER w AS place, count(*) OVER (PARTITION BY run_id) > 500 AS truncated FROM q_path WINDOW w AS (PARTITION BY run_id ORDER BY parent_node, child_node) QUALIFY row_number() OVER w <= 500""")
def rt7_path_page(t: Tables) -> DataFrame:
    return runtime.path_page(runtime.observed_paths(t.matched))


@query(SPANS + " SELECT run_id, kind, count(*) AS nodes, count(*) FILTER (WHERE stable_key NOT IN (SELECT node_key FROM q_span WHERE node_key IS NOT NULL)) AS unobserved FROM q_node WHERE run_id = 'R1' GROUP BY 1, 2")
def rt8_unobserved_count(t: Tables) -> DataFrame:
    return runtime.unobserved_count(t.nodes.where("run_id = 'R1'").select("run_id", F.col("stable_key").alias("node_key"), "kind"), t.matched.where("node_key IS NOT NULL"))


@query("SELECT trace_id, span_id, row_number() OVER (ORDER BY start_nanos, trace_id, span_id) - 10 AS place FROM b_span WHERE upload = 1 ORDER BY start_nanos, trace_id, span_id LIMIT 50 OFFSET 10")
def rt9_span_page(t: Tables) -> DataFrame:
    return runtime.span_page(t.spans.where("upload = 1"), 50, 10).select("trace_id", "span_id", F.col("place").cast("long").alias("place"))


@query("""SELECT t.task_id FROM b_task t, (SELECT max(created_at) AS m FROM b_task) WHERE status = 'PENDING' AND created_at + INTERVAL 1 DAY <= m AND task_id % 5 < 3 AND run_id <> 'R3'
AND NOT EXISTS (SELECT 1 FROM b_task d WHERE d.task_id = t.depends_on AND (d.status IN ('PENDING', 'RUNNING') OR NOT t.accept_failed AND d.status <> 'SUCCEEDED'))""")
def ops6_ready_tasks(t: Tables) -> DataFrame:
    """Tasks are due a day after they were made, have three attempts, and run R3 has ended."""
    at = t.b_task.agg(F.max("created_at").alias("now"))  # one row, by its aggregate
    more = {"available_at": F.col("created_at") + F.expr("INTERVAL 1 DAY"), "attempt": F.col("task_id") % 5, "max_attempts": F.lit(3)}
    tasks = t.b_task.withColumns(more).join(F.broadcast(at))
    active = t.b_task.where("run_id <> 'R3'").select("run_id").distinct()
    return reports.ready_tasks(tasks, t.b_task.select("task_id", "depends_on"), active, F.col("now")).select("task_id")


@query("""WITH m AS (SELECT max(created_at) AS m FROM b_task), c AS (SELECT created_at, task_id % 1000 AS i, task_id % 300 AS o, (task_id % 50) * 0.25 AS cost, task_id % 7 AS l FROM b_task WHERE status = 'RUNNING')
SELECT count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'RUNNING') AS running,
  round(avg(seconds) FILTER (WHERE created_at > m - INTERVAL 1 HOUR AND task_id % 2 = 0), 6) AS analyzer_seconds, count(*) FILTER (WHERE status = 'FAILED_PERMANENTLY' AND created_at > m - INTERVAL 1 HOUR AND task_id % 2 = 0) AS analyzer_failed,
  (SELECT CAST(sum(i) AS BIGINT) FROM c, m WHERE created_at > m - INTERVAL 1 HOUR) AS input_tokens, (SELECT CAST(sum(o) AS BIGINT) FROM c, m WHERE created_at > m - INTERVAL 1 HOUR) AS output_tokens,
  (SELECT CAST(sum(cost) AS DOUBLE) FROM c, m WHERE created_at > m - INTERVAL 1 HOUR) AS cost, (SELECT round(avg(l), 6) FROM c, m WHERE created_at > m - INTERVAL 1 HOUR) AS latency FROM b_task, m""")
def ops7_last_hour_metrics(t: Tables) -> DataFrame:
    """Even tasks ran an analyzer; running ones stand for calls of a model."""
    at = t.b_task.agg(F.max("created_at").alias("now"))  # one row, by its aggregate
    tasks = t.b_task.withColumns({"finished_at": F.col("created_at"), "task_type": F.when(F.col("task_id") % 2 == 0, "RUN_ANALYZER").otherwise("OTHER")})
    i = F.col("task_id")
    calls = t.b_task.where("status = 'RUNNING'").select("created_at", (i % 1000).alias("input_tokens"), (i % 300).alias("output_tokens"), (i % 50 * 0.25).alias("cost"), (i % 7).alias("latency_ms"))
    out = reports.last_hour_metrics(tasks.join(F.broadcast(at)), F.col("now"), calls.join(F.broadcast(at)))
    return out.withColumns({c: F.round(c, 6) for c in ("analyzer_seconds", "latency")})


@query("SELECT split_part(path, '/', 1) AS area, count(*) AS files, sum(octet_length(encode(text))) AS bytes FROM b_file GROUP BY 1")
def src9_file_inventory(t: Tables) -> DataFrame:
    return corpus.area_rollup(corpus.file_inventory(t.b_file.select("path", F.col("text"), F.encode("text", "UTF-8").alias("content")))).select("area", "files", "bytes")


@query(EDGE + """, q_vis AS MATERIALIZED ((SELECT run_id, stable_key FROM q_node WHERE run_id = 'R1' AND kind = 'ENDPOINT' ORDER BY stable_key LIMIT 125) UNION ALL (SELECT run_id, stable_key FROM q_node WHERE run_id = 'R1' AND kind = 'TABLE' ORDER BY stable_key LIMIT 125)), q_way AS MATERIALIZED (SELECT DISTINCT e.run_id, e.source_key, e.target_key, e.kind, v.stable_key IS NOT NULL AS shown FROM q_edge e LEFT JOIN q_vis v ON v.run_id = e.run_id AND v.stable_key = e.target_key),
q_w1 AS (SELECT DISTINCT w.run_id, w.source_key, w.target_key AS at_, w.kind FROM q_way w JOIN q_vis v ON v.run_id = w.run_id AND v.stable_key = w.source_key WHERE NOT shown),
q_w2 AS (SELECT DISTINCT a.run_id, a.source_key, b.target_key AS at_, a.kind, b.shown FROM q_w1 a JOIN q_way b ON b.run_id = a.run_id AND b.source_key = a.at_),
q_w3 AS (SELECT DISTINCT a.run_id, a.source_key, b.target_key AS at_, a.kind, b.shown FROM q_w2 a JOIN q_way b ON b.run_id = a.run_id AND b.source_key = a.at_ WHERE NOT a.shown),
q_w4 AS (SELECT DISTINCT a.run_id, a.source_key, b.target_key AS at_, a.kind, b.shown FROM q_w3 a JOIN q_way b ON b.run_id = a.run_id AND b.source_key = a.at_ WHERE NOT a.shown),
q_w5 AS (SELECT DISTINCT a.run_id, a.source_key, b.target_key AS at_, a.kind, b.shown FROM q_w4 a JOIN q_way b ON b.run_id = a.run_id AND b.source_key = a.at_ WHERE NOT a.shown),
q_pair AS (SELECT DISTINCT run_id, source_key, at_ AS target_key FROM (SELECT * FROM q_w2 UNION ALL SELECT * FROM q_w3 UNION ALL SELECT * FROM q_w4 UNION ALL SELECT * FROM q_w5) WHERE shown AND source_key <> at_)
SELECT p.run_id, p.source_key, p.target_key FROM q_pair p WHERE NOT EXISTS (SELECT 1 FROM q_way w WHERE w.run_id = p.run_id AND w.source_key = p.source_key AND w.target_key = p.target_key) ORDER BY 1, 2, 3 LIMIT 200""")
def qry14_lifted_edges(t: Tables) -> DataFrame:
    shown = t.nodes.where("run_id = 'R1'").select("run_id", "stable_key", "kind")
    page = projections.page(shown.where("kind = 'ENDPOINT'"), ["stable_key"], 125).union(projections.page(shown.where("kind = 'TABLE'"), ["stable_key"], 125))
    return reach.lifted_edges(page, t.edges).select("run_id", "source_key", "target_key")


def _search(depth: int = 8, most: int = 120) -> str:
    """SQL of the whole breadth-first search, a few views a level: q_member, and q_cut, the scenarios that budgets cut."""
    out = ALL + f""",
q_way AS MATERIALIZED (
  SELECT e.run_id, e.source_key, e.target_key, e.kind AS edge_kind, e.confidence AS edge_confidence, row_number() OVER (PARTITION BY e.run_id, e.source_key ORDER BY e.target_key, e.kind) AS turn
  FROM q_edge e SEMI JOIN q_all n ON n.run_id = e.run_id AND n.stable_key = e.target_key WHERE e.kind IN {_in(V.TRAVERSABLE)}
),
q_member0 AS MATERIALIZED (SELECT run_id, stable_key AS entry_key, stable_key AS member_key, kind, 0 AS depth, CAST(1 AS BIGINT) AS position, confidence, unresolved FROM q_all WHERE kind IN {_in(V.ENTRY_KINDS)})"""
    for d in range(depth + 1):
        seen = " UNION ALL ".join(f"SELECT run_id, entry_key, member_key FROM q_member{k}" for k in range(d + 1))
        out += f""",
q_step{d} AS MATERIALIZED (
  SELECT l.run_id, l.entry_key, l.position AS parent, l.confidence AS path_confidence, w.* EXCLUDE (run_id, source_key) FROM q_member{d} l JOIN q_way w ON w.run_id = l.run_id AND w.source_key = l.member_key
  WHERE l.unresolved = 0 {f"AND l.kind NOT IN {_in(V.ASYNC_KINDS)}" if d else ""}
),
q_seen{d} AS MATERIALIZED ({seen}),
q_next{d} AS MATERIALIZED (
  SELECT f.run_id, f.entry_key, f.target_key AS member_key, n.kind, n.unresolved, least(f.path_confidence, f.edge_confidence, n.confidence) AS confidence,
    z.size + row_number() OVER (PARTITION BY f.run_id, f.entry_key ORDER BY parent, target_key, edge_kind) AS position
  FROM (SELECT s.* FROM q_step{d} s ANTI JOIN q_seen{d} m ON m.run_id = s.run_id AND m.entry_key = s.entry_key AND m.member_key = s.target_key WHERE turn <= {most + 1}
    QUALIFY row_number() OVER (PARTITION BY s.run_id, s.entry_key, s.target_key ORDER BY parent, edge_kind) = 1) f
  JOIN q_all n ON n.run_id = f.run_id AND n.stable_key = f.target_key JOIN (SELECT run_id, entry_key, count(*) AS size FROM q_seen{d} GROUP BY ALL) z ON z.run_id = f.run_id AND z.entry_key = f.entry_key
  WHERE n.kind <> 'TECHNICAL_GUARD'
),
q_cut{d} AS (SELECT run_id, entry_key FROM q_step{d} WHERE turn > {most} UNION SELECT run_id, entry_key FROM q_next{d} {f"WHERE position > {most}" if d < depth else ""})"""
        if d < depth:
            out += f""",
q_member{d + 1} AS MATERIALIZED (SELECT run_id, entry_key, member_key, kind, {d + 1} AS depth, position, confidence, unresolved FROM q_next{d} WHERE position <= {most})"""
    union = {x: f" {how} ".join(f"SELECT * FROM q_{x}{k}" for k in range(depth + 1)) for x, how in (("member", "UNION ALL"), ("cut", "UNION"))}
    return out + f", q_member AS MATERIALIZED ({union['member']}), q_cut AS MATERIALIZED ({union['cut']})"


SEARCH = _search()


@query(SEARCH + " SELECT run_id, entry_key, member_key, kind, depth, position, CAST(round(confidence * 100) AS BIGINT) AS confidence FROM q_member")
def sc1_scenario_members(t: Tables) -> DataFrame:
    """By the budgets of a run."""
    return t.members.select("run_id", "entry_key", "member_key", "kind", "depth", "position", F.round(F.col("confidence") * 100).cast("long").alias("confidence"))


#: An entry's properties by its customer, in both engines' SQL.
SAID = """'{"actors":["' || c_mktsegment || '"]' || CASE WHEN c_custkey % 3 = 0 THEN ',"inputContract":{"nation":' || c_nationkey || '}' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ',"preconditions":["known"]}' ELSE '}' END"""


@query(
    SEARCH
    + f""", q_kind AS (SELECT run_id, entry_key, kind, min(position) AS first, kind || '=' || string_agg(member_key, ',' ORDER BY position) AS own FROM q_member GROUP BY run_id, entry_key, kind),
q_kinds AS (SELECT run_id, entry_key, CAST(count(*) AS BIGINT) AS n_kinds, sha256(string_agg(own, ';' ORDER BY first)) AS members FROM q_kind GROUP BY ALL),
q_sum AS (
  SELECT run_id, entry_key, CAST(round(min(x.confidence) * 100) AS BIGINT) AS confidence, count(*) FILTER (WHERE x.unresolved = 1) AS n_unresolved, coalesce(string_agg(member_key, ',' ORDER BY position) FILTER (WHERE x.unresolved = 1), '') AS unresolved,
    count(*) FILTER (WHERE kind IN {_in(V.ASYNC_KINDS)} AND depth > 0 AND x.unresolved = 0) AS n_async FROM q_member x GROUP BY run_id, entry_key
)
SELECT s.*, k.n_kinds, k.members, c.run_id IS NOT NULL AS truncated, '["' || c_mktsegment || '"]' AS actors, CASE WHEN c_custkey % 3 = 0 THEN '{{"nation":' || c_nationkey || '}}' ELSE '{{}}' END AS input_contract, CASE WHEN c_custkey % 5 = 0 THEN '["known"]' ELSE '[]' END AS preconditions
FROM q_sum s JOIN q_kinds k ON k.run_id = s.run_id AND k.entry_key = s.entry_key LEFT JOIN q_cut c ON c.run_id = s.run_id AND c.entry_key = s.entry_key JOIN customer ON 'customer:' || c_custkey = s.entry_key"""
)
def sc3_scenario_model(t: Tables) -> DataFrame:
    """Members by kind in the order of their discovery, as a hash; entries are customers, who state their own contract."""
    customers = t.table("customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("stable_key"), F.expr(SAID).alias("properties"))
    entries = t.members.where("depth = 0").select("run_id", F.col("entry_key").alias("stable_key")).join(customers, "stable_key")
    model = reach.scenario_model(t.members, t.scenario_flags, entries)
    sizes = [F.size(c).cast("long").alias(f"n_{n}") for c, n in (("async_boundaries", "async"), ("unresolved", "unresolved"), ("members_by_kind", "kinds"))]
    told = F.array_join(F.transform(F.map_entries("members_by_kind"), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], ","))), ";")
    lost = F.array_join("unresolved", ",").alias("unresolved")
    return model.select("run_id", "entry_key", *sizes, F.round(F.col("confidence") * 100).cast("long").alias("confidence"), "truncated", F.sha2(told, 256).alias("members"), lost, *reach.FROM_ENTRY)
