"""Queries on odd values, and what their plans write and shuffle."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from factgraph.functions import semantics as S
from factgraph.operators import diff, graph, projections, reach, runtime
from factgraph.plans import registry as queries
from factgraph.plans import tables
from factgraph.sources import corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    """A folder with the tables of sf0.001, of which some may be written anew."""

    def make(**sql):
        for f in os.listdir(SF):
            name = f.removesuffix(".parquet")
            if name in sql:
                duckdb.sql(f"COPY ({sql[name].format(own=f"'{SF}/{f}'")}) TO '{tmp_path}/{f}' (FORMAT parquet)")
            else:
                os.symlink(f"{SF}/{f}", tmp_path / f)
        return str(tmp_path)

    return make


def same_rows(spark, sf, name):
    got, c = queries.QUERIES[name](spark, sf), duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    found = c.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(str(dict(zip(names, r))[k]) for k in sorted(names)) for r in found.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(str(r[k]) for k in sorted(names)) for r in got.collect()) == want


def test_prices_within_one_of_each_other(spark, folder):
    """As call lines they are rounded, not cut: 100.4 comes before 100.6, whatever their files."""
    price = "l_linenumber, 100 + (l_linenumber * 0.4) % 1 + CASE WHEN l_linenumber = 5 THEN 0.5 ELSE 0 END"
    sf = folder(lineitem=f"SELECT * REPLACE ({price.split(', ', 1)[1]} AS l_extendedprice) FROM {{own}}")
    same_rows(spark, sf, "qry15_pipeline_spine")


def test_readers_of_nodes_make_no_relations(spark, folder):
    """Nor is the table of all facts written for readers of some."""
    sf = folder()
    for name in ("gb6_merge_nodes", "gb2_with_provenance", "gb12_assertions", "rt6_runtime_summary"):
        df = queries.QUERIES[name](spark, sf)
        df.collect()
        assert not [f for f in df.inputFiles() if "lineitem" in f], name
    queries.QUERIES["ops4_facts_by_kind"](spark, sf).collect()
    assert {k[2] for k in tables._written if k[1] == sf} == {"matched"}


def test_odd_and_repeated_relations(spark, folder):
    """Flags beside A and N, none, and lines that say the same again."""
    sf = folder(lineitem="SELECT * REPLACE (CASE l_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'X' ELSE l_returnflag END AS l_returnflag) FROM (SELECT * FROM {own} UNION ALL SELECT * FROM {own} WHERE l_orderkey % 3 = 0)")
    for name in ("gb11_merge_edges", "gb10_missing_nodes", "val6_dedup_facts"):
        same_rows(spark, sf, name)


def test_hashes_as_bytes_keep_their_order(spark):
    """And texts that are no hashes are believed in their own order."""
    facts = [("r", "k", f"f{i}", p) for i, p in enumerate(("sha256:" + "0f" * 32, "sha256:" + "a0" * 32, "odd", "sha256:short"))]
    df = spark.createDataFrame([("r", "e", "a", "STATIC_EXACT", 1.0, "METHOD", k, "f", "{}", ["x"], p, i, p) for i, (_, k, _, p) in enumerate(facts)], "run_id string, execution_id string, analyzer string, origin string, confidence double, kind string, stable_key string, fact_id string, properties string, evidence_ids array<string>, fingerprint string, n int, behaves string")
    places = {r.fingerprint: r.place for r in graph.ordered_facts(df).collect()}
    assert sorted(places.values()) == [1, 2, 3, 4] and places["sha256:" + "0f" * 32] < places["sha256:" + "a0" * 32]
    assert graph.merge_nodes(df).first().fact_conflict


def test_scenarios_with_and_without_evidence(spark):
    nodes = spark.createDataFrame([("r", k, "ENDPOINT" if k == "e" else "METHOD", 0.9, [k], False, False) for k in "eabc"], "run_id string, stable_key string, kind string, confidence double, evidence_ids array<string>, unresolved boolean, framework_internal boolean")
    edges = spark.createDataFrame([("r", a, b, "CALLS", 0.8, [a + b]) for a, b in ("ea", "eb", "bc", "ca")], "run_id string, source_key string, target_key string, kind string, confidence double, evidence_ids array<string>")
    full, cut = reach.scenario_members(nodes, edges, max_nodes=3)
    bare, bare_cut = reach.scenario_members(nodes.drop("evidence_ids"), edges.drop("evidence_ids"), max_nodes=3)
    assert set(full.columns) - set(bare.columns) == {"evidence_ids"}
    assert sorted(map(str, full.select(*bare.columns).collect())) == sorted(map(str, bare.collect()))
    assert cut.collect() == bare_cut.collect() and len(full.where("member_key = 'a'").first().evidence_ids) == 3


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_properties_are_parsed_once_a_fact(spark):
    """F32: each property of a fact used to parse all of them again."""
    facts = tables.Tables(spark, SF).facts
    assert plan_of(facts.where("analyzer = 'beta'").select("content", "behaves", "fingerprint")).count("parseJson") == 1


def test_source_texts_go_only_beside_a_stated_condition(spark):
    rows = [('{"b":1,"a":{"d":2,"c":3},"name":"n","condition":"x","sourceExpression":"y"}',), ('{"normalizedCondition":{"type":"T"},"condition":"x","sourceExpression":"y"}',)]
    got = spark.createDataFrame(rows, "p string").select(S.behavioral(F.col("p"))).collect()
    assert [r[0] for r in got] == ['{"a":{"c":3,"d":2},"b":1,"condition":"x","sourceExpression":"y"}', '{"normalizedCondition":{"type":"T"}}']


def test_edges_without_parsing_their_facts(spark):
    """ends that ingestion has kept are not taken out of the text again; facts without them give the same edges."""
    facts = tables.Tables(spark, SF).facts
    kept, parsed = (graph.derive_edges(df).select(*graph.EDGE_KEY) for df in (facts, facts.drop(*graph.ENDS)))
    assert "get_json_object" not in plan_of(kept) and "get_json_object" in plan_of(parsed)
    assert kept.exceptAll(parsed).isEmpty() and parsed.exceptAll(kept).isEmpty() and not kept.isEmpty()


def test_neighbours_meet_a_level_before_they_are_made_distinct(spark, monkeypatch):
    """edges are neither folded nor made distinct before they meet a level, nor is a step dealt by root, then by node."""
    asked = []
    real = reach.shared_table
    monkeypatch.setattr(reach, "shared_table", lambda df, tag: asked.append(plan_of(df)) or real(df, tag))
    kinds = {"a": "TABLE", "b": "METHOD", "c": "METHOD", "d": "METHOD", "x": "PARAMETER"}
    nodes = spark.createDataFrame([("r", k, v) for k, v in kinds.items()], "run_id string, stable_key string, kind string")
    pairs = ["ab", "ab", "ba", "aa", "cb", "bd", "ax", "bq", "da"]
    edges = spark.createDataFrame([("r", p, q, "READS") for p, q in pairs] + [("r", "a", "c", "PART_OF_SCENARIO")], "run_id string, source_key string, target_key string, kind string")
    roots = spark.createDataFrame([("r", "a"), ("r", "c")], "run_id string, root_key string")

    def found(**more):
        return sorted(tuple(r)[1:] for r in reach.neighborhood(nodes, edges, roots, **more).collect())

    assert found() == [("a", "a", 0, False), ("a", "b", 1, False), ("a", "c", 2, False), ("a", "d", 1, False), ("c", "a", 2, False), ("c", "b", 1, False), ("c", "c", 0, False), ("c", "d", 2, False)]
    assert not [p for p in asked if "LeftAnti" in p] and all(p.count("Aggregate") == 1 for p in asked[1:])
    assert found(depth=2, limit=1) == [("a", "a", 0, False), ("a", "b", 1, True), ("a", "c", 2, True), ("c", "a", 2, True), ("c", "b", 1, False), ("c", "c", 0, False)]
    assert [x[1] for x in found(depth=1, developer=True) if x[0] == "a"] == ["a", "b", "d", "x"]


def test_fact_lines_are_numbered_where_they_are_read(spark):
    """lines used to be shuffled with their texts to meet the counts of their blocks, and once more to be counted."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.QUERIES["src1_read_fact_lines"](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "first(raw" not in plan
    assert all(f.endswith(".gz") for f in df.inputFiles())
    assert df.agg({"n": "sum"}).first()[0] == tables.Tables(spark, SF).b_line.count()


def test_spans_meet_only_the_nodes_that_they_name(spark):
    """all nodes of a run used to be folded and shuffled with their properties; an answer hangs on few of them."""
    spans = spark.createDataFrame([("r", "t", f"s{i}", key, symbol) for i, (key, symbol) in enumerate([("k1", None), (None, "a.b"), (None, "c.d"), ("lost", None), (None, None)])], "run_id string, trace_id string, span_id string, stable_key string, symbol string")
    said = [("k1", "x.y", "a"), ("k2", "a.b", "a"), ("k3", "q.r", "a"), ("k3", "c.d", "b"), ("k4", "c.d", "a"), ("k5", "c.d", "a"), ("k6", "no.one", "a")]
    facts = spark.createDataFrame([("r", f"e{a}", a, "STATIC_EXACT", 1.0, "METHOD", k, f"f{k}", '{"symbolSignature":"%s"}' % symbol, ["x"]) for k, symbol, a in said], "run_id string, execution_id string, analyzer string, origin string, confidence double, kind string, stable_key string, fact_id string, properties string, evidence_ids array<string>")
    few = runtime.asked_facts(facts, spans)
    assert sorted((r.stable_key, r.analyzer) for r in few.collect()) == [("k1", "a"), ("k2", "a"), ("k3", "a"), ("k3", "b"), ("k4", "a"), ("k5", "a")]

    def found(own):
        return sorted(map(str, runtime.match_spans(spans, tables._span_nodes(graph.merge_nodes(own))).collect()))

    assert found(few) == found(facts) and "AMBIGUOUS" in str(found(few)) and "MATCHED_SYMBOL" in str(found(few))


def test_spans_are_judged_in_one_shuffle(spark):
    """they were grouped for the first of each key, met it again, and were ranked."""
    t = tables.Tables(spark, SF)
    plan = runtime.dedup_spans(t.spans.drop("span_hash").withColumn("span_hash", F.lit("h")), quota=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_files_are_written_without_a_commit_of_each(spark, tmp_path, monkeypatch):
    """each file of the corpus was a partition of Spark's own, with several calls of chmod."""
    df = spark.createDataFrame([("a/x", b"one\n"), ("a/y", b"\x00\xff"), ("z", b"t")], "path string, content binary")
    for _ in range(2):  # again gives the same
        corpus.write_files(df, f"file://{tmp_path}/files")
    assert {(r.path, bytes(r.content), r.bytes) for r in corpus.read_files(spark, f"file://{tmp_path}/files").collect()} == {("a/x", b"one\n", 4), ("a/y", b"\x00\xff", 2), ("z", b"t", 1)}
    asked = []
    monkeypatch.setattr(corpus, "write_files", lambda files, root, real=corpus.write_files: asked.append(root) or real(files, root))
    same_rows(spark, SF, "src5_read_corpus")
    assert len(asked) == 1


def test_runs_meet_by_key_once(spark):
    """each reader of matches joined both runs by key again, and all pairs were parsed for changes."""
    shape = "stable_key string, kind string, properties string, confidence double, fingerprint string, structural_fingerprint string, evidence_fingerprint string"

    def run(*rows):
        return spark.createDataFrame([(k, kind, '{"symbolSignature":"%s","x":%d}' % (symbol, x) if symbol else '{"x":%d}' % x, 0.9, f"{kind}{x}", s, None) for k, kind, symbol, x, s in rows], shape)

    before = run(("a", "M", "s.a", 1, "t"), ("b", "M", "s.b", 1, "t"), ("c", "M", "s.c", 1, "t"), ("d", "N", None, 1, "u"), ("e", "M", "s.twice", 1, "v"), ("f", "M", "s.f", 2, "w"))
    after = run(("a", "M", "s.a", 1, "t"), ("b", "M", "s.b", 2, "t"), ("c2", "M", "s.c", 1, "t"), ("d2", "N", None, 1, "u"), ("e2", "M", "s.twice", 1, "w"), ("e3", "M", "s.twice", 1, "w"), ("f", "M", "s.a", 2, "w"))
    matched = diff.match_nodes(before, after)
    assert sorted(map(tuple, matched.collect())) == [("a", "a", 1), ("b", "b", 1), ("c", "c2", 2), ("d", "d2", 3), ("f", "f", 1)]
    assert "Join" not in plan_of(matched)
    found = diff.diff_nodes(before, after, matched)
    assert sorted((r.stable_key, r.change_type) for r in found.collect()) == [("b", "MODIFIED"), ("c2", "RENAMED"), ("d2", "RENAMED"), ("e", "REMOVED"), ("e2", "ADDED"), ("e3", "ADDED"), ("f", "MODIFIED")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # changed, gone and new ones are read from what was written once
    same = diff.compare_pairs(spark.range(1).selectExpr("1 AS k").join(before.selectExpr("struct(*) AS b")).join(after.selectExpr("struct(*) AS a")))
    lines = same._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert max(i for i, x in enumerate(lines) if "ArrowEvalPython" in x) < min(i for i, x in enumerate(lines) if "<=>" in x and ("Filter" in x or "Join" in x))


def test_hashes_of_facts_and_lines_are_shuffled_once_or_not_at_all(spark):
    """the hash of a line was shuffled twice.  F10: the hash of what a fact says was shuffled, not made where facts meet."""
    plan = queries.QUERIES["src1_read_fact_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(hash") == 1 and "Exchange hashpartitioning(execution#" not in plan.split("BroadcastExchange")[0]
    plan = queries.QUERIES["gb1_ordered_facts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "sha2(" in above and "sha2(" not in below


def test_an_overview_folds_its_nodes_once(spark):
    """nodes were folded once for titles, once for kinds and once more for lists of evidence, which were only counted."""
    overview, titled = queries.QUERIES["qry28_overview_metrics"](spark, SF), tables.Tables(spark, SF).titled
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in (overview, titled.select("title", "kind", "confidence", "unresolved", "n_evidence"))]
    assert scans[0] == scans[1] > 0
    rows = [("r", "a", "TABLE", 0.9, False, None, 0), ("r", "b", "METHOD", 0.5, False, "t", 2), ("r", "c", "METHOD", 0.9, True, None, None)]
    nodes = spark.createDataFrame(rows, "run_id string, stable_key string, kind string, confidence double, unresolved boolean, title string, n_evidence int")
    r = projections.overview_metrics(nodes).first()
    assert (r.nodes, r.risks, r.enriched, r.grounded, r.grounded_percent) == (3, 2, 1, 1, 33)


def test_refused_lines_are_parsed_once(spark):
    """the filter of refused lines was put below their parsing, where each test parsed its line anew."""
    plan = queries.QUERIES["src3_quarantine_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "json" in x.lower()]
    assert any("Generate explode" in x for x in plan.splitlines())
