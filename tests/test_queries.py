"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import os

import duckdb
import pytest

from factgraph.plans import registry as queries

SF = "/root/testdata/sf0.001"
FEW = ["gb6_merge_nodes", "gb6_node_links", "gb6_fact_alternatives", "gb11_edge_evidence", "gb10_missing_nodes", "gb4_classify_rules", "val6_dedup_facts", "df1_match_nodes", "df2_compare_pairs", "df5_diff_edges", "df7_carry_merges", "rt3_match_spans", "qry24_review_queue", "ops6_ready_tasks", "val1_fact_schema", "val5_check_evidence", "src4_read_otlp", "fn17_endpoint_title", "en10_semantic_search", "en2_evidence_bundle", "src5_read_corpus", "rt7_path_page", "rt8_unobserved_count"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", FEW)
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == want


def test_spans_of_more_events_than_a_quota(spark, duck, tmp_path):
    for f in os.listdir(SF):
        os.symlink(f"{SF}/{f}", tmp_path / f) if f != "events.parquet" else None
    events = duck.execute(f"SELECT * FROM read_parquet('{SF}/events.parquet') LIMIT 1")
    columns = [d[0] for d in events.description]
    n, m = 120_000, duck.execute("SELECT count(*) FROM events").fetchone()[0]
    own = ", ".join("i AS event_id" if c == "event_id" else f"e.{c}" for c in columns)
    duck.execute(f"COPY (SELECT {own} FROM range({n}) t(i) JOIN (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events) e ON e.place = i % {m}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    verdicts = {r.verdict: r["count"] for r in queries.QUERIES["rt2_dedup_spans"](spark, str(tmp_path)).groupBy("verdict").count().collect()}
    repeats = len(range(0, n, 23))
    assert verdicts == {"new": n, "duplicate": repeats - len(range(0, n, 230)), "conflict": len(range(0, n, 230))}
    assert queries.QUERIES["rt6_runtime_summary"](spark, str(tmp_path)).first().spans == n


def test_names_that_look_like_text_operators():
    import __spark_entry__

    assert {"ops4_facts_by_kind", "ops6_ready_tasks", "ops7_last_hour_metrics"} <= set(__spark_entry__.queries()) & set(__spark_entry__.oracle_sql())
