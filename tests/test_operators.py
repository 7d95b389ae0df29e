"""Operators on small rows."""

import json

from pyspark.sql import functions as F

from factgraph.functions import expressions as E
from factgraph.functions import semantics as S
from factgraph.operators import diff, graph, projections, reach, runtime, validate
from factgraph.sources import corpus, facts


def rules(spark, kind, props):
    df = spark.createDataFrame([(kind, json.dumps(props))], "kind string, properties string")
    return graph.assertion_ceiling(graph.classify_rules(df)).first()


def test_rule_categories(spark):
    null = {"type": "BINARY", "operator": "EQUAL", "left": {"type": "REFERENCE"}, "right": {"type": "LITERAL", "value": None}}
    guard = rules(spark, "CONDITION", {"condition": null})
    assert (guard.category, guard.score) == ("TECHNICAL_GUARD", 0) and guard.score_terms.technicalGuardPenalty == -0.65
    assert rules(spark, "CONDITION", {"condition": null, "trueOutcomes": ["REJECT"]}).category == "BUSINESS_CONSTRAINT"
    text = rules(spark, "CONDITION", {"condition": "a < b"})
    assert (text.condition_type, text.category, text.ceiling) == ("UNKNOWN_EXPRESSION", "UNKNOWN_RULE", 0.45)


def test_confidence(spark):
    rows = [("STATIC_INFERRED", "{}"), ("LLM_ENRICHED", "{}"), ("STATIC_RESOLVED", '{"resolved": false}')]
    df = spark.createDataFrame(rows, "origin string, p string").select(S.confidence_ceiling(F.col("origin"), F.lit(1.0), F.col("p"), F.lit(False)).alias("c"))
    assert [round(x.c, 2) for x in df.collect()] == [0.65, 0.30, 0.45]


def test_texts_are_no_booleans(spark):
    df = spark.createDataFrame([('{"a": true}',), ('{"a": "true"}',), ('{"b": 1}',), ("no json",)], "p string")
    assert [r[0] for r in df.select(S.is_true(F.col("p"), "a")).collect()] == [True, False, False, False]


def test_hash_ignores_key_order_and_presentation(spark):
    rows = [('{"a": 1, "b": {"y": 1, "x": 2}, "name": "n"}', '{"b": {"x": 2, "y": 1}, "a": 1, "name": "m"}')]
    r = spark.createDataFrame(rows, "p string, q string").select((S.fingerprint(F.lit("K"), F.col("p")) == S.fingerprint(F.lit("K"), F.col("q"))).alias("same"), (S.content_hash(F.col("p")) == S.content_hash(F.col("q"))).alias("all")).first()
    assert r.same and not r["all"]


def test_outcomes_of_open_depth():
    assert not E.is_impactful({"kind": "THROW", "exception": "NullPointerException"})
    assert E.is_impactful({"kind": "CONDITIONAL", "trueOutcomes": [{"kind": "RETURN", "expression": {"type": "CALL"}}]})
    assert E.numbers({"b": 2, "a": [1, {"c": True}]}) == ["1", "2"]


def node(key, kind, sym, value, **more):
    return (key, kind, json.dumps({"symbolSignature": sym, "normalizedCondition": {"operator": more.get("op", "LT"), "value": value}, **more.get("props", {})}), 1.0, "f", f"s{value}{sym}", None)


def test_diff(spark):
    cols = "stable_key string, kind string, properties string, confidence double, fingerprint string, structural_fingerprint string, evidence_fingerprint string"
    before = spark.createDataFrame([node("a", "K", "sa", 500), node("b", "K", "sb", 1), node("c", "K", "sc", 1), node("m", "K", "sm", 1, props={"filePath": "x"})], cols)
    after = spark.createDataFrame([node("a", "K", "sa", 300), node("b2", "K", "sb", 1), node("d", "K", "sd", 7), node("m", "K", "sm", 1, props={"filePath": "y"})], cols)
    got = {(r.stable_key, r.change_type, r.impact) for r in diff.diff_nodes(before, after, diff.match_nodes(before, after)).collect()}
    assert got == {("a", "MODIFIED", "THRESHOLD_CHANGED"), ("b2", "RENAMED", "NAME_CHANGED"), ("c", "REMOVED", "K_REMOVED"), ("d", "ADDED", "K_ADDED"), ("m", "MOVED", "SOURCE_MOVED")}


def searched(nodes, edges, max_depth, max_nodes):
    """The breadth-first search in plain Python."""
    kinds, out = {k: kind for k, kind in nodes}, {}
    for entry in (k for k, kind in nodes if kind == "ENDPOINT"):
        queue, seen, members, cut = [(entry, 0)], {entry}, [], False
        while queue:
            at, depth = queue.pop(0)
            members.append((at, depth))
            if kinds[at] == "UNRESOLVED_SYMBOL" or (depth and kinds[at] == "EXTERNAL_CALL"):
                continue
            ways = sorted((t, k) for s, t, k in edges if s == at)[: max_nodes + 1]
            cut |= len(ways) > max_nodes
            for t, _ in ways:
                if t in seen or kinds[t] == "TECHNICAL_GUARD":
                    continue
                if depth >= max_depth or len(seen) >= max_nodes:
                    cut = True
                    continue
                seen.add(t)
                queue.append((t, depth + 1))
        out[entry] = (members, cut)
    return out


def test_scenarios_match_the_search(spark):
    import random

    rnd = random.Random(3)
    nodes = [(f"n{i:02}", rnd.choice(["ENDPOINT", "METHOD", "METHOD", "METHOD", "EXTERNAL_CALL", "TECHNICAL_GUARD", "UNRESOLVED_SYMBOL"])) for i in range(30)]
    edges = sorted({(rnd.choice(nodes)[0], rnd.choice(nodes)[0], rnd.choice(["CALLS", "READS"])) for _ in range(90)})
    n = spark.createDataFrame([("R", k, kind, 1.0, [k], kind == "UNRESOLVED_SYMBOL", False) for k, kind in nodes], "run_id string, stable_key string, kind string, confidence double, evidence_ids array<string>, unresolved boolean, framework_internal boolean")
    e = spark.createDataFrame([("R", *x, 0.9, ["e"]) for x in edges], "run_id string, source_key string, target_key string, kind string, confidence double, evidence_ids array<string>")
    for depth, most in ((8, 120), (2, 6)):
        members, flags = reach.scenario_members(n, e, depth, most)
        got: dict = {}
        for r in members.collect():
            got.setdefault(r.entry_key, []).append((r.position, r.member_key, r.depth))
        cut = {r.entry_key: r.truncated for r in flags.collect()}
        want = searched(nodes, edges, depth, most)
        assert {k: ([(m, d) for _, m, d in sorted(v)], cut[k]) for k, v in got.items()} == want


def test_evidence_reasons(spark):
    corpus_ = spark.createDataFrame([("a.txt", "one\r\ntwo\nthree"), ("big.txt", "x\n" + "y" * 70_000 + "\nz")], "file_path string, text string")
    import hashlib

    ok = hashlib.sha256(b"one\ntwo").hexdigest()
    rows = [("a.txt", 1, 2, 1, 4, "sha256:" + ok), ("a.txt", 1, 2, 1, 4, ok), ("big.txt", 1, 1, 1, 1, ""), ("big.txt", 3, 3, 1, 1, ""), ("a.txt", 1, 2, 1, 4, "sha256:00"), ("../a.txt", 1, 1, 1, 1, ""), ("b.txt", 1, 1, 1, 1, ""), ("a.txt", 2, 1, 1, 1, ""), ("a.txt", 1, 9, 1, 1, ""), ("a.txt", 1, 1, 1, 9, "")]
    e = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, start_column int, end_column int, snippet_hash string")
    got = sorted(str(r.reason) for r in validate.check_evidence(e, corpus_).collect())
    assert got == sorted(["None", "SNIPPET_HASH_MISMATCH", "SNIPPET_HASH_MISMATCH", "SNIPPET_HASH_MISMATCH", "SOURCE_ENCODING_OR_LINE_LIMIT", "PATH_ESCAPE", "SOURCE_NOT_REGULAR_FILE", "INVALID_RANGE", "INVALID_RANGE", "INVALID_COLUMN_RANGE"])


def test_span_quota(spark):
    rows = [(u, f"r{r}", f"t{i % 7}", f"s{i:03}", f"h{i}") for r, n in ((1, 90), (2, 20), (3, 41)) for i in range(n) for u in ((1, 2) if i % 9 == 0 else (1 + i % 2,))]
    spans = spark.createDataFrame(rows, "upload int, run_id string, trace_id string, span_id string, span_hash string")
    for quota in (0, 20, 40, 89, None):
        want, used = {}, {}
        for u, r, t, s, _ in sorted(rows):
            if (r, t, s) in {k[1:] for k in want}:
                want[u, r, t, s] = "duplicate"
            else:
                used[r] = used.get(r, 0) + 1
                want[u, r, t, s] = "over_quota" if quota is not None and used[r] > quota else "new"
        got = runtime.dedup_spans(spans, quota=quota).collect()
        assert {(x.upload, x.run_id, x.trace_id, x.span_id): x.verdict for x in got} == want and len(got) == len(rows)


def test_payload_rejects(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ('{"a":1} x',)], "p string")
    assert [r[0] for r in df.select(validate.strict_json("p")).collect()] == [None, "DUPLICATE_KEY", "INVALID_JSON"]
    items = ['[{"key":"k","value":{"intValue":"42"}}]', '[{"key":"k","value":{"intValue":"4.2"}}]', '[{"key":"k","value":{"intValue":"1","stringValue":"x"}}]']
    df = spark.createDataFrame([(x,) for x in items], "p string")
    assert [r[0] for r in df.select(validate.normalize_otlp_attributes("p")).collect()] == ['{"k":42}', None, None]


def test_ignore_rules(spark):
    files = spark.createDataFrame([(p,) for p in ("a.py", "ignored/x/b.py", "ignored/keep.py", "src/.env", "lib/node_modules/z.js")], "path string")
    assert [r.path for r in corpus.ignore_filter(files, ["ignored/**", "!ignored/keep.py"]).orderBy("path").collect()] == ["a.py", "ignored/keep.py"]


def test_components(spark):
    files = spark.createDataFrame([(p,) for p in ("pom.xml", "api/pom.xml", "api/src/A.java", "web/x.ts")], "path string")
    got = {r.path: r.component for r in corpus.assign_component(files, corpus.component_roots(files)).collect()}
    assert got == {"pom.xml": ".", "api/pom.xml": "api", "api/src/A.java": "api", "web/x.ts": "."}


def test_exceptions_hang_on_the_step_before(spark):
    steps = spark.createDataFrame([("s", "p1", "f", 10), ("s", "p2", "f", 20)], "scenario_key string, stable_key string, file_path string, start_line int")
    thrown = spark.createDataFrame([("s", "e1", "f", 15), ("s", "e2", "f", 5), ("s", "e3", "g", 1)], steps.schema)
    assert {(r.source_key, r.target_key) for r in projections.attach_exceptions(steps, thrown).collect()} == {("p1", "e1"), ("p2", "e2"), ("p2", "e3")}


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "execution_id string, fact_id int")
    for _ in range(2):
        facts.append_new(df, str(tmp_path / "t"), ["execution_id", "fact_id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_merges_follow_their_targets(spark):
    nodes = "stable_key string, fingerprint string"
    before = spark.createDataFrame([(k, k) for k in ("a", "b", "c", "d", "e", "f", "kept", "changed", "gone", "renamed")], nodes)
    after = spark.createDataFrame([(k, k) for k in ("a", "b", "c", "d", "e", "f", "kept", "renamed2")] + [("changed", "other")], nodes)
    matched = spark.createDataFrame([(k, k) for k in ("a", "b", "c", "d", "e", "f", "kept", "changed")] + [("renamed", "renamed2")], "before_key string, after_key string")
    rows = [("a", "MERGED", "kept", "a"), ("b", "MERGED", "changed", "b"), ("c", "MERGED", "gone", "c"), ("d", "MERGED", "renamed", "d"), ("e", "CONFIRMED", None, None), ("f", "CONFIRMED", None, "earlier"), ("renamed", "EDITED", None, "renamed")]
    latest = spark.createDataFrame(rows, "stable_key string, decision string, merge_target string, fingerprint string")
    own = spark.createDataFrame([], "stable_key string")
    # a match by symbol carries the node's own review, as its fingerprint says; a merge needs its target under the same key
    got = {r.stable_key: (r.decision, r.merge_target, r.change_type) for r in diff.carry_reviews(latest, matched, before, after, own).collect()}
    stale = ("STALE", None, "REVIEW_BECAME_STALE")
    assert got == {"a": ("MERGED", "kept", None), "b": stale, "c": stale, "d": stale, "e": ("CONFIRMED", None, None), "f": stale, "renamed2": stale}
    assert diff.carry_reviews(latest, matched, before, after, own.union(spark.createDataFrame([("a",)], "stable_key string"))).where("stable_key = 'a'").count() == 0
