import hashlib
import json

from pyspark.sql import functions as F

from factgraph.operators import enrich


def test_quota_grants_in_order(spark):
    r = spark.createDataFrame([("o", "d", i) for i in range(4)], "org_id string, day string, request_no int")
    limits = spark.createDataFrame([("o", "d", 5, 0)], "org_id string, day string, limit int, used int")
    assert [x.granted for x in enrich.quota_reserve(r, limits).orderBy("request_no").collect()] == [True, True, False, False]


def test_progress_and_steps(spark):
    ends = spark.createDataFrame([("R", k) for k in "abc"], "run_id string, stable_key string")
    done = spark.createDataFrame([("R", "a", 1, "FAILED"), ("R", "a", 2, "SUCCEEDED"), ("R", "b", 1, "RUNNING")], "run_id string, stable_key string, seq int, status string")
    p = enrich.enrichment_progress(ends, done).first()
    assert (p.total, p.ready, p.running, p.failed, p.percent) == (3, 1, 1, 0, 33)
    told = spark.createDataFrame([("R", "e", ["1. First", "2) " + "x" * 70], ["boom"])], "run_id string, entry_key string, steps array<string>, errors array<string>")
    m = spark.createDataFrame([("R", "e", "e", "ENDPOINT", 0), ("R", "e", "m1", "METHOD", 1), ("R", "e", "m2", "METHOD", 2), ("R", "e", "x", "EXCEPTION", 2)], "run_id string, entry_key string, member_key string, kind string, depth int")
    assert {r.member_key: r.title for r in enrich.propagate_steps(told, m).collect()} == {"m1": "First", "m2": "x" * 57 + "...", "x": "boom"}


def test_labels(spark):
    n = spark.createDataFrame([("R", "k1", "POST /orders", "Place an order", "", "ENDPOINT"), ("R", "k2", "GET /users", None, "list people", "ENDPOINT")], "run_id string, stable_key string, label string, title string, description string, kind string")
    got = {r.stable_key: r.title for r in enrich.business_label(n, [(r"users", "Look up users", "read")]).collect()}
    assert got == {"k1": "Place an order", "k2": "Look up users"}


def _bundle(spark, facts, evidence, owners=(), nodes=("n",), **more):
    n = spark.createDataFrame([("R", k, "p") for k in nodes], "run_id string, node_key string, fingerprint string")
    f = spark.createDataFrame([("R", "n", *x) for x in facts], "run_id string, node_key string, fact_id string, kind string, properties string")
    e = spark.createDataFrame([("R", *x) for x in evidence], "run_id string, fact_id string, evidence_id string, file_path string, start_line int, end_line int, snippet string")
    o = spark.createDataFrame([("R", *x) for x in owners], "run_id string, owner_key string, evidence_id string, snippet string")
    return {r.node_key: r for r in enrich.evidence_bundle(n, f, e, F.lit(0), o, **more).collect()}


def test_bundle_shows_allowed_fields_and_no_secrets(spark):
    props = '{"password":"x1x","name":"token=y2y","condition":{"secret":"z3z","b":1},"path":"password=\\\\"w4w\\\\" end"}'.replace("\\\\", "\\")
    got = _bundle(spark, [("f1", "K", props), ("f2", "K", "no json"), ("f3", "K", None)], [(f, f + "e", "a/b", 1, 1, "x") for f in ("f1", "f2", "f3")])["n"]
    shown = json.loads(got.bundle)
    assert all(x not in got.bundle for x in ("x1x", "y2y", "z3z", "w4w"))
    assert shown["facts"][0]["properties"]["condition"] == {"secret": "[REDACTED]", "b": 1} and shown["facts"][0]["properties"]["path"].endswith(" end")
    assert [f["properties"] for f in shown["facts"][1:]] == [{}, {}] and (shown["fingerprint"], shown["nodeId"]) == ("p", "n")
    assert got.bundle_bytes == len(got.bundle.encode()) and got.request_hash == hashlib.sha256(got.bundle.encode()).hexdigest()


def test_bundle_declarations_and_cuts(spark):
    facts = [("f1", "K", '{"ownerKey":"o1"}'), ("f2", "K", '{"ownerKey":"o2"}'), ("f3", "K", '{"name":"' + "x" * 13_000 + '"}'), ("f4", "K", "{}")]
    evidence = [("f1", "a", "a", 1, 1, "call()"), ("f1", "b", "a", 1, 1, "if { call() }"), ("f2", "c", "a", 1, 1, "call()"), ("f3", "d", "a", 1, 1, "x"), ("f1", "e", "a", 2, 2, "y" * 5000)]
    shown = json.loads(_bundle(spark, facts, evidence, [("o1", "2", "late {"), ("o1", "1", " void m() { x }"), ("o2", "1", "none")])["n"].bundle)
    texts = {e["evidence_id"]: e["snippet"] for f in shown["facts"] for e in f["evidence"]}
    assert set(texts) == {"a", "b", "c", "e"}  # f3 is too long, f4 has no evidence
    assert texts["a"] == "// in method: void m()\ncall()" and texts["b"] == "if { call() }" and texts["c"] == "call()"
    assert texts["e"] == ("// in method: void m()\n" + "y" * 5000)[:3900] + enrich.CUT


def test_bundle_shrinks_to_its_bytes(spark):
    facts = [(f"f{i:02}", "K", "{}") for i in range(40)]

    def of(length, per=1, chars="z"):
        evidence = [(f, f"{f}{j}", "a", 1, 1, chars * length) for f, _, _ in facts for j in range(per)]
        return _bundle(spark, facts, evidence)["n"]

    few = of(100)
    assert len(few.fact_ids) == 32 and few.n_evidence == 32 and few.bundle_bytes < 48_000
    cut = of(3000)
    assert len(cut.fact_ids) == 32 and cut.bundle.count("[truncated]") == 32 and cut.bundle_bytes <= 48_000
    less = of(3000, per=3)
    one = json.loads(less.bundle)["facts"][0]
    assert less.bundle_bytes <= 48_000 < less.bundle_bytes + 1 + len(json.dumps(one, separators=(",", ":"))) and 8 < len(less.fact_ids) < 32
    over = of(3000, per=8)
    assert over.refusal == "TOO_LARGE" and over.bundle is None and over.fact_ids is None
    wide = of(3000, per=2, chars="é")
    assert wide.bundle_bytes <= 48_000 and 8 < len(wide.fact_ids) < len(less.fact_ids)


def test_bundle_refusals(spark):
    for path in ("/etc/x", "a/../b", "c:x", "a/.env.local", "k.PEM", "..\\b"):
        assert _bundle(spark, [("f", "K", "{}")], [("f", "e", path, 1, 1, "x")])["n"].refusal == "PATH", path
    got = _bundle(spark, [("f", "K", "{}")], [("f", "e", "a.java", 1, 1, "x")], nodes=("n", "m"), allowed=r"\.py$")
    assert got["m"].refusal == "NO_FACTS" and got["n"].refusal == "PATH"
    assert json.loads(_bundle(spark, [("f", "K", "{}")], [])["n"].bundle)["facts"] == []


def test_path_policy(spark):
    e = spark.createDataFrame([("R", "n", "a/.env", 1, "token: abc")], "run_id string, node_key string, file_path string, start_line int, snippet string")
    assert enrich.path_policy(e).first().refused
