"""Ingestion and streams, from files."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from factgraph.operators import runtime, validate
from factgraph.operators.ingest import ingest
from factgraph.plans import registry
from factgraph.sources import corpus, facts, outputs
from factgraph.streaming import jobs, spans

TEXT = "one\ntwo\nthree"


def line(fact_id, value=1, text="two", **more):
    e = {"filePath": "a.txt", "startLine": 2, "startColumn": 1, "endLine": 2, "endColumn": 1, "snippetHash": "sha256:" + hashlib.sha256(text.encode()).hexdigest()}
    fact = {"contractVersion": "1.0", "factId": fact_id, "kind": "METHOD", "stableKey": fact_id, "subject": {"kind": "S", "stableKey": "s"}, "properties": {"v": value}, "origin": "STATIC_EXACT", "confidence": 0.9, "evidence": [e]}
    return json.dumps(fact | more)


FIRST = [line("a"), "", line("a"), line("a", 2), "{broken", line("b", text="stale"), line("c\r"), line("d", contractVersion="2"), line("e") + "}", "x" * ((1 << 20) + 1)]
WANT = [(4, "DUPLICATE_ID_CONFLICT"), (5, "INVALID_JSON"), (6, "SNIPPET_HASH_MISMATCH"), (8, "CONTRACT_VERSION_MISMATCH"), (9, "INVALID_JSON"), (10, "LINE_TOO_LARGE")]


@pytest.fixture
def source(spark):
    return spark.createDataFrame([("a.txt", TEXT)], "file_path string, text string")


def tables(spark, at):
    kept = sorted((r.execution_id, r.fact_id) for r in spark.read.parquet(f"{at}/facts").collect())
    return kept, sorted((r.execution_id, r.line_number, r.reason) for r in spark.read.parquet(f"{at}/bad").collect())


def test_files_become_facts_once(spark, source, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f1").write_text("\n".join(FIRST))
    (tmp_path / "in" / "f2").write_text(line("a", 3) + "\r\n" + line("z") + "\n")
    for _ in range(2):
        ingest(facts.read_fact_lines(spark, str(tmp_path / "in")), source, f"{tmp_path}/facts", f"{tmp_path}/bad")
    kept, bad = tables(spark, tmp_path)
    assert kept == [("f1", "a"), ("f1", "c\r"), ("f2", "a"), ("f2", "z")]
    assert bad == [("f1", n, r) for n, r in WANT]


def test_a_stream_keeps_to_the_batch_rules(spark, source, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "execution string, line_number bigint, raw string, oversized boolean, invalid_utf8 boolean"
    batches = [[("f1", i + 1, t, len(t) > 1 << 20, False) for i, t in enumerate(FIRST) if t], [("f1", 90, line("a", 5), False, False), ("f1", 91, line("a"), False, False), ("f1", 92, line("n"), False, False)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        lines = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_facts(lines, source, f"{tmp_path}/facts", f"{tmp_path}/bad", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    kept, bad = tables(spark, tmp_path)
    assert kept == [("f1", "a"), ("f1", "c\r"), ("f1", "n")]
    assert bad == sorted([("f1", n, r) for n, r in WANT] + [("f1", 90, "DUPLICATE_ID_CONFLICT")])


@pytest.fixture
def keyed_state(spark):
    own = {"spark.sql.streaming.stateStore.providerClass": spans.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for name, value in own.items():
        spark.conf.set(name, value)
    yield
    for name in own:
        spark.conf.unset(name)


def test_spans_over_all_batches(spark, keyed_state, tmp_path):
    schema = "upload int, run_id string, trace_id string, span_id string, span_hash string"
    batches = [[(1, "r", "t", f"s{i}", "h") for i in range(3)], [(2, "r", "t", "s1", "h"), (2, "r", "t", "s2", "other"), (2, "r", "t", "s3", "h"), (2, "r", "t", "s4", "h"), (2, "q", "t", "s4", "h")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_spans(stream, f"{tmp_path}/spans", f"{tmp_path}/rejects", f"{tmp_path}/cp", quota=4).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.run_id, r.span_id) for r in spark.read.parquet(f"{tmp_path}/spans").collect()) == [("q", "s4"), ("r", "s0"), ("r", "s1"), ("r", "s2"), ("r", "s3")]
    assert sorted((r.span_id, r.verdict) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()) == [("s2", "conflict"), ("s4", "over_quota")]


def test_state_gives_the_verdicts_of_batches(spark, keyed_state, tmp_path):
    """Three batches, a restart before each: each row's verdict is the batch operator's over what was stored before."""
    schema = "upload int, run_id string, trace_id string, span_id string, span_hash string, row int"
    rnd = random.Random(4)
    stored, want, rows = [], {}, 0
    for batch in range(3):
        here = [(batch, rnd.choice(["r", "r", "q"]), f"t{rnd.randrange(3)}", f"s{rnd.randrange(25)}", rnd.choice(["h", "h", "h", "other"]), rows + i) for i in range(90)]
        rows += len(here)
        df = spark.createDataFrame(here, schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        known = spark.createDataFrame(stored, "run_id string, trace_id string, span_id string, span_hash string") if stored else None
        # of rows that are equal in upload and hash, either may be the first
        verdicts = runtime.dedup_spans(df, known, quota=30).collect()
        for r in verdicts:
            want.setdefault((r.upload, r.run_id, r.trace_id, r.span_id, r.span_hash), []).append(r.verdict)
        stored += [(r.run_id, r.trace_id, r.span_id, r.span_hash) for r in verdicts if r.verdict == "new"]
        stream = spans.judged_spans(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), quota=30)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        plan = query._jsq.explainInternal(False)
        assert "out" not in plan and "Join" not in plan
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault((r.upload, r.run_id, r.trace_id, r.span_id, r.span_hash), []).append(r.verdict)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {v for vs in got.values() for v in vs} == {"new", "duplicate", "conflict", "over_quota"}


def test_keys_are_forgotten_in_time(spark, keyed_state, tmp_path):
    schema = "upload int, run_id string, trace_id string, span_id string, span_hash string"
    for ttl, want in ((None, 1), (1, 2)):
        for upload in range(2):
            spark.createDataFrame([(upload, "r", "t", "s", "h")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{ttl}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in{ttl}")
            jobs.stream_spans(stream, f"{tmp_path}/spans{ttl}", f"{tmp_path}/rejects{ttl}", f"{tmp_path}/cp{ttl}", None, ttl).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/spans{ttl}").count() == want


def test_children_without_parents_come_after_the_watermark(spark, tmp_path):
    at, minute = datetime.datetime(2024, 1, 1, 12), datetime.timedelta(minutes=1)
    schema = "event_time timestamp, run_id string, trace_id string, span_id string, parent_span_id string, node_key string"
    seen = []
    batches = [
        [(at, "r", "t", "orphan", "nobody", "o"), (at, "r", "t", "child", "parent", "c"), (at, "r", "t", "root", None, "root"), (at, "r", "t", "top", "", "top")],
        [(at + 40 * minute, "r", "t", "parent", None, "p")],  # late, but within the hour
        [(at + 65 * minute, "r", "t", "x", None, "x")],  # the watermark is 55 minutes on
        [(at + 90 * minute, "r", "t", "y", None, "y")],  # now it has passed the hour
        [(at + 500 * minute, "r", "t", "z", "x", "z")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.late_parents(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted((str(r.parent_node), r.child_node) for r in spark.read.schema("run_id string, parent_node string, child_node string, child_span string").parquet(f"{tmp_path}/out").collect()))
    assert seen == [[], [("p", "c")], [("p", "c")], [("None", "o"), ("p", "c")], [("None", "o"), ("p", "c")]]


def run(df, name, spark):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_late_parents_events_and_metrics(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    minute = datetime.timedelta(minutes=1)
    rows = [(at, "r", "t", "c", "p", "child"), (at + 30 * minute, "r", "t", "p", None, "parent"), (at + 300 * minute, "r", "t", "z", "c", "late")]
    schema = "event_time timestamp, run_id string, trace_id string, span_id string, parent_span_id string, node_key string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "spans"))
    got = run(jobs.late_parents(spark.readStream.schema(schema).parquet(str(tmp_path / "spans"))), "late", spark)
    assert [(r.parent_node, r.child_node) for r in got] == [("parent", "child")]
    schema = "run_id string, sequence bigint"
    spark.createDataFrame([("r", 1), ("r", 5), ("q", 9)], schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    assert [r.sequence for r in run(jobs.stream_events(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), "r", 1), "log", spark)] == [5]
    schema = "created_at timestamp, status string, seconds double"
    rows = [(at, "SUCCEEDED", 2.0), (at + minute, "SUCCEEDED", 4.0), (at + 2 * minute, "FAILED_PERMANENTLY", None), (at + 600 * minute, "SUCCEEDED", 1.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "tasks"))
    got = run(jobs.stream_metrics(spark.readStream.schema(schema).parquet(str(tmp_path / "tasks"))), "metrics", spark)
    full = [r for r in got if r.window.start == at - 30 * minute]
    assert [(r.done, r.failed, r.mean_seconds) for r in full] == [(2, 1, 3.0)]
    more = [(at, "PENDING", None), (at, "RUNNING", None), (at + minute, "RUNNING", None)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "tasks"))
    amounts = "created_at timestamp, input_tokens int, output_tokens int, cost double, latency_ms int"
    made = [(at, 10, 1, 0.5, 100), (at + minute, 20, None, 0.25, 300), (at + 300 * minute, 1, 1, 1.0, 1)]
    spark.createDataFrame(made, amounts).coalesce(1).write.parquet(str(tmp_path / "calls"))
    streams = (spark.readStream.schema(x).parquet(str(tmp_path / name)) for name, x in (("tasks", schema), ("calls", amounts)))
    got = {r.window.start: r for r in run(jobs.stream_metrics(*streams), "all_metrics", spark)}
    full = got[at - 30 * minute].asDict()
    full.pop("window")
    assert full == {"pending": 1, "running": 2, "done": 2, "failed": 1, "mean_seconds": 3.0, "input_tokens": 30, "output_tokens": 1, "cost": 0.75, "latency": 200.0}
    # calls have come to 300 minutes only, so that no later window is given
    assert max(got) < at + 300 * minute


def test_payloads_that_are_refused(spark):
    span = '{"traceId":"t","spanId":"s","name":"n"}'
    whole = '{"resourceSpans":[{"scopeSpans":[{"spans":[%s]}]}]}'
    rows = [("ok", whole % span), ("empty", ""), ("null", None), ("none", "{}"), ("twice", '{"a":1,"a":2}'), ("text", whole % span + "x"), ("many", whole % ",".join([span] * 501)), ("large", '"' + "x" * (1 << 20) + '"')]
    spans, refused = facts.parse_otlp(spark.createDataFrame(rows, "upload string, payload string"))
    assert [r.upload for r in spans.collect()] == ["ok"]
    want = {"empty": "EMPTY_PAYLOAD", "null": "EMPTY_PAYLOAD", "none": "NO_RESOURCE_SPANS", "twice": "DUPLICATE_KEY", "text": "INVALID_JSON", "many": "TOO_MANY_SPANS", "large": "PAYLOAD_TOO_LARGE"}
    assert {r.upload: r.reason for r in refused.collect()} == want


def test_a_folder_as_a_corpus(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "bin").write_bytes(b"a\x00b")
    got, left = corpus.read_corpus(spark, f"file://{tmp_path}")
    assert [(r.path, r.text, r.bytes) for r in got.collect()] == [("src/a.py", "x = 1\n", 6)]
    assert [tuple(r) for r in left.collect()] == [("bin", 3, "BINARY")]
    (tmp_path / "src" / "b.json").write_text('{"factCount": 3,\n "more": 1}')
    docs, odd = facts.read_analyzer_output(spark, str(tmp_path / "src"), "factCount int")
    assert [r.factCount for r in docs.collect()] == [3] and [r.value for r in odd.collect()] == ["x = 1\n"]


def test_limits_of_a_corpus(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"f{i}.py").write_text("x" * (i % 7 + 1))
    (tmp_path / "large.py").write_text("x" * 100)
    (tmp_path / "empty.py").write_text("")
    (tmp_path / "skipped.md").write_bytes(b"\x00")
    names = sorted((f.name for f in tmp_path.iterdir() if f.suffix == ".py" and f.name not in ("large.py", "empty.py")), key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    for files_most, bytes_most in ((1000, 1000), (10, 1000), (1000, 50), (30, 50), (0, 0)):
        want, total = {"large.py": "FILE_SIZE_LIMIT"}, 0
        for n, name in enumerate(names, 1):
            total += (tmp_path / name).stat().st_size
            want[name] = "FILES_LIMIT" if n > files_most else "BYTES_LIMIT" if total > bytes_most else "kept"
        got, left = corpus.read_corpus(spark, f"file://{tmp_path}", ["*.md"], 99, files_most, bytes_most)
        assert {r.path: r.verdict for r in left.collect()} | {r.path: "kept" for r in got.collect()} == want
    (tmp_path / "none").mkdir()
    got, left = corpus.read_corpus(spark, f"file://{tmp_path}/none")
    assert got.count() == left.count() == 0


def test_sealed_runs(spark):
    runs, nodes = spark.createDataFrame([("r",), ("q",)], "run_id string"), spark.createDataFrame([("r", "n")], "run_id string, stable_key string")
    with pytest.raises(ValueError, match="RUN_SEALED"):
        validate.reject_if_sealed(runs, nodes)
    validate.reject_if_sealed(runs.where(F.col("run_id") == "q"), nodes)


class Imports:
    """Resolves `import x` to the file of the same component that says `define x`, whichever comes first."""

    def __init__(self):
        self.defined, self.asked = {}, []

    def file(self, path, text):
        for line in text.splitlines():
            verb, _, name = line.partition(" ")
            if verb == "define":
                self.defined[name] = path
                yield {"kind": "SYMBOL", "stable_key": name}
            elif verb == "import":
                self.asked.append((path, name))

    def end(self):
        for path, name in self.asked:
            yield {"kind": "RELATION" if name in self.defined else "UNRESOLVED", "stable_key": f"{path}->{self.defined.get(name, name)}", "path": path}


def test_extractors_of_components(spark):
    rows = [("a", "1", "import x\nimport y"), ("a", "2", "define x"), ("b", "1", "import x"), ("b", "0", None), (None, "9", "define z"), (None, "8", "import z")]
    got = facts.extract_component_facts(spark.createDataFrame(rows, "component string, path string, text string").repartition(3), Imports)
    assert sorted((str(r.component), r.path, r.kind, r.stable_key) for r in got.collect()) == [("None", "8", "RELATION", "8->9"), ("None", "9", "SYMBOL", "z"), ("a", "1", "RELATION", "1->2"), ("a", "1", "UNRESOLVED", "1->y"), ("a", "2", "SYMBOL", "x"), ("b", "1", "UNRESOLVED", "1->x")]
    assert got.select("fact_id").distinct().count() == 6
    with pytest.raises(Exception, match="takes a table with"):
        facts.component_extractor(Imports)(spark.range(1).asTable()).collect()


def test_documents_of_executions(spark, tmp_path):
    whole = {
        "manifest.json": '{"analyzer":{"id":"java","version":"1","imageDigest":"d"},"status":"SUCCEEDED","capabilitiesCompleted":["c"],"capabilitiesPartial":[],"capabilitiesFailed":[]}',
        "coverage.json": '{"filesDiscovered":2,"filesParsed":2,"filesFailed":0,"capabilities":[{"name":"c","status":"COMPLETED"}]}',
        "statistics.json": '{"factCount":1,"diagnosticCount":0}',
        "diagnostics.ndjson": "\n",
        "facts.ndjson": "{}\n",
    }
    cases = {
        "fine": {},
        "missing": {"facts.ndjson": None},
        "trailing": {"manifest.json": whole["manifest.json"] + "}"},
        "silent": {"coverage.json": '{"filesDiscovered":2}'},
        "large": {"statistics.json": '{"factCount":1,"diagnosticCount":0,"x":"' + "x" * (1 << 20) + '"}'},
        "long": {"diagnostics.ndjson": '{"code":"a","severity":"INFO","message":"' + "m" * (1 << 16) + '"}\n'},
        "told": {"diagnostics.ndjson": '{"code":"a","severity":"ERROR","message":"m"}'},
        "short": {"coverage.json": whole["coverage.json"].replace('"filesParsed":2', '"filesParsed":1')},
        "exit": {},
    }
    for case, changed in cases.items():
        (tmp_path / "out" / case).mkdir(parents=True)
        for name, text in (whole | changed).items():
            if text is not None:
                (tmp_path / "out" / case / name).write_text(text)
    (tmp_path / "out" / "fine" / "notes.txt").write_text("no document")
    asked = spark.createDataFrame([(x, 1 if x == "exit" else 0, "java", "1", "d") for x in [*cases, "absent"]], "execution_id string, exit_code int, expected_id string, expected_version string, expected_digest string")
    root = f"file://{tmp_path}/out"
    got = outputs.execution_results(asked, outputs.read_documents(spark, root), outputs.read_diagnostics(spark, root))
    assert {r.execution_id: r.error or r.status for r in got.collect()} == {
        "fine": "SUCCEEDED", "missing": "MISSING_ANALYZER_OUTPUT", "absent": "MISSING_ANALYZER_OUTPUT", "trailing": "INVALID_ANALYZER_MANIFEST", "silent": "INVALID_ANALYZER_COVERAGE",
        "large": "ANALYZER_METADATA_LIMIT", "long": "DIAGNOSTIC_LINE_LIMIT", "told": "PARTIALLY_SUCCEEDED", "short": "PARTIALLY_SUCCEEDED", "exit": "ANALYZER_EXECUTION_FAILED",
    }


def test_documents_of_executions_are_no_partitions_of_a_write(spark, monkeypatch, tmp_path):
    """each document was a partition of a Spark write, and the folders of diagnostics were listed one by one."""

    def refused(*_):
        raise AssertionError("a folder for each document")

    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.partitionBy", refused)
    got = {int(r.execution_id): r for r in registry.QUERIES["val8_from_documents"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 100 and all(r.error == "DOUBLED_ANALYZER_OUTPUT" for k, r in got.items() if k % 23 == 3)
    for path, text in {"a/diagnostics.ndjson": "x\n\n", "b/again=diagnostics.ndjson/copy": "y\n", "b/facts.ndjson": "no\n", "c/diagnostics.ndjson.old": "no\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert sorted(map(tuple, outputs.read_diagnostics(spark, f"file://{tmp_path}").collect())) == [("a", "x"), ("b", "y")]
