"""The batch rules over streams: facts, spans, late parents, event logs and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from factgraph.operators.ingest import ingest
from factgraph.streaming.spans import judged_spans, write_judged


def stream_facts(lines: DataFrame, corpus: DataFrame, facts_path: str, quarantine_path: str, checkpoint: str) -> DataStreamWriter:
    """A stream of raw lines (execution, line_number, raw, oversized, invalid_utf8) into a table of facts and one of
    quarantined lines, by ingest(): a fact that restates one of an earlier batch otherwise is quarantined, and a batch
    that is run again writes nothing twice."""

    def each(batch: DataFrame, _: int) -> None:
        ingest(batch, corpus, facts_path, quarantine_path)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def stream_spans(spans: DataFrame, table_path: str, rejects_path: str, checkpoint: str, quota: int | None = 100_000, ttl_ms: int | None = None) -> DataStreamWriter:
    """New spans into a table; spans that restate a key otherwise, or exceed the quota of their run over all batches, into
    another.  What came before is known from the state store (see `spans`), so that no table is read; the session needs
    spark.sql.streaming.stateStore.providerClass = spans.PROVIDER when the stream starts."""

    def each(judged: DataFrame, batch: int) -> None:
        write_judged(judged, batch, table_path, rejects_path)

    return judged_spans(spans, quota, ttl_ms).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint)


def late_parents(spans: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """run_id, parent_node, child_node, child_span of each child span (event_time, run_id, trace_id, span_id,
    parent_span_id, node_key) of a stream and its parent, whichever came first, if both come within the window.

    A child whose parent has not come by then is given once, without a parent, when the watermark has passed its window.
    """
    timed = spans.withWatermark("event_time", delay)
    child = timed.where("parent_span_id <> ''").select("run_id", "trace_id", "parent_span_id", F.col("span_id").alias("child_span"), F.col("node_key").alias("child_node"), F.col("event_time").alias("child_time"))
    parent = timed.select(F.col("run_id").alias("r"), F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("node_key").alias("parent_node"), F.col("event_time").alias("parent_time"))
    near = F.expr(f"run_id = r AND trace_id = t AND parent_span_id = s AND child_time BETWEEN parent_time - INTERVAL {window} AND parent_time + INTERVAL {window}")
    return child.join(parent, near, "leftOuter").select("run_id", "parent_node", "child_node", "child_span")


def stream_events(events: DataFrame, run_id: str, cursor: int = 0) -> DataFrame:
    """The log of a run after a cursor; the checkpoint of the query that writes it is the cursor from then on."""
    return events.where((F.col("run_id") == run_id) & (F.col("sequence") > cursor))


def stream_metrics(tasks: DataFrame, calls: DataFrame | None = None, window: str = "1 hour", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts, means and sums over a trailing window of a stream of tasks' changes (created_at, status, seconds) and, if
    given, one of model calls (created_at, input_tokens, output_tokens, cost, latency_ms): a task counts in the state that
    each change says.  Both streams are one before they meet their windows, so that one aggregate and one watermark (that
    of the slower stream) serve all; what nothing counts for stays null."""
    amounts = {"input_tokens": "bigint", "output_tokens": "bigint", "cost": "double", "latency_ms": "double"}
    both = tasks.withWatermark("created_at", delay).select("created_at", "status", F.col("seconds").cast("double").alias("seconds"), *[F.lit(None).cast(kind).alias(c) for c, kind in amounts.items()])
    if calls is not None:
        both = both.unionByName(calls.withWatermark("created_at", delay).select("created_at", F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("seconds"), *[F.col(c).cast(kind).alias(c) for c, kind in amounts.items()]))
    done = F.col("status") == "SUCCEEDED"
    states = {"pending": "PENDING", "running": "RUNNING", "done": "SUCCEEDED", "failed": "FAILED_PERMANENTLY"}
    found = [F.count_if(F.col("status") == status).alias(name) for name, status in states.items()]
    found.append(F.avg(F.when(done, F.col("seconds"))).alias("mean_seconds"))
    if calls is not None:
        found += [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost")] + [F.avg("latency_ms").alias("latency")]
    return both.groupBy(F.window("created_at", window, slide)).agg(*found)
