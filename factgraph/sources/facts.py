"""Facts, execution documents and spans as files; idempotent writes; extractors that users bring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from factgraph.operators import validate

MAX_LINE, MAX_FACTS = 1 << 20, 250_000


def read_fact_lines(spark: SparkSession, path: str) -> DataFrame:
    """execution, line_number, raw, oversized, invalid_utf8 of every line of newline-delimited files that isn't blank.

    A line ends at a line feed, not at a lone carriage return.  Lines are numbered within their file, by the block that
    they were read from and their order in it; blank ones count.  Only the counts of blocks are summed over a file; a row
    for each block goes to all tasks, so that no text is shuffled.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.regexp_replace("value", "\r$", "").alias("raw"),
        F.col("_metadata.file_name").alias("execution"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = lines.groupBy("execution", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("execution").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # within a block, ids follow each other
    numbered = lines.join(F.broadcast(before), ["execution", "block"]).withColumn("line_number", F.col("before") + F.col("at") - F.col("first") + 1)
    flags = ((F.octet_length("raw") > MAX_LINE).alias("oversized"), (~F.is_valid_utf8("raw")).alias("invalid_utf8"))
    return numbered.where("trim(raw) <> ''").select("execution", "line_number", "raw", *flags)


def bound_facts(lines: DataFrame, most: int = MAX_FACTS) -> tuple[DataFrame, DataFrame]:
    """The first lines of each execution, and one FACT_COUNT_LIMIT reject for each that has more."""
    over = lines.where(F.col("line_number") > most).groupBy("execution").agg(F.min("line_number").alias("line_number")).withColumn("reason", F.lit("FACT_COUNT_LIMIT"))
    return lines.where(F.col("line_number") <= most), over


def read_analyzer_output(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a schema, one a file, and the texts that do not fit it."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_odd"}
    rows = spark.read.text(path, wholetext=True).select("value", F.from_json("value", schema + ", _odd string", options).alias("d"))
    odd = F.col("d").isNull() | F.col("d._odd").isNotNull()
    return rows.where(~odd).select("d.*").drop("_odd"), rows.where(odd).select("value")


OTLP = """resourceSpans array<struct<resource:struct<attributes:variant>,scopeSpans:array<struct<
scope:struct<name:string,version:string,attributes:variant>,schemaUrl:string,spans:array<struct<traceId:string,spanId:string,
parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:variant,
status:struct<code:string,message:string>,events:array<variant>,links:array<variant>>>>>>>"""
#: Resources and scopes of a payload, and spans, at most.
MAX_RESOURCES, MAX_SPANS = 100, 500


def parse_otlp(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """upload, payload -> one row of each span with its resource's and scope's attributes as JSON, and the payloads that
    are refused as a whole, with the reason: too large, no strict JSON, no spans, or more than the bounds."""
    size = F.octet_length("payload")
    p = payloads.withColumn("reason", F.when(F.col("payload").isNull() | (size == 0), "EMPTY_PAYLOAD").when(size > MAX_LINE, "PAYLOAD_TOO_LARGE"))
    p = p.withColumn("reason", F.coalesce("reason", validate.strict_json(F.when(F.col("reason").isNull(), F.col("payload")).otherwise("{}"))))
    p = p.withColumn("r", F.when(F.col("reason").isNull(), F.from_json("payload", OTLP)["resourceSpans"]))
    scopes = F.flatten(F.transform("r", lambda r: F.coalesce(r["scopeSpans"], F.array())))
    spans = F.aggregate(scopes, F.lit(0), lambda n, s: n + F.coalesce(F.size(s["spans"]), F.lit(0)))
    bound = F.when(F.col("r").isNull(), "NO_RESOURCE_SPANS").when((F.size("r") > MAX_RESOURCES) | (F.size(scopes) > MAX_RESOURCES), "TOO_MANY_SCOPES").when(spans > MAX_SPANS, "TOO_MANY_SPANS")
    p = p.withColumn("reason", F.coalesce("reason", bound))
    refused = p.where("reason IS NOT NULL").select("upload", "reason", F.substring("payload", 1, 4096).alias("payload"))
    r = p.where("reason IS NULL").select("upload", F.explode("r").alias("r"))
    s = r.select("upload", F.to_json("r.resource.attributes").alias("resource_attributes"), F.explode("r.scopeSpans").alias("s"))
    scope = (F.col("s.scope.name").alias("scope_name"), F.col("s.scope.version").alias("scope_version"), F.to_json("s.scope.attributes").alias("scope_attributes"), F.col("s.schemaUrl").alias("schema_url"))
    x = s.select("upload", "resource_attributes", *scope, F.explode("s.spans").alias("x"))
    named = {"traceId": "trace_id", "spanId": "span_id", "parentSpanId": "parent_span_id", "name": "name", "kind": "kind", "status.code": "status", "startTimeUnixNano": "start_nanos", "endTimeUnixNano": "end_nanos"}
    counts = [F.coalesce(F.size(f"x.{c}"), F.lit(0)).alias(f"n_{c}") for c in ("events", "links")]
    return x.select(*x.columns[:-1], *[F.col(f"x.{a}").alias(b) for a, b in named.items()], F.to_json("x.attributes").alias("attributes"), *counts), refused


def read_otlp(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """parse_otlp() of files, one payload each."""
    raw = spark.read.text(path, wholetext=True)
    return parse_otlp(raw.select(F.col("_metadata.file_name").alias("upload"), F.col("value").alias("payload")))


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_new(rows: DataFrame, path: str, keys: list[str], by: str | None = None) -> None:
    """Appends the rows whose keys the table at path lacks; the same call twice writes once.

    by: one of the keys, by which the table is kept in folders, so that only those of the rows are read again.  A task
    that is lost leaves no rows, as files appear when the whole write commits; two writers need a table format with
    transactions.
    """
    fresh = rows.dropDuplicates(keys)
    old = stored_rows(rows.sparkSession, path)
    if old is not None:
        old = old.select(*[F.col(k).cast(rows.schema[k].dataType).alias(k) for k in keys])
        fresh = fresh.join(old, keys, "left_anti")
    out = fresh.write.mode("append")
    (out.partitionBy(by) if by else out).parquet(path)


def replay_events(events: DataFrame, run_id: str, cursor: int, page: int = 500) -> DataFrame:
    return events.where((F.col("run_id") == run_id) & (F.col("sequence") > cursor)).orderBy("sequence").limit(page)


def fact_id(key):
    return F.sha2(key, 256)


def extract_facts(corpus: DataFrame, extractor: Callable[[str, str], list[dict]], schema: str = "path string, kind string, stable_key string, properties string, start int, end int") -> DataFrame:
    """Facts that a user's function finds in each file (path, text), the first of each key in a file.

    The function gives dicts with kind, stable_key, properties (JSON text), start and end (characters of the text).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p, **x} for p, t in zip(b["path"], b["text"], strict=True) for x in {y["stable_key"]: y for y in reversed(extractor(p, t or ""))}.values()]
            yield pd.DataFrame(rows, columns=["path", "kind", "stable_key", "properties", "start", "end"])

    return corpus.select("path", "text").mapInPandas(run, schema).withColumn("fact_id", fact_id(F.col("stable_key")))


def make_evidence(facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Characters start to end of a file's text -> lines, columns and the hash of the whole lines."""
    both = facts.join(corpus.select("path", "text"), "path")
    head, body = F.expr("substring(text, 1, start)"), F.expr("substring(text, 1, greatest(start, end - 1))")
    line, last = (F.size(F.split(x, "\n")) for x in (head, body))
    lines = F.slice(F.split("text", "\n"), line, last - line + 1)
    out = both.withColumn("start_line", line).withColumn("end_line", last).withColumn("start_column", F.length(F.substring_index(head, "\n", -1)) + 1).withColumn("end_column", F.length(F.substring_index(F.expr("substring(text, 1, end)"), "\n", -1)) + 1)
    return out.withColumn("snippet_hash", F.concat(F.lit("sha256:"), F.sha2(F.array_join(lines, "\n"), 256))).drop("text")


COMPONENT_FACTS = T.StructType([T.StructField(c, T.StringType()) for c in ("component", "path", "kind", "stable_key", "properties")])


def component_extractor(make: Callable[[], object], name: str = "extract_component"):
    """A table function that runs a user's extractor over whole components: facts that need several files of one.

    make() gives a fresh extractor for each component.  Its file(path, text) is called for the component's files in the
    order of their paths, its end() after the last; both give dicts with kind, stable_key and properties (JSON text), and
    file() may give path to name another file.  Rows stream in and out: what is held of a component is what the extractor
    itself keeps.  Files of one component are read by one task, as the extractor asks; texts are not copied by the library.
    """

    class Extract:
        @staticmethod
        def analyze(corpus: AnalyzeArgument) -> AnalyzeResult:
            needed = {"component", "path", "text"}
            if not corpus.isTable or not needed <= set(corpus.dataType.names):
                raise ValueError(f"{name} takes a table with {', '.join(sorted(needed))}")
            return AnalyzeResult(COMPONENT_FACTS, partitionBy=[PartitioningColumn("component")], orderBy=[OrderingColumn("path")])

        def __init__(self):
            self.own, self.component = make(), None

        def _rows(self, found, path):
            for x in found:
                yield self.component, x.get("path", path), x["kind"], x["stable_key"], x.get("properties")

        def eval(self, row: Row):
            self.component = row["component"]
            yield from self._rows(self.own.file(row["path"], row["text"] or ""), row["path"])

        def terminate(self):
            yield from self._rows(self.own.end(), None)

    return udtf(Extract)


def extract_component_facts(corpus: DataFrame, make: Callable[[], object]) -> DataFrame:
    """COMPONENT_FACTS and fact_id of what component_extractor() finds in `corpus` (component, path, text)."""
    found = component_extractor(make)(corpus.select("component", "path", "text").asTable())
    return found.withColumn("fact_id", fact_id(F.concat_ws("|", "component", "kind", "stable_key")))
