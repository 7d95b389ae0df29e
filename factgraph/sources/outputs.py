"""The documents that an analyzer leaves of each execution, brought together: manifest, coverage, statistics,
diagnostics and facts.

An execution's documents lie in one folder below a root, each as a file of its name or in a folder whose name ends with it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import validate

DOCUMENTS = ("manifest.json", "coverage.json", "statistics.json", "diagnostics.ndjson", "facts.ndjson")
#: Bytes of a JSON document and characters of a diagnostic, at most.
MAX_DOCUMENT, MAX_DIAGNOSTIC = 1 << 20, 1 << 16
SEVERITIES = ("INFO", "WARNING", "ERROR", "FATAL")
SCHEMAS = {
    "manifest": "analyzer struct<id:string,version:string,imageDigest:string>, status string, capabilitiesCompleted array<string>, capabilitiesPartial array<string>, capabilitiesFailed array<string>, factCount bigint, diagnosticCount bigint",
    "coverage": "filesDiscovered bigint, filesParsed bigint, filesFailed bigint, capabilities array<struct<name:string,status:string>>",
    "statistics": "factCount bigint, diagnosticCount bigint",
}
REQUIRED = {"manifest": ("analyzer.id", "analyzer.version", "status"), "coverage": ("filesDiscovered", "filesParsed", "filesFailed"), "statistics": ("factCount", "diagnosticCount")}


def _named(path: Column, root: str) -> tuple[Column, Column]:
    """The execution and the document that a file below root belongs to."""
    below = F.substring_index(path, root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return F.regexp_extract(below, "^(?:[^/=]*=)?([^/]+)/", 1).alias("execution_id"), F.regexp_extract(below, f"({'|'.join(x.replace('.', '[.]') for x in DOCUMENTS)})(?:/[^/]*)?$", 1).alias("document")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """execution_id, document, bytes, text of the files below root; text is null where it is not JSON or too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = F.col("document").endswith(".json") & (F.col("bytes") <= MAX_DOCUMENT)
    named = files.select(*_named(F.col("path"), root), F.col("length").alias("bytes"), "path", "content")
    # only small JSON is read; of all others no more than their sizes
    texts = named.where(small).select("execution_id", "document", "bytes", F.col("content").cast("string").alias("text"))
    return texts.unionByName(named.where(~small & (F.col("document") != "")).select("execution_id", "document", "bytes"), allowMissingColumns=True)


def read_diagnostics(spark: SparkSession, root: str) -> DataFrame:
    """execution_id, raw: the lines of diagnostics that are not empty, one row each.

    Folders are listed side by side by tasks; files of other names are left out by their paths before any is read.
    """
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(root, lineSep="\n")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "execution_id string, raw string")
    lines = lines.where(F.col("_metadata.file_path").rlike("/[^/]+/[^/]*diagnostics[.]ndjson(/[^/]*)?$"))
    return lines.where("value <> ''").select(_named(F.col("_metadata.file_path"), root)[0], F.col("value").alias("raw"))


def _fits(name: str) -> Column:
    """Whether a parsed document says what it must; an unreadable one says nothing."""
    d = F.col(name)
    return F.coalesce(F.reduce(F.array(*[d.getField(x.split(".")[0]).getField(x.split(".")[1]).isNotNull() if "." in x else d.getField(x).isNotNull() for x in REQUIRED[name]]), F.lit(True), lambda a, x: a & x), F.lit(False))


def assembled(executions: DataFrame, documents: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Each execution with what its documents say, in the shape that validate.derive_execution_status takes, and reason:
    why its output as a whole is refused, first missing and doubled documents, then unreadable ones.

    executions: execution_id, exit_code, expected_id, expected_version, expected_digest.  Documents of other executions do
    not count.  Diagnostics are counted by line; no list of them is built.
    """
    known = F.col("document").isin(*DOCUMENTS)
    by = documents.where(known).groupBy("execution_id").agg(
        F.countDistinct("document").alias("n_documents"),
        F.count("*").alias("n_files"),
        F.max(F.when(F.col("document").endswith(".json"), F.col("bytes"))).alias("largest"),
        *[F.max(F.when(F.col("document") == f"{name}.json", F.col("text"))).alias(f"{name}_text") for name in SCHEMAS],
    )
    d = diagnostics.withColumn("said", F.from_json("raw", "code string, severity string, message string"))
    fine = F.col("said.code").isNotNull() & F.col("said.message").isNotNull() & F.coalesce(F.col("said.severity").isin(*SEVERITIES), F.lit(False)) & validate.strict_json(F.col("raw")).isNull()
    told = d.groupBy("execution_id").agg(F.count("*").alias("n_diagnostics"), F.max(F.length("raw")).alias("longest"), F.count_if(~fine).alias("n_odd"), F.count_if(F.col("said.severity").isin("ERROR", "FATAL")).alias("n_severe"))
    out = executions.join(by, "execution_id", "left").join(told, "execution_id", "left")
    for name, schema in SCHEMAS.items():
        strict = F.when(validate.strict_json(F.col(f"{name}_text")).isNull(), F.col(f"{name}_text"))
        out = out.withColumn(name, F.from_json(strict, schema))
    m, c = F.col("manifest"), F.col("coverage")
    reason = validate.first_reason(
        (~F.col("exit_code").isin(0, 10), "ANALYZER_EXECUTION_FAILED"),
        (F.coalesce("n_documents", F.lit(0)) < len(DOCUMENTS), "MISSING_ANALYZER_OUTPUT"),
        (F.col("n_files") > F.col("n_documents"), "DOUBLED_ANALYZER_OUTPUT"),
        (F.col("largest") > MAX_DOCUMENT, "ANALYZER_METADATA_LIMIT"),
        *[(~_fits(name), f"INVALID_ANALYZER_{name.upper()}") for name in SCHEMAS],
        (m["analyzer"]["version"] != F.col("expected_version"), "ANALYZER_IDENTITY_MISMATCH"),
        (m["status"] == "FAILED", "ANALYZER_EXECUTION_FAILED"),
        (F.col("longest") > MAX_DIAGNOSTIC, "DIAGNOSTIC_LINE_LIMIT"),
        (F.coalesce("n_odd", F.lit(0)) > 0, "INVALID_ANALYZER_DIAGNOSTIC"),
    )
    none = F.array().cast("array<string>")
    severe = F.when(F.col("n_severe") > 0, F.array(F.struct(F.lit("ERROR").alias("severity"))))
    return out.select(
        "execution_id", "exit_code", "expected_id", "expected_digest", reason.alias("reason"),
        m["analyzer"]["id"].alias("analyzer_id"), m["analyzer"]["imageDigest"].alias("digest"), m["status"].alias("manifest_status"),
        *[F.coalesce(m[f"capabilities{x}"], none).alias(f"capabilities_{x.lower()}") for x in ("Completed", "Partial", "Failed")],
        c["filesDiscovered"].alias("files_discovered"), c["filesParsed"].alias("files_parsed"), c["filesFailed"].alias("files_failed"),
        F.coalesce(c["capabilities"], F.array().cast("array<struct<name:string,status:string>>")).alias("capabilities"),
        F.coalesce(severe, F.array().cast("array<struct<severity:string>>")).alias("diagnostics"), F.coalesce("n_diagnostics", F.lit(0)).alias("n_diagnostics"),
    )


def execution_results(executions: DataFrame, documents: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """execution_id, error, status, n_diagnostics of each execution, from its documents."""
    judged = validate.derive_execution_status(assembled(executions, documents, diagnostics))
    error = F.coalesce("reason", "error")
    return judged.select("execution_id", error.alias("error"), F.when(error.isNull(), F.col("status")).alias("status"), "n_diagnostics")
