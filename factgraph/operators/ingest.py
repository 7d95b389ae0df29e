"""Ingestion: raw lines of fact files become stored facts, or quarantined lines with a reason; in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators import validate
from factgraph.operators.reach import shared_table
from factgraph.sources.facts import append_new, bound_facts, stored_rows

FACT_KEY = ["execution_id", "fact_id"]


def validated(lines: DataFrame, corpus: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts to keep and lines to quarantine, by all rules in their order.

    lines: execution, line_number, raw, oversized, invalid_utf8; corpus: file_path, text; stored: execution_id, fact_id,
    fingerprint of facts that earlier batches have kept, which come before all lines.  A line is refused for its form,
    its fields, the first of its pieces of evidence that fails, or as it restates a fact otherwise; one that says the
    same again goes silently.
    """
    lines, over = bound_facts(lines)
    # written once, as every rule below reads what the first one has parsed
    judged = shared_table(validate.check_fact_schema(lines).withColumnRenamed("execution", "execution_id"), "judged")
    fact = F.col("fact")
    shaped = judged.where("reason IS NULL").select(
        "execution_id", "line_number", "raw", fact["factId"].alias("fact_id"), fact["kind"].alias("kind"), fact["stableKey"].alias("stable_key"), fact["origin"].alias("origin"),
        fact["confidence"].alias("confidence"), fact["contractVersion"].alias("contract_version"), F.size(fact["evidence"]).alias("evidence_count"), fact["evidence"].alias("evidence"),
        F.to_json(fact["properties"]).alias("properties"), *[F.try_variant_get(fact["properties"], f"$.{a}", "string").alias(b) for a, b in (("sourceKey", "source_key"), ("targetKey", "target_key"), ("ownerKey", "owner_key"))],
    )
    fields = shared_table(validate.check_fact_fields(shaped), "fields")
    good = fields.where("reason IS NULL").drop("reason")
    cited = good.select("execution_id", "line_number", F.posexplode("evidence").alias("at", "e")).select(
        "execution_id", "line_number", "at", F.col("e.filePath").alias("file_path"), F.col("e.startLine").alias("start_line"), F.col("e.endLine").alias("end_line"),
        F.coalesce("e.startColumn", F.lit(1)).alias("start_column"), F.coalesce("e.endColumn", F.lit(1)).alias("end_column"), F.col("e.snippetHash").alias("snippet_hash"),
    )
    failed = validate.check_evidence(cited, corpus).where("reason IS NOT NULL").groupBy("execution_id", "line_number").agg(F.min_by("reason", "at").alias("failed"))
    print_ = validate.fact_print(F.col("kind"), F.col("stable_key"), F.col("origin"), F.col("confidence"), F.col("properties"), F.col("evidence"))
    known = good.join(failed, ["execution_id", "line_number"], "left").withColumn("fingerprint", print_).withColumn("bad", F.col("failed").isNotNull())
    if stored is not None:
        earlier = stored.join(good.select(*FACT_KEY).distinct(), FACT_KEY, "left_semi").select(*FACT_KEY, "fingerprint", F.lit(0).cast("long").alias("line_number"), F.lit(False).alias("bad"))
        known = known.unionByName(earlier, allowMissingColumns=True)
    told = shared_table(validate.judge_facts(known), "told").where("line_number > 0")
    kept = told.where("verdict = 'KEPT'").select(*FACT_KEY, "line_number", "kind", "stable_key", "origin", "confidence", "properties", "evidence", "fingerprint")
    reason = F.when(F.col("verdict") == "INVALID_EVIDENCE", F.col("failed")).otherwise(F.col("verdict"))
    cols = ("execution_id", "line_number")
    bad = judged.where("reason IS NOT NULL").select(*cols, "reason", "raw").unionByName(fields.where("reason IS NOT NULL").select(*cols, "reason", "raw"))
    bad = bad.unionByName(told.where(F.col("verdict").isin("INVALID_EVIDENCE", "DUPLICATE_ID_CONFLICT")).select(*cols, reason.alias("reason"), "raw"))
    bad = bad.unionByName(over.select(F.col("execution").alias("execution_id"), "line_number", "reason", F.lit(None).cast("string").alias("raw")))
    return kept, validate.quarantine_rows(bad)


def ingest(lines: DataFrame, corpus: DataFrame, facts_path: str, quarantine_path: str) -> None:
    """validated() against what the tables hold, appended to them; the same lines twice write once."""
    stored = stored_rows(lines.sparkSession, facts_path)
    kept, bad = validated(lines, corpus, stored.select(*FACT_KEY, "fingerprint") if stored is not None else None)
    append_new(bad, quarantine_path, ["execution_id", "line_number", "reason"], by="execution_id")
    append_new(kept, facts_path, FACT_KEY, by="execution_id")
