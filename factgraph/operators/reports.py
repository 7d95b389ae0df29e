"""Reports on runs and tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible_rows(rows: DataFrame, members: DataFrame, user_id: str) -> DataFrame:
    """Rows (org_id, project_id, deleted) of projects that a user may see: as admin of the organization or as member."""
    own = members.where(F.col("user_id") == user_id)
    admin = own.where("role = 'ORG_ADMIN'").select("org_id")
    live = rows.where("NOT deleted")
    named = live.join(own.select("org_id", "project_id"), ["org_id", "project_id"], "left_semi")
    return named.union(live.join(admin, "org_id", "left_semi").select(*named.columns)).distinct()


def coverage_report(executions: DataFrame, components: DataFrame) -> DataFrame:
    """run_id with its executions' coverage and components, and whether all of it is complete."""
    e = executions.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("execution_id", "files_discovered", "files_parsed", "files_failed"))).alias("coverage"), F.bool_and((F.col("files_failed") == 0) & (F.col("files_parsed") >= F.col("files_discovered")) & (F.col("status") == "SUCCEEDED")).alias("complete"))
    c = components.groupBy("run_id").agg(F.array_sort(F.collect_list("root")).alias("components"))
    return e.join(c, "run_id", "left")


def diagnostics_report(executions: DataFrame, components: DataFrame, runs: DataFrame) -> DataFrame:
    """The diagnostics of executions and components, and the failure of each run, as one list."""
    parts = [
        executions.select("run_id", F.lit("EXECUTION").alias("origin"), F.col("execution_id").alias("of"), F.explode("diagnostics").alias("d")),
        components.select("run_id", F.lit("COMPONENT").alias("origin"), F.col("root").alias("of"), F.explode("diagnostics").alias("d")),
    ]
    told = parts[0].unionByName(parts[1]).select("run_id", "origin", "of", "d.code", "d.severity", "d.message")
    failed = runs.where("failure_code IS NOT NULL").select("run_id", F.lit("RUN").alias("origin"), F.col("run_id").alias("of"), F.col("failure_code").alias("code"), F.lit("FATAL").alias("severity"), F.col("failure_message").alias("message"))
    return told.unionByName(failed)


def facts_by_kind(facts: DataFrame) -> DataFrame:
    return facts.groupBy("execution_id", "kind").agg(F.count("*").alias("n"))


def coverage_counts(files: DataFrame, capabilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files by what became of them; capabilities by their worst file, with sorted limitations."""
    counts = files.groupBy("execution_id").agg(F.count("*").alias("discovered"), F.count_if(F.col("state") == "PARSED").alias("parsed"), F.count_if(F.col("state") == "FAILED").alias("failed"))
    by = capabilities.groupBy("execution_id", "capability").agg(F.count_if(F.col("state") == "FAILED").alias("bad"), F.count_if(F.col("state") == "COMPLETED").alias("good"), F.array_sort(F.collect_set("limitation")).alias("limitations"))
    status = F.when(F.col("bad") == 0, F.when(F.size("limitations") > 0, "PARTIAL").otherwise("COMPLETED")).when(F.col("good") == 0, "FAILED").otherwise("PARTIAL")
    return counts, by.withColumn("status", status).drop("bad", "good")


def ready_tasks(tasks: DataFrame, dependencies: DataFrame, active_runs: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Pending tasks that are due, have attempts left, and that no unfinished dependency holds up; a failed one does not
    where the task accepts that.  In the order in which they would be taken.

    tasks: task_id, run_id, status, accept_failed, created_at, and where they are kept, priority, available_at, attempt
    and max_attempts; dependencies: task_id, depends_on.
    """
    pending = tasks.where("status = 'PENDING'")
    if "available_at" in tasks.columns:
        pending = pending.where(F.col("available_at") <= (F.current_timestamp() if now is None else now))
    if "attempt" in tasks.columns:
        pending = pending.where("attempt < max_attempts")
    if active_runs is not None:
        pending = pending.join(active_runs.select("run_id"), "run_id", "left_semi")
    state = tasks.select(F.col("task_id").alias("depends_on"), F.col("status").alias("other"))
    held = pending.select("task_id", "accept_failed").join(dependencies.where("depends_on IS NOT NULL"), "task_id").join(state, "depends_on")
    blocking = held.where("other IN ('PENDING', 'RUNNING') OR (NOT accept_failed AND other <> 'SUCCEEDED')")
    order = [c for c in ("priority", "available_at", "created_at", "task_id") if c in tasks.columns]
    return pending.join(blocking.select("task_id"), "task_id", "left_anti").orderBy(*order)


def last_hour_metrics(tasks: DataFrame, now: Column, calls: DataFrame | None = None) -> DataFrame:
    """One row: tasks pending and running, analyzer seconds and failures of the last hour, and tokens, cost and latency
    of the model calls of the last hour; what nothing counts for stays null.

    tasks: status, task_type, created_at, finished_at, seconds; calls: created_at, input_tokens, output_tokens, cost,
    latency_ms.
    """

    def recent(c: str) -> Column:
        return (F.col(c) > now - F.expr("INTERVAL 1 HOUR")) & (F.col(c) <= now)

    run = recent("finished_at") & (F.col("task_type") == "RUN_ANALYZER")
    out = tasks.agg(
        F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "RUNNING").alias("running"),
        F.avg(F.when(run, F.col("seconds"))).alias("analyzer_seconds"), F.count_if(run & (F.col("status") == "FAILED_PERMANENTLY")).alias("analyzer_failed"),
    )
    if calls is None:
        return out
    own = calls.where(recent("created_at"))
    sums = own.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.avg("latency_ms").alias("latency"))
    return out.crossJoin(F.broadcast(sums))  # one row each, by their aggregates


def org_quota(runs: DataFrame, now: Column, active_most: int, hourly_most: int) -> DataFrame:
    counts = runs.groupBy("org_id").agg(F.count_if(F.col("status").isin("PENDING", "RUNNING")).alias("active"), F.count_if(F.col("created_at") > now - F.expr("INTERVAL 1 HOUR")).alias("last_hour"))
    return counts.withColumn("admitted", (F.col("active") < active_most) & (F.col("last_hour") < hourly_most))


TERMINAL = ("SUCCEEDED", "PARTIALLY_SUCCEEDED", "FAILED", "CANCELLED")


def expire_sources(evidence: DataFrame, quarantine: DataFrame, runs: DataFrame, policy: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence and quarantined lines of ended runs that have outlived their organization's retention lose their text,
    not their hashes; with an audit row for each such run.

    runs: run_id, org_id, status, finished_at; policy: org_id, retention_days.
    """
    ended = runs.where(F.col("status").isin(*TERMINAL)).join(policy, "org_id")
    old = ended.where(F.col("finished_at") < now - F.make_dt_interval(F.col("retention_days"))).select("run_id", "org_id")
    mark = old.select("run_id", F.lit(True).alias("expired"))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(mark, "run_id", "left").withColumn("expired", F.coalesce("expired", F.lit(False)))

    out = marked(evidence).withColumn("snippet", F.when(F.col("expired"), "").otherwise(F.col("snippet")))
    out = out.withColumn("source_available", F.col("source_available") & ~F.col("expired")).drop("expired")
    lines = marked(quarantine).withColumn("raw", F.when(F.col("expired"), "").otherwise(F.col("raw"))).drop("expired")
    return out, lines, old.select("org_id", "run_id", F.lit("SOURCE_EXPIRED").alias("action"))


def audit_page(events: DataFrame, org_id: str, limit: int = 100) -> DataFrame:
    return events.where(F.col("org_id") == org_id).orderBy(F.desc("created_at"), F.desc("event_id")).limit(min(500, max(1, limit)))
