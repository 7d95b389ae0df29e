"""Runtime evidence: spans are hashed, deduplicated, matched to nodes and summed up.

spans: upload, run_id, trace_id, span_id, parent_span_id, name, start_nanos, stable_key, symbol and more; nodes: run_id,
node_key, symbols (array), unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import semantics as S
from factgraph.operators.reach import shared_table

SPAN_KEY = ["run_id", "trace_id", "span_id"]


def span_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def dedup_spans(spans: DataFrame, stored: DataFrame | None = None, quota: int | None = 100_000) -> DataFrame:
    """spans with verdict: `new` (one of each key), `duplicate` (same hash), `conflict` (another hash), `over_quota`.

    The first of a key by upload, then hash, is the one that others are held against; a stored one comes before all.
    stored: run_id, trace_id, span_id, span_hash, which count against a run's quota.  Without a quota, no span is over it.
    """
    out = spans
    if stored is not None:
        out = out.join(stored.select(*SPAN_KEY, F.col("span_hash").alias("stored_hash")), SPAN_KEY, "left")
    else:
        out = out.withColumn("stored_hash", F.lit(None).cast("string"))
    same = Window.partitionBy(*SPAN_KEY).orderBy("upload", "span_hash")
    out = out.withColumns({"first": F.first("span_hash").over(same), "turn": F.row_number().over(same)})
    base = F.coalesce("stored_hash", "first")
    verdict = F.when(F.col("span_hash") != base, "conflict").when(F.col("stored_hash").isNotNull() | (F.col("turn") > 1), "duplicate").otherwise("new")
    out = out.withColumn("verdict", verdict).drop("first", "stored_hash", "turn")
    if quota is None:
        return out
    # the quota counts keys, stored ones first; only runs that exceed it are dealt into ranges, and only the range with
    # the cut is ranked
    n_new = out.where("verdict = 'new'").groupBy("run_id").agg(F.count("*").alias("n"))
    used = F.lit(0).cast("long")
    if stored is not None:
        n_new = n_new.join(stored.groupBy("run_id").agg(F.count("*").alias("used")), "run_id", "left")
        used = F.coalesce("used", used)
    full = n_new.select("run_id", "n", F.greatest(F.lit(quota) - used, F.lit(0)).alias("room")).where(F.col("n") > F.col("room")).select("run_id", "room")
    new = out.where("verdict = 'new'").join(full, "run_id", "left_semi").select("run_id", "upload", "trace_id", "span_id")
    ranges = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared_table(new.repartitionByRange(ranges, "run_id", "upload", "trace_id", "span_id").withColumn("range", F.spark_partition_id()), "span-ranges")
    earlier = Window.partitionBy("run_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("run_id", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = dealt.join(counts, ["run_id", "range"]).join(full, "run_id")
    behind = placed.where(F.col("before") >= F.col("room")).select(*SPAN_KEY)
    cut = placed.where((F.col("before") < F.col("room")) & (F.col("before") + F.col("n") > F.col("room")))
    cut = cut.withColumn("place", F.row_number().over(Window.partitionBy("run_id", "range").orderBy("upload", "trace_id", "span_id"))).where(F.col("before") + F.col("place") > F.col("room")).select(*SPAN_KEY)
    out = out.join(behind.union(cut).withColumn("over", F.lit(True)), SPAN_KEY, "left")
    return out.withColumn("verdict", F.when((F.col("verdict") == "new") & F.coalesce("over", F.lit(False)), "over_quota").otherwise(F.col("verdict"))).drop("over")


def asked_facts(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """The facts of nodes that spans can meet: of a key that a span names, or with a fact that states a symbol that one names,
    as a node's symbol is that of one of its facts.  What spans name is written first, so that Spark knows how little it is."""
    symbols = shared_table(spans.where("symbol IS NOT NULL").select("run_id", "symbol").distinct(), "symbols")
    stating = facts.select("run_id", "stable_key", S.prop(F.col("properties"), "symbolSignature").alias("symbol")).join(symbols, ["run_id", "symbol"], "left_semi")
    keys = spans.where("stable_key IS NOT NULL").select("run_id", "stable_key").union(stating.select("run_id", "stable_key"))
    return facts.join(shared_table(keys.distinct(), "asked"), ["run_id", "stable_key"], "left_semi")


def match_spans(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """spans with node_key and status: by stable key alone where they have one, else by a qualified symbol that one node has."""
    by_key = nodes.where("NOT unresolved").select("run_id", F.col("node_key").alias("stable_key"), F.col("node_key").alias("by_key")).distinct()
    symbols = nodes.where("NOT unresolved").select("run_id", "node_key", F.explode(F.array_distinct(F.array_compact("symbols"))).alias("symbol")).groupBy("run_id", "symbol").agg(F.count("*").alias("n"), F.min("node_key").alias("by_symbol"))
    # spans without a key or symbol meet nothing; they are dealt by their own ids, not to the one task of nulls
    alone = F.concat(F.lit("\x00"), "trace_id", "span_id")
    out = spans.withColumns({"_key": F.coalesce("stable_key", alone), "_symbol": F.coalesce("symbol", alone)})
    out = out.join(by_key.withColumnRenamed("stable_key", "_key"), ["run_id", "_key"], "left").join(symbols.withColumnRenamed("symbol", "_symbol"), ["run_id", "_symbol"], "left").drop("_key", "_symbol")
    keyed = F.col("stable_key").isNotNull() & (F.trim("stable_key") != "")
    qualified = F.coalesce(F.col("symbol").rlike(r"\.|::|#"), F.lit(False))
    status = (
        F.when(keyed, F.when(F.col("by_key").isNotNull(), "MATCHED_STABLE_KEY").otherwise("UNRESOLVED"))
        .when(qualified & (F.col("n") == 1), "MATCHED_SYMBOL")
        .when(qualified & (F.col("n") > 1), "AMBIGUOUS")
        .otherwise("UNRESOLVED")
    )
    out = out.withColumn("status", status)
    return out.withColumn("node_key", F.when(F.col("status") == "MATCHED_STABLE_KEY", F.col("by_key")).when(F.col("status") == "MATCHED_SYMBOL", F.col("by_symbol"))).drop("by_key", "by_symbol", "n")


def observations(matched: DataFrame) -> DataFrame:
    return matched.where("node_key IS NOT NULL").select(*SPAN_KEY, "node_key", "status")


def ingest_summary(judged: DataFrame) -> DataFrame:
    """For each upload: accepted, duplicate, matched and unresolved spans.  judged: verdict and status of each span."""
    new = F.col("verdict") == "new"
    return judged.groupBy("upload").agg(
        F.count_if(new).alias("accepted"),
        F.count_if(F.col("verdict") == "duplicate").alias("duplicate"),
        F.count_if(F.col("verdict") == "conflict").alias("conflict"),
        F.count_if(new & F.col("node_key").isNotNull()).alias("matched"),
        F.count_if(new & F.col("node_key").isNull()).alias("unresolved"),
    )


def runtime_summary(matched: DataFrame) -> DataFrame:
    return matched.groupBy("run_id").agg(F.count("*").alias("spans"), F.countDistinct("trace_id").alias("traces"), F.count("node_key").alias("matched"), F.count_if(F.col("node_key").isNull()).alias("unmatched"), F.countDistinct("node_key").alias("observed_nodes"))


def observed_paths(matched: DataFrame) -> DataFrame:
    """Distinct (parent_node, child_node) of spans and their parents, both matched."""
    own = matched.where("node_key IS NOT NULL")
    parent = own.select("run_id", "trace_id", F.col("span_id").alias("parent_span_id"), F.col("node_key").alias("parent_node"))
    return own.select("run_id", "trace_id", "parent_span_id", F.col("node_key").alias("child_node")).join(parent, ["run_id", "trace_id", "parent_span_id"]).select("run_id", "parent_node", "child_node").distinct()


def path_page(paths: DataFrame, most: int = 500) -> DataFrame:
    """The first paths of each run by parent and child, and whether there are more: place, truncated.  Spark keeps the first
    rows of each task before it shuffles, so that no task ranks all paths of a run."""
    ranked = paths.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("parent_node", "child_node"))).where(F.col("place") <= most + 1)
    return ranked.withColumn("truncated", F.max("place").over(Window.partitionBy("run_id")) > most).where(F.col("place") <= most)


def unobserved_nodes(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    return nodes.join(seen.select("run_id", "node_key"), ["run_id", "node_key"], "left_anti")


def unobserved_count(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """run_id, kind, nodes, unobserved: how many nodes of a kind no span was matched to; kinds wholly seen have 0."""
    own = nodes.join(seen.select("run_id", "node_key").distinct().withColumn("_seen", F.lit(True)), ["run_id", "node_key"], "left")
    return own.groupBy("run_id", "kind").agg(F.count("*").alias("nodes"), F.count_if(F.col("_seen").isNull()).alias("unobserved"))


def span_page(spans: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page by start and id, with has_more; limit 1 to 500, offset up to 100 000."""
    limit, offset = min(500, max(1, limit)), min(100_000, max(0, offset))
    page = spans.orderBy("start_nanos", "trace_id", "span_id").offset(offset).limit(limit + 1)
    ranked = page.withColumn("place", F.row_number().over(Window.orderBy("start_nanos", "trace_id", "span_id")))
    return ranked.withColumn("has_more", F.max(F.col("place") > limit).over(Window.partitionBy())).where(F.col("place") <= limit)
