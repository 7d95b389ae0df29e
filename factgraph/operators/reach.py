"""Bounded reachability: scenarios of entry points, neighbourhoods and lifted edges, level by level for all roots at once."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.functions import semantics as S
from factgraph.functions import vocabulary as V


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only on a single machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _own_dir()
    return where.rstrip("/")


def shared_path(df: DataFrame, tag: str) -> str:
    """Where df has been written to in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the plan, and no lost executor undoes it."""
    return df.sparkSession.read.schema(df.schema).parquet(shared_path(df, tag))


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="factgraph-")


def scenario_members(nodes: DataFrame, edges: DataFrame, max_depth: int = 8, max_nodes: int = 120) -> tuple[DataFrame, DataFrame]:
    """Members of each entry point's scenario, and whether it was truncated.

    nodes: run_id, stable_key, kind, confidence, evidence_ids, unresolved, framework_internal.
    edges: run_id, source_key, target_key, kind, confidence, evidence_ids.
    Returns (run_id, entry_key, member_key, kind, depth, position, confidence, evidence_ids) and (run_id, entry_key,
    truncated).  Nodes and edges without evidence_ids give members without: the evidence of a whole path on each member
    is most of what a search writes.  The members are those of a breadth-first search that takes children by (stable_key, edge kind) and
    stops at the budgets: candidates of a level are ordered by (place of the parent, stable_key, edge kind), and the
    first of each child are taken while the budget lasts.

    Nodes are numbered in the order of their keys, so that a search shuffles numbers; what it must know of a child stands
    on the edge.  Each level deals its steps and what was found before once, by entry.
    """
    max_depth, max_nodes = min(16, max(1, max_depth)), min(500, max(1, max_nodes))
    told = "evidence_ids" in nodes.columns
    carried = ["confidence", "evidence_ids"] if told else ["confidence"]
    numbered = shared_table(nodes.orderBy("stable_key", "run_id").withColumn("n", F.monotonically_increasing_id()), "numbered")
    ways = _ways(numbered, edges, max_nodes, carried)
    level = numbered.where(F.col("kind").isin(*V.ENTRY_KINDS)).select(
        F.col("n").alias("entry"), F.col("n").alias("member"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("position"), *carried,
        (~F.col("unresolved")).alias("open"), F.lit(True).alias("taken"), F.lit(False).alias("cut"),
    )
    level = shared_table(level, "level")
    levels, entry = [level], Window.partitionBy("entry")
    for depth in range(max_depth + 1):
        last = depth == max_depth
        front = level.where("taken AND open")
        if front.isEmpty():
            break
        front = front.select("entry", F.col("member").alias("source"), F.col("position").alias("parent"), *[F.col(c).alias(f"path_{c}") for c in carried])
        step = {"confidence": F.least("path_confidence", "edge_confidence", "own_confidence").alias("confidence")}
        if told:
            step["evidence_ids"] = F.array_union(F.array_union("path_evidence_ids", "edge_evidence_ids"), "own_evidence_ids").alias("evidence_ids")
        x = F.struct("parent", "turn", *[step[c] for c in carried], "open", "shut").alias("x")
        none = F.lit(None).cast("long").alias("position")
        steps = front.join(ways, "source").select("entry", F.col("target").alias("member"), none, (F.col("turn") > max_nodes).alias("wide"), x)
        old = _all(levels).where("taken").select("entry", "member", "position", F.lit(False).alias("wide"), F.lit(None).cast(steps.schema["x"].dataType).alias("x"))
        met = steps.union(old).repartition("entry").groupBy("entry", "member").agg(F.max("position").alias("old"), F.bool_or("wide").alias("wide"), F.min("x").alias("x"))
        met = met.withColumn("fresh", F.col("old").isNull() & ~F.col("x.shut"))
        size, turn = F.max("old").over(entry), F.row_number().over(entry.orderBy(F.desc("fresh"), "x.parent", "x.turn"))
        met = met.withColumns({"size": size, "all": F.count_if("fresh").over(entry), "any_wide": F.bool_or("wide").over(entry), "turn": turn})
        cut = F.col("any_wide") | ((F.col("all") > 0) if last else (F.col("size") + F.col("all") > max_nodes))
        place = F.col("size") + F.col("turn")
        met = met.withColumns({"taken": F.lit(False) if last else F.col("fresh") & (place <= max_nodes), "cut": cut})
        # nothing more is found for an entry whose budget did not suffice
        more = F.col("x.open") & (F.col("size") + F.col("all") <= max_nodes)
        rows = met.where("taken OR cut AND turn = 1")
        level = shared_table(rows.select("entry", "member", F.lit(depth + 1).alias("depth"), place.alias("position"), *[F.col(f"x.{c}").alias(c) for c in carried], F.coalesce(more, F.lit(False)).alias("open"), "taken", "cut"), "level")
        levels.append(level)
    found = _all(levels)
    entries = numbered.where(F.col("kind").isin(*V.ENTRY_KINDS)).select(F.col("n").alias("entry"), "run_id", F.col("stable_key").alias("entry_key"))
    of = numbered.select(F.col("n").alias("member"), F.col("stable_key").alias("member_key"), "kind", "unresolved")
    members = found.where("taken").join(of, "member").join(entries, "entry").select("run_id", "entry_key", "member_key", "kind", "depth", "position", *carried, "unresolved")
    cut = found.where("cut").select("entry", F.lit(True).alias("truncated")).distinct()
    flags = entries.join(cut, "entry", "left").select("run_id", "entry_key", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return members, flags


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, levels)


def _ways(numbered: DataFrame, edges: DataFrame, max_nodes: int, carried: list[str]) -> DataFrame:
    """source, target and the turn of each edge among those of its source, with what a search must know of the target:
    whether it is shut to scenarios, and whether it leads on.  Of each source one more than the budget is kept."""
    of = numbered.select("run_id", F.col("stable_key").alias("source_key"), F.col("n").alias("source"))
    to = numbered.select(
        "run_id", F.col("stable_key").alias("target_key"), F.col("n").alias("target"), *[F.col(c).alias(f"own_{c}") for c in carried],
        ((F.col("kind") == "TECHNICAL_GUARD") | F.col("framework_internal")).alias("shut"), (~F.col("unresolved") & ~F.col("kind").isin(*V.ASYNC_KINDS)).alias("open"),
    )
    own = edges.where(F.col("kind").isin(*V.TRAVERSABLE)).select("run_id", "source_key", "target_key", F.col("kind").alias("edge_kind"), *[F.col(c).alias(f"edge_{c}") for c in carried])
    out = Window.partitionBy("source").orderBy("target", "edge_kind", "edge_confidence")
    ways = own.join(of, ["run_id", "source_key"]).join(to, ["run_id", "target_key"]).drop("run_id", "source_key", "target_key")
    ways = shared_table(ways.withColumn("turn", F.row_number().over(out)).where(F.col("turn") <= max_nodes + 1).drop("edge_kind"), "ways")
    # a node without an edge leads nowhere
    on = ways.select(F.col("source").alias("target"), F.lit(True).alias("on")).distinct()
    return shared_table(ways.join(on, "target", "left").withColumn("open", F.col("open") & F.coalesce("on", F.lit(False))).drop("on"), "ways")


#: What a scenario takes from its entry point's properties, as JSON, and what stands there if the entry says nothing.
FROM_ENTRY = {"actors": ("actors", "[]"), "input_contract": ("inputContract", "{}"), "preconditions": ("preconditions", "[]")}


def scenario_model(members: DataFrame, flags: DataFrame, entries: DataFrame) -> DataFrame:
    """What each scenario holds, in the order in which its paths discovered it: members by kind, asynchronous boundaries
    and unresolved ends; its least confidence; and actors, input contract and preconditions as its entry point states them.

    entries: run_id, stable_key, properties (JSON) of entry points.  A scenario has 500 members at most.
    """
    asynchronous = F.col("kind").isin(*V.ASYNC_KINDS) & (F.col("depth") > 0) & ~F.col("unresolved")
    met = F.array_sort(F.collect_list(F.struct("position", "member_key", "kind", asynchronous.alias("asynchronous"), "unresolved"))).alias("met")
    out = members.groupBy("run_id", "entry_key").agg(met, F.min("confidence").alias("confidence"))

    def keys(chosen) -> Column:
        return F.transform(F.filter("met", chosen), lambda x: x["member_key"])

    kinds = F.array_distinct(F.transform("met", lambda x: x["kind"]))
    out = out.select(
        "run_id",
        "entry_key",
        keys(lambda x: x["asynchronous"]).alias("async_boundaries"),
        keys(lambda x: x["unresolved"]).alias("unresolved"),
        F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, keys(lambda x: x["kind"] == k)))).alias("members_by_kind"),
        "confidence",
    )
    said = entries.select("run_id", F.col("stable_key").alias("entry_key"), *[S.prop(F.col("properties"), key).alias(c) for c, (key, _) in FROM_ENTRY.items()])
    out = out.join(flags, ["run_id", "entry_key"]).join(said, ["run_id", "entry_key"], "left").withColumn("path_order_known", F.lit(False))
    return out.withColumns({c: F.coalesce(c, F.lit(none)) for c, (_, none) in FROM_ENTRY.items()})


def scenario_nodes(members: DataFrame, prints: DataFrame) -> DataFrame:
    """A node for each scenario.  prints: run_id, stable_key, fingerprint, fact_ids."""
    own = members.join(prints.select("run_id", F.col("stable_key").alias("member_key"), "fingerprint", "fact_ids"), ["run_id", "member_key"], "left")
    out = own.groupBy("run_id", "entry_key").agg(
        F.array_sort(F.collect_set("member_key")).alias("member_keys"),
        F.array_sort(F.collect_set("fingerprint")).alias("member_fingerprints"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("fact_ids")))).alias("fact_ids"),
        F.min("confidence").alias("confidence"),
    )
    return out.withColumn("stable_key", F.concat(F.lit("scenario:"), "entry_key")).withColumn("kind", F.lit("BUSINESS_SCENARIO")).withColumn("structural_fingerprint", F.concat(F.lit("sha256:"), F.sha2(F.to_json("member_fingerprints"), 256)))


def scenario_edges(members: DataFrame) -> DataFrame:
    """The edge of each member, from one reading of them: to its entry point, or of what is part of it."""
    scenario, entry = F.concat(F.lit("scenario:"), "entry_key"), F.col("depth") == 0
    return members.where("depth >= 0").select(
        "run_id",
        F.when(entry, scenario).otherwise(F.col("member_key")).alias("source_key"),
        F.when(entry, F.col("entry_key")).otherwise(scenario).alias("target_key"),
        F.when(entry, "ENTRY_TO").otherwise("PART_OF_SCENARIO").alias("kind"),
        "depth",
    )


def neighborhood(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 2, limit: int = 250, developer: bool = False) -> DataFrame:
    """run_id, root_key, stable_key, depth, bounded: what lies within `depth` undirected steps of each root (run_id,
    root_key), each level by key and cut to `limit`.

    Edges (run_id, source_key, target_key, kind) may come more than once.  They meet what a level holds before they are
    made distinct or held against the nodes, and what was found before is marked among the steps, so that steps are dealt
    once, by the node that they reach.
    """
    ends = edges.where("kind <> 'PART_OF_SCENARIO'")
    near = ends.select("run_id", F.col("source_key").alias("here"), F.col("target_key").alias("stable_key")).union(ends.select("run_id", F.col("target_key").alias("here"), F.col("source_key").alias("stable_key")))
    key = ["run_id", "root_key", "stable_key"]
    level = shared_table(roots.select("run_id", "root_key", F.col("root_key").alias("stable_key"), F.lit(0).alias("depth"), F.lit(False).alias("bounded")), "near")
    found = level
    for d in range(1, min(5, depth) + 1):
        step = level.select("run_id", "root_key", F.col("stable_key").alias("here")).join(near, ["run_id", "here"]).select(*key, F.lit(False).alias("old"))
        marked = step.union(found.select(*key, F.lit(True).alias("old"))).repartition("run_id", "stable_key")
        fresh = marked.groupBy(*key).agg(F.bool_or("old").alias("old")).where("NOT old")
        if not developer:
            fresh = fresh.join(nodes.where(~F.col("kind").isin(*V.NOISE_KINDS)).select("run_id", "stable_key"), ["run_id", "stable_key"], "left_semi")
        ranked = fresh.withColumn("place", F.row_number().over(Window.partitionBy("run_id", "root_key").orderBy("stable_key"))).where(F.col("place") <= limit + 1)
        ranked = ranked.withColumn("bounded", F.max(F.col("place") > limit).over(Window.partitionBy("run_id", "root_key"))).where(F.col("place") <= limit)
        level = shared_table(ranked.select(*key, F.lit(d).alias("depth"), "bounded"), "near")
        found = found.union(level)
    return found


def scenario_selection(members: DataFrame, depth: int, entry_kinds: tuple[str, ...] = V.ENTRY_KINDS) -> DataFrame:
    """Members that a projection rooted in their entry shows: 4 deep, 5, or 2 * depth + 1 up to 8; no other entries."""
    deep = 4 if depth <= 1 else 5 if depth == 2 else min(2 * depth + 1, 8)
    return members.where((F.col("depth") <= deep) & ((F.col("depth") == 0) | ~F.col("kind").isin(*entry_kinds)))


def lifted_edges(visible: DataFrame, edges: DataFrame, hops: int = 4, limit: int = 200) -> DataFrame:
    """run_id, source_key, target_key, kind: paths between visible nodes (run_id, stable_key) over at most `hops` hidden
    ones, contracted to one edge for each pair that no edge joins directly; kinds other than CONTAINS first."""
    shown = visible.select("run_id", "stable_key", F.lit(True).alias("shown"))
    way = edges.where("kind <> 'PART_OF_SCENARIO'").select("run_id", "source_key", "target_key", "kind").distinct()
    way = way.join(shown.withColumnRenamed("stable_key", "target_key"), ["run_id", "target_key"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    start = way.join(shown.select("run_id", F.col("stable_key").alias("source_key")), ["run_id", "source_key"], "left_semi")
    walk = start.where("NOT shown").select("run_id", "source_key", F.col("target_key").alias("at"), "kind").distinct()
    found = None
    for _ in range(hops):
        step = walk.join(way.select("run_id", F.col("source_key").alias("at"), "target_key", F.col("shown").alias("ends")), ["run_id", "at"])
        ended = step.where("ends AND source_key <> target_key").select("run_id", "source_key", "target_key", "kind").distinct()
        found = ended if found is None else found.union(ended)
        walk = step.where("NOT ends").select("run_id", "source_key", F.col("target_key").alias("at"), "kind").distinct()
    direct = way.select("run_id", "source_key", "target_key").distinct()
    one = found.groupBy("run_id", "source_key", "target_key").agg(F.min(F.struct((F.col("kind") == "CONTAINS").alias("c"), "kind")).alias("k"))
    return one.join(direct, ["run_id", "source_key", "target_key"], "left_anti").select("run_id", "source_key", "target_key", "k.kind").orderBy("run_id", "source_key", "target_key").limit(limit)
