"""Graph queries: filters, latest rows, pages, details and reports over nodes, edges, reviews and enrichments.

nodes: run_id, stable_key, kind, label, confidence, properties, unresolved, evidence_ids, fact_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import semantics as S
from factgraph.functions import vocabulary as V

KEY = ["run_id", "stable_key"]


def latest(rows: DataFrame, *columns: str, order: str = "seq") -> DataFrame:
    """The latest row of each node by `order`, ties to the largest values: one aggregate, no sort of a node's rows."""
    return rows.groupBy(*KEY).agg(F.max(F.struct(order, *columns)).alias("x")).select(*KEY, *[F.col(f"x.{c}").alias(c) for c in columns])


def latest_review(nodes: DataFrame, reviews: DataFrame) -> DataFrame:
    return nodes.join(latest(reviews, "decision"), KEY, "left").withColumn("decision", F.coalesce("decision", F.lit("UNREVIEWED")))


def latest_enrichment(nodes: DataFrame, enrichments: DataFrame) -> DataFrame:
    """nodes with the latest title and description of each, or of its scenario."""
    own = enrichments.withColumn("stable_key", F.regexp_replace("stable_key", "^scenario:", ""))
    return nodes.join(latest(own, "title", "description"), KEY, "left")


def projection_filter(nodes: DataFrame, run_id: str, min_confidence: float = 0.0, search: str = "") -> DataFrame:
    if len(search) > 300:
        raise ValueError("the search text is too long")
    found = nodes.where((F.col("run_id") == run_id) & (F.col("confidence") >= min_confidence))
    return found.where(S.contains_ci(F.col("label"), F.col("stable_key"), search)) if search.strip() else found


def view_filter(nodes: DataFrame, view: str) -> DataFrame:
    if view not in V.VIEWS:
        raise ValueError(f"no view {view}")
    kind, keep = F.col("kind"), F.lit(True)
    if view in V.VIEW_KINDS:
        keep = kind.isin(*V.VIEW_KINDS[view])
        if view == "SECURITY":
            keep = keep | S.has_prop(F.col("properties"), "roles") | S.has_prop(F.col("properties"), "tenantCheck")
    if view != "DEVELOPER":
        keep = keep & ~kind.isin(*V.NOISE_KINDS)
    if view == "BUSINESS":
        keep = keep & ~kind.isin(*V.CODE_KINDS)
    return nodes.where(keep)


def lod_filter(nodes: DataFrame, lod: int, view: str) -> DataFrame:
    """What a projection without a root shows at a level of detail."""
    kind = F.col("kind")
    if lod == 0:
        return nodes.where(kind.isin(*V.LOD0_KINDS))
    if lod == 1:
        return nodes.where(kind.isin(*V.LOD1_KINDS))
    if lod == 2 and view not in ("DEVELOPER", "CONFIDENCE"):
        hidden = {"FILE", "PACKAGE", "PARAMETER", "CONSTANT"} | ({"CLASS", "INTERFACE", "METHOD", "FUNCTION"} if view == "BUSINESS" else set())
        return nodes.where(~kind.isin(*sorted(hidden)))
    return nodes


def hide_rejected(nodes: DataFrame, reviews: DataFrame) -> DataFrame:
    hidden = latest(reviews, "decision").where(F.col("decision").isin(*V.HIDDEN_DECISIONS))
    return nodes.join(hidden.select(*KEY), KEY, "left_anti")


def only_changed(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    return nodes.join(changes.select(*KEY), KEY, "left_semi")


def execution_filter(nodes: DataFrame, links: DataFrame, facts: DataFrame, executions: DataFrame, test: Column) -> DataFrame:
    """Nodes with a fact of an execution that `test` holds for.  links: graph.node_facts()."""
    chosen = executions.where(test).select("execution_id")
    facts = facts.join(chosen, "execution_id", "left_semi").select("run_id", "fact_id")
    hit = links.join(facts, ["run_id", "fact_id"], "left_semi").select(*KEY)
    return nodes.join(hit, KEY, "left_semi")


def layer_filter(nodes: DataFrame, layer: str) -> DataFrame:
    return nodes.where(S.prop(F.col("properties"), "sourceLayer") == layer)


def kind_rank(rooted: bool) -> Column:
    kind = F.col("kind")
    first = ("ENDPOINT", "BUSINESS_SCENARIO") if rooted else ("COMPONENT", "MODULE", "BUSINESS_SCENARIO", "ENDPOINT")
    out = F
    for i, k in enumerate(first):
        out = out.when(kind == k, F.lit(i))
    return out.when(kind.isin(*V.RULE_KINDS), F.lit(len(first))).otherwise(F.lit(len(first) + 1))


def bounded_page(nodes: DataFrame, lod: int, rooted: bool = False) -> DataFrame:
    """The first nodes by rank of their kind and key, with how many there are and whether some were left out."""
    limit = V.LOD_LIMIT[lod]
    total = nodes.agg(F.count("*").alias("total"))
    page = nodes.withColumn("rank", kind_rank(rooted)).orderBy("rank", "stable_key").limit(limit)
    return page.join(F.broadcast(total), how="inner").withColumn("truncated", F.col("total") > limit)  # one row, by its aggregate


def induced_edges(edges: DataFrame, chosen: DataFrame, limit: int = 2000) -> DataFrame:
    out = edges.where("kind <> 'PART_OF_SCENARIO'")
    for end in ("source_key", "target_key"):
        out = out.join(chosen.select("run_id", F.col("stable_key").alias(end)), ["run_id", end], "left_semi")
    return out.orderBy("run_id", "source_key", "target_key", "kind").limit(limit)


def layer_rank(path: Column, kind: Column) -> Column:
    """Where a step stands between the caller and the data, by its file's path and its kind: entry, checks, services,
    data access, all else."""
    path = F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(path.rlike(r"controller|resource|handler|/api/") | kind.isin(*V.ENTRY_KINDS), 0)
        .when(path.rlike(r"validat|guard|security|filter") | kind.isin("VALIDATION_RULE", "AUTHORIZATION_RULE", "SECURITY_RULE"), 1)
        .when(path.rlike(r"service|usecase|facade"), 2)
        .when(path.rlike(r"repository|dao|mapper|persistence") | kind.isin("DATABASE_READ", "DATABASE_WRITE"), 3)
        .otherwise(4)
    )


def call_line(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """steps (scenario_key, stable_key, ...) with call_line, the first line of the scenario that calls each.
    calls: scenario_key, target_key, start_line."""
    first = calls.groupBy("scenario_key", F.col("target_key").alias("stable_key")).agg(F.min("start_line").alias("call_line"))
    return steps.drop("call_line").join(first, ["scenario_key", "stable_key"], "left")


def pipeline_spine(steps: DataFrame) -> DataFrame:
    """scenario_key, stable_key, layer_rank, call_line, file_path, start_line -> FLOWS_TO edges between steps in order."""
    w = Window.partitionBy("scenario_key").orderBy("layer_rank", F.col("call_line").asc_nulls_last(), "file_path", "start_line", "stable_key")
    out = steps.select("scenario_key", F.col("stable_key").alias("source_key"), F.lead("stable_key").over(w).alias("target_key"), F.row_number().over(w).alias("place"))
    return out.where("target_key IS NOT NULL").withColumn("kind", F.lit("FLOWS_TO"))


def attach_exceptions(steps: DataFrame, exceptions: DataFrame) -> DataFrame:
    """scenario_key, stable_key, file_path, start_line -> THROWS edges from the nearest step before each exception in its
    file, else from the last step."""
    s = steps.select("scenario_key", "file_path", "start_line", F.col("stable_key").alias("step"), F.lit(None).cast("string").alias("thrown"))
    e = exceptions.select("scenario_key", "file_path", "start_line", F.lit(None).cast("string").alias("step"), F.col("stable_key").alias("thrown"))
    w = Window.partitionBy("scenario_key", "file_path").orderBy("start_line", F.col("step").asc_nulls_last(), "thrown")
    near = s.union(e).withColumn("source_key", F.last("step", ignorenulls=True).over(w)).where("thrown IS NOT NULL")
    end = steps.groupBy("scenario_key").agg(F.max_by("stable_key", F.struct("file_path", "start_line", "stable_key")).alias("end_key"))
    return near.join(end, "scenario_key", "left").select("scenario_key", F.coalesce("source_key", "end_key").alias("source_key"), F.col("thrown").alias("target_key"), F.lit("THROWS").alias("kind"))


def attach_tables(tables: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges into each table (scenario_key, stable_key): those there are, else READS from the first step that reads or writes."""
    known = tables.join(edges.select("source_key", F.col("target_key").alias("stable_key"), "kind"), "stable_key").select("scenario_key", "source_key", F.col("stable_key").alias("target_key"), "kind")
    first = steps.where(F.col("kind").isin("DATABASE_READ", "DATABASE_WRITE")).groupBy("scenario_key").agg(F.min_by("stable_key", F.struct("place", "stable_key")).alias("source_key"))
    bare = tables.join(known.select("scenario_key", F.col("target_key").alias("stable_key")), ["scenario_key", "stable_key"], "left_anti").join(first, "scenario_key")
    return known.union(bare.select("scenario_key", "source_key", F.col("stable_key").alias("target_key"), F.lit("READS").alias("kind")))


def return_nodes(endpoints: DataFrame) -> DataFrame:
    kind = F.coalesce(S.prop(F.col("properties"), "responseType"), S.prop(F.col("properties"), "returnType"), F.lit("void"))
    return endpoints.select("run_id", S.return_node_id(F.col("stable_key")).alias("stable_key"), F.lit("RETURN_OUTCOME").alias("kind"), F.regexp_replace(kind, r"\b[a-z_][\w]*\.", "").alias("label"), F.col("stable_key").alias("endpoint_key"))


def controllers_rollup(endpoints: DataFrame, members: DataFrame, enrichments: DataFrame) -> DataFrame:
    """run_id, owner_key, endpoints: how many, their steps, side effects, unresolved members and story states."""
    effects = F.col("kind").isin("DATABASE_WRITE", "EXTERNAL_CALL", "EVENT_PUBLICATION", "MESSAGE_PUBLICATION", "NOTIFICATION")
    steps = members.where("depth > 0").groupBy("run_id", F.col("entry_key").alias("stable_key")).agg(F.count("*").alias("steps"), F.count_if(effects).alias("side_effects"), F.count_if(F.col("unresolved")).alias("unresolved"))
    told = latest(enrichments, "title")
    out = endpoints.join(steps, KEY, "left").join(told, KEY, "left").na.fill(0, ["steps", "side_effects", "unresolved"])
    story = F.when(F.col("title").isNotNull(), "READY").when(F.col("steps") > 0, "STATIC_READY").otherwise("DISCOVERED")
    method = F.upper("method") if "method" in endpoints.columns else F.lit(None).cast("string")
    one = F.struct("stable_key", method.alias("method"), "steps", "side_effects", "unresolved", story.alias("story"))
    return out.groupBy("run_id", "owner_key").agg(F.count("*").alias("endpoints"), F.sum("steps").alias("steps"), F.sum("side_effects").alias("side_effects"), F.count_if(story == "READY").alias("ready"), F.count_if(story == "STATIC_READY").alias("static_ready"), F.array_sort(F.collect_set(one)).alias("endpoint_list"))


def node_detail(nodes: DataFrame, facts: DataFrame, reviews: DataFrame, rules: DataFrame, members: DataFrame, enrichments: DataFrame, facts_most: int = 100, reviews_most: int = 50) -> DataFrame:
    """Each node with its first facts, latest reviews, rules, the scenarios it is in, its own members by depth, and its
    latest title and description.

    rules: run_id, stable_key, rule_kind, condition; members: run_id, entry_key, member_key, depth.
    """
    by = Window.partitionBy(*KEY)
    f = facts.withColumn("place", F.row_number().over(by.orderBy("fact_id", "execution_id"))).where(F.col("place") <= facts_most)
    f = f.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("fact_id", "execution_id", "kind"))).alias("facts"))
    r = reviews.withColumn("place", F.row_number().over(by.orderBy(F.desc("seq"), F.desc("decision")))).where(F.col("place") <= reviews_most)
    r = r.groupBy(*KEY).agg(F.reverse(F.array_sort(F.collect_list(F.struct("seq", "decision")))).alias("reviews"))
    a = rules.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rule_kind", "condition"))).alias("rules"))
    of = members.groupBy("run_id", F.col("entry_key").alias("stable_key")).agg(F.array_sort(F.collect_list(F.struct("depth", "member_key"))).alias("members"))
    within = members.groupBy("run_id", F.col("member_key").alias("stable_key")).agg(F.array_sort(F.collect_set("entry_key")).alias("scenarios"))
    out = nodes
    for part in (f, r, a, of, within, latest(enrichments, "title", "description")):
        out = out.join(part, KEY, "left")
    return out


def evidence_of(subjects: DataFrame, evidence: DataFrame, most: int = 200) -> DataFrame:
    """The evidence of each node or edge, by file and line, at most `most`."""
    out = subjects.select("run_id", "subject", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id")).join(evidence, "evidence_id")
    w = Window.partitionBy("run_id", "subject").orderBy("file_path", "start_line", "evidence_id")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def enclosing_declaration(evidence: DataFrame, nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """evidence (run_id, stable_key, ...) with the declaration of the node's owner, unless that is a package or the node
    is a type.  owners: run_id, owner_key, owner_kind, owner_snippet, owner_start, owner_end."""
    types = F.col("node_kind").isin("CLASS", "INTERFACE", "ENTITY", "DTO")
    own = nodes.select(*KEY, F.col("kind").alias("node_kind"), S.prop(F.col("properties"), "ownerKey").alias("owner_key"))
    out = evidence.join(own, KEY, "left").join(owners, ["run_id", "owner_key"], "left")
    show = F.col("owner_snippet").isNotNull() & (F.col("owner_kind") != "PACKAGE") & ~types
    return out.withColumn("declaration", F.when(show, S.declaration_of(F.col("owner_kind"), F.col("owner_snippet"))))


def page(rows: DataFrame, order: list, limit: int = 100, offset: int = 0, most: int = 500) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(most, max(1, limit)))


def quarantine_page(quarantine: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(quarantine, ["execution_id", "line_number"], limit, offset)


def unresolved_page(nodes: DataFrame, run_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(nodes.where((F.col("run_id") == run_id) & F.col("unresolved")), ["stable_key"], limit, offset)


def fact_page(facts: DataFrame, run_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(facts.where(F.col("run_id") == run_id), ["kind", "stable_key", "fact_id", "execution_id"], limit, offset)


def list_runs(runs: DataFrame) -> DataFrame:
    """The newest 200 runs."""
    return page(runs, [F.desc("created_at"), F.desc("run_id")], 200)


def review_queue(nodes: DataFrame, reviews: DataFrame, limit: int = 200) -> DataFrame:
    """Rules and scenarios that await a decision, the least sure first."""
    kinds = F.col("kind").isin(*V.RULE_KINDS, "BUSINESS_SCENARIO")
    out = latest_review(nodes.where(kinds), reviews).where(F.col("decision").isin("UNREVIEWED", "NEEDS_REVIEW", "STALE"))
    return out.orderBy("confidence", "run_id", "stable_key").limit(limit)


def search_nodes(nodes: DataFrame, run_id: str, needle: str, limit: int = 200) -> DataFrame:
    return projection_filter(nodes, run_id, search=needle).orderBy("stable_key").limit(limit)


def node_badges(nodes: DataFrame) -> DataFrame:
    """nodes with decision, title, edited_title, fact_conflict -> shown label and badges."""
    layer = S.prop(F.col("properties"), "sourceLayer")
    badges = F.array_compact(F.array(F.when(F.col("unresolved"), "UNRESOLVED"), F.when(F.col("decision") == "STALE", "REVIEW_STALE"), F.when(F.col("fact_conflict"), "FACT_CONFLICT"), F.when(F.col("title").isNotNull(), "AI_ENRICHED"), F.when(layer.isNotNull(), F.concat(F.lit("LAYER_"), layer))))
    label = F.when((F.col("decision") == "EDITED") & F.col("edited_title").isNotNull(), F.col("edited_title")).otherwise(F.col("label"))
    return nodes.withColumn("shown", F.substring(label, 1, 300)).withColumn("badges", badges)


def facet_filter(nodes: DataFrame, *, unreviewed: bool = False, low_confidence: bool = False, unresolved: bool = False, untested: bool = False, authorization: bool = False, business: bool = False, writes: bool = False, external: bool = False, enriched: bool = False, layer: str | None = None, analyzer: str | None = None) -> DataFrame:
    """Nodes for which every flag that is set holds.  nodes also have decision, tested, title, analyzers."""
    kind, tests = F.col("kind"), []
    tests += [F.col("decision") == "UNREVIEWED"] if unreviewed else []
    tests += [F.col("confidence") < 0.7] if low_confidence else []
    tests += [F.col("unresolved")] if unresolved else []
    tests += [~F.col("tested")] if untested else []
    tests += [kind.isin("AUTHORIZATION_RULE", "SECURITY_RULE")] if authorization else []
    tests += [kind.isin("BUSINESS_RULE", "BUSINESS_CONSTRAINT", "BUSINESS_SCENARIO", "VALIDATION_RULE")] if business else []
    tests += [kind == "DATABASE_WRITE"] if writes else []
    tests += [kind.isin("EXTERNAL_CALL", "EVENT_PUBLICATION", "MESSAGE_PUBLICATION")] if external else []
    tests += [F.col("title").isNotNull()] if enriched else []
    tests += [S.prop(F.col("properties"), "sourceLayer") == layer] if layer else []
    tests += [F.array_contains("analyzers", analyzer)] if analyzer else []
    for t in tests:
        nodes = nodes.where(t)
    return nodes


def overview_metrics(nodes: DataFrame) -> DataFrame:
    """Nodes by run.  Whether a node has evidence says n_evidence, or evidence_ids where there is no such column."""
    kind = F.col("kind")
    evidence = F.col("n_evidence") if "n_evidence" in nodes.columns else F.size("evidence_ids")
    out = nodes.groupBy("run_id").agg(
        F.count("*").alias("nodes"),
        F.count_if(kind.isin(*V.RULE_KINDS)).alias("rules"),
        F.count_if(kind.isin("DATABASE_READ", "DATABASE_WRITE")).alias("data_effects"),
        F.count_if((F.col("confidence") < 0.7) | F.col("unresolved")).alias("risks"),
        F.count_if(F.col("title").isNotNull()).alias("enriched"),
        F.count_if(evidence > 0).alias("grounded"),
    )
    return out.withColumn("grounded_percent", F.floor(F.col("grounded") * 100 / F.col("nodes")).cast("long"))


def rank_insights(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """Nodes whose text has any of the terms, by a sum of what speaks for them."""
    text = F.lower(F.concat_ws(" ", "label", "stable_key", "kind", "title"))
    hits = sum((F.contains(text, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    score = hits * 10 + F.when(F.col("title").isNotNull(), 5).otherwise(0) + F.floor(F.col("confidence") * 10).cast("int")
    trust = F.when(F.col("confidence") >= 0.9, "PROVEN").when(F.col("confidence") >= 0.7, "SUPPORTED").otherwise("TO_CHECK")
    return nodes.where(hits > 0).withColumn("score", score).withColumn("trust", trust).orderBy(F.desc("score"), "run_id", "stable_key")


def endpoint_catalog(rollup: DataFrame, text: str = "", ready_only: bool = False, method: str | None = None) -> DataFrame:
    """The endpoints of controllers_rollup() one by one, by text, story and HTTP method."""
    out = rollup.select("run_id", "owner_key", F.explode("endpoint_list").alias("e")).select("run_id", "owner_key", "e.*")
    out = out.where("story = 'READY'") if ready_only else out
    out = out.where(F.col("method") == method.upper()) if method else out
    return out.where(S.contains_ci(F.col("owner_key"), F.col("stable_key"), text)) if text else out
