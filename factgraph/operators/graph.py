"""Graph construction: facts fold into nodes, edges and rules.

facts: run_id, execution_id, analyzer, origin, confidence, kind, stable_key, fact_id, properties (JSON text),
evidence_ids; with_prints() adds the hashes of their properties once, and what takes facts without them adds them.
Groupings are aggregates with partial sums.  Nodes and edges hold no lists: which facts and evidence each has are rows
of link tables, which readers join, so that a key with a third of all facts costs what its rows cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import expressions as E
from factgraph.functions import semantics as S
from factgraph.functions import vocabulary as V

RUN_KEY = ("run_id", "stable_key")


def with_prints(facts: DataFrame) -> DataFrame:
    """facts with content, behaves and fingerprint: hashes of all properties, and of those that say what a fact does
    without and with its kind.  The JSON text is parsed here and nowhere else."""
    if "fingerprint" in facts.columns:
        return facts
    out = facts.withColumn("_parsed", F.try_parse_json("properties")).withColumn("_behaves", S.behavioral_of(F.col("_parsed")))
    out = out.withColumn("content", S.text_hash(F.to_json("_parsed"))).withColumn("behaves", S.text_hash(F.col("_behaves")))
    return out.withColumn("fingerprint", S.kind_hash(F.col("kind"), F.col("_behaves"))).drop("_parsed", "_behaves")


def fact_order() -> Column:
    """The order in which facts of one key are believed, whatever the order of their arrival; facts have their prints."""
    return F.struct(S.origin_order(F.col("origin")).alias("o"), "analyzer", "execution_id", "fact_id", S.hash_bytes(F.col("fingerprint")).alias("f"))


def ordered_facts(facts: DataFrame, executions: DataFrame | None = None) -> DataFrame:
    """Facts of known executions with their place among those of the same key.  Facts without prints get them after they are
    dealt by key: a hash takes more of a shuffle than the properties, which repeat the key."""
    if executions is not None:
        facts = facts.join(executions.select("execution_id", "component_path", "frameworks", "languages"), "execution_id")
    return with_prints(facts.repartition(*RUN_KEY)).withColumn("place", F.row_number().over(Window.partitionBy(*RUN_KEY).orderBy(fact_order())))


def with_provenance(facts: DataFrame) -> DataFrame:
    """What made each fact, and the layer that it speaks of."""
    sorted_ = {c: F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in ("frameworks", "languages")}
    return facts.withColumn("provenance", F.struct("analyzer", "version", "digest", "origin", "component_path", sorted_["frameworks"].alias("frameworks"), sorted_["languages"].alias("languages"))).withColumn("source_layer", S.source_layer(F.col("frameworks"), F.col("origin")))


def merge_provenance(facts: DataFrame) -> DataFrame:
    """The distinct provenance of each key, by hash, and what it holds."""
    p = F.collect_set(F.struct(F.sha2(F.to_json("provenance"), 256).alias("hash"), "provenance"))
    out = facts.groupBy(*RUN_KEY).agg(F.array_sort(p).alias("p")).withColumn("provenance", F.transform("p", lambda x: x["provenance"])).drop("p")
    for name, c in (("analyzers", "analyzer"), ("origins", "origin"), ("component_paths", "component_path")):
        out = out.withColumn(name, F.array_sort(F.array_distinct(F.col(f"provenance.{c}"))))
    return out.withColumn("frameworks", F.array_sort(F.array_distinct(F.flatten(F.transform("provenance", lambda x: x["frameworks"])))))


def _stated(facts: DataFrame) -> DataFrame:
    """The facts that make nodes."""
    return facts.where((F.col("kind") != "RELATION") & (F.size("evidence_ids") > 0))


def node_facts(facts: DataFrame) -> DataFrame:
    """run_id, stable_key, fact_id: the facts of each node, once each."""
    return _stated(facts).select(*RUN_KEY, "fact_id").distinct()


def node_evidence(facts: DataFrame) -> DataFrame:
    """run_id, stable_key, evidence_id: the evidence of each node, once each."""
    return _stated(facts).select(*RUN_KEY, F.explode("evidence_ids").alias("evidence_id")).distinct()


def fact_alternatives(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """run_id, stable_key, content: hashes of the facts that behave otherwise than the first of a node in conflict."""
    said = with_prints(_stated(facts)).select(*RUN_KEY, "behaves", "content").distinct()
    first = nodes.where("fact_conflict").select(*RUN_KEY, F.col("behaves").alias("first"))
    return said.join(first, list(RUN_KEY)).where("behaves <> first").select(*RUN_KEY, "content").distinct()


def gathered(links: DataFrame, keys: list[str], link: str) -> DataFrame:
    """The links of each key as one sorted array, `<link>s`, for readers of few keys or of keys with few."""
    return links.groupBy(*keys).agg(F.array_sort(F.collect_list(link)).alias(f"{link}s"))


def merge_nodes(facts: DataFrame) -> DataFrame:
    """One node of each key: kind, properties and behaviour of the first fact, the least confidence; facts that behave
    otherwise than the first make a conflict, which bounds the confidence (see fact_alternatives).  n_evidence is the most
    evidence that one of its facts has."""
    own = with_prints(_stated(facts))
    own = own.withColumn("ceiling", S.confidence_ceiling(F.col("origin"), F.col("confidence"), F.col("properties"), F.lit(False)))
    own = own.withColumn("node_kind", S.node_kind(F.col("kind"), F.col("properties")))
    # each column is an aggregate of its own, so that a reader of few pays for these alone; hashes are compared as bytes
    said = S.hash_bytes(F.col("behaves"))
    folded = own.groupBy(*RUN_KEY).agg(
        F.min_by("node_kind", fact_order()).alias("kind"),
        F.min_by("properties", fact_order()).alias("properties"),
        F.min("ceiling").alias("confidence"),
        (F.min(said) != F.max(said)).alias("fact_conflict"),
        F.count("*").alias("n_facts"),
        F.max(F.size("evidence_ids")).alias("n_evidence"),
    )
    return folded.select(
        *RUN_KEY,
        "kind",
        "properties",
        S.text_hash(S.behavioral(F.col("properties"))).alias("behaves"),
        F.when(F.col("fact_conflict"), F.least("confidence", F.lit(0.45))).otherwise(F.col("confidence")).alias("confidence"),
        "fact_conflict",
        "n_facts",
        "n_evidence",
    )


def evidence_fingerprint(subjects: DataFrame, evidence: DataFrame) -> DataFrame:
    """subjects (run_id, subject, evidence_ids) with the hash of the distinct evidence behind each.
    evidence: evidence_id, snippet_hash, analyzer, version, digest, origin."""
    of = subjects.select("run_id", "subject", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", F.struct("snippet_hash", "analyzer", "version", "digest", "origin").alias("e")), "evidence_id")
    return of.groupBy("run_id", "subject").agg(S.text_hash(F.to_json(F.array_sort(F.collect_set("e")))).alias("evidence_fingerprint"))


def finish_nodes(nodes: DataFrame, evidence_prints: DataFrame) -> DataFrame:
    """Label, support and fingerprints.  evidence_prints: run_id, subject, evidence_fingerprint."""
    p = F.col("properties")
    out = nodes.join(evidence_prints.withColumnRenamed("subject", "stable_key"), list(RUN_KEY), "left")
    return (
        out.withColumn("label", F.coalesce(S.prop(p, "name"), F.col("stable_key")))
        .withColumn("subtitle", S.prop(p, "description"))
        .withColumn("support", F.when(F.col("confidence") >= 0.9, "PROVEN").otherwise("SUPPORTED"))
        .withColumn("fingerprint", S.text_hash(F.concat_ws("|", S.fingerprint(F.col("kind"), p), F.coalesce("evidence_fingerprint", F.lit("")))))
        .withColumn("structural_fingerprint", S.structural(F.col("kind"), p))
    )


#: Columns of facts, and the properties that state what they hold: ends and kind of a relation, and the owner.
ENDS = {"source_key": "sourceKey", "target_key": "targetKey", "edge_kind": "edgeKind", "owner_key": "ownerKey"}


def with_ends(facts: DataFrame) -> DataFrame:
    """facts with the columns of ENDS; those that ingestion has kept are taken as they are, so that no text is parsed."""
    return facts.withColumns({c: S.prop(F.col("properties"), key) for c, key in ENDS.items() if c not in facts.columns})


def derive_edges(facts: DataFrame) -> DataFrame:
    """Edges of relation facts, and of owners to what they own, one row a fact."""
    own = with_ends(with_prints(facts.where(F.size("evidence_ids") > 0)))
    rest = ["run_id", "confidence", "evidence_ids", "properties", fact_order().alias("fact_order")]
    relation = own.where("kind = 'RELATION'").select("source_key", "target_key", F.coalesce("edge_kind", F.lit("DEPENDS_ON")).alias("kind"), *rest)
    owner = own.where("kind <> 'RELATION'").select(F.col("owner_key").alias("source_key"), F.col("stable_key").alias("target_key"), F.lit("CONTAINS").alias("kind"), *rest)
    return relation.unionByName(owner).where("trim(source_key) <> '' AND trim(target_key) <> ''")


def missing_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node UNRESOLVED_SYMBOL for each key that edges name and no fact states, with the evidence of the first fact, and the most
    that one has."""
    ends = F.explode(F.array("source_key", "target_key"))
    # ends are folded before they meet the nodes, so that a key that many edges name is shuffled once a task
    named = edges.select("run_id", ends.alias("stable_key"), "evidence_ids", "fact_order").groupBy(*RUN_KEY).agg(F.min_by("evidence_ids", "fact_order").alias("evidence_ids"), F.max(F.size("evidence_ids")).alias("n_evidence"))
    lost = named.join(nodes.select(*RUN_KEY), list(RUN_KEY), "left_anti")
    return lost.select(*RUN_KEY, F.lit("UNRESOLVED_SYMBOL").alias("kind"), F.lit(0.0).alias("confidence"), F.lit("UNRESOLVED").alias("support"), "evidence_ids", "n_evidence")


EDGE_KEY = ("run_id", "source_key", "target_key", "kind")


def edge_evidence(edges: DataFrame) -> DataFrame:
    """run_id, source_key, target_key, kind, evidence_id: the evidence of each edge, once each."""
    return edges.select(*EDGE_KEY, F.explode("evidence_ids").alias("evidence_id")).distinct()


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge of each source, target and kind; no confidence where an end is unresolved, that is, not among the nodes.

    Edges are shuffled twice: by source, by which they are folded too, and by target.
    """
    known = nodes.select("run_id", "stable_key", F.lit(True).alias("known"))
    folded = edges.repartition("run_id", "source_key").groupBy(*EDGE_KEY).agg(
        F.min("confidence").alias("confidence"),
        F.min_by("properties", "fact_order").alias("properties"),
        F.count("*").alias("n_facts"),
    )
    for end in ("source_key", "target_key"):
        folded = folded.join(known.select("run_id", F.col("stable_key").alias(end), F.col("known").alias(f"known_{end}")), ["run_id", end], "left")
    unresolved = F.col("known_source_key").isNull() | F.col("known_target_key").isNull()
    return folded.withColumn("confidence", F.when(unresolved, 0.0).otherwise(F.col("confidence"))).withColumn("unresolved", unresolved).drop("known_source_key", "known_target_key")


def classify_rules(rules: DataFrame) -> DataFrame:
    """kind, properties -> condition, category, score and the terms of the score."""
    p = F.col("properties")
    raw = F.coalesce(S.prop(p, "normalizedCondition"), S.prop(p, "condition"), S.prop(p, "expression"))
    tree = F.when(F.coalesce(F.startswith(F.ltrim(raw), F.lit("{")), F.lit(False)), raw)
    yes = F.when(S.list_size(p, "trueOutcomes") > 0, S.prop(p, "trueOutcomes")).when(S.has_prop(p, "outcome"), F.concat(F.lit("["), F.when(F.substring(S.prop(p, "outcome"), 1, 1) == "{", S.prop(p, "outcome")).otherwise(F.to_json(F.array(S.prop(p, "outcome")))), F.lit("]")))
    yes = F.coalesce(F.regexp_replace(yes, r"^\[\[(.*)\]\]$", "[$1]"), F.lit("[]"))
    no = F.coalesce(S.prop(p, "falseOutcomes"), F.lit("[]"))
    out = rules.withColumn("condition", E.normalize_expression(tree)).withColumn("true_outcomes", yes).withColumn("false_outcomes", no)
    out = out.withColumn("impactful", E.any_impactful("true_outcomes") | E.any_impactful("false_outcomes"))
    kind = F.coalesce(F.get_json_object("condition", "$.type"), F.lit("UNKNOWN_EXPRESSION"))
    method = F.coalesce(F.get_json_object("condition", "$.method"), F.lit(""))
    plumbing = S.is_true(p, "technicalGuard") | F.coalesce(S.prop(p, "technicalGuardKind"), F.lit("")).isin(*V.PLUMBING) | method.isin(*V.LOG_GUARDS)
    technical = ~F.col("impactful") & (plumbing | (kind == "NULL_CHECK") | (F.col("kind") == "TECHNICAL_GUARD"))
    auth = (F.col("kind") == "AUTHORIZATION_RULE") | (kind == "ROLE_CHECK") | S.is_true(p, "authorization")

    def when(test: Column, value: float) -> Column:
        return F.when(test, value).otherwise(0.0)

    # fixed values: the terms of the score by their public names
    terms = {
        "entryPointProximity": when(S.has_prop(p, "entryPointKey"), 0.12),
        "businessVocabularyScore": when(S.is_true(p, "businessVocabulary"), 0.08),
        "domainTypeScore": when(S.has_prop(p, "domainType"), 0.10),
        "outcomeImpactScore": when(F.col("impactful"), 0.35),
        "dataSideEffectScore": when(S.list_size(p, "dataWrites") > 0, 0.12),
        "authorizationScore": when(auth, 0.30),
        "testEvidenceScore": when(S.is_true(p, "verifiedByTest"), 0.10),
        "frameworkSignalScore": when(S.has_prop(p, "annotation"), 0.10),
        "technicalGuardPenalty": F.when(technical, -0.65).when(plumbing, -0.15).otherwise(0.0),
        "ambiguityPenalty": F.when(kind == "UNKNOWN_EXPRESSION", -0.25).otherwise(-F.least(F.lit(0.3), S.list_size(p, "ambiguities") * 0.1)),
    }
    out = out.withColumn("score_terms", F.struct(*[v.alias(k) for k, v in terms.items()]))
    total = F.lit(0.20)
    for k in terms:
        total = total + F.col(f"score_terms.{k}")
    named = F.endswith(F.col("kind"), F.lit("_RULE")) & (F.col("kind") != "UNKNOWN_RULE")
    category = F.when(technical, "TECHNICAL_GUARD").when(auth, "AUTHORIZATION_RULE").when(named, F.col("kind")).when(F.col("impactful"), "BUSINESS_CONSTRAINT").otherwise("UNKNOWN_RULE")
    return out.withColumn("condition_type", kind).withColumn("category", category).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def assertion_ceiling(rules: DataFrame) -> DataFrame:
    """classify_rules() rows with the confidence that a rule may have, and the kind that its node gets."""
    unknown = (F.col("condition_type") == "UNKNOWN_EXPRESSION") | (F.col("category") == "UNKNOWN_RULE")
    moved = (F.col("category") != F.col("kind")) & (F.col("kind") != "BUSINESS_RULE")
    ceiling = F.when(unknown, 0.45).when(moved, 0.85).otherwise(1.0)
    return rules.withColumn("source_kind", F.col("kind")).withColumn("ceiling", ceiling).withColumn("kind", F.when(F.col("category") == "BUSINESS_CONSTRAINT", "BUSINESS_RULE").otherwise(F.col("category")))


def build_assertions(nodes: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One rule of each node that has a condition, and its links to evidence.  evidence: node_evidence()."""
    p = F.col("properties")
    rules = nodes.where(S.has_prop(p, "normalizedCondition")).select(*RUN_KEY, F.col("kind").alias("rule_kind"), S.prop(p, "normalizedCondition").alias("condition"), "confidence")
    return rules, evidence.join(rules.select(*RUN_KEY), list(RUN_KEY), "left_semi")


def merge_relation_evidence(relations: DataFrame, most: int = 32) -> DataFrame:
    """relation_key, file_path, start_line, snippet_hash: the first `most` distinct places of each relation, and whether
    there were more."""
    places = relations.dropDuplicates(["relation_key", "file_path", "start_line", "snippet_hash"])
    by = Window.partitionBy("relation_key")
    ranked = places.withColumn("place", F.row_number().over(by.orderBy("file_path", "start_line", "snippet_hash"))).where(F.col("place") <= most + 1)
    return ranked.withColumn("truncated", F.max(F.col("place") > most).over(by)).where(F.col("place") <= most)


def resolve_unique_target(calls: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (call_id, receiver, name, arity) linked to a method (method_key, owner, name, arity) that alone fits; the
    others with how many fit."""
    fit = methods.groupBy(F.col("owner").alias("receiver"), "name", "arity").agg(F.count("*").alias("candidates"), F.min("method_key").alias("method_key"))
    found = calls.join(fit, ["receiver", "name", "arity"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return found.where("candidates = 1").drop("candidates"), found.where("candidates <> 1").drop("method_key").withColumn("code", F.lit("UNRESOLVED_CALL"))


def finalize_run(runs: DataFrame, nodes: DataFrame, quarantine: DataFrame, executions: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """The final status of each run."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count("*").alias(name))

    out = runs
    for df, name in ((nodes, "n_nodes"), (quarantine, "n_bad"), (executions.where("status <> 'SUCCEEDED'"), "n_short"), (diagnostics, "n_told")):
        out = out.join(counted(df, name), "run_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_nodes") == 0, "FAILED").when(F.col("n_bad") + F.col("n_short") + F.col("n_told") > 0, "PARTIALLY_SUCCEEDED").otherwise("SUCCEEDED"))


def revision_upsert(revisions: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Revisions (commit, fingerprint, parents) that are new, and their parents with their places."""
    fresh = revisions.dropDuplicates(["commit", "fingerprint"]).join(stored.select("commit", "fingerprint"), ["commit", "fingerprint"], "left_anti")
    return fresh.drop("parents"), fresh.select("commit", "fingerprint", F.posexplode("parents").alias("ordinal", "parent"))
