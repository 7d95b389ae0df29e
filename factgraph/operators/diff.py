"""Semantic diff of two runs.

Nodes: stable_key, kind, properties, confidence, fingerprint, structural_fingerprint, evidence_fingerprint.  Matching
runs in tiers over all nodes at once; ties go to the smaller stable key, so that the result does not hang on any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import expressions as E
from factgraph.functions import semantics as S
from factgraph.functions import vocabulary as V
from factgraph.operators.reach import shared_table


def match_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before_key, after_key, tier): by key, then by kind and symbol where one after-node has it, then by kind and
    structure where each side has it once and the after-key is new.

    Both sides meet by key once, and this is written; the later tiers look at what is left, and at counts over whole sides.
    """
    b = before.select(F.col("stable_key").alias("before_key"), "kind", S.prop(F.col("properties"), "symbolSignature").alias("symbol"), F.col("structural_fingerprint").alias("shape"))
    a = after.select(F.col("stable_key").alias("after_key"), "kind", S.prop(F.col("properties"), "symbolSignature").alias("symbol"), F.col("structural_fingerprint").alias("shape"))
    said = F.struct("kind", "symbol", "shape")
    met = b.select("before_key", said.alias("b")).join(a.select("after_key", said.alias("a")), F.col("before_key") == F.col("after_key"), "full_outer")
    left = F.when(F.col("before_key").isNull(), F.col("a")).when(F.col("after_key").isNull(), F.col("b"))
    met = shared_table(met.select("before_key", "after_key", left.alias("x")).select("before_key", "after_key", "x.*"), "met")
    lone_b, lone_a = met.where("after_key IS NULL").drop("after_key"), met.where("before_key IS NULL").drop("before_key")

    def once(pairs: DataFrame, tier: int) -> DataFrame:
        return pairs.groupBy("after_key").agg(F.min("before_key").alias("before_key")).select("before_key", "after_key", F.lit(tier).alias("tier"))

    by_symbol = a.where("symbol IS NOT NULL").groupBy("kind", "symbol").agg(F.count("*").alias("n"), F.min("after_key").alias("after_key")).where("n = 1")
    by_symbol = lone_b.join(by_symbol, ["kind", "symbol"]).select("before_key", "after_key").join(lone_a.select("after_key"), "after_key", "left_semi")
    by_symbol = shared_table(once(by_symbol, 2), "matched")
    new = lone_a.groupBy("kind", "shape").agg(F.count("*").alias("n"), F.min("after_key").alias("after_key")).where("n = 1").drop("n")
    old = b.groupBy("kind", "shape").agg(F.count("*").alias("n"), F.min("before_key").alias("before_key")).where("n = 1").drop("n")
    by_shape = old.join(new, ["kind", "shape"]).select("before_key", "after_key").join(lone_b.select("before_key"), "before_key", "left_semi")
    for key in ("before_key", "after_key"):
        by_shape = by_shape.join(by_symbol.select(key), key, "left_anti")
    by_shape = shared_table(once(by_shape.select("before_key", "after_key"), 3), "matched")
    return met.where("before_key = after_key").select("before_key", "after_key", F.lit(1).alias("tier")).union(by_symbol).union(by_shape)


def impact_type(old: Column, new: Column) -> Column:
    """What a change of behaviour means: the first that applies."""
    conditions = [S.prop(p, "normalizedCondition") for p in (old, new)]
    ops, nums = ([F.coalesce(f(c), F.lit("[]")) for c in conditions] for f in (E.operators_of, E.numbers_of))
    out = F.when(ops[0] != ops[1], "OPERATOR_CHANGED").when(nums[0] != nums[1], "THRESHOLD_CHANGED")
    for key, name in V.IMPACT_KEYS:
        out = out.when(~S.prop(old, key).eqNullSafe(S.prop(new, key)), name)
    return out.otherwise("BEHAVIOR_CHANGED")


def _differ() -> Column:
    """Whether anything that a change may come from differs between `b` and `a`; true where one of them is missing."""
    return ~reduce(Column.__and__, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("stable_key", "kind", "properties", "confidence", "evidence_fingerprint")])


def compare_pairs(pairs: DataFrame) -> DataFrame:
    """Rows with structs `b` and `a` -> a row for each change (change_type, impact).  Nothing is parsed of pairs that are the same."""
    pairs = pairs.where(_differ())
    b, a = F.col("b.properties"), F.col("a.properties")
    names = S.prop(b, "symbolName"), S.prop(a, "symbolName")
    renamed = (F.col("b.stable_key") != F.col("a.stable_key")) | F.coalesce(names[0] != names[1], F.lit(False))
    modified = (F.col("b.kind") != F.col("a.kind")) | (S.behavioral(b) != S.behavioral(a))
    told = [
        F.when(renamed, F.struct(F.lit("RENAMED").alias("change_type"), F.lit("NAME_CHANGED").alias("impact"))),
        F.when(~S.prop(b, "filePath").eqNullSafe(S.prop(a, "filePath")), F.struct(F.lit("MOVED").alias("change_type"), F.lit("SOURCE_MOVED").alias("impact"))),
        F.when(F.col("modified"), F.struct(F.lit("MODIFIED").alias("change_type"), F.col("behaviour").alias("impact"))),
        F.when(~F.col("b.confidence").eqNullSafe(F.col("a.confidence")), F.struct(F.lit("CONFIDENCE_CHANGED").alias("change_type"), F.lit("CONFIDENCE_CHANGED").alias("impact"))),
        F.when(~F.col("b.evidence_fingerprint").eqNullSafe(F.col("a.evidence_fingerprint")), F.struct(F.lit("EVIDENCE_CHANGED").alias("change_type"), F.lit("SOURCE_EVIDENCE_CHANGED").alias("impact"))),
    ]
    marked = pairs.withColumn("modified", F.coalesce(modified, F.lit(False)))
    # trees are read only where something was modified
    trees = F.when(F.col("modified"), b), F.when(F.col("modified"), a)
    return marked.withColumn("behaviour", impact_type(*trees)).withColumn("change", F.explode(F.array_compact(F.array(*told)))).select("b", "a", "change.*")


def diff_nodes(before: DataFrame, after: DataFrame, matched: DataFrame) -> DataFrame:
    """All changes of nodes: stable_key, change_type, impact, confidence."""
    state = F.struct("stable_key", "kind", "properties", "confidence", "fingerprint", "evidence_fingerprint")
    b, a = before.select(F.col("stable_key").alias("before_key"), state.alias("b")), after.select(F.col("stable_key").alias("after_key"), state.alias("a"))
    # each side is dealt by its own key and meets the other once; what has no match keeps a key of its own
    own = b.join(matched.select("before_key", "after_key"), "before_key", "left").select("b", F.coalesce("after_key", F.concat(F.lit("\x00"), "before_key")).alias("after_key"))
    # written, so that changed, gone and new ones do not each deal both sides again
    both = shared_table(own.join(a, "after_key", "full_outer").where(_differ()).select("b", "a"), "differ")
    kept = compare_pairs(both.where("b IS NOT NULL AND a IS NOT NULL").select("b", "a"))
    gone = both.where("a IS NULL").select("b", "a", F.lit("REMOVED").alias("change_type"), F.concat("b.kind", F.lit("_REMOVED")).alias("impact"))
    new = both.where("b IS NULL").select("b", "a", F.lit("ADDED").alias("change_type"), F.concat("a.kind", F.lit("_ADDED")).alias("impact"))
    return change_rows(kept.unionByName(gone).unionByName(new))


def change_rows(changes: DataFrame) -> DataFrame:
    """One row of each key, type and impact, with the lesser confidence and what each side was."""
    key = F.coalesce("a.stable_key", "b.stable_key")
    return changes.select(key.alias("stable_key"), "change_type", "impact", F.least("b.confidence", "a.confidence").alias("confidence"), F.col("b").alias("before_state"), F.col("a").alias("after_state")).dropDuplicates(["stable_key", "change_type", "impact"])


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges that came, went or changed: source_key, target_key, kind, change_type, impact."""
    keys = ["source_key", "target_key", "kind"]
    b = before.select(*keys, F.struct("confidence", "evidence_fingerprint").alias("b"))
    a = after.select(*keys, F.struct("confidence", "evidence_fingerprint").alias("a"))
    both = b.join(a, keys, "full_outer")
    told = F.array_compact(
        F.array(
            F.when(F.col("a").isNull(), F.struct(F.lit("REMOVED").alias("change_type"), F.concat("kind", F.lit("_REMOVED")).alias("impact"))),
            F.when(F.col("b").isNull(), F.struct(F.lit("ADDED").alias("change_type"), F.concat("kind", F.lit("_ADDED")).alias("impact"))),
            F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("b.confidence").eqNullSafe(F.col("a.confidence")), F.struct(F.lit("CONFIDENCE_CHANGED").alias("change_type"), F.lit("CONFIDENCE_CHANGED").alias("impact"))),
            F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("b.evidence_fingerprint").eqNullSafe(F.col("a.evidence_fingerprint")), F.struct(F.lit("EVIDENCE_CHANGED").alias("change_type"), F.lit("SOURCE_EVIDENCE_CHANGED").alias("impact"))),
        )
    )
    return both.withColumn("change", F.explode(told)).select(*keys, "change.*", F.least("b.confidence", "a.confidence").alias("confidence"))


def carry_reviews(latest: DataFrame, matched: DataFrame, before: DataFrame, after: DataFrame, own: DataFrame) -> DataFrame:
    """Latest reviews (stable_key, decision) of the baseline on the nodes of the new run that have none of their own:
    as they are where the fingerprints agree, else STALE.

    `latest` may have merge_target, the key of the baseline's node that the reviewed one was merged into, and fingerprint,
    what the reviewed node was then.  A review of another fingerprint is stale; so is a merge whose target is not in the new
    run under the same key, or has changed there.  merge_target goes on only where the target is as it was.
    """
    text = F.lit(None).cast("string")
    told = latest.select(
        F.col("stable_key").alias("before_key"),
        "decision",
        (F.col("merge_target") if "merge_target" in latest.columns else text).alias("target"),
        (F.col("fingerprint") if "fingerprint" in latest.columns else text).alias("reviewed_print"),
    )
    old = before.select(F.col("stable_key").alias("before_key"), F.col("fingerprint").alias("before_print"))
    new = after.select(F.col("stable_key").alias("after_key"), F.col("fingerprint").alias("after_print"))
    found = told.join(matched.select("before_key", "after_key"), "before_key").join(old, "before_key").join(new, "after_key")
    fresh = found.join(own.select(F.col("stable_key").alias("after_key")), "after_key", "left_anti")
    # targets in both runs, by key; reviews without one do not take part in the join
    kept = old.join(new, F.col("before_key") == F.col("after_key")).where("before_print = after_print").select(F.col("after_key").alias("target"), F.lit(True).alias("target_kept"))
    merged = fresh.where("target IS NOT NULL").join(kept, "target", "left").unionByName(fresh.where("target IS NULL"), allowMissingColumns=True)
    holds = F.coalesce("target_kept", F.lit(False))
    same = F.coalesce(F.col("before_print") == F.col("after_print"), F.lit(False)) & F.coalesce(F.col("reviewed_print") == F.col("before_print"), F.lit(True)) & (F.col("target").isNull() | holds)
    return merged.select(
        F.col("after_key").alias("stable_key"),
        F.when(same, F.col("decision")).otherwise("STALE").alias("decision"),
        F.when(holds, F.col("target")).alias("merge_target"),
        F.when(~same, "REVIEW_BECAME_STALE").alias("change_type"),
    )


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, sha256 of two corpora -> path and what became of it."""
    both = before.select("path", F.col("sha256").alias("b")).join(after.select("path", F.col("sha256").alias("a")), "path", "full_outer")
    return both.where("NOT (a <=> b)").select("path", F.when(F.col("b").isNull(), "ADDED").when(F.col("a").isNull(), "DELETED").otherwise("MODIFIED").alias("change"))


def default_baseline(runs: DataFrame) -> DataFrame:
    """run_id, project_id, created_at, completed -> each run with the latest completed one before it."""
    w = Window.partitionBy("project_id").orderBy("created_at").rangeBetween(Window.unboundedPreceding, -1)
    at = runs.withColumn("created_at", F.unix_micros(F.col("created_at").cast("timestamp")))
    return at.select("run_id", "project_id", F.max(F.when(F.col("completed"), F.struct("created_at", "run_id"))).over(w)["run_id"].alias("baseline_id"))


def list_changes(changes: DataFrame, text: str = "", limit: int = 10_000) -> DataFrame:
    found = changes.where(F.contains(F.lower(F.concat_ws(" ", "stable_key", "change_type", "impact")), F.lit(text.lower()))) if text else changes
    return found.orderBy("stable_key", "change_type", "impact").limit(limit)
