"""The registered scenario queries against a plain search of the same graph."""

from collections import defaultdict

from factgraph.functions import vocabulary as V
from factgraph.operators import reach
from factgraph.plans import queries, registry
from factgraph.plans.tables import Tables

SF = "/root/testdata/sf0.001"


def searched(kinds, lost, ways, entry, max_depth=8, max_nodes=120):
    """Members of one entry point in the order of the search, and whether it was cut."""
    queue, seen, members, cut = [(entry, 0)], {entry}, [], False
    for at, depth in queue:
        members.append((at, depth))
        if at in lost or (depth and kinds[at] in V.ASYNC_KINDS):
            continue
        out = ways[at][: max_nodes + 1]
        cut |= len(out) > max_nodes
        for to, _ in out:
            if to in seen or kinds[to] == "TECHNICAL_GUARD":
                continue
            if depth >= max_depth or len(seen) >= max_nodes:
                cut = True
                continue
            seen.add(to)
            queue.append((to, depth + 1))
    return members, cut


def test_scenarios_of_the_tables(spark):
    nodes, edges = Tables(spark, SF).graph
    nodes, edges = nodes.where("run_id = 'R1'").collect(), edges.where("run_id = 'R1'").collect()
    kinds, lost, ways = {n.stable_key: n.kind for n in nodes}, {n.stable_key for n in nodes if n.unresolved}, defaultdict(list)
    for e in edges:
        if e.kind in V.TRAVERSABLE and e.target_key in kinds:
            ways[e.source_key].append((e.target_key, e.kind))
    for own in ways.values():
        own.sort()
    want = {n.stable_key: searched(kinds, lost, ways, n.stable_key) for n in nodes if n.kind in V.ENTRY_KINDS}
    got = defaultdict(list)
    for r in registry.QUERIES["sc1_scenario_members"](spark, SF).where("run_id = 'R1'").collect():
        got[r.entry_key].append((r.position, r.member_key, r.depth))
    assert {k: [(m, d) for _, m, d in sorted(v)] for k, v in got.items()} == {k: members for k, (members, _) in want.items()}
    model = {r.entry_key: r for r in registry.QUERIES["sc3_scenario_model"](spark, SF).where("run_id = 'R1'").collect()}
    for k, (members, cut) in want.items():
        assert (model[k].truncated, model[k].n_unresolved, model[k].n_kinds) == (cut, sum(m in lost for m, _ in members), len({kinds[m] for m, _ in members}))
        assert model[k].n_async == sum(d > 0 and kinds[m] in V.ASYNC_KINDS and m not in lost for m, d in members)


def test_a_model_keeps_the_order_of_discovery(spark):
    members = [("r", "e", "e", "ENDPOINT", 0, 1, 0.9, False), ("r", "e", "z", "METHOD", 1, 2, 0.8, False), ("r", "e", "a", "EXTERNAL_CALL", 1, 3, 0.7, False), ("r", "e", "b", "METHOD", 2, 4, 0.6, False), ("r", "e", "y", "LOST", 2, 5, 0.0, True), ("r", "e", "x", "LOST", 3, 6, 0.5, True), ("r", "f", "f", "MESSAGE_CONSUMER", 0, 1, 0.9, False)]
    df = spark.createDataFrame(members, "run_id string, entry_key string, member_key string, kind string, depth int, position bigint, confidence double, unresolved boolean")
    flags = spark.createDataFrame([("r", "e", True), ("r", "f", False)], "run_id string, entry_key string, truncated boolean")
    entries = spark.createDataFrame([("r", "e", '{"actors":["clerk"],"inputContract":{"id":"long"},"preconditions":["open","paid"]}')], "run_id string, stable_key string, properties string")
    got = {r.entry_key: r for r in reach.scenario_model(df, flags, entries).collect()}
    e, f = got["e"], got["f"]
    assert (e.async_boundaries, e.unresolved, list(e.members_by_kind.items())) == (["a"], ["y", "x"], [("ENDPOINT", ["e"]), ("METHOD", ["z", "b"]), ("EXTERNAL_CALL", ["a"]), ("LOST", ["y", "x"])])
    assert (e.actors, e.input_contract, e.preconditions, e.confidence, e.truncated) == ('["clerk"]', '{"id":"long"}', '["open","paid"]', 0.0, True)
    # an entry of an asynchronous kind is no boundary of its own; what an entry does not state is empty
    assert (f.async_boundaries, f.actors, f.input_contract, f.preconditions) == ([], "[]", "{}", "[]")


def test_edges_of_scenarios_read_their_members_once(spark):
    """members were found once for entries and once more for what is part of them."""
    edges, kids = registry.QUERIES["sc5_scenario_edges"](spark, SF), queries.contained(Tables(spark, SF)).select("run_id", "entry_key", "member_key")
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in (edges, kids)]
    assert scans[0] == scans[1] > 0
    rows = [("r", "e", "e", 0), ("r", "e", "a", 1), ("r", "e", "b", 2), ("r", "f", "f", 0)]
    got = reach.scenario_edges(spark.createDataFrame(rows, "run_id string, entry_key string, member_key string, depth int")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [("a", "scenario:e", "PART_OF_SCENARIO", 1), ("b", "scenario:e", "PART_OF_SCENARIO", 2), ("scenario:e", "e", "ENTRY_TO", 0), ("scenario:f", "f", "ENTRY_TO", 0)]


def test_a_search_shuffles_numbers_once_a_level(spark, monkeypatch):
    """each level shuffled its keys several times and was searched again for what was cut."""
    asked = []
    real = reach.shared_table
    monkeypatch.setattr(reach, "shared_table", lambda df, tag: asked.append((tag, df)) or real(df, tag))
    names = ["e0", "e1", *(f"m{i:02}" for i in range(14))]
    kinds = {k: "ENDPOINT" if k[0] == "e" else ("METHOD", "TECHNICAL_GUARD", "EXTERNAL_CALL", "METHOD")[int(k[1:]) % 4] for k in names}
    ways = defaultdict(list)
    for i, a in enumerate(names):
        ways[a] = sorted({(names[(i * 5 + j * j * 3 + 1) % len(names)], ("CALLS", "READS")[j % 2]) for j in range(1 + i % 5)})
    nodes = spark.createDataFrame([("r", k, kinds[k], 0.9, k == "m08", False) for k in names], "run_id string, stable_key string, kind string, confidence double, unresolved boolean, framework_internal boolean")
    edges = spark.createDataFrame([("r", a, b, kind, 0.8) for a, own in ways.items() for b, kind in own], "run_id string, source_key string, target_key string, kind string, confidence double")
    cuts = set()
    for depth, most in ((8, 120), (2, 120), (8, 4), (8, 2), (1, 3), (8, 9)):
        members, flags = reach.scenario_members(nodes, edges, max_depth=depth, max_nodes=most)
        got = {r.entry_key: [] for r in flags.collect()}
        for r in sorted(members.collect(), key=lambda r: r.position):
            got[r.entry_key].append((r.member_key, r.depth))
        want = {e: searched(kinds, {"m08"}, ways, e, depth, most) for e in ("e0", "e1")}
        assert got == {e: own for e, (own, _) in want.items()}, (depth, most)
        assert {r.entry_key: r.truncated for r in flags.collect()} == {e: cut for e, (_, cut) in want.items()}, (depth, most)
        cuts |= {cut for _, cut in want.values()}
    assert cuts == {True, False}
    levels = [df for tag, df in asked if tag == "level"]
    assert levels and not [c for df in levels for c, kind in df.dtypes if kind == "string"]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in levels]
    assert all(p.count("RepartitionByExpression") == p.count("Join") for p in plans) and any("Join" in p for p in plans)
