"""Exact dedup, periodic runs and the Merkle manifest against plain Python, SQL and odd rows."""

import os
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from factgraph.llm import exactdedup, merkle, periodic, registry

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep int, digest string, g int, runs string, path string"


def docs(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source), and columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 1, "x", 2, "y", "z") for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_merkle"])
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(str, r)) for r in found.fetchall())


def plain_classes(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((str(i), str(keep), len(groups[t or ""]), i == keep, sha256((t or "").encode()).hexdigest()))
    return sorted(out)


ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "a"), (5, "a"), (6, "a "), (None, "a"), (None, "only"), (None, "only"), (7, "w" * 300_000), (8, "w" * 300_000), (9, "w" * 300_000 + "v"), (10, "é"), (11, "é"), (-3, "low")]


@pytest.mark.parametrize("limit", [exactdedup.LIMIT, 2000])
def test_exact_dedup_against_plain(spark, limit):
    rnd = random.Random(5)
    # a third are copies of one text, others have few; a small table makes buckets split and fold again and again
    rows = ODD + [(100 + i, rnd.choice(["hot " * 150, f"text {rnd.randrange(60)} " * 20, f"own {i} " * 30])) for i in range(900)]
    got = exactdedup.classes(docs(spark, rows).repartition(7), limit=limit, held=64 if limit < 10_000 else exactdedup.HELD).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == plain_classes(rows)


def test_exact_dedup_keeps_one_of_each(spark):
    kept = exactdedup.one_of_each(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(i), t or "") for i, t in ODD if i in (2, 3, 6, 8, 9, 10, 11, -3) or (i == 5) or t == "only")
    assert exactdedup.classes(docs(spark, [])).count() == 0 and exactdedup.one_of_each(docs(spark, [])).count() == 0
    by_case = exactdedup.classes(docs(spark, [(1, "A b"), (2, "a B"), (3, "c")]), text=F.lower("text"))
    assert sorted((r.doc_id, r.keep_id) for r in by_case.collect()) == [(1, 2), (2, 2), (3, 3)]


def test_equal_digests_are_told_apart_by_content():
    t = exactdedup.Records()
    same = b"\0" * 32
    bodies = [b"x%d" % (i % 300) for i in range(3000)]
    assert [t.place(same, b) for b in bodies] == [i % 300 for i in range(3000)]
    assert [t.place(sha256(b).digest(), b) for b in bodies] == [300 + i % 300 for i in range(3000)]


def plain_runs(w, least, times):
    """Every maximal stretch of each period, smallest periods first."""
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            length = i + p - start
            if i > start and length >= max(least, times * p) and not any(p % q == 0 and s <= start and start + length <= s + n for (s, n), q in out.items()):
                out[start, length] = p
            i += i == start
    return sorted((s, n, p) for (s, n), p in out.items())


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (7, 3)])
def test_runs_against_plain(least, times):
    rnd = random.Random(times)
    for _ in range(800):
        n, letters = rnd.randrange(70), rnd.choice("1235")
        w = [str(rnd.randrange(int(letters))) for _ in range(n)]
        if n > 8 and rnd.random() < 0.6:
            a = rnd.randrange(n - 4)
            p = 1 + rnd.randrange((n - a) // 3 + 1)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        assert periodic.runs_of(w, least, times) == plain_runs(w, least, times)


def test_long_texts_have_their_runs():
    n = 100_000
    assert periodic.runs_of(["a"] * n) == [(0, n, 1)]
    assert periodic.runs_of([str(i % 7000) for i in range(n)]) == [(0, n, 7000)]
    assert periodic.runs_of([str(i) for i in range(n)]) == []
    few = random.Random(2)
    w = [few.choice("ab") for _ in range(20_000)]
    assert all(w[s : s + k - p] == w[s + p : s + k] and (s == 0 or w[s - 1] != w[s - 1 + p]) and (s + k == len(w) or w[s + k] != w[s + k - p]) for s, k, p in periodic.runs_of(w))


def test_positions_stay_in_order():
    rnd = random.Random(1)
    values = rnd.sample(range(10**6), 5000)
    own = periodic.Positions([values[0]])
    for k, x in enumerate(values[1:], 1):
        if k % 500 == 0:
            seen = sorted(values[:k])
            assert own.around(x) == (max((v for v in seen if v < x), default=-1), min((v for v in seen if v > x), default=-1))
        own.add(x)
    assert list(own) == sorted(values)


def test_periodic_query_against_plain(spark):
    found = {r.doc_id: r for r in periodic.op12_periodic(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows) and any(r.n_runs for r in found.values())
    for i, t in rows:
        w, h = periodic.WORD.findall(t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
        runs, r = plain_runs(w, 6, 4) if len(w) < 3000 else periodic.runs_of(w), found[i]
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, 1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


def test_periodic_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x y x y x y x y z"), (5, "b" * 100_000), (6, "c " * 50_000), (7, "a a a a")]
    got = periodic.find(docs(spark, rows))
    assert [c for c in got.columns if c not in ("runs", "collapsed")] == [c for c in docs(spark, []).columns if c != "runs"]
    answers = sorted((str(r.doc_id), len(r.runs), r.collapsed[:9]) for r in got.collect())
    assert answers == [("1", 0, ""), ("2", 0, ""), ("3", 0, ""), ("4", 1, "a"), ("4", 1, "a"), ("5", 0, "b" * 9), ("6", 1, "c"), ("7", 0, "a a a a"), ("None", 1, "x y z")]
    assert periodic.summed_up(periodic.find(periodic.with_loops(docs(spark, [])))).count() == 0
    assert periodic.summed_up(periodic.find(periodic.with_loops(docs(spark, rows)))).where("runs_sha256 IS NULL OR collapsed_sha256 IS NULL").count() == 0


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """(root, the siblings (left, right) of each node on each level up)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 16 * 16
            path.append((level[run : at[k]], level[at[k] + 1 : run + 16]))
            at[k] //= 16
        level = [hashed(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return (level or [None])[0], paths


def plain_manifest(rows):
    """From (doc_id, source, text): the columns of the manifest; doc_id alone is hashed with source and text."""
    f = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = defaultdict(list)
    for i, s, t in rows:
        groups[s].append((i, t))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in keys:
        own = sorted(((i is not None, i or 0, hashed(f(i), f(s), f(t))), i, t) for i, t in groups[s])
        trees[s] = own, plain_tree([o[0][2] for o in own])
    root, above = plain_tree([trees[s][1][0] for s in keys])
    for s, up in zip(keys, above, strict=True):
        own, (subroot, paths) = trees[s]
        for (_, i, t), path in zip(own, paths, strict=True):
            bad = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and t is not None
            acc = hashed(f(i), f(s), f("".join(c.lower() if "A" <= c <= "Z" else c for c in t) if bad else t))
            for left, right in path + up:
                acc = hashed(*left, acc, *right)
            proof = hashed(*[x for left, right in path + up for x in [*left, *right]])
            out.append((str(i), hashed(f(i), f(s), f(t)), subroot, root, proof, acc, acc == root))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 1}, {"hot": 700, "": 5, None: 300, "é": 257, "z": 1}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_against_plain(spark, sizes):
    rnd = random.Random(len(sizes))
    rows = [(rnd.choice([None, i, i, i]) if s == "hot" else i, s, rnd.choice([None, "", f"Text {i}", f"low {i}", "É" * 50])) for s, n in sizes.items() for i in range(n)]
    if "hot" in sizes:
        rows += [(5, "hot", "twice")] * 40
    got = merkle.manifest(docs(spark, [(i, t, s) for i, s, t in rows]).repartition(5), ["doc_id", "source", "text"], claimed={"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))})
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_long_texts(spark):
    assert merkle.manifest(docs(spark, []), ["doc_id", "text"]).count() == 0
    got = merkle.manifest(docs(spark, [(1, "x" * 2_000_000), (2, None)]), ["doc_id", "text"]).collect()
    assert len({r.root for r in got}) == 1 and all(r.verified for r in got)
