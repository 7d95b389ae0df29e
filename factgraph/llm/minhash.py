"""Operator 9: near duplicates by circulant MinHash, banding and exact verification.

A document's set holds the hashes of its distinct word shingles.  Documents of equal sets form a class, so that copies
cost one row.  A first permutation spreads a set over a ring of places; a second one, shifted by one place for each
coordinate, gives all coordinates of the signature: those of one shingle lie side by side in one array.  Classes that
agree in a band of coordinates share a bucket.

Links are sought in three rounds, and after the first only between classes of different components:

1.  In every bucket its smallest class and one drawn by a hash meet all others (two stars).
2.  In buckets that still hold several components ("open" ones), classes that share a rare shingle meet.  A shingle is
    rare if at most RARE of the open classes have it, so that these pairs are few.  Also a few classes of each bucket's
    largest component meet its other classes.
3.  All other pairs of different components in a bucket.  They share no rare shingle, so that no more is common to them
    than the rest, counted by PLACES groups of hashes: the sum of the smaller counts bounds what is common.  Only
    pairs whose bound reaches the threshold go on, once each, though they share several buckets.

So no link between two components is left out, while a bucket of many akin classes that are not linked costs a
comparison of two short rows a pair and no set.  Every link is confirmed on the full sets.  Shingles are known by
64-bit hashes, classes by 128-bit hashes of their sets.

Rows: null, empty or blank text has no set and is linked with nothing.  A null doc_id never becomes the id of a
component that has another id; rows of null id in a component without ids have a null component_id and are kept.
Repeated rows of one doc_id share its fate.  Other columns are not read.  No rows give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import by_batch, kept_beyond, shelf, stored, table, texts
from factgraph.llm.components import components

#: Coordinates of a signature, at most.
COORDINATES = 144
#: How likely a pair at the threshold may miss every bucket.
MISS = 2e-5
#: Places of the ring.
RING = 1 << 22
#: A shingle is rare if so many open classes have it at most.
RARE = 8
#: Groups of hashes by which shingles that are not rare are counted.
PLACES = 64
#: Classes of an open bucket's largest component that meet the bucket's others in the second round.
CENTRES = 4
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def banding(similarity: float, coordinates: int = COORDINATES) -> tuple[int, int]:
    """(bands, rows of each): the most rows with which a pair at the threshold is missed with at most MISS."""
    rows = max((r for r in range(1, 13) if (1 - similarity**r) ** (coordinates // r) <= MISS), default=1)
    return coordinates // rows, rows


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(base: int, log: int) -> np.ndarray:
    p = np.full(1 << log, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), max(16, int(n).bit_length()))


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text; with fewer words, of all of them as one."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # lower-cases A-Z alone
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b))[: len(b)], out=sums[1:])
    word = mix((sums[end] - sums[start]) * powers(BACK, len(b))[start] + (end - start).astype(np.uint64))
    of = min(n, words)
    h = np.full(n - of + 1, of, np.uint64)
    for k in range(of):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + word[k : k + len(h)])
    return np.unique(h)


@lru_cache(maxsize=2)
def _ring(coordinates: int) -> np.ndarray:
    """Row i: the coordinates of place i, which are the second permutation from i on."""
    turn = np.random.default_rng(9).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.r_[turn, turn[: coordinates - 1]], coordinates)


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    place = (mix(found ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - 22)).astype(np.int64)  # the first permutation
    ring, low = _ring(coordinates), np.full(coordinates, RING, np.uint32)
    for at in range(0, len(place), 2048):
        np.minimum(low, ring[place[at : at + 2048]].min(axis=0), out=low)
    return low


def buckets(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The hash of each band with its number."""
    cut, h = low[: bands * rows].reshape(bands, rows).astype(np.uint64), np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + cut[:, k])
    return h.astype(np.int64)


def _class(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, class (a hash of the set; null if it is empty), bands (a hash of each)."""
    src = docs.select("doc_id", "text")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        n, cls, out = [], [], []
        for text in texts(b):
            found = shingles(text, words)
            n.append(len(found))
            cls.append(_class(found))
            out.append(buckets(signature(found, bands * rows), bands, rows) if len(found) else None)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "class", "bands"])

    return src.mapInArrow(by_batch(one), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, class binary, bands array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    src = docs.select("text")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, words) for t in texts(b)]
        return pa.RecordBatch.from_arrays([pa.array([_class(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["class", "set"])

    return src.mapInArrow(by_batch(one), "class binary, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(lu, lv) of the pairs (u, v, lu, lv) whose sets are as similar as asked for: 100 * common >= percent * all."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
            ok.append(100 * common >= percent * (len(x) + len(y) - common))
        return b.filter(pa.array(ok, pa.bool_())).select(["lu", "lv"])

    for c in "uv":
        pairs = pairs.join(sets.select(F.col("cid").alias(c), F.col("set").alias(f"set_{c}")), c)
    return pairs.select("lu", "lv", "set_u", "set_v").mapInArrow(by_batch(one), "lu bigint, lv bigint")


def _joined_up(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (cid, label) once the labels that `links` (lu, lv) connect are one, the smallest of them."""
    to = components(links.select(F.col("lu").alias("u"), F.col("lv").alias("v"))).select(F.col("id").alias("label"), F.col("label").alias("to"))
    return stored(label.join(to, "label", "left").select("cid", F.coalesce("to", "label").alias("label")), "labels")


def _open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Of `rows` (h, cid, ...) those in buckets with classes of several components, with label and most: the label that
    most of the bucket's classes have."""
    rows = rows.drop("label", "most").join(label, "cid")
    each = rows.groupBy("h", "label").agg(F.count("*").alias("n"))
    several = each.groupBy("h").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("most")).where("labels > 1")
    # a table of its own, so that Spark can split a large bucket when it meets the rows again
    return stored(rows.join(stored(several.select("h", "most"), "open"), "h"), "open-rows")


def _rare(sets: DataFrame, of: DataFrame) -> DataFrame:
    """The columns of `of` (cid, ...) and s: the rare shingles of each of its classes."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))), pa.array(np.concatenate(found))], names=["cid", "s"])

    each = sets.join(of.select("cid"), "cid", "left_semi").select("cid", "set").mapInArrow(by_batch(one), "cid bigint, s bigint")
    few = each.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") <= RARE).select("s")
    return each.join(few, "s").join(of, "cid")


def _frequent(sets: DataFrame, of: DataFrame, rare: DataFrame) -> DataFrame:
    """cid, c, counts: how many shingles that are not rare each class of `of` has, in all and by groups of hashes."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        c, counts = [], []
        for found, out in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            found = np.setdiff1d(np.frombuffer(found, np.uint64), np.array(out or (), np.int64).view(np.uint64), assume_unique=True)
            c.append(len(found))
            counts.append(np.bincount((mix(found) % np.uint64(PLACES)).astype(np.int64), minlength=PLACES).astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(c, pa.int64()), pa.array(counts, pa.binary())], names=["cid", "c", "counts"])

    own = rare.groupBy("cid").agg(F.collect_list("s").alias("out"))  # no more than a text has
    return sets.join(of.select("cid"), "cid", "left_semi").join(own, "cid", "left").select("cid", "set", "out").mapInArrow(by_batch(one), "cid bigint, c bigint, counts binary")


def _within_bound(pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v, lu, lv) of the pairs whose counts allow the similarity."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.int32).reshape(-1, PLACES) for i in (6, 7))
        common = np.minimum(x, y).sum(axis=1, dtype=np.int64)
        both = b.column(4).to_numpy(zero_copy_only=False) + b.column(5).to_numpy(zero_copy_only=False)
        return b.filter(pa.array(100 * common >= percent * (both - common))).select(["u", "v", "lu", "lv"])

    return pairs.select("u", "v", "lu", "lv", "nu", "nv", "gu", "gv").mapInArrow(by_batch(one), "u bigint, v bigint, lu bigint, lv bigint")


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    """The columns of one side of a pair: cid u, n nu, label lu, c cu, counts gu, all hu."""
    names = {"cid": side, "n": f"n{side}", "label": f"l{side}", "c": f"c{side}", "counts": f"g{side}", "all": f"h{side}"}
    return rows.select(*more, *[F.col(a).alias(b) for a, b in names.items() if a in rows.columns])


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component (a number; null for an empty set), component_id, kept of every row of `docs`."""
    bands, rows = banding(percent / 100)
    similar_size = F.expr(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    apart = F.col("lu") != F.col("lv")
    sig = stored(signatures(docs, words, bands, rows), "signatures")
    classes = stored(
        sig.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    with shelf(docs.sparkSession):  # what is stored here goes at its end, but for the labels
        member = classes.select("cid", "n", F.explode("bands").alias("h"))
        own = F.struct("cid", "n")
        # tables of their own, so that Spark can split a large bucket when it meets the rows again
        several = stored(member.groupBy("h").agg(F.count("*").alias("size")).where("size > 1").select("h"), "several")
        rows_ = stored(member.join(several, "h"), "buckets")  # only classes that meet another one
        shared = rows_.join(stored(rows_.groupBy("h").agg(F.min(own).alias("a"), F.min_by(own, F.xxhash64("cid", "h")).alias("b")), "centres"), "h")
        star = shared.select(F.col("cid").alias("v"), F.col("n").alias("nv"), F.explode(F.array("a", "b")).alias("x")).select(F.col("x.cid").alias("u"), F.col("x.n").alias("nu"), "v", "nv")
        pairs = stored(star.where("u <> v").where(similar_size).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumns({"lu": F.col("u"), "lv": F.col("v")}), "pairs")

        # the sets of classes that share a bucket, from one document each
        meet = rows_.select("cid").distinct()
        wanted = classes.join(meet, "cid", "left_semi").select("cid", "class", "rep")
        texts_of = docs.select("doc_id", "text").join(wanted.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        sets = stored(_sets(texts_of, words).join(wanted.select("class", "cid"), "class").dropDuplicates(["cid"]).select("cid", "set"), "sets")

        label = _joined_up(meet.withColumn("label", F.col("cid")), stored(_confirmed(pairs, sets, percent), "links"))
        live = _open(rows_, label)
        if not live.isEmpty():
            of = stored(live.select("cid", "n", "label").distinct(), "open-classes")
            rare = stored(_rare(sets, of), "rare")
            kin = _side(rare, "u", "s").join(_side(rare, "v", "s"), "s").where(F.col("u") < F.col("v")).where(apart & similar_size)
            # the others can only be similar by shingles that are not rare
            likely = F.expr(f"100 * least(cu, cv) >= {percent} * (nu + nv - least(cu, cv))")
            live = stored(live.join(_frequent(sets, of, rare), "cid").where(f"100 * c >= {percent} * n"), "likely")
            most = live.where("label = most").select("h", F.struct("cid", "n", "c", "label").alias("x"))
            few = stored(most.groupBy("h").agg(*[F.max_by("x", F.xxhash64("x.cid", F.lit(i))).alias(f"x{i}") for i in range(CENTRES)]), "few")
            near = _side(live.where("label <> most"), "v", "h").join(few.select("h", F.explode(F.array_distinct(F.array(*[f"x{i}" for i in range(CENTRES)]))).alias("x")), "h")
            near = near.select("v", "nv", "cv", "lv", *[F.col(f"x.{a}").alias(b) for a, b in (("cid", "u"), ("n", "nu"), ("c", "cu"), ("label", "lu"))]).where(apart & likely)
            cross = [x.select("u", "v", "lu", "lv") for x in (kin, near)]
            label = _joined_up(label, stored(_confirmed(stored(cross[0].union(cross[1]).distinct(), "pairs"), sets, percent), "links"))
            live = _open(live, label)
            all_ = live.groupBy("cid").agg(F.array_sort(F.collect_list("h")).alias("all"))  # at most one a band
            live = stored(live.join(all_, "cid"), "open-all")
            once = F.expr("element_at(array_intersect(hu, hv), 1) = h")  # of the buckets that two classes share, in the first alone
            # of two of a bucket's others, the smaller one asks
            ask = apart & likely & once & ((F.col("lv") == F.col("most")) | (F.col("u") < F.col("v")))
            rest = _side(live.where("label <> most"), "u", "h", "most").join(_side(live, "v", "h"), "h").where(ask)
            label = _joined_up(label, stored(_confirmed(stored(_within_bound(rest, percent), "pairs"), sets, percent), "links"))
        label = kept_beyond(label)

    root = classes.join(label, "cid", "left").select("class", "rep", F.coalesce("label", "cid").alias("component"))
    named = stored(root.join(root.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("class", "component", "component_id"), "named")
    out = sig.drop("bands").join(named, "class", "left")
    name = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component", name.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without near duplicates: of each component the document with the smallest id, once."""
    keep = near_duplicates(docs, words=words, percent=percent).where("kept").select("doc_id").distinct()
    return docs.join(keep.withColumnRenamed("doc_id", "kept_id"), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["doc_id", "text"])


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("component")


#: All pairs of sets that share a shingle, and all that links reach.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 2], ' ') for i in range(1, len(w) - 1)] END) AS s FROM w
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON b.s = a.s AND b.doc_id > a.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
way AS MATERIALIZED (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reached AS (SELECT u AS doc_id, v AS other FROM way UNION SELECT r.doc_id, w.v FROM reached r JOIN way w ON w.u = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(r.least, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY 1) r USING (doc_id)
"""
