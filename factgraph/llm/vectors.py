"""Blocks of vectors, and a stated query set against all of them block by block."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.llm.common import stored

#: Vectors of a block, and queries of a part, about.
BLOCK, QUERIES = 4096, 1024
#: Parts of queries whose kth scores a worker remembers, and that a cell has, at most; cells for each shuffle partition.
REMEMBERED, CELLS = 64, 4

#: ids, vectors, query ids, queries, the score that each query's kth best has at least -> query ids, ids, scores
Searcher = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[list, list, list]]


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def _matrix(items: pa.Array, at: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of one block; shorter vectors are filled with zeros."""
    rows = items[at].values
    ids, vecs = rows.field(0).to_numpy(zero_copy_only=False), rows.field(1)
    size = vecs.value_lengths().to_numpy(zero_copy_only=False)
    flat, width = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64), int(size.max(initial=0))
    out = np.zeros((len(ids), width))
    out[np.arange(width) < size[:, None]] = flat
    return ids, out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _raised(least: np.ndarray, qids: np.ndarray, found: tuple[list, list, list], k: int) -> np.ndarray:
    """`least` raised to the kth score of the queries that found k vectors; each query's come together, best first."""
    asked, scores = np.array(found[0], np.int64), np.array(found[2], np.float64)
    own, start, n = np.unique(asked, return_index=True, return_counts=True)
    full = n >= k
    at = np.searchsorted(qids, own[full])
    least[at] = np.maximum(least[at], scores[start[full] + k - 1])
    return least


def grid(n_vectors: int, n_queries: int, blocks: int, parts: int, cells: int) -> tuple[int, int]:
    """How many rows and columns of cells there are, about `cells` at most.

    Vectors are shuffled once a row and queries once a column, so that the fewest bytes are shuffled where both sides
    weigh alike; for as many cells, these bytes grow as the input does.  A task holds one block and the parts of a cell,
    which are REMEMBERED at most.
    """
    rows = max(ceil(parts / REMEMBERED), min(parts, round(sqrt(cells * n_queries / max(1, n_vectors)))), 1)
    return rows, max(1, min(blocks, ceil(cells / rows)))


def search_in_blocks(vectors: DataFrame, queries: DataFrame, search: Searcher, k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what `search` finds in each pair of a block of vectors and a part of
    the queries, best first, ties to the smaller vec_id.

    vectors, queries: vec_id, embedding; queries have one row of each id.  Vectors are dealt into blocks by a hash of
    their place, so that repeated ids don't gather in one; each part of the queries meets every block, k rows of each
    query come back from each, and are cut to k before and after the shuffle.  A worker carries what the kth score of
    a query is at least from one block to its next.

    Blocks and parts meet in the cells of a grid (see grid()): a row of cells has the same parts, a column the same blocks.
    """
    n_vectors, n_queries = vectors.count(), queries.count()
    blocks, parts = 1 + n_vectors // BLOCK, 1 + n_queries // QUERIES
    rows, columns = grid(n_vectors, n_queries, blocks, parts, CELLS * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    item, cell = F.collect_list(F.struct("vec_id", "embedding")), ["row", "column"]

    def place(name: str, n: int) -> Column:
        return F.pmod(F.col(name), F.lit(n))

    def all_of(n: int) -> Column:
        return F.explode(F.expr(f"sequence(0L, {n - 1}L)"))

    dealt = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))
    dealt = dealt.select("*", place("block", columns).alias("column"), all_of(rows).alias("row"))
    held = dealt.repartition(*cell).groupBy(*cell, "block").agg(item.alias("items"))
    asked = stored(queries.groupBy(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).alias("part")).agg(F.array_sort(item).alias("asked")), "queries")
    asked = asked.select("part", "asked", place("part", rows).alias("row"), all_of(columns).alias("column"))
    # merged by hint: taken for as small as its file, the side of the queries would be broadcast with its copies for all columns
    pairs = held.join(asked.hint("merge"), cell).select("items", "asked", "part")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        for b in batches:
            for r in range(b.num_rows):
                (ids, x), (qids, q), part = _matrix(b.column(0), r), _matrix(b.column(1), r), b.column(2)[r].as_py()
                x, q = _same_width(x, q)
                least = known.pop(part, np.full(len(q), -np.inf))
                found = search(ids, x, qids, q, least)
                known[part] = _raised(least, qids, found, k)
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64() if score == "bigint" else pa.float64())], names=["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(run, f"query_id bigint, vec_id bigint, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def one_query_each(vectors: DataFrame, every: int) -> DataFrame:
    """The rows whose id `every` divides, one of each id (of repeated ids the smallest vector)."""
    return vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where the k best scores stand, best first, ties to the smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))
