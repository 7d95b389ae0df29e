"""Operator 10: exact top-k by integer inner product, by block-at-a-time pruning.

A dimension is a term whose weight may be negative.  A block of vectors is ordered so that alike ones lie together and
is cut into ranges of RANGE.  A range keeps the largest and the smallest weight of each term; summed with a query's
weights they bound the score of every vector in it.  Each query visits ranges in its own order, the largest bound
first, and scores them through their forward index (the rows of the range), FIRST ranges at first and twice as many in
each further turn.  Before a turn it leaves out the ranges whose bounds are below its kth score, which is also carried
from block to block, and it stops when none is left.  Within a turn, the queries that visit a range score it together.

The bound holds for every vector, so that the result is exact.  What is skipped hangs on the data: of vectors in
clusters most ranges are, of vectors in all directions alike in many dimensions none, as no bound is below the kth.

Rows: vectors that are null or hold a null or non-finite component, and rows of null id, take no part; empty vectors
score 0.  Of queries with the same id the smallest vector asks once; every other row is a candidate, repeated ones
too, but not rows of the query's own id.  Vectors of unequal length meet as if filled with zeros.  Scores beyond 64
bits wrap around.  No rows give no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import table
from factgraph.llm.vectors import best_of, one_query_each, search_in_blocks, usable

#: Vectors of a range, ranges of a query's first turn, pivots that order a block.
RANGE, FIRST, PIVOTS = 32, 4, 64
#: Below every score.
NONE = np.iinfo(np.int64).min


def _ordered(x: np.ndarray) -> np.ndarray:
    """An order in which vectors near to the same pivot, then to the same second one, stand together."""
    if len(x) <= RANGE:
        return np.arange(len(x))
    near = x @ x[:: max(1, len(x) // PIVOTS)].T
    first = near.argmax(axis=1)
    near[np.arange(len(x)), first] = -np.inf
    return np.lexsort((near.argmax(axis=1), first))


def search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, least: np.ndarray, *, k: int, told: list | None = None) -> tuple[list, list, list]:
    """Scores are counted in doubles while those hold every partial sum exactly, else in 64-bit integers.

    least: what each query's kth score is at least.  told: takes how many pairs of query and range were scored, of how many.
    """
    n, d = x.shape
    order = _ordered(x)
    ids, x = ids[order], x[order]
    exact = d * max(1.0, np.abs(x).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) < 2.0**53
    starts = np.arange(0, n, RANGE)
    high, low = np.maximum.reduceat(x, starts, axis=0), np.minimum.reduceat(x, starts, axis=0)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    if not exact:
        x, q = x.astype(np.int64), q.astype(np.int64)
        bound[:] = np.inf  # sums that may wrap around bound nothing
    turns = np.argsort(-bound, axis=1, kind="stable")
    score = np.full((len(q), n), NONE, np.int64)
    kth, open_ = least.copy(), np.arange(len(q))
    at, step, scored = 0, FIRST, 0
    while at < len(starts) and len(open_):
        asked = turns[open_, at : at + step]
        row, _ = np.nonzero(wanted := np.take_along_axis(bound[open_], asked, axis=1) >= kth[open_, None])
        who, what = open_[row], asked[wanted]
        by = np.argsort(what, kind="stable")
        who, what = who[by], what[by]
        cuts = np.flatnonzero(np.diff(what)) + 1
        for r, some in zip(what[np.r_[0, cuts]] if len(what) else (), np.split(who, cuts), strict=False):
            own = slice(starts[r], starts[r] + RANGE)
            found = (q[some] @ x[own].T).astype(np.int64)
            found[ids[own] == qids[some, None]] = NONE
            score[some, own] = found
        scored += len(what)
        at, step = at + step, step * 2
        if n > k and len(open_):
            own = np.partition(score[open_], n - k, axis=1)[:, n - k]
            kth[open_] = np.maximum(kth[open_], np.where(own == NONE, -np.inf, own))
        if at < len(starts):  # a bound equal to the kth score may hide an equal score of a smaller id
            open_ = open_[bound[open_, turns[open_, at]] >= kth[open_]]
    if told is not None:
        told.append((scored, bound.size))
    out_q, out_v, out_s = [], [], []
    for j, qid in enumerate(qids.tolist()):
        some = np.flatnonzero((score[j] != NONE) & (score[j] >= kth[j]))
        some = some[best_of(ids[some], score[j, some], k)]
        out_q += [qid] * len(some)
        out_v += ids[some].tolist()
        out_s += score[j, some].tolist()
    return out_q, out_v, out_s


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query.  vectors, queries: vec_id, embedding of whole numbers."""
    return search_in_blocks(vectors, queries, partial(search, k=k), k, "bigint")


def whole_numbers(vector, scale: int = 256):
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole_numbers(F.col("embedding")).alias("embedding"))
    return top_k(good, one_query_each(good, 50), 5)


ORACLE_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
