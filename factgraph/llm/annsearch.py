"""Operator 8: approximate nearest neighbours by inner product, by collision-counting hashing.

Within a block of vectors, one more component makes all vectors equally long, so that the nearest ones in distance are
those of the largest inner product.  Each of up to ARRAYS perpendicular directions gives an array of the block's projections,
sorted.  Around the query's projection a window of REACH radii opens in every array; from radius to radius it widens
(virtual rehashing).  Narrow windows are walked, only through the entries that are new in them; wide ones are counted
by the ranks that vectors have in the arrays.  Vectors that lie in at least COLLISIONS of
the windows are verified by their exact inner product.  A query ends when its kth nearest, verified here or in an
earlier block, lies within the radius; no radius goes beyond that distance, so that windows stay as small as the data
allow.  Neighbours in clusters take few entries.  Vectors in all directions alike lie at almost one distance, and no
windows tell them apart before they hold most entries.

Rows: vectors that are null, empty, zero, or hold a null or non-finite component, and rows of null id, take no part.
Of queries with the same id the smallest vector asks once; every other row is a candidate, repeated ones too, but not
rows of the query's own id.  Vectors of unequal length meet as if filled with zeros.  No rows give no rows.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import table
from factgraph.llm.vectors import best_of, one_query_each, search_in_blocks, usable

#: Arrays, at most; the share of the windows in which a candidate lies; half a window in radii.  A vector at the radius
#: lies in 0.73 of the windows, one at 1.25 radii in 0.62.
ARRAYS, COLLISIONS, REACH = 64, 0.69, 1.1
#: The share of the kth distance of PROBES vectors at which the windows open, and how they grow.
OPENING, GROWTH, PROBES = 0.8, 1.3, 64
#: Windows that hold more than this share of the entries are counted by ranks.
WIDE = 0.1


@lru_cache(maxsize=4)
def directions(d: int) -> np.ndarray:
    """d perpendicular directions in as many dimensions, at random, each as long as the root of d."""
    return np.linalg.qr(np.random.default_rng(8).standard_normal((d, d)))[0] * np.sqrt(d)


def search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, least: np.ndarray, *, k: int, told: list | None = None) -> tuple[list, list, list]:
    """least: what each query's kth score is at least.  told: takes how many entries were counted and vectors verified,
    and how many of each there were."""
    n, d = x.shape
    long2 = np.einsum("ij,ij->i", x, x)
    far = np.sqrt(long2.max())
    a = directions(d + 1)[:ARRAYS]
    m, enough = len(a), int(np.ceil(COLLISIONS * len(a)))
    own = (np.c_[x, np.sqrt(np.maximum(0, far * far - long2))] @ a.T).T
    order = np.argsort(own, axis=1, kind="stable")
    line = np.take_along_axis(own, order, axis=1)
    rank = np.empty(order.shape, np.uint16 if n < 1 << 16 else np.uint64)  # where each vector stands in each array
    np.put_along_axis(rank, order, np.arange(n, dtype=rank.dtype)[None], axis=1)
    norm = np.linalg.norm(q, axis=1)
    asked = np.c_[q * (far / norm)[:, None], np.zeros(len(q))] @ a.T

    def distance(score: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The distance of vectors of this inner product, once all are equally long."""
        return np.sqrt(np.maximum(0, 2 * far * far - 2 * far * score / norm[of]))

    # some vectors are verified at once; each query's best scores so far, and its kth, of these or of what it brings along
    score, hits = np.full((len(q), n), -np.inf), np.zeros((len(q), n), np.int64)
    at = np.unique(np.linspace(0, n - 1, min(n, PROBES)).astype(int))
    for j, v in enumerate(q):
        score[j, at] = np.where(ids[at] == qids[j], -np.inf, (x[at] * v).sum(axis=1))
    top = np.sort(np.c_[np.full((len(q), k), -np.inf), score[:, at]], axis=1)[:, -k:]
    kth = np.maximum(top[:, 0], least)
    unknown = ~np.isfinite(kth)
    kth[unknown] = -far * norm[unknown]  # none is farther than the opposite direction
    low, high = np.zeros((2, len(q), m), np.int64)
    open_ = np.arange(len(q))
    radius = np.where(np.isfinite(least), 1, OPENING) * distance(kth, open_)
    counted = 0
    while len(open_):
        reach = REACH * radius[open_] + 1e-9 * far  # equal vectors may differ in the last bits of a projection
        to_low, to_high = (np.stack([np.searchsorted(line[i], asked[open_, i] + s * reach, side) for i in range(m)], axis=1) for s, side in ((-1, "left"), (1, "right")))
        for j, a2, b2 in zip(open_.tolist(), to_low, to_high, strict=True):
            if (b2 - a2).sum() > WIDE * m * n:
                inside = (rank - a2[:, None].astype(rank.dtype)) < (b2 - a2)[:, None].astype(rank.dtype)  # below the window wraps around
                hits[j] = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
                counted += m * n
            else:
                fresh = np.concatenate([p for o, lo2, lo, hi, hi2 in zip(order, a2.tolist(), low[j].tolist(), high[j].tolist(), b2.tolist(), strict=True) for p in ((o[lo2:lo], o[hi:hi2]) if lo < hi else (o[lo2:hi2],))])
                hits[j] += np.bincount(fresh, minlength=n)
                counted += len(fresh)
            found = np.flatnonzero((hits[j] >= enough) & (score[j] == -np.inf) & (ids != qids[j]))
            score[j, found] = s = (x[found] * q[j]).sum(axis=1)  # in the same order in every row
            top[j] = np.partition(np.r_[top[j], s], len(s))[len(s) :]
        low[open_], high[open_] = to_low, to_high
        kth[open_] = np.maximum(kth[open_], top[open_].min(axis=1))
        nearest_ = distance(kth[open_], open_)
        open_, nearest_ = open_[more := radius[open_] < nearest_], nearest_[more]
        radius[open_] = np.minimum(radius[open_] * GROWTH, nearest_)
    for j in np.flatnonzero(unknown & ((score > -np.inf).sum(axis=1) < k)):  # fewer candidates than asked for: all of them
        rest = np.flatnonzero((score[j] == -np.inf) & (ids != qids[j]))
        score[j, rest] = (x[rest] * q[j]).sum(axis=1)
    if told is not None:
        told.append((counted, m * n * len(q), int((score > -np.inf).sum()), n * len(q)))
    out_q, out_v, out_s = [], [], []
    for j, qid in enumerate(qids.tolist()):
        some = np.flatnonzero(score[j] > -np.inf)
        some = some[best_of(ids[some], score[j, some], k)]
        out_q += [qid] * len(some)
        out_v += ids[some].tolist()
        out_s += score[j, some].tolist()
    return out_q, out_v, out_s


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found to each query.  vectors, queries: vec_id, embedding."""
    return search_in_blocks(vectors, queries, partial(search, k=k), k, "double")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda c: c != 0))
    return nearest(good, one_query_each(good, 20), 20)
