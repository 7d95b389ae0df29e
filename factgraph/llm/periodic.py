"""Operator 12: periodic runs of words, by uniting suffix classes in descending order of their common prefixes.

Suffixes of a text's words are sorted by prefix doubling, and the common prefixes of neighbours found by going back
through the doublings.  From the longest common prefix down, the classes on both sides are united, the smaller one's
ordered positions into the larger one's.  Two positions that become neighbours by that share a prefix of exactly the
current length; if they lie no further apart than that, all between them repeats, and they seed a run: their distance
is its smallest period (a smaller one would have put a position between them before), and the common prefix says where
it ends.  Seeds of a period and an end belong to one run, which starts at the first of them.  Of runs of at least `least`
words and `times` periods no seed has a common prefix under `least` - 1 and (`times` - 1) periods, so that shorter ones
are never united, and texts whose words never repeat for so long are not sorted at all.

Rows: null text has no words and no runs; its collapsed text is empty.  Texts of any length are worked on whole, one at
a time.  Repeated rows are answered alike.  Columns named runs or collapsed are replaced; others come back.  No rows
give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import by_batch, table, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has so many words and so many of its periods at least.
LEAST, TIMES = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Positions of a block of an ordered set are at most twice as many.
BLOCK = 512

Run = tuple[int, int, int]


class Positions:
    """An ordered set of positions in blocks, so that adding one to a large set moves few."""

    def __init__(self, first: list[int]) -> None:
        self.blocks, self.starts, self.n = [first], [first[0]], len(first)

    def around(self, x: int) -> tuple[int, int]:
        """The positions before and after x, -1 where there is none."""
        b = max(0, bisect_right(self.starts, x) - 1)
        block = self.blocks[b]
        i = bisect_left(block, x)
        low = block[i - 1] if i else -1
        high = block[i] if i < len(block) else self.starts[b + 1] if b + 1 < len(self.blocks) else -1
        return low, high

    def add(self, x: int) -> None:
        b = max(0, bisect_right(self.starts, x) - 1)
        block = self.blocks[b]
        insort(block, x)
        self.starts[b] = block[0]
        self.n += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
            self.starts[b : b + 1] = [block[0], block[BLOCK]]

    def __iter__(self):
        for block in self.blocks:
            yield from block


def sorted_suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes in order, and how many words each has in common with the one before it."""
    n = len(codes)
    ranks, k = [np.unique(codes, return_inverse=True)[1].astype(np.int32)], 1
    while True:
        now = ranks[-1].astype(np.int64)
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = now[k:] + 1
        key = now * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int32)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        k *= 2
        if new[order[-1]] == n - 1:
            break
        ranks.append(new)
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for power in range(len(ranks) - 1, -1, -1):
        # a rank of a level tells suffixes by 2 ** level words, and by their ends where fewer are left
        step, both = 1 << power, np.maximum(a, b) + (1 << power) <= n
        at = np.flatnonzero(both)
        same = at[ranks[power][a[at]] == ranks[power][b[at]]]
        a[same] += step
        b[same] += step
        common[same + 1] += step
    return order, common


def repeats(codes: np.ndarray, length: int) -> bool:
    """Whether some `length` words may occur twice."""
    n = len(codes) - length + 1
    if n < 2:
        return False
    mixed = np.zeros(n, np.uint64)
    for i in range(length):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64) + np.uint64(1)
    return len(np.unique(mixed)) < n


def runs_of(words: list[str], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of each run, by start, then period."""
    if len(words) < max(least, times):
        return []
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    fewest = max(1, least - least // times, times - 1)  # of words that the seed of a run has in common
    if not repeats(codes, fewest):
        return []
    order, common = sorted_suffixes(codes)
    edges = np.flatnonzero(common >= fewest)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent: dict[int, int] = {}
    members: dict[int, Positions] = {}
    found: dict[tuple[int, int], int] = {}  # (period, end): start

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def seed(i: int, j: int, shared: int) -> None:
        period = j - i
        if period + shared >= max(least, times * period):
            key = (period, j + shared)
            found[key] = min(i, found.get(key, i))

    for x, y, shared in zip(order[edges - 1].tolist(), order[edges].tolist(), common[edges].tolist(), strict=True):
        x, y = root(x), root(y)
        large, small = members.pop(x, None) or Positions([x]), members.pop(y, None) or Positions([y])
        if large.n < small.n:
            large, small, x, y = small, large, y, x
        parent[y] = x
        own = list(small)
        for k, p in enumerate(own):
            low, high = large.around(p)
            # neighbours in the union, one of each side
            if low >= 0 and (k == 0 or own[k - 1] < low):
                seed(low, p, shared)
            if high >= 0 and (k + 1 == len(own) or own[k + 1] > high):
                seed(p, high, shared)
        for p in own:
            large.add(p)
        members[x] = large
    return sorted((start, end - start, period) for (period, end), start in found.items())


def collapsed(words: list[str], runs: list[Run]) -> str:
    """The words without those that a run repeats after its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return " ".join([w for w, gone in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not gone])


def find(docs: DataFrame, *, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """`docs` with runs, an array of (start, length, period), and collapsed, the text without what runs repeat."""
    own = [c for c in docs.columns if c not in ("runs", "collapsed")]
    src = docs.select(*[F.col(f"`{c}`") for c in own])

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found, short = [], []
        for x in texts(b, text):
            words = WORD.findall(x)
            runs = runs_of(words, least, times)
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            short.append(collapsed(words, runs))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(found, RUNS_ARROW), pa.array(short, pa.string())], names=[*own, "runs", "collapsed"])

    return src.mapInArrow(by_batch(one), T.StructType([*src.schema.fields, *T._parse_datatype_string(f"runs {RUNS}, collapsed string").fields]))


def looped(words: list[str], doc_id: int | None) -> list[str]:
    """The words of a document, whose tail some documents repeat: of every tenth by a hash of its id, where it begins and
    how long its period is follow from the hash."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and the text of documents as the query takes them, by looped()."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column(0).to_pylist()
        made = [x if i is None or crc32(str(i).encode()) % 10 else " ".join(looped(WORD.findall(x), i)) for i, x in zip(ids, texts(b), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(by_batch(one), docs.select("doc_id", "text").schema)


def summed_up(found: DataFrame) -> DataFrame:
    """doc_id with the number of runs, the one of greatest exponent and the digests of all runs and of the rest."""
    # exponents are compared exactly, as products; of equal ones the first start, then the smallest period stays
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a),
    )
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed_up(find(with_loops(table(spark, sf_dir, "documents"))))
