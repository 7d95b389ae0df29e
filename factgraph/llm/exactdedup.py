"""Operator 11: exact deduplication by Grace hashing.

Each document is a record: a digest, its whole content, how many documents it stands for and the largest of their ids.
A task folds the records of its slice of the input in an open-addressing table and writes those that differ to spill
files in the shared folder, so that a text with copies in a third of all rows leaves one record a table.  Records are
then dealt into buckets by a hash of the digest; a bucket that fits a table of `limit` bytes is settled by one task.
A larger bucket is dealt into pieces that fit, each piece is folded once more (which shrinks copies of one text), its
records are written to new spill files and dealt by another hash (which splits different texts), and so on.  Texts count
as equal only once their whole contents have been compared, whatever their digests.

Rows: null text counts as empty, other texts are taken as they are (a text with blanks differs from one without).  Rows
without id count in group_size and stay if no row of their group has an id; then keep_id is null.  Repeated rows (same
id and text) are answered alike.  Other columns, of any name, are left out by `classes` and come back as they were from
`one_of_each`.  No rows give no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import kept_beyond, shelf, slices, stored, table

#: Bytes of text, and records, that one table holds.
LIMIT, HELD = 64 << 20, 200_000
#: After so many rounds a bucket holds little but texts that each fill a table, and is settled as it is.
ROUNDS = 8


class Records:
    """An open-addressing table with linear probing: a digest says where to look, the whole content what is equal."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 64
        self.digests: list[bytes] = []
        self.bodies: list[bytes] = []

    def place(self, digest: bytes, body: bytes) -> int:
        """The number of the record with this content, which is a new one if there was none."""
        at = self._free(digest, body)
        if self.slots[at] < 0:
            self.slots[at] = len(self.bodies)
            self.digests.append(digest)
            self.bodies.append(body)
            if 3 * len(self.bodies) > 2 * len(self.slots):
                self._grow()
            return len(self.bodies) - 1
        return self.slots[at]

    def _free(self, digest: bytes, body: bytes | None) -> int:
        """The slot of the record with this content, else the empty one that it would have."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (k := self.slots[at]) >= 0 and not (body is not None and self.digests[k] == digest and self.bodies[k] == body):
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (4 * len(self.slots))
        for k, digest in enumerate(self.digests):
            self.slots[self._free(digest, None)] = k


class Groups:
    """A table with what it sums up for each of its records."""

    def __init__(self) -> None:
        self.table = Records()
        self.first, self.n, self.top = [], [], []
        self.members: list[tuple] = []  # (rep, id, record)
        self.size = 0

    def add(self, rep: int, own: object, digest: bytes, body: bytes, n: int, top: object) -> None:
        k = self.table.place(digest, body)
        if k == len(self.first):
            self.first.append(rep)
            self.n.append(n)
            self.top.append(top)
            self.size += len(body)
        else:
            self.n[k] += n
            if self.top[k] is None or (top is not None and top > self.top[k]):
                self.top[k] = top
        self.members.append((rep, own, k))

    def full(self, limit: int, held: int) -> bool:
        return self.size > limit or len(self.members) >= held

    def spilled(self, types: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each member; digest, body, n and top at the first of each record only."""
        for at in range(0, len(self.members), 1000):
            rows = self.members[at : at + 1000]
            first = [k if self.first[k] == rep else None for rep, _, k in rows]
            made = [
                [rep for rep, *_ in rows],
                [self.first[k] for *_, k in rows],
                [own for _, own, _ in rows],
                [None if k is None else self.table.digests[k] for k in first],
                [None if k is None else self.table.bodies[k] for k in first],
                [None if k is None else self.n[k] for k in first],
                [None if k is None else self.top[k] for k in first],
            ]
            yield from slices(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, types, strict=True)], schema=types))

    def settled(self, types: pa.Schema) -> Iterator[pa.RecordBatch]:
        """rep, digest, group_size and keep_id of each member."""
        for at in range(0, len(self.members), 10_000):
            rows = self.members[at : at + 10_000]
            made = [[rep for rep, *_ in rows], [self.table.digests[k] for *_, k in rows], [self.n[k] for *_, k in rows], [self.top[k] for *_, k in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, types, strict=True)], schema=types)


def _arrow(types: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(types)


def _fold(records: DataFrame, limit: int, held: int) -> DataFrame:
    """rep, to, own, digest, body, n, top: the records of each task that are equal have one `to`, the rep of their first;
    the first alone goes on with its content.  Given (own, body), records are made of rows first."""
    raw = "rep" not in records.columns
    own, top = records.schema["own"].dataType, records.schema["own" if raw else "top"].dataType
    types = T.StructType().add("rep", "long").add("to", "long").add("own", own).add("digest", "binary").add("body", "binary").add("n", "long").add("top", top)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, groups = _arrow(types), Groups()
        no = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in (("own", "body") if raw else ("rep", "own", "digest", "body", "n", "top"))]
                for row in zip(*columns, strict=True):
                    if raw:
                        groups.add(no, row[0], sha256(row[1]).digest(), row[1], 1, row[0])
                        no += 1
                    else:
                        groups.add(*row)
                if groups.full(limit, held):
                    yield from groups.spilled(schema)
                    groups = Groups()
        yield from groups.spilled(schema)
        pa.default_memory_pool().release_unused()

    return records.mapInArrow(run, types)


def _settle(records: DataFrame) -> DataFrame:
    """rep, digest, group_size, keep_id of records, all equal ones of which are in one partition."""
    types = T.StructType().add("rep", "long").add("digest", "binary").add("group_size", "long").add("keep_id", records.schema["top"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()
        for batch in batches:
            for part in slices(batch):
                for rep, digest, body, n, top in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("rep", "digest", "body", "n", "top")), strict=True):
                    groups.add(rep, None, digest, body, n, top)
        yield from groups.settled(_arrow(types))
        pa.default_memory_pool().release_unused()

    return records.mapInArrow(run, types)


def classes(docs: DataFrame, *, text: str | Column = "text", doc_id: str = "doc_id", limit: int = LIMIT, held: int = HELD) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row, stored; `text` may be a column that normalises it."""
    spark = docs.sparkSession
    body = F.col(text) if isinstance(text, str) else text
    with shelf(spark):
        spilled = stored(_fold(docs.select(F.col(doc_id).alias("own"), F.coalesce(body, F.lit("")).cast("binary").alias("body")), limit, held), "records", "zstd")
        now, settled, folds = spilled, [], []
        for level in range(ROUNDS + 1):
            now = now.where("rep = `to`").withColumn("size", F.length("body").cast("long"))
            total = now.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // limit))
            dealt = now.withColumn("bucket", F.pmod(F.xxhash64("digest", F.lit(level)), F.lit(parts)))
            sizes = dealt.groupBy("bucket").agg(F.sum("size").alias("in_bucket"), F.count("*").alias("m")).where((F.col("in_bucket") > limit) & (F.col("m") > 1))
            wide = stored(sizes.select("bucket", F.ceil(F.col("in_bucket") / limit).alias("pieces")), "wide-buckets")
            pieces = wide.agg(F.sum("pieces")).first()[0] if level < ROUNDS else None
            settled.append(_settle((dealt.join(wide, "bucket", "left_anti") if pieces else dealt).repartition(parts, "bucket")))
            if not pieces:
                break
            mine = dealt.join(wide, "bucket").withColumn("piece", F.pmod(F.xxhash64("rep", F.lit(level)), F.col("pieces")))
            now = stored(_fold(mine.repartition(int(pieces), "bucket", "piece").select("rep", "own", "digest", "body", "n", "top"), limit, held), "records", "zstd")
            folds.append(now.where("rep <> `to`").select("rep", "to"))
        known = settled[-1]
        for found, fold in zip(reversed(settled[:-1]), reversed(folds), strict=True):
            # a record that was folded away is answered as the one that it was folded into
            away = fold.join(known.withColumnRenamed("rep", "to"), "to").select("rep", "digest", "group_size", "keep_id")
            known = reduce(DataFrame.unionByName, [known, away, found])
        members = spilled.select("to", "own").join(known.withColumnRenamed("rep", "to"), "to")
        out = members.select(F.col("own").alias("doc_id"), "keep_id", "group_size", F.col("own").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
        return kept_beyond(stored(out, "classes"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The rows of `docs` that stay, in all their columns; rows that are equal in id and text stay or go together."""
    stay = classes(docs, doc_id=doc_id, text=text, limit=limit).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    return docs.join(stay, F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256) == F.col("_sha")), "left_semi")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
  FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents))
"""
