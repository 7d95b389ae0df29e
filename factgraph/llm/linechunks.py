"""Operator 7: removal of multi-line passages that repeat anywhere in the corpus, by content-defined line chunks.

A hash rolls over the hashes of WINDOW lines; where its low BITS bits are zero, a long chunk ends.  Boundaries hang on the
lines around them alone, so that a passage is cut alike wherever it stands, whatever was put before it.  Long chunks that
repeat go as wholes.  What they leave of a passage, at its ends or where it is too short to hold two boundaries, is found by
short chunks, for which each window is a boundary: each line that is not blank makes one with the next such line and the
blank lines between.  Short chunks within a long one that goes are not looked at; an earlier copy has them all.

Of equal chunks the one with the smallest (doc_id, text hash, place) stays; the lines of the others go once their bytes are
found equal to the bytes of that one.  A line that goes has a copy at an earlier place, so that one copy of each line stays,
and what goes are all repeated passages of two lines or more.  What goes through shuffles besides hashes are the texts,
once, and the kept one of each repeated chunk.

Rows: null text stays null; texts of one line, and blank lines outside of chunks, stay as they are.  Rows without id
stay as they are.  Repeated rows (same doc_id and text) count as one document and stay alike.  Other columns, of any
name, come back as they were.  No rows give no rows.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import by_batch, stored, table, texts

#: Lines that the rolling hash covers, and how many of its bits are zero at a boundary: a long chunk has 2 ** BITS lines on average.
WINDOW, BITS = 2, 3
BASE, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1

Chunk = tuple[int, int]  # first line, line after the last


def full_lines(lines: list[str]) -> list[int]:
    """The places of the lines that are not blank; the others count with these."""
    return [i for i, x in enumerate(lines) if x.strip()]


def chunks(text: str) -> list[Chunk]:
    """The short chunks; none for a single line."""
    full = full_lines(text.split("\n"))
    return [(x, y + 1) for x, y in zip(full, full[1:])]


def boundaries(hashes: list[int]) -> list[int]:
    """How many lines, of which these are the hashes, stand before each boundary."""
    out, rolling, drop = [], 0, pow(BASE, WINDOW, 1 << 64)
    for i, h in enumerate(hashes):
        rolling = (rolling * BASE + h) & ALL
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * drop) & ALL
        # the high bits of a product are better mixed than its low ones
        if i >= WINDOW - 1 and not ((rolling ^ (rolling >> 29)) * BASE & ALL) >> (64 - BITS):
            out.append(i + 1)
    return out


def long_chunks(lines: list[str], full: list[int]) -> list[tuple[int, int]]:
    """(first, after the last) of each long chunk, as places in `full`, several lines each."""
    ends = [0, *boundaries([xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass")) for i in full]), len(full)]
    return [(x, y) for x, y in zip(ends, ends[1:]) if y - x > 1]


PLACE = ["id_key", "text_key", "first", "last"]


def _occurrences(docs: DataFrame) -> DataFrame:
    """id_key, text_key, first, last, within, h: the chunks of each document; within: the first line of the long chunk that
    a short one lies in, -1 if in none, null for long ones."""
    src = docs.where("doc_id IS NOT NULL").select("id_key", "text_key", "text")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        row, first, last, within, h = [], [], [], [], []

        def add(k: int, lines: list[str], x: int, y: int, up: int | None) -> None:
            row.append(k)
            first.append(x)
            last.append(y)
            within.append(up)
            h.append(xxhash.xxh3_128_digest("\n".join(lines[x:y]).encode("utf-8", "surrogatepass")))

        for k, text in enumerate(texts(b)):
            lines = text.split("\n") if "\n" in text else ()
            full = full_lines(lines)
            if len(full) < 2:
                continue
            up = [-1] * len(full)  # of the chunk of each line and the next
            for x, y in long_chunks(lines, full):
                add(k, lines, full[x], full[y - 1] + 1, None)
                up[x : y - 1] = [full[x]] * (y - 1 - x)
            for i in range(len(full) - 1):
                add(k, lines, full[i], full[i + 1] + 1, up[i])
        row = pa.array(row, pa.int64())
        made = [pa.array(x, pa.int32()) for x in (first, last, within)]
        return pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), *made, pa.array(h, pa.binary())], names=[*PLACE, "within", "h"])

    return src.mapInArrow(by_batch(one), T.StructType([src.schema["id_key"], *T._parse_datatype_string("text_key bigint, first int, last int, within int, h binary").fields]))


def _bodies(b: pa.RecordBatch) -> pa.RecordBatch:
    """From text and the chunks asked for with their hashes: the hash and text of each."""
    h, body = [], []
    for text, asked in zip(texts(b), b.column(b.schema.get_field_index("asked")).to_pylist(), strict=True):
        lines = text.split("\n")
        for x in asked:
            h.append(x["h"])
            body.append("\n".join(lines[x["first"] : x["last"]]))
    return pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(body, pa.string())], names=["h", "body"])


def _without(b: pa.RecordBatch) -> pa.RecordBatch:
    """Text, n_lines and n_removed once the chunks whose bytes equal the kept one's are gone."""
    made, n_lines, n_removed = [], [], []
    raw = b.column(b.schema.get_field_index("text")).to_pylist()
    for text, repeats in zip(raw, b.column(b.schema.get_field_index("repeats")).to_pylist(), strict=True):
        lines = (text or "").split("\n")
        gone: set[int] = set()
        for x in repeats or ():
            if "\n".join(lines[x["first"] : x["last"]]) == x["body"]:
                gone.update(range(x["first"], x["last"]))
        made.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text)
        n_lines.append(len(lines) if text else 0)
        n_removed.append(len(gone))
    rest = [i for i, f in enumerate(b.schema) if f.name not in ("text", "repeats")]
    return pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(made, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=[*(b.schema.field(i).name for i in rest), "text", "n_lines", "n_removed"])


def _kept(chunks_: DataFrame) -> DataFrame:
    """h and the place of the one that stays of each repeated chunk."""
    return stored(chunks_.groupBy("h").agg(F.min(F.struct(*PLACE)).alias("k"), F.count("*").alias("n")).where("n > 1").select("h", "k"), "kept-chunks")


def _copies(chunks_: DataFrame, kept: DataFrame) -> DataFrame:
    """The repeated chunks that do not stay; a hash that many have can be split, as both sides come from tables."""
    return chunks_.join(kept, "h").where(F.struct(*PLACE) != F.col("k")).select(*PLACE, "h")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of `docs`, whose text has lost its repeated chunks, with n_lines and n_removed: how many it had and lost."""
    docs = docs.drop("n_lines", "n_removed")
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    # other columns travel in one struct, so that their names clash with none of ours; rows without id meet no key
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("id_key"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("text_key"),
        "doc_id",
        "text",
        F.struct(*[F.col(f"`{c}`") for c in own], F.lit(0).alias("_")).alias("own"),
    )
    key = ["id_key", "text_key"]
    at = stored(_occurrences(keyed), "chunks")
    long = at.where("within IS NULL").drop("within")
    kept_long = _kept(long)
    gone_long = stored(_copies(long, kept_long), "long-copies")
    covered = gone_long.select(*key, F.col("first").alias("within")).distinct()
    short = at.where("within IS NOT NULL").join(covered, [*key, "within"], "left_anti").drop("within")
    kept_short = _kept(short)
    asked = kept_long.union(kept_short).select("h", "k.*").groupBy(*key).agg(F.collect_list(F.struct("first", "last", "h")).alias("asked"))
    # both joins below take the same columns of `keyed`, so that the texts are shuffled once
    bodies = stored(keyed.join(asked.hint("merge"), key).drop(*key).mapInArrow(by_batch(_bodies), "h binary, body string").dropDuplicates(["h"]), "bodies")
    others = gone_long.union(_copies(short, kept_short)).distinct()
    repeats = others.join(bodies.hint("merge"), "h").groupBy(*key).agg(F.collect_list(F.struct("first", "last", "body")).alias("repeats"))
    joined = keyed.join(repeats.hint("merge"), key, "left").select("doc_id", "text", "repeats", "own")
    schema = T.StructType([joined.schema["doc_id"], joined.schema["own"], joined.schema["text"], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = joined.mapInArrow(by_batch(_without), schema)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"own.`{c}`").alias(c) for c in docs.columns], F.col("n_lines").alias("n_lines"), F.col("n_removed").alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


#: All that repeated passages hold: pairs of lines that are not blank, and what any but the first of equal ones takes away.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, lines, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM t)),
c AS (SELECT doc_id, lines, i AS a, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l WHERE regexp_matches(line, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]')),
r AS (SELECT doc_id, a, b FROM (SELECT doc_id, a, b, row_number() OVER (PARTITION BY array_to_string(lines[a : b], chr(10)) ORDER BY doc_id, a) AS turn FROM c WHERE b IS NOT NULL) WHERE turn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM r),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(o.n, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN lost o USING (doc_id)
"""
