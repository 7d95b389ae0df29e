"""Operator 3: language identification by bit-sliced Bloom filters of n-grams.

One Bloom filter holds the n-grams of all languages: a row has one bit for each language, so that the rows of an
n-gram's places, and-ed, give the bitmask of every language that contains it.  A text's n-grams are counted by
language; each count is corrected for the filter's false positives, and the largest one decides.

A language contains an n-gram that at least MIN_SHARE of its documents have, and at least MIN_RATIO as large a share
as any other language's documents.  Shares come from a sample of at most about SAMPLE different labelled texts a
language, chosen by a hash of the text; copies count once.  This bounds the filter, which is sent to all tasks.

Rows: `und` with score 0 for null text, text without a letter, or where nothing could be learned.  A text with letters
of which no n-gram is known gets the most frequent language with score 0.  Ties go to the language first in order.
Rows of null doc_id are not learned from and not held out.  Other columns are not read.  No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import by_batch, table, texts
from factgraph.llm.minhash import mix

#: Lengths of the n-grams, in letters; the gap between words counts as one.
SIZES = (2, 3, 4)
SAMPLE = 3000
MIN_SHARE = 0.004
MIN_RATIO = 0.2
#: Places of an n-gram, and rows of the filter for each n-gram that it holds.
PLACES, ROWS_EACH = 3, 8
#: A text is rejected if so small a share of its n-grams is known to its best language.
REJECT = 0.2


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str) -> np.ndarray:
    """The hashes of the n-grams of the letters of a text, as often as they occur; empty without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, c, 32)[keep]
    c = np.r_[32 if c[0] != 32 else c[:0], c, 32 if c[-1] != 32 else c[:0]].astype(np.uint64)
    out = []
    for n in SIZES:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x1F0001) + c[k : k + len(h)]  # one-to-one: 21 bits a letter, of up to three
            out.append(mix(h))
    return np.concatenate(out)


@dataclass
class Filters:
    """slices: for each eight languages a byte for each row of the filter; false: the false positives of each language."""

    langs: list[str]
    slices: list[np.ndarray]
    false: np.ndarray
    usual: int

    def known(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains, as the filter says."""
        rows = len(self.slices[0]) - 1
        step = (grams >> np.uint64(32)) | np.uint64(1)
        place = [((grams + np.uint64(k) * step) & np.uint64(rows)).astype(np.int64) for k in range(PLACES)]
        counts = []
        for s in self.slices:
            mask = s[place[0]]
            for p in place[1:]:
                mask = mask & s[p]
            times = np.bincount(mask, minlength=256)
            counts += [int(times[(np.arange(256) >> k) & 1 == 1].sum()) for k in range(8)]
        return np.array(counts[: len(self.langs)], np.float64)

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, its share of the corrected counts, and the share of the n-grams that it knows."""
        grams = ngrams(text) if self.langs else ()
        if not len(grams):
            return "und", 0.0, 0.0
        n = len(grams)
        right = np.clip((self.known(grams) - n * self.false) / (1 - self.false), 0, n)
        best = int(right.argmax())
        if not right[best]:
            return self.langs[self.usual], 0.0, 0.0
        return self.langs[best], float(right[best] / right.sum()), float(right[best] / n)


def build(known: dict[str, np.ndarray], counts: dict[str, int]) -> Filters:
    """From the n-grams of each language and how many documents it has."""
    langs = sorted(counts)
    if not langs:
        return Filters([], [], np.empty(0), 0)
    grams = len(np.unique(np.concatenate([known[x] for x in langs])))
    rows = 1 << max(10, (ROWS_EACH * grams).bit_length())
    slices = [np.zeros(rows, np.uint8) for _ in range(-(-len(langs) // 8))]
    for i, x in enumerate(langs):
        g = known[x]
        step = (g >> np.uint64(32)) | np.uint64(1)
        for k in range(PLACES):
            np.bitwise_or.at(slices[i // 8], ((g + np.uint64(k) * step) & np.uint64(rows - 1)).astype(np.int64), np.uint8(1 << i % 8))
    filled = np.array([((slices[i // 8] >> i % 8) & 1).mean() for i in range(len(langs))])
    return Filters(langs, slices, np.minimum(filled**PLACES, 0.99), max(range(len(langs)), key=lambda i: (counts[langs[i]], -i)))


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters of every non-null value of `lang`."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(3)))
    found = rows.groupBy("lang", "h").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("own")).collect()
    counts = {x["lang"]: x["n"] for x in found}
    if not counts:
        return build({}, {})
    # copies of a text count once, both for the share that is drawn and in what is drawn
    part = F.create_map(*[F.lit(y) for x in found for y in (x["lang"], min(1.0, sample / x["own"]))])
    chosen = rows.where(F.pmod("h", F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000).dropDuplicates(["lang", "h"]).select("text", "lang")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        lang_of = b.column(1).to_pylist()
        names, grams, times = [], [], []
        for x in sorted(set(lang_of)):
            own = [t for t, y in zip(texts(b), lang_of, strict=True) if x == y]
            for at in range(0, len(own), 50):
                g, n = np.unique(np.concatenate([np.unique(ngrams(t)) for t in own[at : at + 50]]), return_counts=True)
                names += [x] * (len(g) + 1)
                grams.append(np.r_[g.astype(np.int64), 0])  # gram 0: the documents
                times.append(np.r_[n, len(own[at : at + 50])])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(grams), pa.int64()), pa.array(np.concatenate(times), pa.int64())], names=["lang", "gram", "n"])

    seen = chosen.mapInArrow(by_batch(one), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = seen.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("of"))  # a row for each language at most
    drawn = {x["lang"]: x["n"] for x in seen.where("gram = 0").collect()}
    share = F.create_map(*[F.lit(y) for x in counts for y in (x, 1.0 / max(1, drawn.get(x, 1)))])
    shares = F.transform("of", lambda x: F.struct(x["lang"].alias("lang"), (x["n"] * share[x["lang"]]).alias("share")))
    kept = by_gram.where("gram <> 0").select("gram", F.explode(shares).alias("x"), F.array_max(F.transform(shares, lambda x: x["share"])).alias("most"))
    kept = kept.where((F.col("x.share") >= MIN_SHARE) & (F.col("x.share") >= MIN_RATIO * F.col("most"))).select("x.lang", "gram").toPandas()
    return build({x: kept.loc[kept["lang"] == x, "gram"].to_numpy(np.int64).astype(np.uint64) for x in counts}, counts)


def identify(docs: DataFrame, model: Filters, *, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and share_known, columns of these names replaced."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "share_known")]
    src = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index(text)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.predict(x or "") for x in b.column(at).to_pylist()]
        made = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays([*b.columns, *made], names=[*own, "lang_pred", "score", "share_known"])

    return src.mapInArrow(by_batch(one), T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("share_known", T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(learnable(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "share_known")
