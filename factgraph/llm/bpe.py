"""Operator 1: byte-level BPE encoding and decoding by a pair occurrence index.

The distinct new words of an Arrow batch form one array of symbols.  An index maps each pair of neighbouring symbols
to all its positions; the active rank that is lowest is applied at each of them, which updates the lists of the pairs
beside it, until no ranked pair is left.  Encoded words stay in a bounded cache of the worker.

Rows: null or empty text gives no ids and an empty decoded text.  Repeated rows give repeated rows; other columns, of
any name, are not touched, as only `key` columns and the text are read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import by_batch, table, texts

#: How the byte-level vocabulary cuts a text into words (a fixed value of that vocabulary).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Runs without white space and the one space before each: no word of WORD crosses their ends.
RUN = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: White space to Python, not to the vocabulary's pattern.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Runs, and words, that a worker keeps as recent ones.
CACHE = 400_000


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class PairIndex:
    """Applies BPE merges to many words at once.  merges: rank -> (left id, right id, made id)."""

    def __init__(self, merges: list[tuple[int, int, int]], n_ids: int):
        self.n = n_ids
        self.made = merges
        self.rank: dict[int, int] = {}
        for r, (a, b, _) in enumerate(merges):
            self.rank.setdefault(a * n_ids + b, r)

    def encode(self, words: list[list[int]]) -> list[list[int]]:
        n, rank_of, made = self.n, self.rank.get, self.made
        if not words:
            return []
        sym = [x for w in words for x in w]
        ends = list(accumulate(map(len, words)))
        starts = [0, *ends[:-1]]
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        for a, b in zip(starts, ends, strict=True):
            if a < b:
                prv[a] = nxt[b - 1] = -1
        places: dict[int, list[int]] = defaultdict(list)  # rank of a pair -> where its left part stands
        for i, (x, y) in enumerate(pairwise(sym)):
            if (r := rank_of(x * n + y)) is not None and nxt[i] >= 0:
                places[r].append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = made[r]
            for i in sorted(places.pop(r)):
                j = nxt[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = new, -1
                nxt[i] = after = nxt[j]
                if after >= 0:
                    prv[after] = i
                    if (q := rank_of(new * n + sym[after])) is not None:
                        if q not in places:
                            heapq.heappush(active, q)
                        places[q].append(i)
                if (before := prv[i]) >= 0 and (q := rank_of(sym[before] * n + new)) is not None:
                    if q not in places:
                        heapq.heappush(active, q)
                    places[q].append(before)
        return [[x for x in sym[a:b] if x >= 0] for a, b in zip(starts, ends, strict=True)]


class Recent(dict):
    """What was put in or asked for last: at most `most` entries, whose values have WEIGHT bytes on average,, and as many older ones that
    come back when asked for."""

    WEIGHT = 64

    def __init__(self, most: int):
        super().__init__()
        self.most, self.weight, self.old = most, 0, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        self.weight += len(value)
        return value

    def put(self, keys: list, values: list) -> None:
        self.update(zip(keys, values, strict=True))
        self.weight += sum(map(len, values))

    def lacking(self, keys: set) -> set:
        return {k for k in keys - self.keys() if k not in self.old}

    def turn(self) -> None:
        if len(self) > self.most or self.weight > self.most * self.WEIGHT:
            self.old = dict(self)
            self.clear()
            self.weight = 0


class ByteBpe:
    """A byte-level vocabulary file in the format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab = j["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        n = 1 + max([*vocab.values(), *self.special.values()])
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.index = PairIndex([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], n)
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        byte_of = {c: i for i, c in enumerate(letters)}
        self.bytes_of = [b""] * n
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.cache: Recent = Recent(CACHE)  # run -> packed ids
        self.words: Recent = Recent(CACHE)

    def runs(self, text: str) -> list[str]:
        return WORD.findall(text) if ODD_SPACE.search(text) else RUN.findall(text)

    def learn(self, runs: set[str]) -> None:
        """Puts the ids of runs that the cache lacks into it."""
        self.cache.turn()
        self.words.turn()
        words_of = {run: WORD.findall(run) for run in self.cache.lacking(runs)}
        new = list(self.words.lacking({w for ws in words_of.values() for w in ws}))
        first = self.first.__getitem__
        ids = self.index.encode([list(map(first, w.encode())) for w in new])
        packed = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = list(accumulate(4 * len(x) for x in ids))
        self.words.put(new, [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        of = self.words.__getitem__
        self.cache.put(list(words_of), [of(ws[0]) if len(ws) == 1 else b"".join(map(of, ws)) for ws in words_of.values()])

    def encode(self, many: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut, runs = [], set()
        for text in many:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            parts[::2] = map(self.runs, parts[::2])
            for part in parts[::2]:
                runs.update(part)
            cut.append(parts)
        self.learn(runs)
        of = self.cache.__getitem__
        return [b"".join([self.special[x].to_bytes(4, "little") if k % 2 else b"".join(map(of, x)) for k, x in enumerate(parts)]) for parts in cut]

    def decode(self, many: list[bytes]) -> list[str]:
        of = self.bytes_of.__getitem__
        return [b"".join(map(of, memoryview(x).cast("I"))).decode("utf-8", "replace") for x in many]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def _run(df: DataFrame, keys: list[str], column: str, add: dict[str, T.DataType], fn) -> DataFrame:
    src = df.select(*keys, column)
    schema = T.StructType([*(src.schema[k] for k in keys), *(T.StructField(k, t) for k, t in add.items())])
    kinds = {T.BinaryType(): pa.binary(), T.StringType(): pa.string()}

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(b)
        return pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *(pa.array(x, kinds[t]) for x, t in zip(made, add.values(), strict=True))], names=[*keys, *add])

    return src.mapInArrow(by_batch(one), schema)


def encode(df: DataFrame, path: str, *, keys: list[str], text: str = "text") -> DataFrame:
    """keys and `ids`: the token ids of the whole text as packed little-endian unsigned 32-bit integers."""
    return _run(df, keys, text, {"ids": T.BinaryType()}, lambda b: [vocabulary(path).encode(texts(b, text))])


def decode(df: DataFrame, path: str, *, keys: list[str], ids: str = "ids") -> DataFrame:
    """keys and `decoded`: the text of packed ids."""
    return _run(df, keys, ids, {"decoded": T.StringType()}, lambda b: [vocabulary(path).decode([x or b"" for x in b.column(len(keys)).to_pylist()])])


def round_trip(df: DataFrame, path: str, *, keys: list[str], text: str = "text") -> DataFrame:
    """encode() and decode() of the ids so found, in one pass over the texts: keys, `ids`, `decoded`."""

    def fn(b: pa.RecordBatch):
        v = vocabulary(path)
        ids = v.encode(texts(b, text))
        return [ids, v.decode(ids)]

    return _run(df, keys, text, {"ids": T.BinaryType(), "decoded": T.StringType()}, fn)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keys=["doc_id"])
    return done.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
