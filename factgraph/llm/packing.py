"""Operator 6: packing documents into sequences of a fixed length by best-two-fit.

Each document's ids end with an end id; only longer ones are cut, into pieces of the full length and a last shorter
one.  Full pieces are sequences of their own at once.  The others are dealt in turn over groups of about GROUP pieces,
each packed by one task: a sequence is filled greedily with the longest piece that fits; then its shortest piece is
exchanged for the two unpacked pieces that fill the widened gap most tightly, if they fill it better.  A group of that
size leaves at most one sequence badly filled, so that the groups cost a part of a thousandth.

Rows: null or empty text is the end id alone.  Repeated rows are pieces of their own.  Ties go to the smaller document
id, then piece, then start; null ids come last.  No rows give no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.bpe import ODD_SPACE, Recent, byte_letters
from factgraph.llm.common import by_batch, table, texts

CAPACITY = 4096
END = 1
#: Pieces that one task packs together, about.
GROUP = 20_000
#: Runs without white space that a worker keeps as recent ones.
CACHE = 500_000


class Merges:
    """BPE of many words at once: each round applies in every word its lowest rank, until no word has a ranked pair."""

    def __init__(self, merges: list[tuple[int, int, int]], n_ids: int):
        key = np.array([a * n_ids + b for a, b, _ in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.n, self.key, self.rank = n_ids, key[order], order
        self.made = np.array([m[2] for m in merges], np.int64)

    def ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that start at these places, none that any merge has where there is no such pair."""
        none = len(self.key)
        after = np.minimum(at + 1, len(sym) - 1)
        pair = sym[at] * self.n + sym[after]
        found = np.minimum(np.searchsorted(self.key, pair), none - 1)
        return np.where((self.key[found] == pair) & (word[after] == word[at]) & (after > at), self.rank[found], none)

    def encode(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the number of the word of each, from the first symbols and their words, in order."""
        none, done = len(self.key), []
        rank = self.ranks(sym, word, np.arange(len(sym)))
        while len(sym) > 1:
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            over = low == none
            done.append((sym[over], word[over]))
            i = np.flatnonzero((rank == low) & ~over)
            if not len(i):
                return self._ordered(done)
            first = np.maximum.accumulate(np.where(np.r_[True, np.diff(i) != 1], i, 0))
            i = i[(i - first) % 2 == 0]  # of pairs that overlap, as in aaa, every other one from the left
            sym[i] = self.made[rank[i]]
            keep, changed = ~over, np.zeros(len(sym), bool)
            keep[i + 1] = False
            # a pair is new where its left part is, and where the next symbol that is kept is new
            changed[i] = changed[np.maximum(i - 1, 0)] = True
            changed[np.maximum(i - 2, 0)] |= ~keep[np.maximum(i - 1, 0)]
            sym, word, rank, changed = sym[keep], word[keep], rank[keep], changed[keep]
            at = np.flatnonzero(changed)
            if len(at):
                rank[at] = self.ranks(sym, word, at)
        return self._ordered([*done, (sym, word)])

    @staticmethod
    def _ordered(parts: list) -> tuple[np.ndarray, np.ndarray]:
        sym, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]


class WordIds:
    """Ids of a vocabulary file with word ends, as the tokenizers library gives them.

    What lies between white space is looked up once: the library's own normalizer and the file's pattern cut it into
    words, by the library's own tables where it is not ASCII.  Texts with its special tokens, or with control characters on which Python and the library differ, go to
    the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab, end = j["model"]["vocab"], j["model"]["end_of_word_suffix"]
        cut = j["pre_tokenizer"]["pretokenizers"][0]
        self.word = regex.compile(cut["pattern"]["Regex"])
        self.cut = Split(Regex(cut["pattern"]["Regex"]), re.sub("(?<!^)(?=[A-Z])", "_", cut["behavior"]).lower(), cut["invert"])
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], max(vocab.values()) + 1)
        self.first = np.array([vocab[c] for c in byte_letters()])
        self.last = np.array([vocab[c + end] for c in byte_letters()])
        self.cache: Recent = Recent(CACHE)
        # marks that the pattern cuts off from letters before them
        self.marks = {c for c in ",.;:!?" if self.word.findall(f"ab{c}") == ["ab", c]}

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, run: str) -> list[str]:
        if run.isascii():
            if run.isalpha():
                return [run.lower()]
            if run[-1] in self.marks and run[:-1].isalpha():
                return [run[:-1].lower(), run[-1]]
            return self.word.findall(run.lower())
        # what is a letter or a number beyond ASCII, the library says itself
        return [w for w, _ in self.cut.pre_tokenize_str(self.lib.normalizer.normalize_str(run))]

    def learn(self, runs: set[str]) -> None:
        self.cache.turn()
        new = list(self.cache.lacking(runs))
        words_of = [[w.encode() for w in self.words(r)] for r in new]
        flat = [w for ws in words_of for w in ws]
        size = np.array([len(w) for w in flat], np.int64)
        byte = np.frombuffer(b"".join(flat), np.uint8)
        sym, end = self.first[byte], np.cumsum(size)
        sym[end - 1] = self.last[byte[end - 1]]
        ids, word = self.merges.encode(sym, np.repeat(np.arange(len(flat)), size)) if len(flat) else (sym, sym)
        ends = np.searchsorted(word, np.cumsum([0, *map(len, words_of)])) * 4
        packed, ends = ids.astype("<u4").tobytes(), ends.tolist()
        self.cache.put(new, [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)])

    def encode(self, many: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [None if "<|" in text or ODD_SPACE.search(text) else text.split() for text in many]
        runs: set[str] = set()
        for x in cut:
            runs.update(x or ())
        self.learn(runs)
        of = self.cache.__getitem__
        return [self.whole(text) if x is None else b"".join(map(of, x)) for text, x in zip(many, cut, strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each document, cut where they are more than `capacity`."""
    src = docs.select("doc_id", "text")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        row, no, start, length, crc = [], [], [], [], []
        tail, step = end.to_bytes(4, "little"), 4 * capacity
        for k, ids in enumerate(word_ids(path).encode(texts(b))):
            ids += tail
            for p, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                row.append(k)
                no.append(p)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", *PIECES.names])

    # in larger slices than other operators: the more words come at once, the fewer come again
    return src.mapInArrow(by_batch(one, rows=4000, size=16 << 20), T.StructType([src.schema["doc_id"], *PIECES.fields]))


class Pool:
    """How many unpacked pieces there are of each length, with the lengths that occur as bits of one number."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.tolist()
        self.bits = sum(1 << i for i, c in enumerate(self.counts) if c)

    def longest(self, most: int) -> int:
        """The longest length of at most `most`, 0 if none."""
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.bits & ((1 << (most + 1)) - 1) else 0

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            self.bits ^= 1 << n

    def give(self, n: int) -> None:
        if not self.counts[n]:
            self.bits |= 1 << n
        self.counts[n] += 1

    def best_two(self, gap: int) -> tuple[int, int, int]:
        """(sum, a, b) of the two unpacked lengths, a >= b, with the largest sum of at most `gap`; sum 0 if none."""
        best, a = (0, 0, 0), self.longest(gap - 1)
        while a and 2 * a > best[0]:
            b = self.longest(min(gap - a, a))
            if b == a and self.counts[a] < 2:
                b = self.longest(a - 1)
            if b and a + b > best[0]:
                best = (a + b, a, b)
                if a + b == gap:
                    break
            a = self.longest(a - 1)
        return best


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The lengths of each sequence, in their order there; every length is at most `capacity`."""
    pool, out = Pool(np.bincount(lengths, minlength=capacity + 1)), []
    while pool.bits:
        held, gap = [], capacity
        while n := pool.longest(gap):
            pool.take(n)
            held.append(n)
            gap -= n
        if gap and held:
            small = held[-1]  # filled from the longest down, so that the last is the shortest
            total, a, b = pool.best_two(gap + small)
            if total > small:
                pool.give(small)
                pool.take(a)
                pool.take(b)
                held[-1:] = [a, b]
        out.append(held)
    return out


def pack(cut: DataFrame, *, capacity: int = CAPACITY, groups: int) -> DataFrame:
    """`cut` with sequence_id and offset.  groups: into how many tasks the pieces are dealt."""
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = TaskContext.get().partitionId() << 40, []

        def placed(t: pa.Table, seq: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from t.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).to_batches(max_chunksize=10_000)

        for b in batches:
            t = pa.Table.from_batches([b])
            n = t["length"].to_numpy()
            full = n >= capacity
            if full.any():
                k = int(full.sum())
                yield from placed(t.filter(pa.array(full)), ids + np.arange(k), np.zeros(k, np.int64))
                ids += k
            if not full.all():
                held.append(t.filter(pa.array(~full)))
        if held:
            t = pa.concat_tables(held).sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
            n = t["length"].to_numpy()
            first = np.searchsorted(n, np.arange(capacity + 2)).tolist()  # the next unused row of each length
            seq, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for k, lengths in enumerate(best_two_fit(n, capacity)):
                at = 0
                for x in lengths:
                    seq[first[x]], offset[first[x]] = ids + k, at
                    first[x] += 1
                    at += x
            yield from placed(t, seq, offset)

    return cut.repartition(groups).mapInArrow(run, schema)  # one by one, so that equal rows do not meet in one group


def packed(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(pieces(docs, path, capacity=capacity, end=end), capacity=capacity, groups=1 + docs.count() // GROUP)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
