"""Operator 2: secret scans by a linear-chain conditional random field.

Tokens are tagged as outside, begin or inside of a secret.  What speaks for a tag is the token's shape, the words
beside it (two before, one after) and features of the whole text; the best tags are found by Viterbi.  The weights are
the maximum of the penalised likelihood on at most 2 * WINDOWS windows of tokens from about SAMPLE texts, whose labels
are the values that the fixed patterns find.

A token is surely outside if its tag could be changed to that in any tagging at a gain, whatever stands beside it;
Viterbi runs on what lies between such tokens, which gives the same tags as on the whole text.

Rows: null or empty text has no spans.  The patterns' spans come first and stay; tagged ones are added, as kind `crf`,
where they overlap none.  Columns named base or spans are replaced; others come back.  No rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import by_batch, table, texts
from factgraph.llm.spans import SPANS, SPANS_ARROW, Span, as_rows, count_of, free_of, joined, redacted

# The patterns of the three kinds and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
HINTS = ("passw", "secret", "token", "api")

TOKEN = re.compile(r"[\w+/.\-]+|[^\s\w+/.\-]+")
OUT, BEGIN, INSIDE = 0, 1, 2
BEFORE, AFTER = 2, 1
SAMPLE, WINDOWS, WIDTH, ROUNDS = 20_000, 1000, 20, 60
#: A word beside a token is a feature if the windows have it so often.
NAMED = 25
NEVER = -1e4
CACHE = 100_000


def base_spans(text: str, longest: int | None = None) -> tuple[list[Span], list[tuple[int, int]]]:
    """The patterns' spans by start, then kind, and the places of the secret values in them."""
    spans: list[Span] = []
    values: list[tuple[int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                spans.append(("assign", *m.span()))
                values.append(m.span(2))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 16:
                spans.append(("access", *m.span()))
                values.append(m.span())
    if longest is None or longest >= 32:
        for m in HEX.finditer(text):
            spans.append(("hex", *m.span()))
            values.append(m.span())
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans, values


def shape(token: str) -> list[str]:
    """What a token looks like."""
    n = len(token)
    size = f"n{min(n, 4) if n < 4 else 4 if n < 8 else 8 if n < 16 else 16 if n < 32 else 32}"
    if token.isalpha():
        case = "lower" if token.islower() else "upper" if token.isupper() else "title" if token[1:].islower() else "mixed"
        return ["letters", case, f"letters-{size}"]
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    if not digits and not letters:
        return ["marks"]
    found = [size, "digits" if not letters else "both" if digits else "letters-marks", f"both-{size}" if digits and letters else f"other-{size}"]
    if digits and letters:
        if all(c in "0123456789abcdef" for c in token):
            found.append(f"hex-{size}")
        if not any(c.islower() for c in token):
            found.append(f"capitals-{size}")
    if token.startswith("AKIA"):
        found.append("akia")
    return found


def file_features(text: str) -> list[str]:
    lines = text.count("\n") + 1
    return [f for f, y in (("file-assigns", "=" in text), ("file-quotes", '"' in text), ("file-short-lines", len(text) < 60 * lines)) if y]


def features(tokens: list[str], i: int, of_file: list[str]) -> list[str]:
    found = [*shape(tokens[i]), *of_file]
    for k in range(1, BEFORE + 1):
        found.append(f"before{k}=" + (tokens[i - k].lower() if i >= k else "^"))
    found.append("after1=" + (tokens[i + 1].lower() if i + 1 < len(tokens) else "$"))
    return found


@dataclass
class Model:
    """weights: feature -> what it adds to outside, begin, inside; moves: from tag to tag."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray
    _rows: dict = field(default_factory=dict)
    _table: np.ndarray = field(default_factory=lambda: np.zeros((64, BEFORE + AFTER + 1, 3)))
    _used: int = 0

    def __getstate__(self):
        return {"weights": self.weights, "moves": self.moves, "_rows": {}, "_table": np.zeros((64, BEFORE + AFTER + 1, 3)), "_used": 0}

    def _sum(self, names: list[str]) -> np.ndarray:
        return sum((self.weights[x] for x in names if x in self.weights), np.zeros(3))

    def _row(self, token: str) -> int:
        """Where the table has what a token adds to its own tag, to those one and two places after it, and to the one
        before it.  Tokens that no weight knows by name share a row by shape."""
        names = [f"{x}={token.lower()}" for x in (*(f"before{k}" for k in range(1, BEFORE + 1)), "after1")]
        look = shape(token)
        key = None if any(x in self.weights for x in names) else ("", *look)
        if key in self._rows:
            return self._rows[key]
        if self._used == len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        self._table[self._used] = [self._sum(look), *(self._sum([x]) for x in names)]
        self._used += 1
        if key:
            self._rows[key] = self._used - 1
        return self._used - 1

    def rows(self, tokens: list[str]) -> np.ndarray:
        rows = self._rows
        if len(rows) > CACHE:
            rows.clear()
            self._used = 0
        at = list(map(rows.get, tokens))
        if None in at:
            for t in {t for t, i in zip(tokens, at, strict=True) if i is None}:
                rows[t] = self._row(t)
            at = [rows[t] for t in tokens]
        return self._table[at]

    def slack(self) -> float:
        """The most that moves can lose if a tag becomes outside, and an inside after it begin."""
        m, worst = self.moves, 0.0
        for a, y, c, d in product((OUT, BEGIN, INSIDE), (BEGIN, INSIDE), (OUT, BEGIN, INSIDE, None), (OUT, BEGIN, INSIDE, None)):
            was = m[a, y] + (m[y, c] if c is not None else 0) + (m[c, d] if c == INSIDE and d is not None else 0)
            if was > NEVER / 2:
                turned = BEGIN if c == INSIDE else c
                now = m[a, OUT] + (m[OUT, turned] if c is not None else 0) + (m[turned, d] if c == INSIDE and d is not None else 0)
                worst = max(worst, was - now)
        return worst

    def scores(self, tokens: list[str], text: str) -> np.ndarray:
        """What speaks for each tag at each token."""
        r = self.rows(tokens)
        e = r[:, 0] + self._sum(file_features(text))
        for k in range(1, BEFORE + 1):
            e[k:] += r[:-k, k]
            e[:k] += self._sum([f"before{k}=^"])
        e[:-1] += r[1:, BEFORE + 1]
        e[-1] += self._sum(["after1=$"])
        return e

    def tag(self, tokens: list[str], text: str) -> list[tuple[int, int]]:
        """(first token, token after the last) of each secret."""
        e = self.scores(tokens, text)
        gain = np.r_[np.maximum(0, e[1:, INSIDE] - e[1:, BEGIN]), 0]
        open_ = np.flatnonzero(e[:, OUT] - e[:, 1:].max(axis=1) <= self.slack() + gain)
        if not len(open_):
            return []
        out = []
        for part in np.split(open_, np.flatnonzero(np.diff(open_) != 1) + 1):
            tags = viterbi(e[part], self.moves, part[-1] + 1 < len(tokens))
            for i, y in zip(part.tolist(), tags, strict=True):
                if y == BEGIN:
                    out.append([i, i + 1])
                elif y == INSIDE:
                    out[-1][1] = i + 1
        return [tuple(x) for x in out]


def viterbi(e: np.ndarray, moves: np.ndarray, more: bool) -> list[int]:
    """The best tags of a part of a text that follows an outside tag or the start; `more`: an outside tag follows it."""
    best, back = moves[OUT] + e[0], []
    for x in e[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + x
    y = int((best + (moves[:, OUT] if more else 0)).argmax())
    tags = [y]
    for b in reversed(back):
        y = int(b[y])
        tags.append(y)
    return tags[::-1]


def fit(windows: list[tuple[list[list[str]], list[int]]], penalty: float = 0.01, rounds: int = ROUNDS) -> Model:
    """The most likely weights for windows of (features of each token, tag of each token), all of them WIDTH long."""
    times = Counter(f for w, _ in windows for fs in w for f in fs)
    windows = [([[f for f in fs if "=" not in f or times[f] >= NAMED] for fs in w], tags) for w, tags in windows]
    names = {"": 0}
    slots = max((len(f) for w, _ in windows for f in w), default=1)
    ids = np.zeros((len(windows), WIDTH, slots), np.int64)
    y = np.zeros((len(windows), WIDTH), np.int64)
    for a, (w, tags) in enumerate(windows):
        y[a, : len(tags)] = tags
        for b, fs in enumerate(w):
            ids[a, b, : len(fs)] = [names.setdefault(f, len(names)) for f in fs]
    moves = np.zeros((3, 3))
    closed = np.zeros((3, 3), bool)
    closed[OUT, INSIDE] = True
    moves[closed] = NEVER
    weights = np.zeros((len(names), 3))
    if len(windows):
        one_hot = np.eye(3)
        seen = one_hot[y]
        seen_moves = np.einsum("nta,ntb->ab", seen[:, :-1], seen[:, 1:])
        flat, n = ids.ravel(), len(windows)
        state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            m = x.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

        for step in range(1, rounds + 1):
            e = weights[ids].sum(axis=2)
            a, b = np.empty_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0] + moves[OUT]
            for t in range(1, WIDTH):
                a[:, t] = e[:, t] + lse(a[:, t - 1, :, None] + moves, 1)
            for t in range(WIDTH - 2, -1, -1):
                b[:, t] = lse(moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            total = lse(a[:, -1], 1)
            p = np.exp(a + b - total[:, None, None])
            q = np.exp(a[:, :-1, :, None] + moves + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
            wrong = (p - seen).reshape(-1, 3)
            slope = np.stack([np.bincount(flat, np.repeat(wrong[:, k], slots), len(names)) for k in range(3)], axis=1) / n + penalty * weights / 10
            slope[0] = 0
            slope_moves = (q - seen_moves) / n + penalty * np.where(closed, 0, moves) / 10
            for k, (w, g) in enumerate(((weights, slope), (moves, slope_moves))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            moves[closed] = NEVER
    else:
        weights[:, OUT] = 1
    return Model({f: weights[i] for f, i in names.items() if f and np.abs(weights[i]).max() > 1e-3} if len(windows) else {"letters": np.array([9.0, 0, 0])}, moves)


def _windows(text: str, seed: int) -> list[dict]:
    """A window around each value that the patterns find, and one at a place without any."""
    found = [(m[0], *m.span()) for m in TOKEN.finditer(text)]
    tokens, of_file = [t for t, _, _ in found], file_features(text)
    tags = [OUT] * len(tokens)
    for a, b in base_spans(text)[1]:
        y = BEGIN
        for i, (_, x, z) in enumerate(found):
            if x < b and z > a and not tags[i]:
                tags[i], y = y, INSIDE
    spots = [i for i, y in enumerate(tags) if y == BEGIN]
    out = []
    for i in [*spots, seed % len(tokens) if tokens else -1]:
        at = max(0, i - 8 - seed % 5)
        if i >= 0 and tags[at] != INSIDE:
            own = range(at, min(len(tokens), at + WIDTH))
            out.append({"features": [features(tokens, k, of_file) for k in own], "tags": [tags[k] for k in own], "secret": any(tags[k] for k in own)})
    return out


def learn(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE, windows: int = WINDOWS) -> Model:
    """Weights from at most 2 * windows windows of about `sample` texts, chosen by hash."""
    rows = docs.select(F.col(text).alias("text")).where("text <> ''")
    n = rows.count()
    src = rows.withColumn("h", F.xxhash64("text", F.lit(2))).where(F.pmod("h", F.lit(1_000_000)) < min(1.0, sample / max(1, n)) * 1_000_000)
    kind = pa.list_(pa.struct([("features", pa.list_(pa.list_(pa.string()))), ("tags", pa.list_(pa.int32())), ("secret", pa.bool_())]))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        h = b.column(1)
        return pa.RecordBatch.from_arrays([h, pa.array([_windows(t, x & 0x7FFFFFFF) for t, x in zip(texts(b), h.to_pylist(), strict=True)], kind)], names=["h", "w"])

    cut = src.mapInArrow(by_batch(one), "h bigint, w array<struct<features:array<array<string>>,tags:array<int>,secret:boolean>>").select("h", F.posexplode("w").alias("k", "w")).select("h", "k", "w.*").dropDuplicates(["h", "k"])
    chosen = [cut.where("secret" if y else "NOT secret").orderBy("h", "k").limit(windows) for y in (True, False)]
    return fit([(x["features"], x["tags"]) for x in chosen[0].union(chosen[1]).select("features", "tags").collect()])


def spans_of(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(the patterns' spans, those and the tagged ones, by start, then kind)."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return [], []
    base, _ = base_spans(text, max(map(len, tokens)))
    tagged = model.tag(tokens, text)
    if not tagged:
        return base, base
    at = [m.span() for m in TOKEN.finditer(text)]
    added = free_of([("crf", at[a][0], at[b - 1][1]) for a, b in tagged], base)
    return base, sorted([*base, *added], key=lambda s: (s[1], [*KINDS, "crf"].index(s[0])))


def scan(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """`docs` with base and spans: arrays of (kind, start, end)."""
    own = [c for c in docs.columns if c not in ("base", "spans")]
    src = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index(text)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans_of(x or "", model) for x in b.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, *(pa.array([as_rows(x[k]) for x in found], SPANS_ARROW) for k in (0, 1))], names=[*own, "base", "spans"])

    schema = T.StructType([*src.schema.fields, *T._parse_datatype_string(f"base {SPANS}, spans {SPANS}").fields])
    return src.mapInArrow(by_batch(one), schema)


def without_secrets(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with [kind] in place of each secret of its text."""
    own, schema = docs.columns, docs.schema
    i = own.index("text")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        clean = [redacted(t, as_rows(s)) if t and (s := spans_of(t, model)[1]) else t for t in b.column(i).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if k == i else b.column(k) for k in range(b.num_columns)], names=own)

    return docs.mapInArrow(by_batch(one), schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn(docs)).drop("text")
    return found.select("doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
