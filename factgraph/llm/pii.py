"""Operator 4: personal data by a semi-Markov conditional random field.

A text is cut into islands: runs of tokens with a digit or an at-sign, with little between them.  Elsewhere nothing
can be personal data.  Within an island, segments of up to MOST tokens are candidates for each type; features of the
whole span (its form, digits, check digit) and the word before it score them, and a dynamic program over the island
chooses boundaries and types together.  The weights are the maximum of the penalised likelihood on at most ISLANDS
islands of about SAMPLE texts, whose labels are what the fixed patterns find.

Rows: null or empty text has no spans.  Texts are worked on whole, in time that grows with their length.  The patterns' spans stay; the model's are added as kind `crf_<type>` where
they overlap none.  Columns named base or spans are replaced; others come back.  No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import by_batch, table, texts
from factgraph.llm.spans import SPANS, SPANS_ARROW, Span, as_rows, count_of, free_of, joined

# The patterns of the four kinds.  A match of IP from within a run of digits would also be one from the
# start of the run, so that it is tried there alone.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"crf_{k}" for k in KINDS)

#: A token lies between two of these and holds one of those.
BREAK = re.compile(r"[\s,;:!?\"'<>|=]")
MAY_HOLD = re.compile(r"[0-9@]")
NO_DIGITS = str.maketrans("", "", "0123456789")
#: So many spans' scores are kept at a time, of at most so many characters each.
SCORES, SHORT = 50_000, 40
#: Between two tokens of an island lie so many characters at most; a segment has so many tokens at most.
GAP, MOST = 3, 8
SAMPLE, ISLANDS, ROUNDS = 20_000, 2000, 80
#: How far before a span its word is looked for.
REACH = 24
WORD_BEFORE = re.compile(r"([^\W\d_]{2,12})[^\w\n]*$")


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def fits(kind: str, found: str) -> bool:
    """Whether a match of a pattern is kept."""
    if kind == "ip":
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in found.split(".")))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def emails(text: str) -> list[Span]:
    """The leftmost non-overlapping emails; tried only from the start of each run of letters before an at-sign, as any
    match that starts within such a run is found from the run's start."""
    out, at = [], 0
    while (i := text.find("@", at)) >= 0:
        start = i
        while start > at and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = EMAIL.match(text, start) if start < i else None
        if m:
            out.append(("email", *m.span()))
        at = m.end() if m else i + 1
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    if not MAY_HOLD.search(text):
        return []
    out = emails(text)
    for kind, pattern, sign in (("ip", IP, "."), ("card", CARD, ""), ("phone", PHONE, "+")):
        if sign in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text) if fits(kind, m[0])]
    return out


def islands(text: str) -> list[list[tuple[int, int]]]:
    """The tokens (start, end) of each island."""
    out: list[list[tuple[int, int]]] = []
    at = 0
    while m := MAY_HOLD.search(text, at):
        a, end = m.start(), BREAK.search(text, m.end())
        while a > at and not BREAK.match(text, a - 1):  # what lies before `at` is looked at no more
            a -= 1
        at = b = end.start() if end else len(text)
        while b > a and text[b - 1] in ".-(":
            b -= 1
        if b > a:
            if out and a - out[-1][-1][1] <= GAP and "\n" not in text[out[-1][-1][1] : a]:
                out[-1].append((a, b))
            else:
                out.append([(a, b)])
    return out


def before(text: str, start: int) -> str:
    """The word before a place, lower-cased, if at most REACH characters lie between; else nothing."""
    m = WORD_BEFORE.search(text[max(0, start - REACH) : start])
    return m[1].lower() if m else ""


def shown(s: str, tokens: int, word: str) -> list[str]:
    """What a whole span, and the word before it, show of what it may be."""
    bare = s.translate(NO_DIGITS)
    n, ats = len(s) - len(bare), s.count("@")
    found = [f"tokens{min(tokens, 5)}", f"digits{min(n, 20)}", f"ats{min(ats, 2)}"]
    if ats == 1 and EMAIL.fullmatch(s):
        found.append("email-form")
    if s.count(".") == 3 and all(x.isdecimal() and len(x) <= 3 and int(x) <= 255 for x in s.split(".")):
        found.append("four-octets")
    plus = s[0] == "+"
    if plus:
        found.append("plus")
    if not ats and not any(map(str.isalpha, bare)):
        found.append("no-letters")
        checked = 13 <= n <= 19 and luhn(re.sub("[^0-9]", "", s))
        if checked:
            found.append("check-digit")
        if 9 <= n <= 15:
            found.append("phone-length")
        found.append(f"marks{''.join(sorted({c for c in bare if not c.isdigit()}))[:4]}")
        if checked and not set(bare) - set(" -"):
            found.append("card-form")
        if plus and 9 <= n <= 15 and not set(bare[1:]) - set(" ().-"):
            found.append("phone-form")
    found.append(f"after-{word}")
    return found


def features(text: str, start: int, end: int, kind: str, tokens: int, word: str) -> list[str]:
    """What a whole span, and the word before it, show of being of a kind."""
    return [f"{kind}:{x}" for x in shown(text[start:end], tokens, word)]


@dataclass
class Model:
    weights: dict[str, float]

    def __post_init__(self) -> None:
        own: dict[str, list[float]] = {}
        for name, w in self.weights.items():
            kind, _, x = name.partition(":")
            own.setdefault(x, [0.0] * len(KINDS))[KINDS.index(kind)] = w
        self._by_feature = own
        self._scores: dict[tuple[str, int, str], tuple[float, ...]] = {}

    def scores(self, s: str, tokens: int, word: str) -> tuple[float, ...]:
        """A span's score as each kind."""
        if (known := self._scores.get((s, tokens, word))) is None:
            rows = [w for x in shown(s, tokens, word) if (w := self._by_feature.get(x))]
            known = tuple(map(sum, zip(*rows, strict=True))) or (0.0,) * len(KINDS)
            if len(s) <= SHORT:
                if len(self._scores) >= SCORES:
                    self._scores.clear()
                self._scores[s, tokens, word] = known
        return known

    def candidates(self, text: str, tokens: list[tuple[int, int]]) -> Iterator[list[tuple[int, str, float]]]:
        """For each token after which a segment may end: (first token, type, score) of each candidate."""
        words: list[str] = []
        for j, (a, end) in enumerate(tokens):
            words.append(before(text, a))
            yield [(i, kind, score) for i in range(max(0, j - MOST + 1), j + 1) for kind, score in zip(KINDS, self.scores(text[tokens[i][0] : end], j - i + 1, words[i]), strict=True)]

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> list[Span]:
        """The best segments of an island; a token outside of any scores 0."""
        best, back = [0.0], [None]
        for j, own in enumerate(self.candidates(text, tokens)):
            top, how = best[j], None
            for i, kind, score in own:
                if best[i] + score > top:
                    top, how = best[i] + score, (i, kind)
            best.append(top)
            back.append(how)
        out, j = [], len(tokens)
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]


def fit(samples: list[tuple[str, list[tuple[int, int]], list[Span]]], penalty: float = 0.002, rounds: int = ROUNDS) -> Model:
    """The most likely weights for (text, tokens, true segments as token indices) of islands, by forward and backward
    sums over all segmentations."""
    names: dict[str, int] = {}
    seen_islands = []
    for text, tokens, truth in samples:
        true = {(a, b, k) for k, a, b in truth}
        segments = [(i, j, kind, [names.setdefault(f, len(names)) for f in features(text, tokens[i][0], tokens[j][1], kind, j - i + 1, before(text, tokens[i][0]))]) for j in range(len(tokens)) for i in range(max(0, j - MOST + 1), j + 1) for kind in KINDS]
        seen_islands.append((len(tokens), segments, {(i, j, k) for i, j, k, _ in segments} & true))
    w = np.zeros(len(names))
    if not names:
        return Model({})
    size = max(len(f) for _, segs, _ in seen_islands for *_, f in segs)
    table_ = np.full((sum(len(s) for _, s, _ in seen_islands), size), len(names))
    real = np.zeros(len(table_))
    at = 0
    for _, segs, true in seen_islands:
        for i, j, k, f in segs:
            table_[at, : len(f)] = f
            real[at] = (i, j, k) in true
            at += 1
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        score = np.append(w, 0.0)[table_].sum(axis=1)
        force = np.exp(np.clip(score, -60, 60)).tolist()
        p, at = np.empty(len(table_)), 0
        for n, segs, _ in seen_islands:
            a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            own = force[at : at + len(segs)]
            spot = 0
            for j in range(n):
                a[j + 1] = a[j]
                while spot < len(segs) and segs[spot][1] == j:
                    a[j + 1] += a[segs[spot][0]] * own[spot]
                    spot += 1
            for j in range(n - 1, -1, -1):
                b[j] += b[j + 1]
                while spot and segs[spot - 1][1] == j:
                    spot -= 1
                    b[segs[spot][0]] += own[spot] * b[j + 1]
            p[at : at + len(segs)] = [a[s[0]] * x * b[s[1] + 1] / a[n] for s, x in zip(segs, own, strict=True)]
            at += len(segs)
        g = np.bincount(table_.ravel(), np.repeat(p - real, size), len(names) + 1)[:-1] / len(seen_islands) + penalty * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-4})


def _labelled(text: str) -> list[dict]:
    base = sorted(base_spans(text), key=lambda s: (s[1], s[0]))
    out, at = [], 0
    for tokens in islands(text):
        while at < len(base) and base[at][2] <= tokens[0][0]:  # before this and all later islands
            at += 1
        if len(tokens) <= 2 * MOST:
            low, high = max(0, tokens[0][0] - REACH), tokens[-1][1]
            truth, taken = [], 0
            for k, a, b in takewhile(lambda s: s[1] < high, (base[x] for x in range(at, len(base)))):
                i = [x for x, (p, q) in enumerate(tokens) if p < b and q > a]
                if i and i[0] >= taken:
                    truth.append({"kind": k, "start": i[0], "end": i[-1]})
                    taken = i[-1] + 1
            out.append({"text": text[low:high], "tokens": [[a - low, b - low] for a, b in tokens], "truth": truth})
    return out


def learn(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE, most: int = ISLANDS) -> Model:
    rows = docs.select(F.col(text).alias("text")).where("text <> ''")
    n = rows.count()
    src = rows.withColumn("h", F.xxhash64("text", F.lit(4))).where(F.pmod("h", F.lit(1_000_000)) < min(1.0, sample / max(1, n)) * 1_000_000)
    kind = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.list_(pa.list_(pa.int32()))), ("truth", SPANS_ARROW)]))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(1), pa.array([_labelled(t) for t in texts(b)], kind)], names=["h", "w"])

    cut = src.mapInArrow(by_batch(one), f"h bigint, w array<struct<text:string,tokens:array<array<int>>,truth:{SPANS}>>").select("h", F.posexplode("w").alias("k", "w")).select("h", "k", "w.*").dropDuplicates(["h", "k"])
    chosen = [cut.where("size(truth) > 0" if y else "size(truth) = 0").orderBy("h", "k").limit(most // 2) for y in (True, False)]
    got = chosen[0].union(chosen[1]).select("text", "tokens", "truth").collect()
    return fit([(x["text"], [tuple(t) for t in x["tokens"]], [(s["kind"], s["start"], s["end"]) for s in x["truth"]]) for x in got])


def spans_of(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(the patterns' spans, those and the model's, each by kind, then start)."""
    if not MAY_HOLD.search(text):
        return [], []
    base = base_spans(text)
    added = [(f"crf_{k}", a, b) for k, a, b in free_of([s for tokens in islands(text) for s in model.segments(text, tokens)], base)]
    return base, [*base, *sorted(added, key=lambda s: (ADDED.index(s[0]), s[1]))]


def find(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """`docs` with base and spans: arrays of (kind, start, end)."""
    own = [c for c in docs.columns if c not in ("base", "spans")]
    src = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index(text)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans_of(x or "", model) for x in b.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, *(pa.array([as_rows(x[k]) for x in found], SPANS_ARROW) for k in (0, 1))], names=[*own, "base", "spans"])

    return src.mapInArrow(by_batch(one), T.StructType([*src.schema.fields, *T._parse_datatype_string(f"base {SPANS}, spans {SPANS}").fields]))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, learn(docs)).drop("text")
    return found.select("doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
