"""Spans of a text by kind, as columns: kind, start and end in code points, the end exclusive."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
Span = tuple[str, int, int]


def as_rows(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def free_of(found: list[Span], taken: list[Span]) -> list[Span]:
    """The spans of `found` that overlap none of `taken`."""
    starts, ends = [], []  # of what is taken, as stretches that do not touch
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(s: Span) -> bool:
        i = bisect_left(starts, s[2]) - 1  # the last stretch that starts before the span ends
        return i < 0 or ends[i] <= s[1]

    return [s for s in found if free(s)]


def redacted(text: str, spans: list[dict]) -> str:
    """The text with [kind] in place of each span; of spans that overlap, as one."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])
