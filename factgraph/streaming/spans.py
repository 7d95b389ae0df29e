"""Spans of a stream judged by keyed state: what was seen before is kept by key in the state store, not read from a table.

Two operators follow each other.  The first, keyed by span, holds each arrival against the first hash of its key.  The
second, keyed by run, counts what is accepted against the run's quota and knows which keys it has refused.  Their
verdicts are those of runtime.dedup_spans() over all that has been accepted before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factgraph.operators.runtime import SPAN_KEY

#: The state store that these operators need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _judged(rows: pd.DataFrame, first: pd.Series | str, seen: bool) -> pd.Series:
    """Verdicts of rows in order: another hash than the first is a conflict, the first row of a key not seen is new."""
    turn = rows.groupby(["trace_id", "span_id"], dropna=False).cumcount()
    verdict = pd.Series("new", index=rows.index).mask(seen | (turn > 0), "duplicate")
    return verdict.mask(rows["span_hash"] != first, "conflict")


class FirstOfKey(StatefulProcessor):
    """Keeps the hash that a key came with first; of one batch that is the least (upload, hash)."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "span_hash string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        here = pd.concat(list(rows)).sort_values(["upload", "span_hash"], kind="stable").reset_index(drop=True)
        seen = self.first.exists()
        first = self.first.get()[0] if seen else here["span_hash"].iloc[0]
        if not seen:
            self.first.update((first,))
        yield here.assign(verdict=_judged(here, first, seen))

    def close(self) -> None:
        pass


class QuotaOfRun(StatefulProcessor):
    """Accepts the first new spans of a run, by (upload, trace, span) within a batch, up to its quota.

    No more rows than the quota and one frame are held at a time, besides those of keys refused before.  A key that was
    refused is not stored, so that its next arrival is judged as if it were the first, and refused again.
    """

    def __init__(self, quota: int, ttl_ms: int | None):
        self.quota, self.ttl_ms = quota, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "n bigint")  # a number a run, kept for good
        self.refused = handle.getMapState("refused", "trace_id string, span_id string", "here int", self.ttl_ms)

    def _refuse(self, rows: pd.DataFrame) -> pd.DataFrame:
        for k in zip(rows["trace_id"], rows["span_id"], strict=True):
            self.refused.updateValue(k, (1,))
        return rows.assign(verdict="over_quota")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.accepted.get()[0] if self.accepted.exists() else 0
        room, full = max(0, self.quota - n), n >= self.quota
        kept, again = None, []
        for frame in rows:
            new = frame["verdict"] == "new"
            back = pd.Series(False, index=frame.index)
            if full:
                known = {k: self.refused.containsKey(k) for k in set(zip(frame.loc[~new, "trace_id"], frame.loc[~new, "span_id"], strict=True))}
                back = ~new & pd.Series([known.get(k, False) for k in zip(frame["trace_id"], frame["span_id"], strict=True)], index=frame.index)
                again.append(frame[back])
            yield frame[~new & ~back]
            if new.any():
                kept = pd.concat([x for x in (kept, frame[new]) if x is not None]).sort_values(["upload", "trace_id", "span_id"], kind="stable")
                yield self._refuse(kept.iloc[room:])
                kept = kept.iloc[:room]
        if kept is not None and len(kept):
            self.accepted.update((n + len(kept),))
            yield kept
        if any(map(len, again)):
            back = pd.concat(again).sort_values(["upload", "span_hash"], kind="stable").reset_index(drop=True)
            first = back.groupby(["trace_id", "span_id"])["span_hash"].transform("first")
            verdict = _judged(back, first, False)
            yield back.assign(verdict=verdict.mask(verdict == "new", "over_quota"))

    def close(self) -> None:
        pass


def judged_spans(spans: DataFrame, quota: int | None = 100_000, ttl_ms: int | None = None) -> DataFrame:
    """A stream of spans (upload, run_id, trace_id, span_id, span_hash and more, no nulls in the key) with verdict.

    ttl_ms: after how long a key is forgotten, and would be new again; it should be longer than the uploads of a run go
    on.  None: never.  With a time, a trigger that is to end needs spark.sql.streaming.noDataMicroBatches.enabled=false, as
    Spark else runs batches for the clock alone.  Rows of one key in one micro-batch are held together.
    """
    clock = "None" if ttl_ms is None else "ProcessingTime"
    schema = T.StructType([*spans.schema.fields, T.StructField("verdict", T.StringType())])
    out = spans.groupBy(*SPAN_KEY).transformWithStateInPandas(FirstOfKey(ttl_ms), schema, "Append", clock)
    if quota is None:
        return out
    return out.groupBy("run_id").transformWithStateInPandas(QuotaOfRun(quota, ttl_ms), schema, "Append", clock)


def write_judged(judged: DataFrame, batch: int, table_path: str, rejects_path: str) -> None:
    """The batch's new spans into a folder of its own of one table, its conflicts and what exceeds quotas into one of the
    other: a batch that is run again replaces what it wrote."""
    judged = judged.persist()  # a second action would ask the state store once more
    try:
        judged.where("verdict = 'new'").drop("verdict").write.mode("overwrite").parquet(f"{table_path}/batch={batch}")
        judged.where(F.col("verdict").isin("conflict", "over_quota")).write.mode("overwrite").parquet(f"{rejects_path}/batch={batch}")
    finally:
        judged.unpersist()
