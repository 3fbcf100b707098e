"""Bounded state over streams, on stateful processors: one attempt history, and jobs that are forgotten in time.

Both need a state store that keeps several kinds of state: ``with_store`` sets it for
the queries that are started inside.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in the store that these operators need."""
    old = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if old is None else spark.conf.set(STORE, old)


ATTEMPT = "event_id long, provider string, status string"


class _Ring(StatefulProcessor):
    """The last ``keep`` attempts by event id; what arrives late takes its place among them, or none."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("attempts", StructType().add("event_id", "long").add("provider", "string").add("status", "string"))

    def _take(self, held: list[tuple], pdf: pd.DataFrame) -> list[tuple]:
        new = ((int(r.event_id), r.provider, r.status) for r in pdf.itertuples(index=False))
        return heapq.nlargest(self.keep, {*held, *new}, key=lambda x: x[0])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = self._take([], initialState)
        if held:
            self.held.put(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(a), b, c) for a, b, c in self.held.get()] if self.held.exists() else []
        for pdf in rows:  # never more than the ring and one batch of rows
            held = self._take(held, pdf)
        if held:
            self.held.put(held)
            shown = sorted(held)
            yield pd.DataFrame({"history": [key[0]], "event_ids": [[x[0] for x in shown]], "providers": [[x[1] for x in shown]], "statuses": [[x[2] for x in shown]]})

    def close(self) -> None:
        pass


def attempt_history(attempts: DataFrame, keep: int = 20, snapshot: DataFrame | None = None) -> DataFrame:
    """One history of the last ``keep`` attempts over all providers, after every batch; 0 disables.

    attempts: a stream of provider, event_id, status; snapshot: a table of the same,
    of which the ring begins with the last ``keep``.  Every task passes on its own
    last ``keep`` of a batch, so the one history sees few rows however long a batch is.
    """
    columns = ("event_id", "provider", "status")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = (pdf if held is None else pd.concat([held, pdf])).nlargest(keep, "event_id") if keep else pdf[:0]
        if held is not None and len(held):
            yield held

    def keyed(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("event_id").cast("long").alias("event_id"), F.col("provider").cast("string").alias("provider"), F.col("status").cast("string").alias("status"))
        return rows.mapInPandas(last, ATTEMPT).select(F.lit("all").alias("history"), *columns)

    before = keyed(snapshot).groupBy("history") if snapshot is not None else None
    out = "history string, event_ids array<long>, providers array<string>, statuses array<string>"
    return keyed(attempts).groupBy("history").transformWithStateInPandas(_Ring(keep), out, "Update", "None", initialState=before)


class _Jobs(StatefulProcessor):
    """A key's first request, until a time after it is over."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", StructType().add("request_id", "long").add("until", "long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.first.get() if self.first.exists() else None
        for pdf in rows:
            out = []
            for r in pdf.itertuples(index=False):
                at = int(r.at.timestamp() * 1000)
                if first is None or at >= first[1]:
                    first = (int(r.request_id), at + self.keep_ms)
                    self.first.update(first)
                    self.handle.registerTimer(first[1])
                    out.append((key[0], int(r.request_id), "accepted", f"job-{first[0]}"))
                else:
                    out.append((key[0], int(r.request_id), "already_exists", f"job-{first[0]}"))
            yield pd.DataFrame(out, columns=["job_key", "request_id", "outcome", "job_ref"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.first.exists() and self.first.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.first.clear()
        yield pd.DataFrame({"job_key": [], "request_id": [], "outcome": [], "job_ref": []}).astype({"job_key": str, "request_id": "int64", "outcome": str, "job_ref": str})

    def close(self) -> None:
        pass


def bounded_jobs(requests: DataFrame, late: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """One job for each key within ``keep_ms`` of its first request; a replay answers with the same job.

    requests: job_key, request_id, at (event time).  Requests are taken in the order
    in which batches bring them; those later than the watermark, ``late`` behind the
    newest, are dropped by it.  A request after the key's time makes a new job, whatever
    the watermark; once that has passed, the key is forgotten, so the state holds
    the keys of a bounded time only.
    """
    marked = requests.select("job_key", "request_id", "at").withWatermark("at", late)
    return marked.groupBy("job_key").transformWithStateInPandas(_Jobs(keep_ms), "job_key string, request_id long, outcome string, job_ref string", "Append", "EventTime")
