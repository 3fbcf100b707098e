"""Stateful operators over streams: bounded attempt history, circuit breaker, idempotent jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.operators.batch import COOLDOWN, THRESHOLD, Breaker


def attempt_history(attempts: DataFrame, keep: int = 20) -> DataFrame:
    """The last ``keep`` attempts of each source after every batch, newest last; 0 disables.

    attempts: provider, event_id (rising), status.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, statuses = (list(x) for x in state.get) if state.exists else ([], [])
        rows = sorted((int(r.event_id), r.status) for pdf in batches for r in pdf.itertuples(index=False))
        ids, statuses = ids + [r[0] for r in rows], statuses + [r[1] for r in rows]
        ids, statuses = (ids[-keep:], statuses[-keep:]) if keep else ([], [])
        state.update((ids, statuses))
        if ids:
            yield pd.DataFrame({"provider": [key[0]], "event_ids": [ids], "statuses": [statuses]})

    kind = attempts.schema["provider"].dataType.simpleString()
    return attempts.groupBy("provider").applyInPandasWithState(run, f"provider {kind}, event_ids array<long>, statuses array<string>", "event_ids array<long>, statuses array<string>", "update", GroupStateTimeout.NoTimeout)


def breaker(executions: DataFrame, threshold: int = THRESHOLD, cooldown: int = COOLDOWN) -> DataFrame:
    """Outcome of every execution under a circuit breaker, state kept between batches."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Breaker(*state.get) if state.exists else Breaker()
        rows = sorted(((int(r.item_index), bool(r.failed), r.reason, r.retry_class) for pdf in batches for r in pdf.itertuples(index=False)), key=lambda r: r[0])
        out = [(key[0], i, own.step(i, failed, reason, kind, threshold, cooldown), own.count(i), own.left(i)) for i, failed, reason, kind in rows]
        state.update((own.failures, own.until, own.reason, own.kind))
        yield pd.DataFrame(out, columns=["provider", "item_index", "outcome", "consecutive_failures", "cooldown_remaining"])

    kind = executions.schema["provider"].dataType.simpleString()
    return executions.groupBy("provider").applyInPandasWithState(run, f"provider {kind}, item_index long, outcome string, consecutive_failures int, cooldown_remaining int", "failures int, until long, reason string, kind string", "append", GroupStateTimeout.NoTimeout)


def idempotent_jobs(requests: DataFrame) -> DataFrame:
    """One job for each key; a replay answers with the same job as already_exists.

    requests: job_key, request_id.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        out = []
        for request in sorted(int(x) for pdf in batches for x in pdf["request_id"]):
            out.append((key[0], request, "accepted" if first is None else "already_exists", f"job-{first if first is not None else request}"))
            first = request if first is None else first
        state.update((first,))
        yield pd.DataFrame(out, columns=["job_key", "request_id", "outcome", "job_ref"])

    return requests.groupBy("job_key").applyInPandasWithState(run, "job_key string, request_id long, outcome string, job_ref string", "first long", "append", GroupStateTimeout.NoTimeout)


# The state that each operation leads to; "query" leads nowhere.
TRANSITIONS = {"enqueue": "queued", "pause": "paused", "resume": "running", "cancel": "cancelled"}
TERMINAL = ("cancelled", "succeeded", "failed")


def job_transitions(requests: DataFrame) -> DataFrame:
    """A job's state and progress after each request; a job begins with its first enqueue, and any state may follow any.

    requests: job_key, request_id (rising), operation.  Requests before the first enqueue are not_found.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job, percent = state.get if state.exists else (None, 0)
        out = []
        for request, operation in sorted((int(r.request_id), r.operation) for pdf in batches for r in pdf.itertuples(index=False)):
            if job is None and operation != "enqueue":
                out.append((key[0], request, "not_found", 0))
                continue
            if not (job is not None and operation == "enqueue"):  # a replayed enqueue answers with the job as it is
                job = TRANSITIONS.get(operation, job)
            percent = 100_000 if job in TERMINAL else percent
            out.append((key[0], request, job, percent))
        if job is not None:
            state.update((job, percent))
        yield pd.DataFrame(out, columns=["job_key", "request_id", "state", "percent_milli"])

    return requests.groupBy("job_key").applyInPandasWithState(run, "job_key string, request_id long, state string, percent_milli int", "state string, percent_milli int", "append", GroupStateTimeout.NoTimeout)
