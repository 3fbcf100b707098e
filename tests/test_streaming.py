"""Bounded streaming state: one history over all providers, jobs that are forgotten, restarts and replays."""

import datetime

import pytest

from spindrift.streaming import history

EVENTS = "provider string, event_id long, status string"
ASKED = "job_key string, request_id long, at timestamp"


def run(spark, tmp_path, make, mode="update"):
    """Run a stream over all files that are there; returns rows by batch and the last progress."""
    out = []
    sink = lambda df, epoch: out.append((epoch, [tuple(r) for r in df.collect()]))
    with history.with_store(spark):
        q = make().writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
    return out, q.lastProgress


def put(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def stream(spark, tmp_path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_one_history_over_all_providers_outlives_a_restart(spark, tmp_path):
    make = lambda: history.attempt_history(stream(spark, tmp_path, EVENTS), 3)
    put(spark, tmp_path, "a", [("p", 1, "ok"), ("q", 5, "failed"), ("p", 3, "ok"), ("r", 2, "ok")], EVENTS)
    out, _ = run(spark, tmp_path, make)
    assert [r[1:] for _, rows in out for r in rows] == [([2, 3, 5], ["r", "p", "q"], ["ok", "ok", "failed"])]
    put(spark, tmp_path, "b", [("q", 4, "late"), ("q", 0, "too late")], EVENTS)
    out, progress = run(spark, tmp_path, make)
    assert [r[1:3] for _, rows in out for r in rows][-1] == ([3, 4, 5], ["p", "q", "q"])
    assert progress is None or sum(s["numRowsTotal"] for s in progress["stateOperators"]) <= 3


def test_a_history_begins_with_a_snapshot(spark, tmp_path):
    snapshot = spark.createDataFrame([("s", k, "old") for k in range(10)], EVENTS)
    put(spark, tmp_path, "a", [("p", 20, "ok")], EVENTS)
    out, _ = run(spark, tmp_path, lambda: history.attempt_history(stream(spark, tmp_path, EVENTS), 3, snapshot))
    assert [r[1] for _, rows in out for r in rows][-1] == [8, 9, 20]


def test_capacity_0_keeps_nothing(spark, tmp_path):
    put(spark, tmp_path, "a", [("p", 20, "ok")], EVENTS)
    out, _ = run(spark, tmp_path, lambda: history.attempt_history(stream(spark, tmp_path, EVENTS), 0))
    assert [r for _, rows in out for r in rows] == []


def test_jobs_are_forgotten_in_time(spark, tmp_path):
    at = lambda minutes: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=minutes)
    make = lambda: history.bounded_jobs(stream(spark, tmp_path, ASKED), "10 minutes", 60 * 60 * 1000)
    found, totals = {}, []
    for n in range(6):
        rows = [(f"k{n}-{i}", 1000 * n + i, at(120 * n + i)) for i in range(20)] + [("same", 1000 * n + 900, at(120 * n)), ("same", 1000 * n + 901, at(120 * n + 30))]
        put(spark, tmp_path, str(n), rows, ASKED)
        out, progress = run(spark, tmp_path, make, "append")
        found |= {r[1]: r[2:] for _, rows in out for r in rows}
        totals += [sum(s["numRowsTotal"] for s in progress["stateOperators"])] if progress else []
    assert found[0] == ("accepted", "job-0") and found[900][0] == "accepted" and found[901] == ("already_exists", found[900][1])
    assert len({found[1000 * n + 900][1] for n in range(6)}) == 6  # each two hours later, so another job
    assert max(totals) <= 3 * 2 * 21  # keys and timers of the time that is kept, not of all six


def test_restarting_without_new_files_changes_nothing(spark, tmp_path):
    put(spark, tmp_path, "a", [("k", 1, datetime.datetime(2024, 1, 1))], ASKED)
    make = lambda: history.bounded_jobs(stream(spark, tmp_path, ASKED))
    first, _ = run(spark, tmp_path, make, "append")
    again, _ = run(spark, tmp_path, make, "append")
    assert [r[2] for _, rows in first for r in rows] == ["accepted"] and [r for _, rows in again for r in rows] == []


@pytest.mark.parametrize("keep", [1, 5])
def test_only_the_last_of_each_task_are_passed_on(spark, tmp_path, keep):
    put(spark, tmp_path, "a", [(f"p{k % 3}", k, "ok") for k in range(500)], EVENTS)
    out, _ = run(spark, tmp_path, lambda: history.attempt_history(stream(spark, tmp_path, EVENTS), keep))
    assert [r[1] for _, rows in out for r in rows][-1] == list(range(500 - keep, 500))
