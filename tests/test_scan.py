"""Parallel scans of a source's rows against plain folds, with many blocks, and their number of tasks."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import batch, scan

ROWS = "provider string, item_index long, failed boolean, reason string, retry_class string"


def rows(seed):
    rng = random.Random(seed)
    kinds = ["retryable", "retryable", None, "operator_action", "permanent", "other"]
    out = [("hot", i, rng.random() < 0.7, None, rng.choice(kinds)) for i in range(0, 900) if rng.random() < 0.8]
    out += [("failing", i, True, "x", "retryable") for i in range(300)] + [("well", i, False, None, None) for i in range(50)] + [("one", 5, True, None, None)]
    out += [(f"p{k}", i * k, rng.random() < 0.5, None, rng.choice(kinds)) for k in range(1, 9) for i in range(12)]
    return rng.sample(out, len(out))


def plain(found, threshold, cooldown):
    out, states = {}, {}
    for provider, item, failed, reason, kind in sorted(found, key=lambda r: r[:2]):
        own = states.setdefault(provider, batch.Breaker())
        did = own.step(item, failed, reason, kind, threshold, cooldown)
        out[provider, item] = (did, own.count(item), own.left(item))
    return out


@pytest.mark.parametrize(("threshold", "cooldown"), [(2, 3), (1, 1), (4, 7), (0, 3), (3, 0)])
@pytest.mark.parametrize("parts", [1, 23])
def test_breaker_equals_the_fold(spark, threshold, cooldown, parts):
    found = rows(threshold * 10 + cooldown)
    got = batch.replay(spark.createDataFrame(found, ROWS).repartition(3), threshold, cooldown, parts)
    assert got.columns == ["provider", "item_index", "outcome", "consecutive_failures", "cooldown_remaining"]
    assert {(r.provider, r.item_index): tuple(r)[2:] for r in got.collect()} == plain(found, threshold, cooldown)


@pytest.mark.parametrize("parts", [1, 17])
def test_streaks_equal_the_count(spark, parts):
    found, want, run = rows(3), {}, {}
    for provider, item, failed, *_ in sorted(found, key=lambda r: r[:2]):
        run[provider] = run.get(provider, 0) + 1 if failed else 0
        want[provider, item] = run[provider]
    got = batch.consecutive_failures(spark.createDataFrame(found, ROWS), parts=parts)
    assert {(r.provider, r.item_index): r.in_a_row for r in got.collect()} == want and set(got.columns) == {"provider", "item_index", "failed", "reason", "retry_class", "in_a_row"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert batch.replay(none).count() == 0 and batch.consecutive_failures(none).count() == 0


def test_one_source_with_a_million_items_lies_in_many_tasks(spark):
    million = spark.range(1_000_000).selectExpr("'p' provider", "id item_index", "id % 3 <> 0 failed", "cast(null as string) reason", "'retryable' retry_class")
    sizes = scan.blocks(million, "provider", "item_index", 16).groupBy("part").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 150_000
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = batch.replay(million.where("item_index < 100000"), parts=16).withColumn("task", F.spark_partition_id())
        assert got.select("task").distinct().count() >= 3 and got.count() == 100_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_sources_are_composed_in_many_tasks(spark):
    many = spark.range(4000).selectExpr("concat('s', id % 500) provider", "id item_index", "id % 3 <> 0 failed", "cast(null as string) reason", "'retryable' retry_class")
    plan = batch.replay(many)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "hashpartitioning(source#" in plan and f", {4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan
