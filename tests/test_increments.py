"""Clusters that take new facts, and writes that count once."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import resolve
from spindrift.sources import sinks

PAIRS = "fact long, id string"


def plain(pairs):
    """Least reachable fact of every fact, by union and find."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for fact, i in pairs:
        a, b = root(("f", fact)), root(("i", i) if i is not None else ("f", fact))
        if a != b:
            up[max(a, b)] = min(a, b)
    least = {}
    for kind, fact in list(up):
        if kind == "f":
            r = root((kind, fact))
            least[r] = min(fact, least.get(r, fact))
    return {fact: least[root(("f", fact))] for kind, fact in list(up) if kind == "f"}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_the_whole(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.choice([None, *(f"k{rng.randrange(45)}" for _ in range(3))])) for _ in range(75)]
    cuts = [0, 20, 45, 75]
    labels = spark.createDataFrame([], "fact long, cluster long")
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        old, new = spark.createDataFrame(rows[:lo], PAIRS), spark.createDataFrame(rows[lo:hi], PAIRS)
        changed = resolve.extended(labels, old, new)
        before = dict(map(tuple, labels.collect()))
        got = dict(map(tuple, changed.collect()))
        want = plain(rows[:hi])
        assert got == {f: c for f, c in want.items() if before.get(f) != c}  # what is not touched is not written again
        labels = resolve.stored(resolve.merged_labels(labels, changed), "labels")
        assert dict(map(tuple, labels.collect())) == want


def test_a_fact_that_bridges_two_clusters(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (9, "z")], PAIRS)
    changed = resolve.extended(resolve.clusters(old), old, spark.createDataFrame([(5, "b"), (5, "a"), (7, None)], PAIRS))
    assert dict(map(tuple, changed.collect())) == {2: 1, 3: 1, 5: 1, 7: 7}


ROWS = "id long, write_status string"


def read(spark, path):
    return sorted((r.id, r.epoch) for r in sinks.written(spark, path, "id long").collect())


def test_an_epoch_counts_once(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(1, "submitted"), (2, "failed"), (3, "submitted")], ROWS)
    assert sinks.write_once(rows, path, 0) and not sinks.write_once(rows, path, 0) and sinks.write_once(rows, path, 1)
    assert read(spark, path) == [(1, 0), (1, 1), (3, 0), (3, 1)]


def test_a_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    rows = spark.createDataFrame([(k, "submitted") for k in range(5)], ROWS)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "commit", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            sinks.write_once(rows, path, 7)
    assert spark.read.parquet(f"{path}/rows").count() == 5  # what the first attempt left
    assert sinks.write_once(rows, path, 7) and not sinks.write_once(rows, path, 7)
    assert read(spark, path) == [(k, 7) for k in range(5)] and spark.read.parquet(f"{path}/rows").count() == 10


def test_a_stream_batch_that_is_replayed(spark, tmp_path):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    spark.range(4).selectExpr("id", "if(id % 2 = 0, 'submitted', 'skipped') write_status").write.parquet(source)

    def run(checkpoint):
        q = spark.readStream.schema(ROWS).parquet(source).writeStream.foreachBatch(lambda df, epoch: sinks.write_once(df, path, epoch) or None).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()

    run("a")
    run("lost")  # a checkpoint that was lost sends the same epoch again
    assert read(spark, path) == [(0, 0), (2, 0)]
    assert sinks.commits(spark, path).where(F.col("epoch") == 0).count() == 1


def test_facts_that_share_nothing_take_no_part_in_the_rounds(spark, monkeypatch):
    from spindrift.operators import resolve

    sizes = {}
    stored = resolve.stored
    monkeypatch.setattr(resolve, "stored", lambda df, name: sizes.setdefault(name, []).append(df.count()) or stored(df, name))
    rows = [(k, f"own{k}") for k in range(50)] + [(3, "x"), (7, "x"), (7, "y"), (9, "y"), (60, None)]
    got = {r.fact: r.cluster for r in resolve.clusters(spark.createDataFrame(rows, "fact long, id string")).collect()}
    assert got == {k: 3 if k in (3, 7, 9) else k for k in (*range(50), 60)}
    assert sizes["id-pairs"] == [4] and set(sizes["labels"][:-1]) == {3}


def test_a_title_that_many_share_meets_its_best_alone(spark):
    from spindrift.operators import lookups

    rows = [("t", k, k % 50) for k in range(200)] + [("u (x)", 7, 99), ("u", 300, 98), ("u", 7, 1), ("t", 400, 60), ("u (x)", 400, 70), ("u", 301, 5)]
    index = spark.createDataFrame(rows, "search_title string, id long, score int")
    kept = lookups.leading(index, 3)
    assert kept.count() == 10 and kept.where("search_title = 't'").count() == 5  # the best three, and ids 7 and 400 of several titles
    queries = spark.createDataFrame([(1, "t"), (2, "u (x)")], "query_id long, title string")
    detail = spark.createDataFrame([], "asked long, id long, failed boolean")
    out = lookups.search_and_enrich(queries, index, detail, spark.createDataFrame([], "variant string"))
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {1: [400, 49, 99], 2: [7, 300, 400]}
