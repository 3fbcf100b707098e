"""Sequences of a source as parallel scans: blocks are summarised, summaries composed, blocks replayed.

Rows are dealt by range over source and order, so a source with very many rows lies
in many blocks.  A block is what one partition has of one source.  What a block
does to the state before it is a small map; maps compose, and a source has at
most one block a partition, so only their composition is sequential.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resolve import stored


def blocks(rows: DataFrame, source: str, order: str, parts: int | None = None) -> DataFrame:
    """The rows with part, the number of their range; written, so that every pass sees the same blocks.

    parts: how many ranges; else the session's shuffle partitions, merged where they are small.
    """
    dealt = rows.repartitionByRange(*([parts] if parts else []), source, order)
    return stored(dealt.withColumn("part", F.spark_partition_id()), "blocks")


def streaks(rows: DataFrame, source: str, order: str, flag: str, parts: int | None = None) -> DataFrame:
    """Adds in_a_row: how many rows in a row, up to each one, have the flag; a row without it starts anew."""
    dealt = blocks(rows, source, order, parts)
    own = Window.partitionBy(source, "part")
    island = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marked = dealt.withColumn("island", island)
    # A block's carry: all its rows if all have the flag, else those after its last row without it.
    sums = marked.groupBy(source, "part", "island").agg(F.count_if(flag).alias("n")).groupBy(source, "part").agg(F.max("island").alias("islands"), F.max_by("n", "island").alias("tail"))
    # Blocks in which every row has the flag pass on what came before; the others cut it off.
    before = Window.partitionBy(source).orderBy("part")
    run = sums.withColumn("cut", F.sum(F.when(F.col("islands") > 0, 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    last = F.last(F.when(F.col("islands") > 0, F.col("tail")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    within = F.sum(F.when(F.col("islands") == 0, F.col("tail")).otherwise(0)).over(Window.partitionBy(source, F.coalesce("cut", F.lit(0))).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = run.select(source, "part", (F.coalesce(last, F.lit(0)) + F.coalesce(within, F.lit(0))).alias("carry"))
    place = F.sum(F.col(flag).cast("int")).over(Window.partitionBy(source, "part", "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = marked.withColumn("place", place).join(carried, [source, "part"])
    return joined.withColumn("in_a_row", (F.col("place") + F.when((F.col("island") == 0) & F.col(flag), F.col("carry")).otherwise(0)).cast("long")).drop("island", "place", "carry", "part")


def replayed(rows: DataFrame, source: str, order: str, starts: Callable[[int], list], step: Callable, told: Callable, schema: str, at: Callable, parts: int | None = None, apply: Callable = dict.__getitem__) -> DataFrame:
    """What a finite-state fold says at each row, by source and in order.

    starts(order): the states in which a block can begin whose first row has that
    order; step(state, row) -> (state, outcome); at(state, order): the state as it is
    found before a row of that order; told(row, state, outcome): the result's values
    after source and order, with schema; apply(map, state): the state after a block.
    The first of ``starts`` is where a source begins.
    """
    dealt = blocks(rows, source, order, parts)
    kind, index = (rows.schema[c].dataType.simpleString() for c in (source, order))

    def summarise(batches):
        # Start states that have come to the same state go on as one.
        key, part, first, classes, out = None, None, None, {}, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                own, place = getattr(r, source), int(getattr(r, order))
                if key is None or own != key[0] or int(r.part) != part:
                    if key is not None:
                        out.append((key[0], part, first, [list(map(_number, s)) for s in classes], [list(map(_number, e)) for e in classes.values()]))
                    key, part, first = (own,), int(r.part), place
                    classes = {s: s for s in starts(place)}
                moved = {s: step(at(s, place), r)[0] for s in set(classes.values())}
                classes = {s: moved[e] for s, e in classes.items()}
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=["source", "part", "first", "before", "after"])
                out = []
        if key is not None:
            out.append((key[0], part, first, [list(map(_number, s)) for s in classes], [list(map(_number, e)) for e in classes.values()]))
        yield pd.DataFrame(out, columns=["source", "part", "first", "before", "after"])

    def compose(batches):
        # Blocks of a source lie together, in order.
        key, state = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                known = {_state(b): _state(a) for b, a in zip(r.before, r.after, strict=True)}
                state = at(next(iter(known)) if key != (r.source,) else state, int(r.first))
                key = (r.source,)
                out.append((r.source, r.part, list(map(_number, state))))
                state = apply(known, state)
            yield pd.DataFrame(out, columns=["source", "part", "state"])

    def replay(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                own, place = getattr(r, source), int(getattr(r, order))
                if key != (own, r.part):
                    key, state = (own, r.part), _state(r.state)
                state, outcome = step(at(state, place), r)
                out.append((own, place, *told(r, state, outcome)))
            yield pd.DataFrame(out, columns=[source, order, *(x.split()[0] for x in schema.split(", "))])

    ordered = dealt.repartition("part").sortWithinPartitions("part", source, order)
    summaries = ordered.mapInPandas(summarise, f"source {kind}, part int, first long, before array<array<long>>, after array<array<long>>")
    # Dealt over a fixed number of tasks: summaries are small, so their groups would be left to one.
    by_source = summaries.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "source").sortWithinPartitions("source", "part")
    states = by_source.mapInPandas(compose, f"source {kind}, part int, state array<long>")
    begun = dealt.join(states.withColumnRenamed("source", source), [source, "part"]).repartition(source, "part").sortWithinPartitions(source, "part", order)
    return begun.mapInPandas(replay, f"{source} {kind}, {order} {index}, {schema}")


_NONE = -(1 << 62)


def _number(x: int | None) -> int:
    return _NONE if x is None else int(x)


def _state(values) -> tuple:
    return tuple(None if int(x) == _NONE else int(x) for x in values)
