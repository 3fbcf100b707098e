"""Entity resolution: facts that share an identifier, directly or through others, are one entity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import ascii_lower, trimmed

from .presets import emitted_ids


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, which ``spark.checkpoint.dir`` names.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster that would be each machine's own disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder that all executors share, and read again: cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clusters(ids: DataFrame) -> DataFrame:
    """(fact, cluster): cluster is the least fact that is reachable.

    ids: (fact, id), one row for each identifier of a fact.  Least labels go
    from facts to identifiers and back, and labels take on their own label's
    label, so the rounds grow with the logarithm of a chain.  An identifier
    that very many facts have is reduced by partial aggregation; in the joins that
    follow it meets one row of the other side, and adaptive execution splits it.
    """
    every = ids.where("id is not null").select("fact", "id")
    ends = every.groupBy("id").agg(F.min("fact").alias("near"), F.max("fact").alias("far")).where("near < far").select("id")
    pairs = stored(every.join(ends, "id").select("fact", "id").distinct(), "id-pairs")
    # Facts that share no identifier are clusters of their own, and take no part in the rounds.
    alone = ids.select("fact").distinct()
    labels = _labelled(pairs)
    return stored(alone.join(labels, "fact", "left").select("fact", F.coalesce("cluster", "fact").alias("cluster")), "labels")


def _labelled(pairs: DataFrame) -> DataFrame:
    """(fact, cluster) of the facts in stored (fact, id) pairs."""
    labels = stored(pairs.select("fact").distinct().withColumn("cluster", F.col("fact")), "labels")
    while True:
        by_id = pairs.join(labels, "fact").groupBy("id").agg(F.min("cluster").alias("near"))
        near = pairs.join(by_id, "id").groupBy("fact").agg(F.min("near").alias("near"))
        step = labels.join(near, "fact", "left").select("fact", F.col("cluster").alias("was"), F.least("cluster", F.coalesce("near", "cluster")).alias("cluster"))
        step = stored(step, "labels")
        jump = step.select(F.col("fact").alias("f"), F.col("cluster").alias("further"))
        following = step.join(jump, F.col("cluster") == F.col("f"), "left").select("fact", "was", F.least("cluster", F.coalesce("further", "cluster")).alias("cluster"))
        following = stored(following, "labels")
        labels = following.drop("was")
        if not following.where("was <> cluster").limit(1).count():
            return labels


def extended(labels: DataFrame, pairs: DataFrame, new: DataFrame) -> DataFrame:
    """Labels that change when facts arrive: (fact, cluster) of the new facts and of old ones whose cluster is another now.

    labels: (fact, cluster) so far; pairs: (fact, id) so far; new: (fact, id) that
    arrive, of new facts or of old ones.  Only clusters that a new row touches, by
    its fact or its id, take part: each stands as one node for all its facts, so the
    rounds run over the new rows and the touched clusters alone.
    """
    arrived = stored(new.where("id is not null").select("fact", "id").distinct(), "new-pairs")
    named = stored(new.select("fact").distinct(), "new-facts")
    known = labels.join(named, "fact", "left_semi")
    by_id = pairs.join(arrived.select("id").distinct(), "id", "left_semi").join(labels, "fact").select(F.col("cluster").alias("node"), "id").distinct()
    # An old fact among the new rows is its cluster; a new fact is itself.
    own = arrived.join(known, "fact", "left").select(F.coalesce("cluster", "fact").alias("node"), "id")
    alone = named.join(known, "fact", "left").select(F.coalesce("cluster", "fact").alias("node"))
    lone_id = F.concat(F.lit("\x1fown\x1f"), F.col("node").cast("string")).alias("id")
    edges = own.unionByName(by_id).select("node", F.concat(F.lit("id"), F.col("id").cast("string")).alias("id")).unionByName(alone.select("node", lone_id))
    moved = stored(clusters(edges.select(F.col("node").alias("fact"), "id")), "moved")
    changed = labels.join(moved.where("fact <> cluster").select(F.col("fact").alias("was"), F.col("cluster").alias("now")), F.col("cluster") == F.col("was")).select("fact", F.col("now").alias("cluster"))
    fresh = named.join(known, "fact", "left_anti").join(moved, "fact").select("fact", "cluster")
    return stored(changed.unionByName(fresh), "changed-labels")


def merged_labels(labels: DataFrame, changed: DataFrame) -> DataFrame:
    """The labels after a change."""
    return labels.join(changed.select("fact"), "fact", "left_anti").unionByName(changed)


def identifiers(facts: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(fact, id) rows for ``clusters``: a fact's own provider and id, and its external ids that some source emits.

    facts: fact, provider, provider_id, ids (provider, value structs); capabilities:
    id_provider, one row for each kind of id (empty: all count).  Providers count
    without regard to case, external values too; blank ids do not count.
    """
    key = lambda kind, provider, value: F.concat_ws("\x1f", F.lit(kind), ascii_lower(trimmed(provider)), value)
    own = trimmed(F.col("provider_id"))
    named = facts.select("fact", F.when(own != "", key("own", F.col("provider"), own)).alias("id"))
    outer = facts.select("fact", F.explode("ids").alias("x")).select("fact", ascii_lower(trimmed(F.col("x.provider"))).alias("id_provider"), ascii_lower(trimmed(F.col("x.value"))).alias("value")).where("value <> ''")
    outer = emitted_ids(outer, capabilities)
    return named.unionByName(outer.select("fact", key("id", F.col("id_provider"), F.col("value")).alias("id")))


def shared_ids(facts: DataFrame) -> DataFrame:
    """Identifiers with several sources in a cluster; facts: (cluster, id_provider, id, provider)."""
    return facts.groupBy("cluster", "id_provider", "id").agg(F.countDistinct("provider").alias("source_count")).where("source_count > 1")


def cluster_sources(facts: DataFrame) -> DataFrame:
    """(cluster, n_facts, sources): sorted, empty where there is one source only."""
    found = facts.groupBy("cluster").agg(F.count("*").alias("n_facts"), F.array_sort(F.collect_set("provider")).alias("sources"))
    return found.withColumn("sources", F.when(F.size("sources") > 1, F.col("sources")).otherwise(F.array().cast("array<string>")))
