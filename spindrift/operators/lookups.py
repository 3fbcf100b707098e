"""Lookups of records by id and by number, and unions of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import search_title_variants, trimmed


def first_direct(attempts: DataFrame, records: DataFrame, query: str = "query_id", key: str = "id", order: str = "attempt") -> DataFrame:
    """The record of the first attempt, in order, that finds one; queries without any are gone."""
    found = attempts.join(records, key)
    columns = [c for c in found.columns if c not in (query, order)]
    return found.groupBy(query).agg(F.min(F.struct(order, *columns)).alias("first")).select(query, F.col(f"first.{order}").alias(order), *(F.col(f"first.{c}").alias(c) for c in columns))


def by_external_id(queries: DataFrame, *tables: DataFrame, on: str = "external_id", kind: str = "kind") -> DataFrame:
    """The entity that an external id leads to, with its kind: in the first table that has it, else the next.

    Of several rows of an id the least entity, and of that the least kind, counts.
    """
    out = queries
    for i, t in enumerate(tables):
        out = out.join(t.groupBy(on).agg(F.min(F.struct("entity", F.col(kind).alias("kind"))).alias(f"found_{i}")), on, "left")
    pick = lambda name: F.coalesce(*(F.col(f"found_{i}.{name}") for i in range(len(tables)))).alias(name)
    return out.select(*queries.columns, pick("entity"), pick("kind"))


def enriched(search: DataFrame, detail: DataFrame) -> DataFrame:
    """Search results with their details and an outcome: enriched, or degraded with the reason.

    search: id; detail: asked (the id that was asked for), id (the answer's), failed.
    """
    d = detail.select("asked", F.col("id").alias("detail_id"), "failed", *(F.col(c).alias(f"detail_{c}") for c in detail.columns if c not in ("asked", "id", "failed")))
    joined = search.join(d, F.col("id") == F.col("asked"), "left")
    reason = (
        F.when(F.col("asked").isNull(), "no_detail").when(F.col("failed"), "enrichment_failed")
        .when(~F.col("detail_id").eqNullSafe(F.col("id")), "id_mismatch")
    )
    outcome = F.when(reason.isNull(), "enriched").otherwise("degraded")
    return joined.withColumns({"outcome": outcome, "degraded_by": reason}).drop("asked", "failed")


def union_by_variant(variants: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Distinct results over all title variants: of each key the first one counts."""
    columns = [c for c in variants.columns if c not in (*key, *order)]
    return variants.groupBy(*key).agg(F.min(F.struct(*order, *columns)).alias("first")).select(*key, *(F.col(f"first.{c}").alias(c) for c in (*order, *columns)))


def leading(index: DataFrame, most: int) -> DataFrame:
    """The rows of an index (search_title, id, score) that can be among a query's best ``most``.

    An id with one title has one score, so of a title's ids only the best can be among
    any query's best, in whichever variant it is met.  An id with several titles counts
    by its first variant; such ids all stay.
    """
    own = index.groupBy("search_title", "id").agg(F.min("score").alias("score"))
    titles = own.groupBy("id").agg(F.min("search_title").alias("a"), F.max("search_title").alias("b"))
    told = own.join(titles, "id").select("search_title", "id", "score", (F.col("a") < F.col("b")).alias("several"))
    order = Window.partitionBy("search_title").orderBy(F.col("score").desc(), "id")
    best = told.where("not several").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")
    return best.unionByName(told.where("several")).select("search_title", "id", "score")


def search_and_enrich(queries: DataFrame, index: DataFrame, detail: DataFrame, failed: DataFrame, most: int = 3) -> DataFrame:
    """Records of each query's title variants, the best ``most`` of them enriched or degraded.

    queries: query_id, title; index: search_title, id, score; detail: as in
    ``enriched``; failed: variant texts whose search failed.  A query of which some
    variants failed is partial; one of which all failed has the outcome search_failed.
    """
    variants = queries.select("query_id", F.posexplode(search_title_variants(F.col("title"))).alias("place", "variant"))
    tried = variants.join(failed.select(F.col("variant").alias("f")).distinct(), F.col("variant") == F.col("f"), "left")
    state = tried.groupBy("query_id").agg(F.count("*").alias("n"), F.count("f").alias("n_failed"))
    hits = tried.where("f is null").join(leading(index, most), F.col("variant") == F.col("search_title")).select("query_id", "id", "place", "score")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    top = union_by_variant(hits, ["query_id", "id"], ["place"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    found = enriched(top, detail).join(state.select("query_id", (F.col("n_failed") > 0).alias("partial")), "query_id")
    none = state.where("n = n_failed").select("query_id", F.lit("search_failed").alias("outcome"), F.lit(True).alias("partial"))
    return found.unionByName(none, allowMissingColumns=True)


def with_known(commands: DataFrame, targets: DataFrame, key: str = "target_id") -> DataFrame:
    """Adds known: whether a command's target is one of the targets."""
    named = targets.select(F.col(key).alias("_known")).distinct()
    return commands.join(named, F.col(key) == F.col("_known"), "left").withColumn("known", F.col("_known").isNotNull()).drop("_known")


def distinct_targets(targets: DataFrame, key: str = "target_id", order: str = "ordinal") -> DataFrame:
    """Targets with ids that are not blank, the first of each id, in order."""
    there = targets.withColumn(key, trimmed(F.col(key))).where(F.col(key) != "")
    return union_by_variant(there, [key], [order])


def manual_and_discovered(manual: DataFrame, discovered: DataFrame, live: bool) -> DataFrame:
    """The target list: manual ones, then discovered ones where discovery is on; the first of each id."""
    placed = manual.withColumn("origin", F.lit("manual"))
    if live:
        placed = placed.unionByName(discovered.withColumn("origin", F.lit("discovered")))
    ranked = placed.withColumn("place", F.struct((F.col("origin") != "manual").alias("late"), "ordinal"))
    return distinct_targets(ranked, order="place").drop("place")


def positive_ids(ids: Column, provider: str) -> Column:
    """Distinct ids above 0 that (provider, value) structs of a provider hold, in order."""
    own = F.filter(ids, lambda x: F.lower(x["provider"]) == provider)
    numbers = F.transform(own, lambda x: F.when(trimmed(x["value"]).rlike("^[0-9]{1,18}$"), trimmed(x["value"]).cast("bigint")))
    return F.array_distinct(F.filter(numbers, lambda n: n > 0))


def by_priority(sources: DataFrame, priority: str = "priority", order: str = "ordinal") -> DataFrame:
    """Adds place: priority falling, then the given order; one row for each source, so one window holds it."""
    return sources.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(priority).desc(), order)))
