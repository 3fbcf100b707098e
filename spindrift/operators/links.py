"""Link search: filter, order, limit, then merge links by normalized URL and group them by type.

Links are rows (id, title, score, place, url, source); results are what rows of
one id have in common.  Only the aggregations shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import ascii_lower, trimmed
from spindrift.functions.urls import LINK_TYPES, host, normalized, type_of, without_fragment

from .resolve import stored


def typed(rows: DataFrame, link_types: list[str] | None = None) -> DataFrame:
    """Adds normalized_url and link_type; links of other types, and results without links, are gone."""
    # Each step names the one before several times, so each is a projection of its own.
    rows = rows.withColumn("url", trimmed(F.col("url"))).withColumns({"_plain": without_fragment(F.col("url")), "_low": ascii_lower(F.col("url"))})
    rows = rows.where("_plain <> ''").withColumns({"normalized_url": normalized(F.col("_plain")), "_host": host(F.col("_low"))})
    rows = rows.withColumn("link_type", type_of(F.col("_low"), F.col("_host"))).drop("_plain", "_low", "_host")
    return rows.where(F.col("link_type").isin(*link_types)) if link_types else rows


def best(rows: DataFrame, limit: int, link_types: list[str] | None = None, most: int = 100) -> DataFrame:
    """Typed links of the best results: score, then title and id; the limit lies between 1 and ``most``.

    Only results that have a wanted link count.  They are found first; then the
    links of those alone are typed for the result.
    """
    # Whether a result has a wanted link is aggregated, not filtered: a filter on the type would be
    # pushed below the steps that make it and repeat them for every host.
    wanted = F.max(F.col("link_type").isin(*link_types) if link_types else F.lit(True)).alias("wanted")
    found = typed(rows).groupBy("score", "title", "id").agg(wanted).where("wanted")
    results = found.orderBy(F.col("score").desc(), "title", "id").limit(max(1, min(limit, most)))
    chosen = rows.join(F.broadcast(results.select("id")), "id", "left_semi")  # at most ``most`` results
    # Written, as the filter on the type would else be pushed below the join and type every link anew, with each step repeated.
    return typed(stored(chosen, "best"), link_types)


#: What a merged link takes from its first link, where the rows have it.
TOLD = ("url", "link_type", "password", "note", "title")


def merged(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each normalized URL (of each key): what its first link says, and all its sources, sorted.

    The first link is that of the best result: score, title, id, then its place there.
    """
    told = [c for c in TOLD if c in rows.columns and c != "title"]
    first = F.min(F.struct((-F.col("score")).alias("s"), "title", "id", "place", *told)).alias("first")
    return rows.groupBy(*keys, "normalized_url").agg(first, F.array_sort(F.collect_set("source")).alias("sources")).select(*keys, "normalized_url", *(f"first.{c}" for c in told), "sources")


def search(rows: DataFrame, requests: DataFrame, most: int = 100) -> DataFrame:
    """Merged links of the best results of every request.

    rows: request, provider, id, title, score, place, url, source and, if they are
    there, password and note: the links of all sources' results; requests: request,
    sources and link_types (empty: all), limit (held between 1 and ``most``).

    A request's sources are asked, links of its types remain, results that have one
    are ordered by score, title and id, and the first ``limit`` of them give their
    links, merged by normalized URL.  No request needs more than ``most`` results, so
    every task passes on that many of a request at most, however many it has.
    """
    asked = rows.join(requests.select("request", "sources", "link_types"), "request").where(source_requested(F.col("sources"), F.col("provider")))
    wanted = lambda df: df.where((F.size("link_types") == 0) | F.array_contains("link_types", F.col("link_type")))
    results = wanted(typed(asked)).groupBy("request", "score", "title", "id").agg(F.count("*").alias("n_links"))
    order = Window.partitionBy("request").orderBy(F.col("score").desc(), "title", "id")
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    limits = requests.select("request", F.greatest(F.lit(1), F.least(F.col("limit"), F.lit(most))).alias("limit"), "link_types")
    best = ranked.join(limits, "request").where("rank <= limit").select("request", "id", "score", "title", "link_types")
    # A result is there once, so this is a semi join; as one it would be pushed below the choice of sources, and all links be shuffled.
    # Types come with the results, so that only their links are typed.
    chosen = asked.drop("link_types").join(best, ["request", "id", "score", "title"])
    return merged(wanted(typed(chosen)), "request")


def grouped(links: DataFrame) -> DataFrame:
    """The links with their type's declared order, by type and then normalized URL.

    Rows stay rows: a type's links are never gathered into one value.
    """
    order = F.array_position(F.array(*map(F.lit, LINK_TYPES)), F.col("link_type")).cast("int")
    return links.withColumn("type_order", order).orderBy("type_order", "normalized_url")


def type_summary(links: DataFrame) -> DataFrame:
    """Count, ends and total length of each type's links."""
    order = F.array_position(F.array(*map(F.lit, LINK_TYPES)), F.col("link_type")).cast("int")
    totals = (F.count("*").alias("n_links"), F.min("normalized_url").alias("first_url"), F.max("normalized_url").alias("last_url"), F.sum(F.length("normalized_url")).cast("bigint").alias("chars"))
    return links.groupBy("link_type").agg(*totals).withColumn("type_order", order)


def source_requested(sources: Column, provider: Column) -> Column:
    return (F.size(sources) == 0) | F.exists(sources, lambda s: ascii_lower(s) == ascii_lower(provider))
