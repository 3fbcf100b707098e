"""The catalog of sources: order, qualities, routes, and the policies made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROUTES = ("censored", "uncensored", "fc2", "amateur", "western", "domestic", "unknown")
# Source, qualities (official, community, artwork, trailer) and routes ("" for all).
SOURCES = (
    ("theporndb", 700, 700, 750, 700, "censored uncensored western unknown"),
    ("prestige", 650, 450, 650, 650, "censored"),
    ("caribbean", 620, 400, 620, 620, "uncensored"),
    ("1pondo", 620, 400, 620, 620, "uncensored"),
    ("10musume", 620, 400, 620, 620, "uncensored"),
    ("dmm", 600, 500, 600, 500, "censored"),
    ("xcity", 560, 300, 560, 200, "censored amateur"),
    ("mgstage", 550, 450, 550, 600, "amateur censored"),
    ("javdb", 500, 550, 500, 400, "censored uncensored amateur western domestic unknown"),
    ("fc2", 450, 350, 450, 300, "fc2"),
    ("jav321", 450, 550, 350, 250, "censored uncensored amateur"),
    ("fc2ppvdb", 430, 450, 450, 350, "fc2"),
    ("airav", 420, 420, 420, 100, "censored uncensored fc2 amateur western"),
    ("javbus", 400, 400, 400, 200, "censored uncensored"),
    ("avsox", 380, 350, 380, 0, "censored uncensored fc2 amateur western"),
    ("javlibrary", 350, 600, 0, 0, "censored uncensored amateur"),
    ("fixture", 0, 0, 0, 0, ""),
    ("tmdb", 0, 0, 0, 0, ""),
    ("bangumi", 0, 0, 0, 0, ""),
    ("browser_worker", 0, 0, 0, 0, ""),
    ("douban", 0, 0, 0, 0, ""),
    ("anilist", 0, 0, 0, 0, ""),
)


def catalog(spark: SparkSession) -> DataFrame:
    """ordinal, provider, the four qualities and the routes that a source serves."""
    rows = [(i, *row[:5], (row[5] or " ".join(ROUTES)).split()) for i, row in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "ordinal int, provider string, official int, community int, artwork int, trailer int, routes array<string>")


def statuses(sources: DataFrame, disabled: list[str], route: Column, most: int | None) -> DataFrame:
    """What a run does with each source: skipped by policy or route, over the budget, or selected.

    Only sources that pass the first two tests count against the budget, in
    catalog order.  The frame has one row for each source, so one window holds it.
    """
    skip = F.when(F.col("provider").isin(*disabled) if disabled else F.lit(False), "suppressed").when(~F.array_contains("routes", route), "skipped_by_route")
    marked = sources.withColumn("skip", skip)
    place = F.sum(F.when(F.col("skip").isNull(), 1).otherwise(0)).over(Window.partitionBy(F.lit(0)).orderBy("ordinal"))
    over = F.lit(False) if most is None else place > most
    return marked.withColumn("status", F.coalesce("skip", F.when(over, "budget_exhausted").otherwise("selected"))).drop("skip")


def assembled(sources: DataFrame, settings: DataFrame) -> DataFrame:
    """Each setting's sources and their states: disabled, unavailable (enabled but not usable) or ready, in catalog order.

    settings: setting, enabled and usable, lists of providers.  The catalog is a bounded table.
    """
    state = F.when(~F.array_contains("enabled", F.col("provider")), "disabled").when(~F.array_contains("usable", F.col("provider")), "unavailable").otherwise("ready")
    return settings.join(F.broadcast(sources), how="cross").select("setting", "ordinal", "provider", state.alias("state"))


def by_quality(sources: DataFrame, quality: str) -> DataFrame:
    """Preference list of a field group: quality falling, then catalog order."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col(quality)).alias("q"), "ordinal", "provider")))
    return sources.where(F.col(quality) > 0).agg(F.transform(listed, lambda x: x["provider"]).alias("providers")).withColumn("field_group", F.lit(quality))


def overlay(disabled: Column, more: Column, most: Column, new_most: Column) -> tuple[Column, Column]:
    """A request's run policy over the default: disabled ids add up, the budget is replaced."""
    return F.array_union(disabled, more), F.coalesce(new_most, most)
