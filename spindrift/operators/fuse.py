"""Survivorship: one record for each cluster under source preferences by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import policies

# The fields of a record in the order in which their sources are listed.
FIELDS = ("title", "original_title", "sort_title", "overview", "release_date", "runtime_minutes", "tagline", "genres", "tags", "ratings", "images", "credits", "collections", "studios", "external_ids")


def field_sources(record: dict[str, Column], provider: Column, provider_id: Column) -> Column:
    """(field, provider, provider_id) of a record's fields that have a value, in their fixed order.

    Texts count where they are not blank, lists where they are not empty.
    """

    def there(c: Column) -> Column:
        text = c.cast("string")
        return text.isNotNull() & (F.trim(text) != "") & (text != "[]")

    return F.array_compact(F.array(*(F.when(there(record[f]), F.struct(F.lit(f).alias("field"), provider.alias("provider"), provider_id.alias("provider_id"))) for f in FIELDS if f in record)))


def chosen_sources(facts: DataFrame, fused_rows: DataFrame, fields: list[str]) -> DataFrame:
    """(cluster, field, provider): the first fact, by arrival, that has each fused value."""
    own = facts.select("cluster", "provider", "arrival", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x"))
    fused_ = fused_rows.select("cluster", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("y")).where("y.value is not null")
    joined = own.select("cluster", "provider", "arrival", "x.field", "x.value").join(fused_.select("cluster", "y.field", "y.value"), ["cluster", "field", "value"])
    return joined.groupBy("cluster", "field").agg(F.min(F.struct("arrival", "provider")).alias("first")).select("cluster", "field", "first.provider")


def fused(facts: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """One row for each cluster: every field by its preferred providers, else base, else first fact.

    fields: field -> providers in order of preference (empty: base only): the policy
    of all clusters.
    """
    values = policies.fused_by(facts, fields)
    return policies.records(values, {f: facts.schema[f].dataType.simpleString() for f in fields})


def best_artwork(art: DataFrame, key: str = "cluster") -> DataFrame:
    """Of each kind the greatest by confidence, area, provider, id and url."""
    order = F.struct("confidence_milli", "area", "provider", "provider_id", "source_url")
    return art.groupBy(key, "kind").agg(F.max(order).alias("best")).select(key, "kind", "best.*")


def preferred_artwork(art: DataFrame, kinds: dict[str, list[str]], shared: list[str]) -> DataFrame:
    """Artwork of fused records: kinds are chosen apart, each by its own preference list and then the common one.

    art: cluster, kind, provider, url, arrival, base (of the base record).  For a
    kind with a list, the first preferred provider's pictures take the place of
    the base's; other kinds, and kinds for which no preferred provider has one,
    stay as the base has them.
    """
    rank = F.lit(None).cast("int")
    for kind, own in kinds.items():
        order = list(dict.fromkeys([*own, *shared]))
        place = F.lit(None).cast("int")
        for i in range(len(order) - 1, -1, -1):
            place = F.when(F.col("provider") == order[i], i).otherwise(place)
        rank = F.when(F.col("kind") == kind, place).otherwise(rank)
    placed = art.withColumn("place", rank)
    best = placed.groupBy("cluster", "kind").agg(F.min("place").alias("best"))
    kept = placed.join(best, ["cluster", "kind"]).where(F.when(F.col("best").isNotNull(), F.col("place") == F.col("best")).otherwise(F.col("base")))
    return kept.drop("place", "best")
