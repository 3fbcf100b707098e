"""Presets of sources and field policies, and how requests override them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import ascii_lower, non_blank, trimmed

# The sources that each preset enables; "manual" governs none.
PRESETS = {
    "manual": "",
    "fast_safe": "javdb dmm fc2 mgstage prestige theporndb",
    "official_only": "dmm fc2 mgstage prestige caribbean 1pondo 10musume",
    "community_first": "javdb jav321 javbus javlibrary airav avsox dmm xcity fc2 fc2ppvdb mgstage prestige theporndb",
    "fc2_enhanced": "fc2 fc2ppvdb airav avsox",
    "uncensored_official": "caribbean 1pondo 10musume",
}
# Names of field-policy presets.
POLICY_NAMES = {
    "default": "default", "balanced": "default", "recommended": "default", "quality_scores": "quality_scores", "quality_score": "quality_scores",
    "provider_quality": "quality_scores", "none": "none", "empty": "none", "base_only": "none",
}
# What each source is preferred for, and in which place.
DEFAULT_PREFERENCES = {
    "dmm": {"title": 30, "outline": 20, "trailer": 20},
    "jav321": {"title": 50, "outline": 30, "score": 10},
    "javbus": {"title": 40, "tags": 10, "release": 10, "runtime": 10, "directors": 10, "series": 10, "studio": 10, "publisher": 10, "actors": 20, "thumb": 20, "poster": 20, "extrafanart": 10},
    "javdb": {"actors": 40, "wanted": 20, "score": 30, "score_votes": 20},
    "javlibrary": {"title": 60, "actors": 30, "wanted": 10, "score": 20, "score_votes": 10},
    "mgstage": {"title": 20, "trailer": 10},
    "theporndb": {"title": 10, "outline": 10, "actors": 10, "thumb": 10, "poster": 10},
}
# Other names of fields; a field takes its aliases' preferences after its own.
ALIASES = {
    "overview": ("outline",), "release_date": ("release",), "runtime_minutes": ("runtime",), "genres": ("tag",), "tags": ("tag",), "actors": ("actor",),
    "thumb_url": ("thumb",), "extrafanart_urls": ("extrafanart",), "trailer_url": ("trailer",), "wanted_count": ("wanted",), "community_score_milli": ("score",), "community_vote_count": ("score_votes",),
}


def normalized_name(c: Column) -> Column:
    """A preset's name as it is written in settings: trimmed, lower case, dashes and spaces as underscores."""
    return F.translate(ascii_lower(trimmed(c)), "- ", "__")


def policy_preset(c: Column) -> Column:
    """The field-policy preset that a setting names, NULL for others."""
    table = F.create_map(*(F.lit(x) for pair in POLICY_NAMES.items() for x in pair))
    return F.try_element_at(table, normalized_name(c))


def enabled(sources: DataFrame, settings: DataFrame) -> DataFrame:
    """Which sources each setting enables.

    settings: setting, preset, explicit (map of provider to boolean, or NULL).  An
    explicit entry wins over the preset, and the preset only governs the sources
    that have qualities; what neither decides is enabled for ``fixture`` alone.
    """
    table = F.create_map(*(x for name, ids in PRESETS.items() for x in (F.lit(name), F.array(*map(F.lit, ids.split())) if ids else F.array().cast("array<string>"))))
    listed = F.try_element_at(table, normalized_name(F.col("preset")))
    governed = (F.col("official") + F.col("community") + F.col("artwork") + F.col("trailer") > 0) & (F.size(listed) > 0)
    by_preset = F.when(governed, F.array_contains(listed, F.col("provider")))
    decided = F.coalesce(F.try_element_at("explicit", F.col("provider")), by_preset, F.col("provider") == "fixture")
    return settings.join(F.broadcast(sources), how="cross").select("setting", "ordinal", "provider", decided.alias("enabled"))  # 22 sources


def preferences(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(field, providers) of the default policy: by declared place, then catalog order."""
    rows = [(field, place, provider) for provider, fields in DEFAULT_PREFERENCES.items() for field, place in fields.items()]
    declared = spark.createDataFrame(rows, "field string, place int, provider string").join(sources.select("provider", "ordinal"), "provider")
    ordered = F.array_sort(F.collect_list(F.struct("place", "ordinal", "provider")))
    return declared.groupBy("field").agg(ordered.alias("l")).select("field", F.transform("l", lambda x: x["provider"]).alias("providers"))


def with_aliases(policy: DataFrame) -> DataFrame:
    """The policy of every field that has aliases or preferences: its own providers, then its aliases', distinct."""
    table = F.create_map(*(x for f, names in ALIASES.items() for x in (F.lit(f), F.array(*map(F.lit, names)))))
    named = F.explode(F.map_keys(table)).alias("field")
    fields = policy.select("field").unionByName(policy.limit(1).select(named)).distinct()
    wanted = fields.select("field", F.posexplode(F.concat(F.array("field"), F.coalesce(F.try_element_at(table, F.col("field")), F.array().cast("array<string>")))).alias("place", "name"))
    lists = wanted.join(policy.withColumnRenamed("field", "name"), "name").groupBy("field").agg(F.array_sort(F.collect_list(F.struct("place", "providers"))).alias("l"))
    return lists.select("field", F.array_distinct(F.flatten(F.transform("l", lambda x: x["providers"]))).alias("providers"))


def request_policy(policy: Column, default: Column) -> Column:
    """A request's field policy (JSON): an object takes the default's place whole, anything else leaves it.

    Blank fields and empty lists are dropped; a provider may stand alone instead of in a list.
    """
    v = F.try_parse_json(policy)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    listed = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))
    texts = lambda x: F.array_compact(F.transform(F.filter(listed(x), lambda y: F.schema_of_variant(y) == "STRING"), lambda y: ascii_lower(non_blank(F.try_variant_get(y, "$", "string")))))
    named = F.transform(entries, lambda e: F.struct(normalized_name(e["key"]).alias("key"), F.array_distinct(texts(e["value"])).alias("value")))
    kept = F.filter(named, lambda e: (e["key"] != "") & (F.size(e["value"]) > 0))
    return F.when(is_object, F.map_from_entries(kept)).otherwise(default)


def emitted_ids(facts: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Facts' ids whose provider some source emits; an empty catalog lets all pass.

    facts: fact, id_provider, id; capabilities: id_provider, one row each.
    """
    known = capabilities.select("id_provider").distinct()
    if not known.limit(1).count():
        return facts
    return facts.join(F.broadcast(known), "id_provider", "left_semi")  # one row for each kind of id in the catalog
