"""Requests' own policies as rows: which sources run for a request, and whose values its record takes.

A policy is a table, not a part of the plan, so requests under many policies are
answered in one job.  Requests that say the same share a policy's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from spindrift.functions.text import ascii_lower, non_blank, trimmed

from . import presets

#: The policy of requests that name none.
DEFAULT = "default"


def field_policies(requests: DataFrame, default: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Which policy each request has, and the preferences of every policy.

    requests: request, policy (JSON; an object takes the default's place whole);
    default: field, providers.  Gives (request, policy) and (policy, field, source,
    rank), with a record's fields under all their names: a field's own sources come
    first, then those of its other names, each source once.
    """
    parsed = requests.select("request", presets.request_policy(F.col("policy"), F.lit(None).cast("map<string,array<string>>")).alias("own"))
    listed = F.array_sort(F.map_entries("own"))
    told = parsed.withColumn("policy", F.when(F.col("own").isNull(), DEFAULT).otherwise(F.md5(F.to_json(listed).cast("binary"))))
    own = told.where("own is not null").groupBy("policy").agg(F.first("own").alias("own"))
    names = own.select("policy", F.explode("own").alias("name", "sources")).unionByName(default.select(F.lit(DEFAULT).alias("policy"), F.col("field").alias("name"), F.col("providers").alias("sources")))
    wanted = [(field, place, name) for field in fields for place, name in enumerate((field, *presets.ALIASES.get(field, ())))]
    wanted = F.broadcast(requests.sparkSession.createDataFrame(wanted, "field string, place int, name string"))  # a record's fields
    placed = names.join(wanted, "name").select("policy", "field", "place", F.posexplode("sources").alias("i", "source"))
    rank = F.min(F.struct("place", "i")).alias("x")
    rows = placed.groupBy("policy", "field", "source").agg(rank).select("policy", "field", "source", (F.col("x.place").cast("long") * 65536 + F.col("x.i")).alias("rank"))
    return told.select("request", "policy"), rows


def _variant(df: DataFrame, field: str) -> Column:
    nested = isinstance(df.schema[field].dataType, ArrayType | MapType | StructType)
    return F.to_variant_object(F.col(field)) if nested else F.col(field).cast("variant")


def fused_values(facts: DataFrame, rows: DataFrame, fields: list[str], keys: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """(keys, field, n_facts, base, value, provider): every field of every cluster under its facts' policy.

    facts: policy, keys, provider, provider_id, arrival, confidence_milli and the
    fields; rows: policy, field, source, rank.  A cluster of several facts takes the
    value of the first preferred source that has one, else the base fact's own, else,
    where the policy names sources for the field, the first fact's that has one.  The
    base is the fact with the greatest confidence, then least provider, id and arrival.

    Cells meet the preferences of their policy and field: a small table is broadcast by
    the planner from its measured size, a large one is joined by key, and what a common
    policy and field make hot is split by adaptive execution.  Where facts come with
    their preferences, or all have the same, ``chosen_values`` joins nothing.
    """
    # Joined by one key of both, so that each side has a shuffle of its own: only such sides are split.
    at = F.concat_ws("\x1f", "policy", "field").alias("at")
    listed = rows.groupBy("policy", "field").agg(F.map_from_entries(F.collect_list(F.struct("source", "rank"))).alias("ranks")).select(at, "ranks")
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), _variant(facts, f).alias("value")) for f in fields))).alias("x")
    cells = facts.select("policy", *keys, "provider", "provider_id", "arrival", "confidence_milli", values).select("*", "x.*").drop("x")
    joined = cells.select("*", at).join(listed, "at", "left")
    return _best(joined.withColumns({"rank": F.try_element_at("ranks", F.col("provider")), "is_listed": F.col("ranks").isNotNull()}), keys)


def with_listed(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds listed, what each row's policy prefers: field -> source -> rank (NULL: nothing)."""
    own = rows.groupBy("policy", "field").agg(F.map_from_entries(F.collect_list(F.struct("source", "rank"))).alias("ranks"))
    listed = own.groupBy("policy").agg(F.map_from_entries(F.collect_list(F.struct("field", "ranks"))).alias("listed"))
    return df.join(listed, "policy", "left")


def fused_by(facts: DataFrame, preferred: dict[str, list[str]], keys: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """``fused_values`` under one policy for all facts, which is a part of the plan: nothing is joined."""
    ranks = {f: F.create_map(*(x for k, s in enumerate(dict.fromkeys(sources)) for x in (F.lit(s), F.lit(k).cast("long")))) for f, sources in preferred.items() if sources}
    none = F.lit(None).cast("map<string,map<string,bigint>>")
    listed = F.create_map(*(x for f, r in ranks.items() for x in (F.lit(f), r))) if ranks else none
    return chosen_values(facts, listed, list(preferred), keys)


def chosen_values(facts: DataFrame, listed: Column, fields: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Every field's value of every cluster; listed: field -> source -> rank of a fact's policy."""
    # A fact's own place among its policy's sources, for all fields, so that cells carry a number and no map.
    ranks = F.array(*(F.try_element_at(F.try_element_at(listed, F.lit(f)), F.col("provider")).alias(f) for f in fields))
    named = F.array(*(F.coalesce(F.map_contains_key(listed, F.lit(f)), F.lit(False)) for f in fields))
    placed = facts.select(*keys, "provider", "provider_id", "arrival", "confidence_milli", ranks.alias("_ranks"), named.alias("_named"), *(_variant(facts, f).alias(f"_v{i}") for i, f in enumerate(fields)))
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_v{i}").alias("value"), F.get("_ranks", F.lit(i)).alias("rank"), F.get("_named", F.lit(i)).alias("is_listed")) for i, f in enumerate(fields)))).alias("x")
    joined = placed.select(*keys, "provider", "provider_id", "arrival", "confidence_milli", values).select("*", "x.*").drop("x")
    return _best(joined, keys)


def _best(joined: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each cluster and field of cells with their source's rank."""
    said, text = F.struct("value", "provider"), F.col("value").cast("string").alias("text")  # the text only settles ties
    there = F.col("value").isNotNull()
    base = F.struct((-F.col("confidence_milli")).alias("c"), "provider", "provider_id", "arrival", text)
    preferred = F.when(there & F.col("rank").isNotNull(), F.struct("rank", "arrival", text))
    found = joined.groupBy(*keys, "field").agg(
        F.count("*").alias("n_facts"), F.min(base).alias("base"), F.max("is_listed").alias("is_listed"),
        F.min_by(said, base).alias("own"), F.min_by(said, preferred).alias("best"), F.min_by(said, F.when(there, F.struct("arrival", text))).alias("first"),
    )
    own = F.when(F.col("own.value").isNotNull(), F.col("own"))
    several = F.coalesce(F.col("best"), own, F.when(F.col("is_listed"), F.col("first")))
    chosen = F.when(F.col("n_facts") > 1, several).otherwise(own)
    return found.withColumn("chosen", chosen).select(*keys, "field", "n_facts", F.col("base.provider").alias("base_provider"), F.col("base.provider_id").alias("base_id"), F.col("chosen.value").alias("value"), F.col("chosen.provider").alias("provider"))


def records(values: DataFrame, types: dict[str, str], keys: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """The long rows of ``fused_values`` as one record a cluster, with the fields' types and the base's identity."""
    of = lambda f: F.any_value(F.when(F.col("field") == f, F.col("value")), ignoreNulls=F.lit(True))
    wide = values.groupBy(*keys).agg(F.max("n_facts").alias("n_facts"), F.min("base_provider").alias("provider"), F.min("base_id").alias("provider_id"), *(of(f).alias(f) for f in types))
    return wide.select(*keys, "n_facts", "provider", "provider_id", *(F.try_variant_get(F.col(f), "$", t).alias(f) for f, t in types.items()))


def run_policy(payload: Column, disabled: Column, most: Column) -> tuple[Column, Column]:
    """The disabled sources and the budget of a request's payload (JSON), over the defaults.

    An object under either of its names holds both; without one only a list of
    disabled sources counts.  A budget of 0 is none.
    """
    v = F.try_parse_json(payload)
    at = lambda path: F.try_variant_get(v, path, "variant")
    named = F.coalesce(at("$.provider_execution_policy"), at("$.provider_run_policy"))
    is_object = F.coalesce(F.schema_of_variant(named).startswith("OBJECT"), F.lit(False))
    member = lambda x, *names: F.coalesce(*(F.try_variant_get(x, f"$.{n}", "variant") for n in names))
    ids = F.when(is_object, member(named, "disabled_provider_ids", "suppressed_provider_ids")).otherwise(member(v, "disabled_provider_ids", "suppressed_provider_ids"))
    listed = F.coalesce(F.try_variant_get(ids, "$", "array<variant>"), F.array(ids))
    texts = F.transform(F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: ascii_lower(non_blank(F.try_variant_get(x, "$", "string"))))
    asked = F.when(is_object, member(named, "max_selected_providers", "max_selected_providers_per_item"))
    number = F.when(F.schema_of_variant(asked).isin("BIGINT", "STRING"), trimmed(F.try_variant_get(asked, "$", "string")).try_cast("int"))
    budget = F.coalesce(F.when(number >= 0, number), most)
    return F.array_union(disabled, F.coalesce(F.array_compact(texts), F.array().cast("array<string>"))), F.when(budget > 0, budget)


def statuses(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """(request, ordinal, provider, status): what every request's run does with each source.

    requests: request, disabled, route (NULL: all), most (NULL: no budget).  The
    catalog is a bounded table, and the window of a request holds one row a source.
    """
    rows = requests.join(F.broadcast(sources), how="cross")
    skip = F.when(F.array_contains("disabled", F.col("provider")), "suppressed").when(F.col("route").isNotNull() & ~F.array_contains("routes", F.col("route")), "skipped_by_route")
    marked = rows.withColumn("skip", skip)
    place = F.sum(F.when(F.col("skip").isNull(), 1).otherwise(0)).over(Window.partitionBy("request").orderBy("ordinal"))
    return marked.select("request", "ordinal", "provider", F.coalesce("skip", F.when(place > F.col("most"), "budget_exhausted").otherwise("selected")).alias("status"))
