"""From requests to ranked, fused answers.

Search results of all sources are rows; for each request the sources that its run
policy selects count, results that share identifiers become one entity, every
field of the entity comes from the source that the request's field policy prefers,
and the fused records are scored against the request, ranked and cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import policies, rank, resolve

#: A candidate's fields that policies choose between, with their types.
FIELDS = {"title": "string", "original_title": "string", "overview": "string", "year": "int", "runtime_minutes": "int", "language": "string", "score_milli": "int", "votes": "long"}


def answers(requests: DataFrame, candidates: DataFrame, statuses: DataFrame, assigned: DataFrame, rows: DataFrame, capabilities: DataFrame, most: int = rank.MOST) -> DataFrame:
    """The best fused records of every request, with score, outcomes, reasons and sources.

    requests: request, query_title, query_year, query_language, query_ids;
    candidates: request, provider, provider_id, arrival (order within the request; a source gives an id once), ids
    (provider, value structs) and FIELDS; statuses: from ``policies.statuses``;
    assigned, rows: from ``policies.field_policies``; capabilities: as in ``resolve``.

    Entities never reach over requests, so a request is part of every identifier; the
    labels are found together for all requests.
    """
    # A request's sources are as many as the catalog has; by request alone the candidates keep their partitions.
    selected = statuses.where("status = 'selected'").groupBy("request").agg(F.collect_set("provider").alias("_selected"))
    found = candidates.join(selected, "request").where(F.array_contains("_selected", F.col("provider"))).drop("_selected")
    found = resolve.stored(found.withColumn("fact", F.concat_ws("\x1f", "request", F.lpad(F.col("arrival").cast("string"), 12, "0"), "provider", "provider_id")), "found")
    own = resolve.identifiers(found.select(F.struct("request", "fact").alias("fact"), "provider", "provider_id", "ids"), capabilities)
    labels = resolve.clusters(own.select("fact.fact", F.concat_ws("\x1f", "fact.request", "id").alias("id")))
    # Preferences come with the request, so its cells are not dealt by policy.
    asked = requests.join(policies.with_listed(assigned, rows), "request")
    facts = found.join(labels, "fact").join(asked, "request")
    scored = rank.outcomes(facts.withColumn("titles", F.array("title", "original_title"))).select("request", "cluster", "listed", "provider", "provider_id", "arrival", "confidence_milli", "ids", *FIELDS)
    keys = ("request", "cluster")
    # Dealt once as facts: their cells, the records and what is joined to them keep these partitions.
    scored = scored.repartition(*keys)
    fused = policies.records(policies.chosen_values(scored, F.col("listed"), list(FIELDS), keys), FIELDS, keys)
    # The base fact's identifiers stay with the record; sources are those of the entity's facts.
    base = F.min_by("ids", F.struct((-F.col("confidence_milli")).alias("c"), "provider", "provider_id", "arrival"))
    about = scored.groupBy(*keys).agg(base.alias("ids"), F.array_sort(F.collect_set("provider")).alias("sources"))
    again = fused.join(about, [*keys]).join(requests, "request").withColumn("titles", F.array("title", "original_title"))
    best = rank.ranked(rank.outcomes(again), "request", most)
    return rank.with_reasons(best).select("request", "rank", "cluster", "provider", "provider_id", *FIELDS, "n_facts", "sources", "confidence_milli", *rank.PARTS.values(), "reasons")
