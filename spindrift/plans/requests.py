"""Queries over many requests at once: policies, and answers from request to ranked record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import answer, links, policies, presets, resolve
from spindrift.sources import catalog, sinks
from spindrift.sources import page_sources as P

from .evidence import _own_pages
from .queries import _facts, _link, _stream
from .records import flat, read


def _choice(key: Column, *values: str | None) -> Column:
    """One of the texts by the key's remainder."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values)).cast("int"))


# What customers ask for, by their keys: field policies and run policies as JSON.
POLICIES = ('{"Title":["dmm"," JAVDB "],"outline":"fc2","release":["javdb","x"]}', None, "{}", '"text"', '{"runtime minutes":["xcity","dmm"],"overview":["prestige"],"tag":[]}')
RUNS = (None, '{"provider_execution_policy":{"disabled_provider_ids":[" JavDB ","javdb","dmm"],"max_selected_providers":"2"}}', '{"provider_run_policy":{"suppressed_provider_ids":"fc2","max_selected_providers_per_item":0}}', '{"disabled_provider_ids":["xcity",7," "]}', '{"provider_execution_policy":{"max_selected_providers":5}}')
SOURCES = ("dmm", "javdb", "fc2", "xcity", "prestige")


def policy_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as facts, fused by priority under that customer's own field policy."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), _choice(F.col("c_custkey"), *POLICIES).alias("policy"))
    fields = {"title": "string", "overview": "string", "runtime_minutes": "int", "release_date": "date"}
    assigned, rows = policies.field_policies(c, presets.preferences(spark, catalog.catalog(spark)), list(fields))
    k = F.col("o_orderkey")
    facts = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request"), F.col("o_orderpriority").alias("cluster"), _choice(k, *SOURCES).alias("provider"), F.lpad(k.cast("string"), 12, "0").alias("provider_id"), k.alias("arrival"), (k % 97).cast("int").alias("confidence_milli"),
        F.when(k % 3 != 0, F.concat(F.lit("t"), k.cast("string"))).alias("title"), F.when(k % 2 == 0, F.concat(F.col("o_orderstatus"), k.cast("string"))).alias("overview"), F.when(k % 7 > 2, (k % 200).cast("int")).alias("runtime_minutes"), F.when(k % 5 != 1, F.col("o_orderdate").cast("date")).alias("release_date"),
    ).join(policies.with_listed(assigned, rows), "request")
    keys = ("request", "cluster")
    out = policies.records(policies.chosen_values(facts, F.col("listed"), list(fields), keys), fields, keys)
    return out.select("request", "cluster", F.col("n_facts").cast("bigint").alias("n_facts"), "provider", "provider_id", "title", "overview", "runtime_minutes", F.col("release_date").cast("string").alias("release_date"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests, each with a run policy and a field policy of its own."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    ids = F.array().cast("array<struct<provider:string,value:string>>")
    disabled, most = policies.run_policy(_choice(k, *RUNS), F.array(F.lit("prestige")), F.when(k % 3 == 0, 9))
    return p.select(k.alias("request"), F.col("p_name").alias("query_title"), F.when(F.col("p_size") % 4 != 0, F.lit(1992) + F.col("p_size") % 7).cast("int").alias("query_year"), F.lit("en").alias("query_language"), ids.alias("query_ids"), F.when(k % 4 == 0, "censored").when(k % 4 == 1, "fc2").alias("route"), disabled.alias("disabled"), most.alias("most"), _choice(k, *POLICIES).alias("policy"))


def request_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every request's run does with each source of the catalog."""
    return policies.statuses(_requests(spark, sf_dir), catalog.catalog(spark)).select("request", "ordinal", "provider", "status")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From requests to ranked, fused records (twelve a request: the limit is the feature).

    Parts ask; their lines are the sources' results; lines of one supplier share an
    identifier and so are one entity.
    """
    requests = _requests(spark, sf_dir)
    assigned, rows = policies.field_policies(requests, presets.preferences(spark, catalog.catalog(spark)), list(answer.FIELDS))
    status = policies.statuses(requests, catalog.catalog(spark))
    n = F.col("l_linenumber")
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request"), "p_name", "p_type")
    found = read(spark, sf_dir, "lineitem").join(names, F.col("l_partkey") == F.col("request"))
    # The same order can have a line number twice: an id names more of the line.
    told = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), "l_linenumber", "l_suppkey", (F.col("l_extendedprice") * 100).cast("long"))
    candidates = found.select(
        "request", _choice(F.col("l_orderkey") + n, *SOURCES).alias("provider"), told.alias("provider_id"), (F.col("l_orderkey") * 10 + n).cast("long").alias("arrival"),
        F.array(F.struct(F.lit(" Supp").alias("provider"), F.col("l_suppkey").cast("string").alias("value")), F.struct(F.lit("unknown").alias("provider"), F.lit("1").alias("value"))).alias("ids"),
        F.when(n % 4 == 0, F.col("p_name")).when(n % 4 == 1, F.upper("p_name")).when(n % 4 == 2, F.col("p_type")).alias("title"), F.when(n == 5, F.col("p_name")).alias("original_title"), F.when(n % 2 == 0, F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).alias("overview"),
        F.year("l_shipdate").cast("int").alias("year"), F.when(n != 3, F.col("l_quantity").cast("int")).alias("runtime_minutes"), F.when(F.col("l_returnflag") == "A", "EN").when(F.col("l_returnflag") == "N", "ja_JP").alias("language"),
        (F.col("l_quantity") * 20).cast("int").alias("score_milli"), F.col("l_extendedprice").cast("long").alias("votes"),
    )
    capabilities = spark.createDataFrame([("supp",)], "id_provider string")
    out = answer.answers(requests.drop("policy", "disabled", "most", "route"), candidates, status, assigned, rows, capabilities)
    return out.select("request", "rank", "provider", "provider_id", *answer.FIELDS, F.col("n_facts").cast("bigint").alias("n_facts"), F.array_join("sources", ",").alias("sources"), "confidence_milli", F.array_join("reasons", ",").alias("reasons"))


def link_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer searches links, with limits, sources and types of its own; orders and their lines are two sources."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    texts = lambda *values: F.array(*map(F.lit, values)).cast("array<string>")
    types = F.when(k % 4 == 0, texts("quark", "magnet", "web")).when(k % 4 == 1, texts("other")).otherwise(texts())
    asked = c.select(k.alias("request"), F.when(k % 3 == 0, texts("DESK")).when(k % 3 == 1, texts("desk", "line2")).otherwise(texts()).alias("sources"), types.alias("link_types"), (k % 7 - 1).cast("int").alias("limit"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), (F.floor("o_totalprice") % 50).cast("int").alias("score"))
    # What a link says is made after the join, which moves keys alone.
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), "l_partkey", "l_suppkey", (F.col("l_quantity") > 25).alias("guarded")).join(orders, "id")
    lines = lines.select("request", "id", "title", "score", "place", _link(F.col("l_partkey") % 40, F.col("l_partkey")).alias("url"), F.concat(F.lit("line"), F.col("l_suppkey") % 4).alias("provider"), F.when(F.col("guarded"), F.concat(F.lit("pw"), F.col("l_partkey"))).alias("password"), F.concat(F.lit("note "), F.col("l_suppkey")).alias("note"))
    own = orders.select("*", F.lit(0).alias("place"), _link(F.col("id") % 40, F.col("id")).alias("url"), F.lit("desk").alias("provider"), F.lit(None).cast("string").alias("password"), F.concat(F.lit("order "), F.col("id")).alias("note"))
    rows = own.unionByName(lines).withColumn("source", F.col("provider"))
    return links.search(rows, asked).select("request", "normalized_url", "url", "link_type", "password", "note", F.array_join("sources", ",").alias("sources"))


def written_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded writes of customers' records in epochs, each sent twice: what is read back is there once."""
    path, k = resolve.scratch(spark, "written"), F.col("c_custkey")
    c = read(spark, sf_dir, "customer")
    rows = sinks.guarded(c, k % 10 != 0, F.col("c_mktsegment") != "BUILDING", F.when(F.col("c_acctbal") > 0, F.col("c_name"))).select("c_custkey", "submission", "write_status")
    for epoch in (0, 1, 1, 0):
        sinks.write_once(rows.where(k % 2 == epoch), path, epoch)
    return sinks.written(spark, path, "c_custkey long, submission string").select("c_custkey", "submission", "epoch")


def cluster_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' clusters when the documents arrive in three batches; only touched clusters are labelled anew."""
    facts = _facts(spark, sf_dir)
    ids = facts.select("fact", F.explode(F.array("whole", "last")).alias("id")).where("id is not null")
    pairs = resolve.stored(ids.distinct(), "all-pairs")
    of = lambda k: pairs.where(F.col("fact") % 3 == k)
    labels = resolve.clusters(of(0))
    for k in (1, 2):
        labels = resolve.stored(resolve.merged_labels(labels, resolve.extended(labels, pairs.where(F.col("fact") % 3 < k), of(k))), "labels")
    return labels


def stream_all_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 attempts over all providers, from a stream (the bound is the feature)."""
    from spindrift.streaming import history

    with history.with_store(spark):
        out = _stream(spark, sf_dir, "all-history", lambda e: history.attempt_history(e.select(F.col("user_id").alias("provider"), "event_id", F.col("event_type").alias("status")), 20), "update")
    return out.select(F.array_join("event_ids", ",").alias("event_ids"), F.array_join("providers", ",").alias("providers"), F.array_join("statuses", ",").alias("statuses"))


def _flow(spark: SparkSession, sf_dir: str, s: P.Site) -> DataFrame:
    """Candidates of a source of pages, over search and detail pages that parts describe."""
    pages, queries = _own_pages(spark, sf_dir)
    listed = P.searched_links(queries, pages.where(F.col("url").contains("/search")), s) if s.search else None
    return flat(P.candidates(P.targets(queries, listed, s), pages, s))


def rendered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered search page that is never read as a detail page."""
    return _flow(spark, sf_dir, P.site("rendered_search", "https://site.example", "airav", search="/search?q={}", routes=("censored",)))


def numbered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of one kind of number each: one that is searched, and one with detail pages alone; all fields of their candidates."""
    searched = _flow(spark, sf_dir, P.site("jav321", "https://site.example", search="/search?q={}"))
    alone = _flow(spark, sf_dir, P.site("fc2ppvdb", "https://site.example", detail="/v/{}", id_form="[0-9]+", routes=("none",)))
    return searched.unionByName(alone)


def official_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the candidates of a source whose detail pages are asked by number, without a search."""
    pages, queries = _own_pages(spark, sf_dir)
    s = P.site("official", "https://site.example", "caribbean", detail="/v/{}", routes=("censored",), id_form="[0-9]+")
    by_key = queries.withColumn("number", F.when(F.col("number").isNotNull(), F.col("query_id").cast("string")))
    none = spark.createDataFrame([], "url string, position int, href string, text string")
    return flat(P.candidates(P.targets(by_key, none, s), pages, s))


QUERIES = {f.__name__: f for f in (policy_fusion, request_statuses, answers, link_searches, written_rows, cluster_batches, stream_all_history, rendered_candidates, numbered_candidates, official_fields)}
