"""Queries over pages, policies, batch runs, lookups, payloads and the smaller functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import html as H
from spindrift.functions import text as T
from spindrift.functions import urls as U
from spindrift.functions import values as V
from spindrift.operators import batch, fuse, links, lookups, planning, presets, rank, resolve
from spindrift.sources import catalog, sinks
from spindrift.sources import json_sources as J
from spindrift.sources import page_sources as P

from .records import flat, read, spread


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").where("url is not null")


def html_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic recipe over all pages."""
    p = _pages(spark, sf_dir).select("page_id", H.page_texts("html", "url").alias("f"))
    f = H.recipe(F.col("f"))
    lists = ("genres", "tags", "poster_urls")
    return p.select("page_id", *((F.array_join(c, "|") if n in lists else c).alias(n) for n, c in f.items()))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", H.page_texts("html", "url", "links")["links"].alias("links"))
    return p.select("page_id", F.explode("links").alias("x")).select("page_id", "x.url", "x.text")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines, images and the snapshot text of pages that parts describe."""
    p = spread(read(spark, sf_dir, "part"), "p_partkey")
    html = F.concat(F.lit("<body><ul><li>Maker： "), F.col("p_brand"), F.lit("</li><li>Size: "), F.col("p_size").cast("string"), F.lit("</li></ul><img src='/i.jpg'><a href='/x'><img src=\"//c.example/j.jpg\"></a></body>"))
    f = p.select("p_partkey", H.page_texts(html, F.lit("https://h.example/a/b"), "lines", "images", "body").alias("f"))
    lines = F.array_join(F.transform("f.lines", lambda x: F.concat(x["label"], F.lit("="), x["value"])), "|")
    return f.select("p_partkey", lines.alias("lines"), F.array_join("f.images", "|").alias("images"), H.snapshot_text(F.concat(F.lit(" "), F.col("f.body"), F.lit(" \n"))).alias("text"))


def generic_page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that queries name, by text or by recipe."""
    p = _pages(spark, sf_dir)
    q = p.select(F.col("page_id").alias("query_id"), F.lit("asked").alias("query_title"), F.lit("en").alias("query_language"), F.when(F.col("page_id") % 2 == 0, "recipe").otherwise("text").alias("kind"), F.col("url").alias("source_url"), H.page_texts("html", "url").alias("f"))
    return P.generic(q).select("query_id", "provider_id", "title", "original_title", "outcome", F.col("overview").isNotNull().alias("has_overview"), "language")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page's links, those that a search for its second link's word finds."""
    p = _pages(spark, sf_dir).select("page_id", "url", H.page_texts("html", "url", "links")["links"].alias("links"))
    # A page's word goes with its own links: several pages can have one address.
    found = P.result_links(p.withColumn("word", F.get("links", F.lit(1))["text"]), "page_id", "word")
    return found.where(H.mentions(F.col("text"), F.col("href"), F.col("word"))).select("page_id", "position", "href")


def _own_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Search and detail pages of a site that parts describe, and queries to it."""
    p, key = spread(read(spark, sf_dir, "part"), "p_partkey"), F.col("p_partkey").cast("string")
    number = F.concat(F.lit("ABC-"), (F.col("p_partkey") + 100_000).cast("string"))
    base = F.lit("https://site.example")
    detail = F.concat(
        F.lit("<head><meta property='og:image' content='/p.jpg'></head><body><main><h2>"), F.col("p_name"), F.lit("</h2><ul><li>Number: "), number, F.lit("</li><li>Release Date: 2011-02-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"),
        F.lit("</li><li>Duration: "), F.col("p_size").cast("string"), F.lit(" min</li><li>Maker: "), F.col("p_brand"), F.lit("</li></ul><a href='/actor/1'>One</a><a href='/genre/2'>G1</a><div class='tag'><a href='/x'>G2</a></div><div class='score'>4.5 / 5</div>"),
        F.lit("<div class='sample'><img src='/p.jpg'><img src='/s.jpg'></div><a href='/t.mp4'>t</a></main></body>"),
    )
    listed = F.concat(F.lit("<body><a href='/search/more'>"), number, F.lit("</a><a href='#x'>"), number, F.lit("</a><a href='/v/other'>other</a><a href='/v/"), key, F.lit("'>see "), F.lower(number), F.lit("</a></body>"))
    pages = p.where("p_size % 7 <> 3").select(F.concat(base, F.lit("/v/"), key).alias("url"), detail.alias("html"))
    pages = pages.unionByName(p.select(F.concat(base, F.lit("/search?q="), number).alias("url"), F.when(F.col("p_size") % 5 == 0, detail).otherwise(listed).alias("html")))
    kind = F.col("p_partkey") % 4
    queries = p.select(
        F.col("p_partkey").alias("query_id"), F.when(kind == 0, F.concat(F.lit("/v/"), key)).alias("direct_url"), F.when(kind == 1, key).alias("direct_id"), F.when(kind >= 2, number).alias("number"),
        F.when(F.col("p_size") % 9 == 0, "fc2").otherwise("censored").alias("route"),
    )
    return pages, queries


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of rendered pages: direct address, direct id, search, and the search page itself as a fallback."""
    pages, queries = _own_pages(spark, sf_dir)
    s = P.site("javdb", "https://site.example")
    links_ = P.searched_links(queries, pages.where(F.col("url").contains("/search")), s)
    return flat(P.candidates(P.targets(queries, links_, s), pages, s))


def official_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source without a search page: only direct addresses, ids and detail pages of numbers it serves."""
    pages, queries = _own_pages(spark, sf_dir)
    s = P.site("official", "https://site.example", "caribbean", detail="/v/{}", routes=("censored",), id_form="[0-9]+")
    by_key = queries.withColumn("number", F.when(F.col("number").isNotNull(), F.col("query_id").cast("string")))
    none = pages.limit(0).select("url", F.lit(0).alias("position"), F.lit("").alias("href"), F.lit("").alias("text"))
    out = P.candidates(P.targets(by_key, none, s), pages, s)
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.min("query_id").alias("first_id"), F.sum("query_id").alias("ids"))


def titled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is searched by title and enriches its first results."""
    pages, queries = _own_pages(spark, sf_dir)
    links_ = P.result_links(pages.where(F.col("url").contains("/search")).select("url", H.page_texts("html", "url", "links")["links"].alias("links")))
    q = queries.where("number is not null").withColumn("query_title", F.col("number"))
    out = P.search_then_detail(q, links_, pages, "douban", F.concat(F.lit("https://site.example/search?q="), F.col("number")))
    return out.select("query_id", "provider_id", "title", "release_date", "runtime_minutes", "score_milli")


def source_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's setting enables: a preset's name, and for some an explicit entry."""
    c = read(spark, sf_dir, "customer")
    names = F.array(*map(F.lit, (" Fast-Safe ", "official only", "MANUAL", "community_first", "nonsense", "fc2_enhanced", "uncensored-official")))
    explicit = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("tmdb"), F.lit(True), F.lit("dmm"), F.lit(False)))
    settings = c.select(F.col("c_custkey").alias("setting"), F.get(names, (F.col("c_custkey") % 7).cast("int")).alias("preset"), explicit.alias("explicit"))
    on = presets.enabled(catalog.catalog(spark), settings).where("enabled")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "provider"))), lambda x: x["provider"])
    return on.groupBy("setting").agg(F.array_join(listed, ",").alias("providers"))


def default_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default field policy with the fields' other names."""
    p = presets.with_aliases(presets.preferences(spark, catalog.catalog(spark)))
    return p.select("field", F.array_join("providers", ",").alias("providers"))


def request_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests' policies over the defaults: field policies, run policies and the preset's name."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    policy = F.when(k % 4 == 0, '{"Title":[" DMM ","dmm",7],"sort title":"fc2","x":[]," ":["a"]}').when(k % 4 == 1, '"text"').when(k % 4 == 2, "{}")
    default = F.create_map(F.lit("title"), F.array(F.lit("javdb")))
    own = presets.request_policy(policy, default)
    listed = F.array_join(F.array_sort(F.transform(F.map_entries(own), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))), "|")
    more = F.when(k % 2 == 0, F.array(F.lit("fc2"), F.lit("dmm"))).otherwise(F.array().cast("array<string>"))
    disabled, most = catalog.overlay(F.array(F.lit("dmm")), more, F.lit(3), F.when(k % 5 == 0, 1))
    name = F.when(k % 3 == 0, " Balanced").when(k % 3 == 1, "quality-score").otherwise("other")
    texts = V.json_strings(F.when(k % 2 == 0, '{"a":[" x ",1,"","y"]}').otherwise('{"a":"z "}'), "a")
    return c.select("c_custkey", listed.alias("policy"), F.array_join(disabled, ",").alias("disabled"), most.alias("most"), presets.policy_preset(name).alias("preset"), F.array_join(texts, ",").alias("texts"))


def emitted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact"), F.substring("o_orderpriority", 1, 1).alias("id_provider"), F.col("o_custkey").alias("id"))
    known = spark.createDataFrame([("1",), ("2",), ("2",)], "id_provider string")
    kept = presets.emitted_ids(o, known).groupBy("id_provider").agg(F.count("*").alias("n"))
    return kept.unionByName(presets.emitted_ids(o, known.limit(0)).agg(F.lit("all").alias("id_provider"), F.count("*").alias("n")))


def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a breaker does at each event, by user as a source; every event is a scraped item."""
    from .queries import _executions

    e = _executions(spark, sf_dir).withColumn("retry_class", F.when(F.col("reason") != "rate_limited", F.col("retry_class")))
    return batch.replay(e)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of ten runs; purchases have a write-back request, so they are never reused."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    key = F.when(F.col("event_type") != "purchase", F.concat(F.lit("K"), (i * 7 % 40).cast("string"), F.lit(":"), F.col("event_type")))
    items = e.select((F.col("user_id") % 10).alias("run"), i.alias("item_index"), key.alias("key"), "event_type")
    cached = spark.range(10).where("id % 3 = 0").select(F.col("id").alias("run"), F.explode(F.array(*(F.lit(f"K{n}:click") for n in range(5)))).alias("key"), F.lit(-1).alias("item_index"))
    return batch.reuse(items, cached)


def batch_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("run", "item_index", "reused_from")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _runs(spark, sf_dir).where("reused_from is null")
    rows = items.select("run", "item_index", "event_type", F.explode(F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(f"p{k}").alias("provider")) for k in range(3)))).alias("p"))
    h = F.col("item_index") * (F.col("p.ordinal") + 3) % 11
    reason = F.when(h == 0, "timeout").when(h == 1, "auth_or_forbidden").when(h == 2, "not_found")
    executions = rows.select(
        "run", "item_index", "p.ordinal", "p.provider", ((F.col("p.ordinal") != 1) | (F.col("event_type") != "view")).alias("serves"), F.when(h < 4, "failed").when(h < 7, "empty").otherwise("returned").alias("status"),
        h.alias("candidate_count"), reason.alias("reason"), T.retry_class(reason).alias("retry_class"),
    )
    resumed = [(run, *state) for run in range(0, 10, 2) for state in (("p0", 1, 0, "timeout", "retryable"), ("p1", 2, 2, "timeout", "retryable"))]
    states = spark.createDataFrame(resumed, f"run long, {batch.STATE}")
    return batch.scrape(executions, states, budget=2)


def batch_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source did at each scraped item of ten resumed runs, two sources an item at most."""
    return _reports(spark, sf_dir).select("run", "item_index", "provider", "status", "candidate_count", "failures", "cooldown_remaining")


def batch_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs' summaries by source."""
    return batch.provider_summary(_reports(spark, sf_dir))


def batch_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states with which the runs' next pages begin."""
    return batch.resume_states(_reports(spark, sf_dir))


def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by reason and class, and the reasons of items without a candidate."""
    r = _reports(spark, sf_dir)
    by_reason = batch.retry_class_counts(r).select("run", F.concat_ws(":", "reason", "retry_class").alias("what"), "n")
    count = lambda s: F.count_if(F.col("status").isin(*s)).alias(s[0])
    items = r.groupBy("run", "item_index").agg(F.sum("candidate_count").alias("n"), count(["failed"]), count(["returned", "empty", "failed"]), count(["suppressed"]), count(["budget_exhausted"]), count(["skipped_by_route"]))
    why = planning.no_candidate_reason(F.col("n"), F.col("failed"), F.col("returned"), F.col("suppressed"), F.col("budget_exhausted"), F.col("skipped_by_route"))
    return by_reason.unionByName(items.withColumn("what", why).where("what is not null").groupBy("run", "what").agg(F.count("*").alias("n")))


def direct_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's lines, the first part that there is in a small size; then entities by external id."""
    tries = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("attempt"))
    small = read(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id"), "p_name")
    return lookups.first_direct(tries, small)


def external_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id's entity: a movie, else a show; the ids come from texts in several spellings."""
    o = read(spark, sf_dir, "orders")
    spelled = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" TT"), F.col("o_custkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("tt"), F.col("o_custkey").cast("string"))).otherwise("tt")
    q = o.select("o_orderkey", T.imdb_id(spelled).alias("external_id"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("tt"), F.col("c_custkey").cast("string")).alias("external_id"), F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation"))
    movies = c.where("nation % 2 = 0").select("external_id", "entity", F.lit("movie").alias("kind"))
    shows = c.where("nation % 3 = 0").select("external_id", "entity", F.lit("tv").alias("kind"))
    return lookups.by_external_id(q, movies, shows)


def enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    d = search.where("id % 5 <> 0").select(F.col("id").alias("asked"), F.when(F.col("id") % 7 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("id"), (F.col("id") % 6 == 0).alias("failed"), F.upper("p_name").alias("name"))
    out = lookups.enriched(search, d)
    return out.select("id", F.coalesce(F.when(F.col("outcome") == "enriched", F.col("detail_name")), F.col("p_name")).alias("title"), "outcome", "degraded_by")


def device_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual and discovered devices, the first of each id; and ids of a query, distinct and above 0."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit(" d"), (F.col("s_suppkey") % 7).cast("string")).alias("target_id"), F.col("s_suppkey").cast("bigint").alias("ordinal"), F.col("s_name").alias("name"))
    found = read(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.concat(F.lit("d"), (F.col("n_nationkey") % 11).cast("string"))).alias("target_id"), F.col("n_nationkey").cast("bigint").alias("ordinal"), F.col("n_name").alias("name"))
    ids = F.transform(F.array(F.lit("5"), F.lit("0"), F.lit(" 5 "), F.lit("x"), F.lit("-3"), F.lit("7")), lambda v: F.struct(F.lit("TMDB").alias("provider"), v.alias("value")))
    return lookups.manual_and_discovered(s, found, True).withColumn("ids", F.array_join(lookups.positive_ids(ids, "tmdb").cast("array<string>"), ",")).select("target_id", "name", "origin", "ids")


def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("priority"))
    return lookups.by_priority(s, "priority", "n_nationkey").select("n_nationkey", F.col("place").cast("bigint").alias("place"))


def field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that candidates have, in their fixed order, and the source of each fused value."""
    p = read(spark, sf_dir, "part").select("*", F.array(F.when(F.col("p_size") % 2 == 0, "g")).alias("g"))
    record = {"title": F.col("p_name"), "overview": F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_type")), "runtime_minutes": F.when(F.col("p_size") > 25, F.col("p_size")), "genres": F.array_compact("g")}
    own = fuse.field_sources(record, F.lit("p0"), F.col("p_partkey").cast("string"))
    named = p.select("p_partkey", F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["field"], x["provider"], x["provider_id"])), "|").alias("fields"))
    facts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_linenumber").alias("arrival"), F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("provider"), F.col("l_partkey").cast("string").alias("provider_id"), (F.col("l_partkey") % 1000).cast("int").alias("confidence_milli"), "l_shipdate", F.when(F.col("l_quantity") > 20, F.col("l_quantity").cast("int")).alias("runtime"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("flag"))
    rows = fuse.fused(facts, {"runtime": ["p2", "p1"], "flag": []})
    chosen = fuse.chosen_sources(facts, rows, ["runtime", "flag"]).groupBy("field", "provider").agg(F.count("*").alias("n"))
    return named.where("p_partkey >= 0").select(F.col("p_partkey").alias("id"), "fields").unionByName(chosen.select(F.lit(-1).cast("bigint").alias("id"), F.concat_ws(":", "field", "provider", "n").alias("fields")))


def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused records scored again: the values of all sources against the query, the base's identity kept."""
    line = read(spark, sf_dir, "lineitem")
    facts = line.select(F.col("l_orderkey").alias("cluster"), F.col("l_linenumber").alias("arrival"), F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("provider"), F.col("l_partkey").cast("string").alias("provider_id"), (F.col("l_partkey") % 1000).cast("int").alias("confidence_milli"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("title"), F.year("l_shipdate").alias("year"))
    rows = fuse.fused(facts, {"title": ["p1"], "year": ["p2", "p0"]})
    empty = F.array().cast("array<struct<provider:string,value:string>>")
    pairs = rows.withColumns({"query_title": F.lit("R"), "query_year": F.lit(1995), "query_language": F.lit("en"), "query_ids": empty, "titles": F.array("title"), "language": F.lit(None).cast("string"), "ids": empty, "score_milli": F.lit(None).cast("int"), "votes": F.lit(None).cast("long")})
    return rank.scored(pairs).select("cluster", "provider", "provider_id", "title", "year", "confidence_milli")


def artwork_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    art = line.select(F.col("l_orderkey").alias("cluster"), F.when(F.col("l_linenumber") % 3 == 0, "poster").when(F.col("l_linenumber") % 3 == 1, "backdrop").otherwise("logo").alias("kind"), F.concat(F.lit("p"), (F.col("l_partkey") % 4).cast("string")).alias("provider"), F.concat_ws("/", "l_partkey", "l_linenumber").alias("url"), (F.col("l_partkey") % 4 == 3).alias("base"))
    kept = fuse.preferred_artwork(art, {"poster": ["p1"], "backdrop": ["p2"]}, ["p0"])
    return kept.select("cluster", "kind", "provider", "url")


def native_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate's facts merged into its patch: ids, credits with gaps in their order, studios."""
    p = read(spark, sf_dir, "part")
    actors, everyone = F.array(F.col("p_brand"), F.lit(" "), F.upper("p_brand"), F.col("p_type")), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("A"), F.lit("a "), F.lit("B")))
    names = F.when(F.size(F.coalesce(everyone, F.array().cast("array<string>"))) > 0, everyone).otherwise(actors)
    credits = F.array_join(F.transform(V.numbered(names), lambda x: F.concat_ws("#", x["name"], x["order"])), "|")
    studios = V.append_distinct(F.array(F.lit("Base")), F.array(F.col("p_type"), F.lit(" base "), F.col("p_brand"), F.lower("p_type")))
    pictures = F.filter(F.array(F.lit("a"), F.lit("poster"), F.lit("b")), lambda u: u != "poster")
    return p.select("p_partkey", credits.alias("credits"), F.array_join(studios, "|").alias("studios"), F.array_join(pictures, "|").alias("backdrops"))


def query_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog numbers of payloads from their members in order, and titles that a number replaces."""
    p, z, k = spread(read(spark, sf_dir, "part"), "p_partkey"), F.col("p_size"), F.col("p_partkey").cast("string")
    n = F.lpad(k, 4, "1")
    payload = F.to_json(F.struct(F.when(z % 5 == 0, F.concat(F.lit("abc-"), n)).alias("av_number"), F.when(z % 3 == 0, F.concat(F.lit("XYZ-"), n)).alias("number"), F.when(z % 2 == 0, F.concat(F.lit("/d/QRS-"), n, F.lit(".mkv"))).alias("path"), F.when(z % 7 != 0, F.when(z % 4 == 0, "movie.1080p").otherwise(F.col("p_name"))).alias("title")))
    members = ("av_number", "number", "file_name", "filename", "path", "title", "name")
    asked = {"id": F.when(z % 6 == 0, F.concat(F.lit("ID-"), n)), "said": F.concat(F.lit("see DEF-"), n)}
    # One projection for what each member says, one for its tokens, one for the numbers in them.
    texts = p.select("p_partkey", *(V.json_text(payload, m).alias(m) for m in members), *(c.alias(m) for m, c in asked.items()))
    every = (*members, *asked)
    tokens = texts.select("p_partkey", "title", "name", *(T.filename_tokens(F.col(m)).alias(f"t_{m}") for m in every))
    found = tokens.select("p_partkey", "title", "name", *(T.catalog_number(F.col(f"t_{m}"))["number"].alias(f"n_{m}") for m in every))
    number, title = F.coalesce(*(f"n_{m}" for m in members)), F.coalesce("title", "name")
    shown = F.when(number.isNotNull() & T.looks_like_file(title), number).when(title.isNotNull(), title).otherwise(F.coalesce(number, F.lit("Unknown Title")))
    return found.select("p_partkey", number.alias("number"), shown.alias("title"), F.coalesce("n_id", "n_said").alias("query_number"))


def small_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller functions over parts."""
    p, z, k = read(spark, sf_dir, "part"), F.col("p_size"), F.col("p_partkey")
    number = k.cast("string")
    title = F.when(z % 4 == 0, F.concat(F.lit("FC2PPV-"), number, F.lit(" ：- "), F.col("p_name"))).when(z % 4 == 1, F.concat(F.lit("FC2-"), number)).when(z % 4 == 2, F.concat(number, F.lit(":"), F.col("p_brand"))).otherwise(F.col("p_name"))
    note = T.outcome_note(F.when(z % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("?"))).otherwise(F.array().cast("array<string>")), {"a": "Note A.", "b": "Note B."}, F.when(z % 3 == 0, " own "))
    span = V.year_range(F.when(z % 9 == 0, 0).otherwise(z + 1950))
    hashed = J.scene_hash(F.when(z % 3 == 0, " AB_c-9 ").when(z % 3 == 1, "xyz"), "md5")["hash"]
    lab = T.labeled_value(F.concat(F.lit("Maker: "), F.col("p_brand"), F.lit("  Label： "), F.col("p_type")), "Maker", ["Maker", "Label"])
    return p.select(
        "p_partkey", T.strip_number_prefix(title, number).alias("stripped"), note.alias("note"), span["since"].alias("since"), span["before"].alias("before"), V.vote_average_milli(z / 4).alias("ten"), V.hundred_point_milli(z * 3).alias("hundred"),
        V.whole_number(F.when(z % 2 == 0, F.concat(F.lit(" "), z.cast("string"))).otherwise("1.5")).alias("whole"), hashed.alias("hash"), lab.alias("maker"), H.is_outline(F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand"), F.col("p_name"), ("Brand#1",)).alias("outline"),
        T.setting_label(F.when(z % 2 == 0, " Fast-Safe"), {"fast_safe": "fast_safe"}).alias("label"), J.collection_total(F.struct(z.alias("wish"), F.lit(None).cast("int").alias("collect"), F.lit(1).alias("doing"), F.lit(0).alias("on_hold"), F.lit(0).alias("dropped"))).alias("total"),
    )


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses joined to a page's, video tests, link type names and render faults."""
    p, k = _pages(spark, sf_dir), F.col("page_id")
    value = F.when(k % 4 == 0, "/a/b").when(k % 4 == 1, " //c.example/x ").when(k % 4 == 2, "d.MP4?x=1").otherwise("https://e.example/v.m3u8")
    name = F.when(k % 5 == 0, " ALI").when(k % 5 == 1, "139").when(k % 5 == 2, "Magnet").when(k % 5 == 3, "others").otherwise("nope")
    bad = F.when(k % 6 == 0, " ").when(k % 6 == 1, "no address").when(k % 6 == 2, "ftp://h/x").when(k % 6 == 3, "https://u:p@h/").when(k % 6 == 4, "http://").otherwise(F.col("url"))
    asked = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("WEB"))).otherwise(F.array(F.lit("other")))
    base = F.lit("https://h.example/p/")
    return p.select("page_id", U.absolute_url(base, value).alias("joined"), U.resolved_url(base, value).alias("resolved"), U.is_video_url(value).alias("video"), U.parse_link_type(name).alias("kind"), planning.render_url_fault(bad).alias("fault"), links.source_requested(asked, F.lit("web")).alias("requested"))


def link_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a link source's answers: nested results, else grouped links; and of the fixture source."""
    from spindrift.sources import link_sources as L

    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    nested = F.concat(F.lit('{"results":[{"unique_id":"","message_id":"m'), k, F.lit('","title":" T ","channel":"ch","links":[{"url":"https://pan.quark.cn/s/'), k, F.lit('","type":"","password":"pw"},{"url":" ","type":"web"}]},{"title":"","links":[]}]}'))
    merged = F.concat(F.lit('{"results":[],"merged_by_type":{"web":[{"url":"https://W.example/'), k, F.lit('#f","note":" n ","source":""}],"magnet":[{"url":"MAGNET:?xt='), k, F.lit('","source":"s"}]}}'))
    rows = c.select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query"), F.when(F.col("c_custkey") % 2 == 0, nested).otherwise(merged).alias("response"))
    found = L.wired(rows).unionByName(L.fixture(rows.where("query_id % 3 = 0").select("query_id", "query")))
    return found.select("query_id", "id", "title", "source", "score", "url", "normalized_url", "link_type", "password")


def link_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    types = F.when(k % 3 == 0, F.array(F.lit("web"), F.lit("quark"))).when(k % 3 == 1, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    return c.select("c_custkey", planning.link_request(F.col("c_name"), planning.effective_limit(F.lit(None).cast("int"), 20, 100), k % 2 == 0, types, ["baidu", "web"], F.lit(None).cast("string")).alias("request"))


def grouped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of orders' pages merged and in their types' declared order."""
    from .queries import _results

    rows = links.typed(_results(spark, sf_dir))
    return links.grouped(links.merged(rows)).select("link_type", "type_order", "normalized_url", F.array_join("sources", ",").alias("sources"))


def cast_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    url = F.when(k % 7 == 1, "ftp://h").when(k % 7 == 2, "https://h/a b").otherwise("https://host/x")
    given = F.array(F.struct(F.lit("stream").alias("kind"), url.alias("url"), F.when(k % 5 == 0, F.lit(" ")).otherwise(F.lit("video/mp4")).alias("content_type")))
    command = F.when(k % 3 == 0, "play").when(k % 3 == 1, "seek").otherwise("set_volume")
    fault = planning.cast_fault(F.when(k % 13 == 0, "dlna").otherwise("chromecast"), F.when(k % 17 != 0, "app"), F.col("o_custkey") % 10 != 0, k % 2 == 0, F.when(k % 11 == 0, F.slice(given, 1, 0)).otherwise(given), command, F.lit("direct"), F.when(k % 4 != 0, k), F.when(k % 9 != 0, 50))
    return o.select("o_orderkey", F.coalesce(fault, F.lit("accepted")).alias("outcome"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured endpoints and events' envelopes."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    status = planning.endpoint_status(F.when(k % 11 == 0, 2).otherwise(1), k % 7 != 0, k % 5 != 0, k % 3 == 0)
    ok = planning.envelope_ok({"event_kind": F.col("event_type"), "version": F.when(k % 4 != 0, "1")}, {"event_kind": "click", "version": "1"})
    return e.select("event_id", status.alias("status"), ok.alias("accepted"))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as cases of suites: checks of their size and text; suites fail with a drifted case."""
    p = _pages(spark, sf_dir)
    text = T.strip_markup(F.col("html"))
    checks = [F.octet_length("html") > 0, F.octet_length(text) >= 900, F.when(F.col("page_id") % 2 == 0, F.col("html").contains("<h1>"))]
    cases = p.select((F.col("page_id") % 7).alias("suite"), planning.drift_status(checks).alias("status"))
    return planning.suite_status(cases)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's payloads for a webhook and as an embed, and a response with its provenance."""
    e = read(spark, sf_dir, "events")
    event = {"event_id": F.col("event_id").cast("string"), "event_kind": F.col("event_type"), "subject_kind": F.lit("user"), "subject_id": F.col("user_id").cast("string"), "occurred_at": F.date_format("ts", "yyyy-MM-dd"), "attempt": F.lit(1)}
    keys, summary = V.payload_keys(F.when(F.col("event_id") % 2 == 0, F.col("props"))), F.concat(F.lit("Event "), F.col("event_type"))
    best = {"provider": F.lit("p0"), "provider_id": event["event_id"], "confidence_milli": F.lit(910)}
    source = sinks.provenance(event["event_id"], F.col("event_type"), F.when(F.col("event_id") % 3 == 0, 1999), F.lit("en"), best | {"kind": F.lit("poster")})
    answer = sinks.response({"title": F.col("event_type"), "language": F.lit("en")}, F.struct(F.array(F.lit("p0")).alias("selected")), F.array(F.struct(*(c.alias(k) for k, c in best.items()))))
    return e.select("event_id", sinks.webhook_payload(event, summary, keys).alias("webhook"), sinks.embed_payload(event, summary, keys).alias("embed"), source.alias("provenance"), answer.alias("response"))


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent to three providers in order; the first failure ends an event's sending."""
    e = read(spark, sf_dir, "events").select("event_id", F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("provider")) for i, n in enumerate(("http", "discord", "telegram"))))).alias("p"))
    h = (F.col("event_id") * (F.col("p.ordinal") + 2)) % 7
    sends = e.select("event_id", "p.ordinal", "p.provider", F.when(h == 0, 500).when(h == 1, 404).when(h != 2, 204).alias("http_status"))
    return sinks.fan_out(sends).select("event_id", "provider", "provider_status", "retryable")


def written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded writes of customers' records: what is submitted is written, and all is counted by status."""
    from spindrift.operators.resolve import scratch

    c = read(spark, sf_dir, "customer")
    rows = sinks.guarded(c, F.col("c_custkey") % 10 != 0, F.col("c_mktsegment") != "BUILDING", F.when(F.col("c_acctbal") > 0, F.col("c_name")))
    return sinks.write_submitted(rows, scratch(spark, "written")).select("write_status", "write_reason", F.col("count").alias("n"))


def provider_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facts that share their own source's ids in pairs, and emitted external ids across the pairs."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    four = F.floor(k / 4).cast("string")
    shared = F.when(k % 4 < 2, F.concat(F.lit("TT"), four)).otherwise(F.concat(F.lit(" tt-"), k.cast("string")))
    ids = F.array(F.struct(F.lit("IMDB").alias("provider"), shared.alias("value")), F.struct(F.lit("other").alias("provider"), F.lit("same").alias("value")), F.struct(F.lit("imdb").alias("provider"), F.lit(" ").alias("value")))
    facts = c.select(k.alias("fact"), F.when(k % 2 == 0, "P0").otherwise("p1").alias("provider"), F.when(k % 8 < 4, four).otherwise(F.concat(four, F.lit(" "))).alias("provider_id"), ids.alias("ids"))
    return resolve.clusters(resolve.identifiers(facts, spark.createDataFrame([("imdb",)], "id_provider string")))


def payload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of payloads as objects, lists and top-level members."""
    c, k = spread(read(spark, sf_dir, "customer"), "c_custkey"), F.col("c_custkey")
    n = k.cast("string")
    payload = (
        F.when(k % 4 == 0, F.concat(F.lit('{"external_ids":{"IMDB":" tt'), n, F.lit('","tmdb":['), n, F.lit(',-1,"7",true]},"tmdb_id":0}')))
        .when(k % 4 == 1, F.concat(F.lit('{"external_ids":[{"provider":" Tvdb ","id":'), n, F.lit('},{"provider":"imdb","value":" ","external_id":"x"},{"value":"lost"},7],"tmdb_id":"'), n, F.lit('"}')))
        .when(k % 4 == 2, F.concat(F.lit('{"external_ids":"text","imdb_id":"tt'), n, F.lit('"}'))).otherwise("no json")
    )
    ids = V.external_ids(payload, {"tmdb_id": "tmdb", "imdb_id": "imdb"}, ("tmdb",))
    return c.select("c_custkey", F.array_join(F.transform(ids, lambda x: F.concat_ws(":", x["provider"], x["value"])), "|").alias("ids"))


def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources of each state customers' settings assemble."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    on = F.when(k % 2 == 0, F.array(F.lit("tmdb"), F.lit("dmm"))).otherwise(F.array(F.lit("fixture")))
    settings = c.select(k.alias("setting"), on.alias("enabled"), F.array(F.lit("fixture"), F.when(k % 3 == 0, "tmdb")).alias("usable"))
    usable = settings.withColumn("usable", F.array_compact("usable"))
    return catalog.assembled(catalog.catalog(spark), usable).groupBy("provider", "state").agg(F.count("*").alias("n"), F.min("ordinal").alias("ordinal"))


def known_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commands to customers as devices, of which some are known."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("target_id"))
    t = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("target_id"))
    return lookups.with_known(o, t).groupBy("known").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def variant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts searched for by the variants of their titles, the best three hits enriched or degraded."""
    p = read(spark, sf_dir, "part")
    title = F.concat(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(")"))).otherwise(""))
    index = p.select(F.col("p_name").alias("search_title"), F.col("p_partkey").alias("id"), F.col("p_size").alias("score"))
    detail = p.where("p_size > 20").select(F.col("p_partkey").alias("asked"), F.col("p_partkey").alias("id"), (F.col("p_size") % 5 == 0).alias("failed"))
    failed = p.where("p_size % 10 = 4").select(title.alias("variant"))
    out = lookups.search_and_enrich(p.select(F.col("p_partkey").alias("query_id"), title.alias("title")), index, detail, failed)
    return out.select("query_id", "id", "rank", "outcome", "degraded_by", "partial")


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs' states after every request of a stream of enqueue, pause, resume, cancel and query."""
    from spindrift.streaming import stateful

    from .queries import _stream

    operation = F.when(F.col("event_type") == "click", "enqueue").when(F.col("event_type") == "view", "pause").when(F.col("event_type") == "signup", "resume").when(F.col("event_type") == "purchase", "cancel").otherwise("query")
    make = lambda e: stateful.job_transitions(e.select(F.col("user_id").cast("string").alias("job_key"), F.col("event_id").alias("request_id"), operation.alias("operation")))
    return _stream(spark, sf_dir, "transitions", make, "append")


QUERIES = {
    f.__name__: f
    for f in (
        html_facts, html_links, page_lines, generic_page_candidates, search_results, page_candidates, official_candidates, titled_candidates, source_presets, default_preferences, request_policies, emitted_ids,
        breaker_replay, batch_reuse, batch_reports, batch_scrape, batch_resume, batch_failures, direct_lookups, external_lookups, enrichments, device_targets, source_order, field_evidence, fused_scores, artwork_preferences,
        native_projection, query_numbers, small_values, page_urls, link_sources, link_requests, grouped_links, cast_commands, endpoints, drift, payloads, fan_out, written_back, job_transitions,
        provider_clusters, payload_ids, source_states, known_commands, variant_search,
    )
}
