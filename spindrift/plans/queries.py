"""The registered queries.  Each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import urls as U
from spindrift.functions import values as V
from spindrift.operators import batch, fuse, links, planning, rank, resolve
from spindrift.sources import catalog, sinks


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title normalization of whole texts, as digests."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.normalize_title(F.col("text"))).alias("title_md5"), F.md5(T.normalize_search_title(F.col("text"))).alias("search_md5"), F.md5(T.collapsed(F.col("text"))).alias("collapsed_md5"), F.length(T.compact(F.col("text"))).cast("bigint").alias("compact_chars"))


def _qualified() -> Column:
    tail = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(") ["), F.col("p_type"), F.lit("] "))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(")"))).otherwise(F.lit(" ( )"))
    return F.concat(F.lit(" "), F.col("p_name"), tail)


def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    v = T.search_title_variants(_qualified())
    return p.select("p_partkey", F.coalesce(T.strip_qualifiers(F.trim(_qualified())), F.lit("-")).alias("stripped"), F.array_join(v, "|").alias("variants"), F.size(v).cast("bigint").alias("n_variants"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("t", F.concat(F.lit(" "), F.col("p_name"), F.lit(" _ "), F.col("p_type"), F.lit("!#")))
    return p.select("p_partkey", T.slug(F.col("t")).alias("slug"), T.slug_dropping(F.col("t")).alias("slug_dropping"), T.slug_each(F.col("t")).alias("slug_each"), T.percent_encode(F.concat("p_name", F.lit(" *~/é"))).alias("encoded"), T.strip_year_suffix(F.concat("p_name", F.lit(" (1999)"))).alias("no_year"), T.safe_excerpt(F.concat("p_name", F.lit("\r\nx"))).alias("excerpt"))


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(T.strip_markup(F.col("html"))).alias("text_md5"), V.first_integer(F.col("html")).alias("first_integer"), F.coalesce(V.first_iso_date(F.col("html")), F.lit("-")).alias("first_date"))


def _file_name() -> Column:
    k = F.col("p_partkey")
    text = k.cast("string")
    name = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    forms = [
        name("/media/[HD] ssni", F.lpad(text, 5, "0"), " 1080p x264.mkv"), name("fc2-ppv-", F.lpad(text, 7, "1"), ".mp4"), name("C:\\v\\Studio.", F.lpad((k % 100).cast("string"), 2, "0"), ".", F.lpad((k % 12 + 1).cast("string"), 2, "0"), ".15.avi"),
        name("300MIUM-", F.lpad(text, 3, "0"), " uhd"), name("01", F.lpad((k % 10000).cast("string"), 4, "0"), "_", F.lpad((k % 1000).cast("string"), 3, "0")), name("n", F.lpad((k % 10000).cast("string"), 4, "0"), ".wmv"),
        name("MDX", F.lpad(text, 4, "0"), "-clip"), name("MKY-hs-", text), name("HEVC 1080 web ", text, " plain title"), F.col("p_name"),
    ]
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(F.col("p_size") % len(forms) == i, form).otherwise(out)
    return out


def catalog_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("file", _file_name()).withColumn("tokens", T.filename_tokens(F.col("file"))).withColumn("n", T.catalog_number(F.col("tokens")))
    number = F.coalesce(F.col("n.number"), F.lit("-"))
    return p.select("p_partkey", "tokens", number.alias("number"), F.coalesce("n.route", F.lit("unknown")).alias("route"), F.array_join(T.search_terms(number), "|").alias("terms"), F.when(T.looks_like_file(F.col("file")) & F.col("n.number").isNotNull(), F.col("n.number")).otherwise(T.collapsed(F.col("file"))).alias("title"))


# Authorities that give supplier and line rows link types of every kind.
AUTHORITIES = ("https://PAN.quark.cn/s/", "http://user@www.AliPan.com:80/s/", "https://pan.baidu.com/s/", "magnet:?xt=URN:btih:", "ed2k://|FILE|", "https://Example.org/Path/", "https://notuc.cn/", "https://drive.uc.cn/s/", "no-scheme/", "https://cloud.189.cn/t/")


def _link(key: Column, selector: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, a in enumerate(AUTHORITIES):
        out = F.when(selector % len(AUTHORITIES) == i, F.concat(F.lit(a), key.cast("string"))).otherwise(out)
    return F.concat(F.lit(" "), out, F.when(selector % 2 == 0, F.lit("#Frag")).otherwise(F.lit("?Q=1")))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.lit("web").alias("source"))
    supplied = read(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("id"), _link(F.col("s_suppkey"), F.col("s_suppkey")).alias("url"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("Fixture:x")).otherwise(F.lit("live")).alias("source"))
    u = F.col("url")
    kind = U.link_type(u)
    return pages.unionByName(supplied).select("id", U.normalize_url(u).alias("normalized_url"), F.coalesce(U.host(T.ascii_lower(T.trimmed(u))), F.lit("-")).alias("host"), kind.alias("link_type"), U.link_health(kind, F.col("source")).alias("health"), U.is_exact_link(u).alias("exact"), U.is_safe_url(u).alias("safe"), F.coalesce(U.query_value(u, "utm_source"), F.lit("-")).alias("utm_source"), F.coalesce(U.last_segment(T.trimmed(u)), F.lit("-")).alias("last_segment"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results, their lines as links; addresses are made after the join, which moves keys alone."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.floor("o_totalprice").cast("int").alias("score"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), "l_partkey", "l_suppkey").join(orders, "id")
    return lines.select("id", "place", _link(F.col("l_partkey"), F.col("l_partkey")).alias("url"), F.concat(F.lit("supp"), F.col("l_suppkey").cast("string")).alias("source"), "title", "score")


def link_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 100 results with links of the wanted types, their links merged (the limit is the feature)."""
    wanted = ["quark", "aliyun", "magnet", "ed2k", "web"]
    return links.merged(links.best(_results(spark, sf_dir), 100, wanted)).select("normalized_url", "url", "link_type", F.array_join("sources", ",").alias("sources"))


def link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of all results, merged and counted by type in declared order."""
    return links.type_summary(links.merged(links.typed(_results(spark, sf_dir))))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    year = F.when(k % 4 == 0, F.to_json(F.struct((k % 120 + 1900).alias("year")))).when(k % 4 == 1, F.to_json(F.struct(F.concat(F.lit(" "), (k % 120 + 1900).cast("string")).alias("release_year")))).when(k % 4 == 2, F.to_json(F.struct(F.lit("x").alias("year"), F.concat((k % 120 + 1900).cast("string"), F.lit("-05-06")).alias("air_date")))).otherwise(F.to_json(F.struct(F.lit(99999).alias("year"))))
    ids = F.when(k % 3 == 0, F.concat(F.lit('"external_ids":{"tmdb":'), (k % 7 - 2).cast("string"), F.lit(',"imdb":"tt'), k.cast("string"), F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit('"external_ids":{"imdb":" "},"tmdb_id":'), k.cast("string"))).otherwise(F.concat(F.lit('"tmdb_id":"'), (-k).cast("string"), F.lit('"')))
    payload = F.concat(F.regexp_replace(year, "}$", ""), F.lit(","), ids, F.when(k % 2 == 0, F.lit(',"title":"  "')).otherwise(F.lit(',"title":7')), F.lit(',"name":" '), F.col("p_name"), F.lit('  x "'), F.when(k % 5 == 0, F.lit(',"language":"fr"')).otherwise(F.lit("")), F.lit("}"))
    return read(spark, sf_dir, "part").select(k.alias("id"), payload.alias("payload"))


def query_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, year, language and external ids from JSON payloads."""
    p = _payloads(spark, sf_dir)
    pay = F.col("payload")
    years = [V.json_scalar(pay, key) for key in ("year", "release_year", "original_year")]
    number = [F.when(T.trimmed(y).try_cast("int").between(1, 9999), T.trimmed(y).try_cast("int")) for y in years]
    dated = [V.year_of_date(V.json_text(pay, key)) for key in ("release_date", "date", "air_date")]
    ok = lambda v: v.isNotNull() & (T.trimmed(v) != "") & ~(T.trimmed(v).try_cast("decimal(38,0)") <= 0)
    good = lambda provider, v: F.when(F.when(F.lit(provider == "tmdb"), F.coalesce(ok(v), v.isNotNull())).otherwise(v.isNotNull() & (T.trimmed(v) != "")), F.concat(F.lit(provider + ":"), T.trimmed(v)))
    ids = F.array_compact(F.array(good("imdb", V.json_scalar(pay, "external_ids.imdb")), good("tmdb", V.json_scalar(pay, "external_ids.tmdb")), good("tmdb", V.json_scalar(pay, "tmdb_id"))))
    title = F.coalesce(*(V.json_text(pay, key) for key in ("title", "name", "original_title", "sort_title")))
    return p.select("id", T.collapsed(title).alias("title"), F.coalesce(*number, *dated, F.lit(-1)).cast("int").alias("year"), F.coalesce(V.json_text(pay, "language"), F.lit("en-US")).alias("language"), F.array_join(ids, "|").alias("external_ids"), F.array_join(V.payload_keys(pay), ",").alias("keys"))


def _candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as queries, their lines as candidates of suppliers."""
    one = lambda p, v: F.array(F.struct(F.lit(p).alias("provider"), v.cast("string").alias("value")))
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query_title"), T.normalize_title(F.col("p_name")).alias("query_normal"), F.when(F.col("p_size") % 5 == 0, None).otherwise(F.lit(1992) + F.col("p_size") % 7).cast("int").alias("query_year"),
        F.lit("en-US").alias("query_language"), F.when(F.col("p_size") % 3 == 0, one("Supp", F.col("p_size"))).otherwise(F.array().cast("array<struct<provider:string,value:string>>")).alias("query_ids"), "p_type", "p_brand",
    )
    line = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("query_id"), F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("provider"), F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string")).alias("provider_id"),
        F.col("l_linenumber").alias("n"), F.year("l_shipdate").cast("int").alias("year"), F.when(F.col("l_returnflag") == "A", "EN").when(F.col("l_returnflag") == "N", "ja_JP").alias("language"),
        one(" supp", F.col("l_suppkey")).alias("ids"), (F.col("l_quantity") * 20).cast("int").alias("score_milli"), F.col("l_extendedprice").cast("int").alias("votes"),
    )
    kind = F.col("n") % 4
    names = F.array(F.when(kind == 0, F.col("query_title")).when(kind == 1, F.upper("query_title")).when(kind == 2, F.col("p_type")), F.when(kind == 3, F.lit(" ")), F.when(F.col("n") == 5, F.concat(F.col("query_title"), F.lit("!"))))
    return line.join(part, "query_id").withColumn("titles", names)


def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: evidence, score and the best 12 candidates of every query (the cap is the feature)."""
    shown = ("query_id", "provider", "provider_id", "confidence_milli", "title_outcome", "year_outcome", "id_outcome", "language_outcome")
    # Only keys, score and outcomes go through the window; reasons are made for what it keeps.
    best = rank.ranked(rank.outcomes(_candidate_pairs(spark, sf_dir)).select(*shown, "community"))
    return rank.with_reasons(best).select(*shown, "rank", F.array_join("reasons", ",").alias("reasons"))


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rank.scored(_candidate_pairs(spark, sf_dir))
    return s.groupBy("title_outcome", "year_outcome", "id_outcome", "language_outcome").agg(F.count("*").alias("n"), F.min("confidence_milli").alias("least"), F.max("confidence_milli").alias("most"), F.sum("community").cast("bigint").alias("community"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts: the provider is the source; identifiers are digests of the text and of its last line."""
    d = read(spark, sf_dir, "documents")
    whole, last = F.md5(T.normalize_title(F.col("text"))), F.element_at(F.split("text", "\n"), -1)
    return d.select(F.col("doc_id").alias("fact"), F.col("source").alias("provider"), "lang", "n_chars", whole.alias("whole"), F.when(F.length(last) >= 40, F.md5(T.normalize_title(last))).alias("last"))


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = _facts(spark, sf_dir)
    ids = facts.select("fact", F.explode(F.array("whole", "last")).alias("id"))
    return facts, resolve.clusters(ids)


def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)[1]


def cluster_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, sources and shared identifiers of the clusters."""
    facts, clusters = _clusters(spark, sf_dir)
    both = facts.join(clusters, "fact")
    shared = resolve.shared_ids(both.select("cluster", "provider", F.explode(F.array(F.struct(F.lit("whole").alias("id_provider"), F.col("whole").alias("id")), F.struct(F.lit("last").alias("id_provider"), F.col("last").alias("id")))).alias("x")).select("cluster", "provider", "x.id_provider", "x.id").where("id is not null"))
    merges = shared.groupBy("cluster").agg(F.array_sort(F.collect_set(F.concat_ws(":", F.lit("shared_external_id"), "id_provider", "source_count"))).alias("reasons"))
    out = resolve.cluster_sources(both).join(merges, "cluster", "left")
    return out.select("cluster", F.col("n_facts").cast("bigint").alias("n_facts"), F.array_join("sources", ",").alias("sources"), F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("merge_reasons"))


def fused_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each cluster under field preferences by source."""
    facts, clusters = _clusters(spark, sf_dir)
    rows = facts.join(clusters, "fact").select("cluster", "provider", F.lpad(F.col("fact").cast("string"), 12, "0").alias("provider_id"), F.col("fact").alias("arrival"), F.least(F.col("n_chars"), F.lit(1000)).cast("int").alias("confidence_milli"), F.when(F.col("n_chars") % 3 != 0, F.col("n_chars")).alias("runtime"), F.col("lang").alias("language"), F.when(F.col("fact") % 2 == 0, F.col("whole")).alias("overview"))
    out = fuse.fused(rows, {"runtime": ["src3", "src1"], "language": [], "overview": ["src2"]})
    return out.select("cluster", F.col("n_facts").cast("bigint").alias("n_facts"), "provider", "provider_id", F.coalesce("runtime", F.lit(-1)).alias("runtime"), "language", F.coalesce("overview", F.lit("-")).alias("overview"))


def artwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    art = line.select(F.col("l_partkey").alias("cluster"), F.when(F.col("l_linenumber") % 3 == 0, "backdrop").otherwise("poster").alias("kind"), (F.col("l_quantity").cast("int") * 10 % 100).alias("confidence_milli"), V.area(F.when(F.col("l_linenumber") == 2, None).otherwise(F.col("l_quantity").cast("int")), F.col("l_linenumber")).alias("area"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("provider"), F.col("l_orderkey").cast("string").alias("provider_id"), F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("source_url"))
    return fuse.best_artwork(art)


def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over each route does with each source, under a budget of five."""
    sources = catalog.catalog(spark)
    out = None
    for route in catalog.ROUTES:
        own = catalog.statuses(sources, ["dmm", "fc2"], F.lit(route), 5).select(F.lit(route).alias("route"), "ordinal", "provider", "status")
        out = own if out is None else out.unionByName(own)
    return out


def source_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = catalog.catalog(spark)
    out = None
    for quality in ("official", "community", "artwork", "trailer"):
        own = catalog.by_quality(sources, quality)
        out = own if out is None else out.unionByName(own)
    return out.select("field_group", F.array_join("providers", ",").alias("providers"))


def _executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    message = F.when(F.col("event_id") % 5 == 0, "request timed out").when(F.col("event_id") % 5 == 1, "HTTP 429").when(F.col("event_id") % 5 == 2, "403 Forbidden").when(F.col("event_id") % 5 == 3, "404").otherwise("malformed body")
    failed = F.col("event_type").isin("error", "view")
    reason = F.when(failed, T.failure_reason(message))
    return e.select(F.col("user_id").alias("provider"), F.col("event_id").alias("item_index"), failed.alias("failed"), reason.alias("reason"), T.retry_class(reason).alias("retry_class"), F.when(failed, "failed").when(F.col("value") < 10, "empty").otherwise("returned").alias("status"), F.when(failed | (F.col("value") < 10), 0).otherwise(F.floor(F.col("value") / 10)).cast("int").alias("candidate_count"))


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = batch.consecutive_failures(_executions(spark, sf_dir))
    return s.groupBy("provider").agg(F.max("in_a_row").cast("bigint").alias("longest"), F.count_if(F.col("in_a_row") >= 2).alias("over_threshold"))


def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's executions by status and by reason of failure."""
    e = _executions(spark, sf_dir)
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{v}")
    reasons = ("timeout", "rate_limited", "auth_or_forbidden", "not_found", "parse_error")
    return e.groupBy("provider").agg(
        F.count("*").alias("n_items"), *(count("status", v) for v in ("returned", "empty", "failed")), F.sum("candidate_count").cast("bigint").alias("n_candidates"), F.max("item_index").alias("last_item"),
        *(count("reason", v) for v in reasons), count("retry_class", "retryable"),
    )


def last_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 attempts of each source (the bound is the feature)."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return batch.last_attempts(e, "user_id", "event_id", 20).select("user_id", "event_id", "event_type", F.col("back").cast("int").alias("back"))


def reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items with a repeated key: which earlier item each one reuses."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_index"), "o_custkey", "o_orderpriority")
    return batch.first_occurrence(o, "o_custkey", "o_orderpriority").select("item_index", F.coalesce("reused_from", F.lit(-1).cast("bigint")).alias("reused_from"))


def batch_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 12 items from cursor 100 on (the page is the feature)."""
    w = Window.partitionBy(F.lit(0)).orderBy("n_nationkey")
    items = read(spark, sf_dir, "nation").withColumn("item_index", F.row_number().over(w) - 1)
    return batch.page(items, 8, 50).select("item_index", "n_name")


def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("url", U.query_value(F.col("url"), "utm_source").alias("utm_source"), U.last_segment(F.col("url")).alias("last_segment"), V.first_iso_date(F.col("html")).alias("release_date"))
    return batch.presence(p, "url", "utm_source", "last_segment", "release_date")


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.col("event_id") % 6
    template = F.when(k == 0, "{{ event_kind }} {{event_id}} by {{subject_id}}: {{payload_keys}}").when(k == 1, "{{event_id").when(k == 2, "x {{ }} y").when(k == 3, "{{event_id}} {{nope}}").when(k == 4, "{{event_id}} }}").otherwise("attempt {{attempt}} $1 \\ end")
    keys = V.payload_keys(F.col("props"))
    shown = F.when(F.size(keys) == 0, F.lit("none")).otherwise(F.array_join(keys, ", "))
    values = {"event_id": F.col("event_id").cast("string"), "event_kind": F.col("event_type"), "subject_id": F.col("user_id").cast("string"), "attempt": F.lit("1"), "payload_keys": shown}
    return e.select("event_id", T.template_status(template).alias("status"), F.coalesce(T.render_template(template, values), F.lit("-")).alias("rendered"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    text = F.concat(F.lit("no 12345 on 18875 at "), F.when(F.col("l_linenumber") % 2 == 0, day).otherwise(F.translate(day, "-", "/")), F.lit(" x"))
    return d.select("l_orderkey", "l_linenumber", F.coalesce(V.first_iso_date(text), F.lit("-")).alias("iso_date"), F.coalesce(V.first_year(text), F.lit(-1)).alias("first_year"), F.coalesce(V.year_of_date(F.concat(day, F.lit("T"))), F.lit(-1)).alias("year"), F.coalesce(V.iso_date(F.year("l_shipdate"), F.col("l_quantity").cast("int"), F.lit(31)), F.lit("-")).alias("built"), V.minutes_of_seconds(F.col("l_quantity") * 61).alias("minutes"), V.first_integer(text).alias("first_integer"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem")
    rating = F.col("l_quantity") / 8
    votes = F.col("l_extendedprice").cast("int")
    milli = V.rating_milli(rating)
    return d.select("l_orderkey", "l_linenumber", milli.alias("rating_milli"), V.community_bonus(milli, votes).alias("community"), F.coalesce(V.milli_percent(F.col("l_discount") - 0.02), F.lit(-1)).alias("milli_percent"), V.retry_delay_ms(F.col("l_linenumber"), F.when(F.col("l_linenumber") > 3, votes)).cast("int").alias("delay_ms"), V.is_retryable_status((F.col("l_quantity").cast("int") * 10 + 99)).alias("retryable"))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names appended without duplicates, preferences flattened, alternates without the selected one."""
    p = read(spark, sf_dir, "part")
    merged = V.append_distinct(F.array("p_brand"), F.array(F.lower("p_brand"), F.concat(F.lit(" "), F.col("p_type")), F.col("p_type"), F.lit(" "), F.col("p_name")))
    alternates = V.without(F.array("p_name", "p_type", "p_brand", "p_type"), F.col("p_brand"))
    return p.select("p_partkey", F.array_join(merged, "|").alias("merged"), F.array_join(alternates, "|").alias("alternates"), F.array_join(T.split_values(F.concat_ws(" / ", "p_name", "p_type", F.lit(" "))), "|").alias("split"))


def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles alone, in expressions; the parsed facts have the same."""
    p = read(spark, sf_dir, "pages")
    raw = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    return p.select("page_id", T.collapsed(raw).alias("title"), _bytes(F.col("html")).alias("html_bytes"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device command plans: orders as commands, lines' URLs as transports."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    url = F.when(k % 7 == 0, "http://u@h/x").when(k % 7 == 1, "ftp://h").when(k % 7 == 2, "https://h/?token=Bearer").otherwise("https://host/x")
    given = F.array(F.struct(F.lit("stream").alias("kind"), url.alias("url"), F.when(k % 5 == 0, F.lit(" ")).otherwise(F.lit("video/mp4")).alias("content_type")))
    transports = F.when(k % 11 == 0, F.slice(given, 1, 0)).otherwise(given)
    command = F.when(k % 3 == 0, "play").when(k % 3 == 1, "seek").otherwise("set_volume")
    fault = planning.command_fault("dlna", F.when(k % 13 == 0, "cast").otherwise("dlna"), F.col("o_custkey") % 10 != 0, transports, command, F.when(k % 2 == 0, "hls").otherwise("direct"), F.when(k % 4 != 0, k), F.when(k % 9 != 0, 50))
    return o.select("o_orderkey", F.coalesce(fault, F.lit("accepted")).alias("outcome"))


def subtitle_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested languages of every customer, validated; two fixture results each."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    asked = F.when(k % 3 == 0, F.array(F.lit(" FR "), F.lit("en-US"), F.lit("fr"))).when(k % 3 == 1, F.array(F.lit("bad_token"))).otherwise(F.array(F.lit("de"), F.lit(""), F.lit("cs"), F.lit("ab")))
    found = c.select("c_custkey", F.posexplode(F.slice(planning.languages(asked), 1, 2)).alias("place", "language"), T.slug_dropping(F.col("c_name")).alias("slug"), planning.effective_limit((k % 60 - 2).cast("int"), 10, 50).alias("limit"))
    return found.where(F.col("place") < F.col("limit")).select("c_custkey", "language", F.concat_ws("-", "slug", "language").alias("subtitle_id"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    query = F.when(k % 6 == 0, " HTTPS://x/y").otherwise(F.col("c_name"))
    ext = F.when(k % 6 == 1, '{"external_id":{"kind":"imdb","value":"tt1"}}').when(k % 6 == 2, '{"external_id":{"kind":" ","value":"tt1"},"external_id_kind":"a","external_id_value":"b","title":"T"}').when(k % 6 == 3, '{"external_id_kind":"a","external_id_value":"b"}').when(k % 6 == 4, '{"media_title":" M "}').otherwise("{}")
    return c.select("c_custkey", planning.intent(query, ext).alias("intent"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent requests: the first order of a customer and priority makes the job."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("profile"), F.col("o_orderpriority").alias("request_key"), "o_orderkey", F.col("o_totalprice"))
    made = batch.idempotent(o, ["profile", "request_key"], ["o_orderkey"])
    percent = F.when(F.col("o_orderkey") % 2 == 0, 100_000).otherwise(50_000)
    return made.select("o_orderkey", "outcome", "job_ref", batch.job_state((F.col("o_orderkey") % 8).cast("int"), percent).alias("state"))


def search_and_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two title variants, distinct, the best three of each query enriched with details or degraded."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("hit_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").cast("int").alias("score"))
    variants = line.unionByName(line.withColumns({"ordinal": F.col("ordinal") + 100, "score": F.col("score") + 1}))
    distinct = variants.groupBy("query_id", "hit_id").agg(F.min(F.struct("ordinal", "score")).alias("x")).select("query_id", "hit_id", "x.ordinal", "x.score")
    top = distinct.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "hit_id"))).where("place <= 3")
    details = read(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("hit_id"), "p_name")
    out = top.join(details, "hit_id", "left")
    return out.select("query_id", "hit_id", "place", F.coalesce("p_name", F.concat(F.lit("hit "), F.col("hit_id").cast("string"))).alias("title"), F.when(F.col("p_name").isNull(), "degraded").otherwise("enriched").alias("outcome"))


def write_backs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    payload = F.when(F.col("c_acctbal") > 0, F.to_json(F.struct(F.col("c_custkey").alias("event_id"), F.lit("scan").alias("event_kind"), F.col("c_name").alias("subject"))))
    rows = sinks.guarded(c, F.col("c_custkey") % 10 != 0, F.col("c_mktsegment") != "BUILDING", payload)
    return rows.select("c_custkey", "write_status", F.coalesce("write_reason", F.lit("-")).alias("write_reason"), F.coalesce(payload, F.lit("-")).alias("payload"))


def _stream(spark: SparkSession, sf_dir: str, name: str, make, mode: str) -> DataFrame:
    """Run a stateful stream over the events table to its end; its output as a table in the shared folder."""
    from spindrift.operators.resolve import scratch

    schema, path = read(spark, sf_dir, "events").schema, scratch(spark, f"stream-{name}")
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    out = make(source)
    sink = lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/out/batch={epoch}")
    out.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(out.columns)


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.streaming import stateful

    make = lambda e: stateful.attempt_history(e.select(F.col("user_id").alias("provider"), "event_id", F.col("event_type").alias("status")), 20)
    return _stream(spark, sf_dir, "history", make, "update").select("provider", F.array_join("event_ids", ",").alias("event_ids"))


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.streaming import stateful

    def make(e: DataFrame) -> DataFrame:
        failed = F.col("event_type").isin("error", "view")
        reason = F.when(failed, F.when(F.col("event_id") % 5 == 2, "auth_or_forbidden").when(F.col("event_id") % 5 == 3, "not_found").when(F.col("event_id") % 5 == 4, "parse_error").otherwise("timeout"))
        return stateful.breaker(e.select(F.col("user_id").alias("provider"), F.col("event_id").alias("item_index"), failed.alias("failed"), reason.alias("reason"), T.retry_class(reason).alias("retry_class")))

    return _stream(spark, sf_dir, "breaker", make, "append")


def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.streaming import stateful

    make = lambda e: stateful.idempotent_jobs(e.select(F.concat_ws(":", "user_id", "event_type").alias("job_key"), F.col("event_id").alias("request_id")))
    return _stream(spark, sf_dir, "jobs", make, "append")


QUERIES = {
    f.__name__: f
    for f in (
        ranked_candidates, evidence_summary, titles, title_variants, slugs, markup, catalog_numbers, urls, link_search, link_groups, query_payloads, entity_clusters, cluster_evidence, fused_records, artwork, source_status, source_preferences,
        failure_streaks, provider_summary, last_attempts, reuse, batch_page, field_presence, templates, dates, scores, arrays, html_titles, commands, subtitle_search, intents, jobs, search_and_enrich, write_backs,
        stream_history, stream_breaker, stream_jobs,
    )
}
