"""Link search sources: a wire answer's nested results or grouped links, and a fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import urls as U

ANSWER = (
    "results array<struct<unique_id:string,message_id:string,title:string,channel:string,content:string,links array<struct<url:string,type:string,password:string>>>>, "
    "merged_by_type map<string,array<struct<url:string,note:string,source:string,password:string>>>"
).replace("links array", "links:array")
COLUMNS = ("query_id", "id", "title", "source", "score", "url", "normalized_url", "link_type", "password")


def _linked(rows: DataFrame) -> DataFrame:
    """Rows with their links' forms; a given type counts where it is one, else the address tells it."""
    url = T.trimmed(F.col("url"))
    out = rows.withColumns({"url": url, "normalized_url": U.normalize_url(url), "link_type": F.coalesce(U.parse_link_type(F.col("given")), U.link_type(url)), "password": T.non_blank(F.col("password"))})
    return out.where("normalized_url is not null").select(*COLUMNS)


def wired(rows: DataFrame, provider: str = "pansou") -> DataFrame:
    """Links of answers (query_id, query, response): nested results with links, where there are none grouped links."""
    a = rows.select("query_id", "query", F.from_json("response", ANSWER).alias("a"))
    nested = a.select("query_id", F.posexplode("a.results").alias("i", "r")).select("query_id", "i", "r", F.explode("r.links").alias("l"))
    place = F.col("i").cast("string")
    source = F.coalesce(F.concat(F.lit(f"{provider}:"), T.non_blank(F.col("r.channel"))), F.lit(provider))
    own = nested.select(
        "query_id", F.coalesce(T.non_blank(F.col("r.unique_id")), T.non_blank(F.col("r.message_id")), F.concat(F.lit(f"{provider}:"), place)).alias("id"), F.coalesce(T.non_blank(F.col("r.title")), F.concat(F.lit("Result "), place)).alias("title"),
        source.alias("source"), F.lit(700).alias("score"), F.col("l.url").alias("url"), F.col("l.type").alias("given"), F.col("l.password").alias("password"),
    )
    grouped = a.where(F.size("a.results") == 0).select("query_id", "query", F.explode("a.merged_by_type").alias("kind", "links")).select("query_id", "query", "kind", F.posexplode("links").alias("i", "l"))
    merged = grouped.select(
        "query_id", F.concat_ws(":", F.lit(f"{provider}:merged"), "kind", "i").alias("id"), F.concat_ws(" ", "query", F.coalesce(U.parse_link_type(F.col("kind")), U.link_type(F.col("l.url"))), F.lit("resource")).alias("title"),
        F.coalesce(T.non_blank(F.col("l.source")), F.lit(provider)).alias("source"), F.lit(650).alias("score"), F.col("l.url").alias("url"), F.col("kind").alias("given"), F.col("l.password").alias("password"),
    )
    return _linked(own.unionByName(merged))


def fixture(queries: DataFrame) -> DataFrame:
    """Two certain results for each query (query_id, query), with two links each."""
    slug = T.slug(F.col("query"))
    link = lambda url, password=None: F.struct(url.alias("url"), F.lit(password).cast("string").alias("password"))
    at = lambda host, tail="": F.concat(F.lit(host), slug, F.lit(tail))
    pack = F.struct(F.lit("pack").alias("name"), F.lit(" release pack").alias("tail"), F.lit(900).alias("score"), F.array(link(at("https://pan.quark.cn/s/"), "pw"), link(F.lit("magnet:?xt=urn:btih:0123456789abcdef"))).alias("links"))
    archive = F.struct(F.lit("archive").alias("name"), F.lit(" 1080p archive").alias("tail"), F.lit(800).alias("score"), F.array(link(at("https://www.aliyundrive.com/s/")), link(at("https://PAN.QUARK.CN/s/", "#duplicate"), "pw")).alias("links"))
    rows = queries.select("query_id", "query", slug.alias("slug"), F.explode(F.array(pack, archive)).alias("r")).select("query_id", "query", "slug", "r", F.explode("r.links").alias("l"))
    return _linked(rows.select("query_id", F.concat_ws(":", F.lit("fixture"), "slug", "r.name").alias("id"), F.concat("query", "r.tail").alias("title"), F.lit("fixture").alias("source"), "r.score", "l.url", F.lit(None).cast("string").alias("given"), "l.password"))
