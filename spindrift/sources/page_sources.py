"""Page sources: rendered pages held as (url, html) become candidate records.

Which page answers a query is decided by joins on addresses; the pages that
answer one are parsed after them.  Fetching and rendering pages is no part of this.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import html as H
from spindrift.functions import text as T
from spindrift.functions import urls as U
from spindrift.functions import values as V

from .json_sources import ART, STRINGS, _candidates, artwork, external_ids, non_empty


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key over four tasks a core, ahead of work that is heavy for each row.

    A table of few bytes is read by one task or two, however many rows it has.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


@dataclass(frozen=True)
class Site:
    """How a source answers a query: templates hold {} for the number or id; routes: what it serves (empty: all)."""

    provider: str
    base: str
    detail: str = "/v/{}"
    #: None: the source has no search page.
    search: str | None = None
    routes: tuple[str, ...] = ()
    #: The detail page of the number is tried before the search page.
    direct_first: bool = False
    #: The search page is read as a detail page where it lists no result.
    fallback: bool = True
    #: What an id must look like.
    id_form: str = ".+"


# Each source's kind of flow and the routes that it serves; bases and templates are the deployment's.
FLOWS = {
    "javdb": {"search": "/search?q={}", "routes": ("censored", "uncensored", "amateur", "western", "domestic", "unknown")},
    "dmm": {"search": "/search/?searchstr={}", "routes": ("censored",)},
    "fc2": {"detail": "/article/{}/", "routes": ("fc2",), "id_form": "[0-9]{5,}"},
    "fc2ppvdb": {"detail": "/articles/{}", "routes": ("fc2",), "id_form": "[0-9]{5,}"},
    "jav321": {"search": "/search/{}", "routes": ("censored", "uncensored", "amateur")},
    "official": {"detail": "/movies/{}/", "routes": ("uncensored",), "direct_first": True, "id_form": "[0-9]{6}_[0-9]{2,4}"},
    "rendered_search": {"search": "/search?keyword={}", "fallback": False},
}


def site(flow: str, base: str, provider: str | None = None, **changes) -> Site:
    return Site(provider or flow, base, **(FLOWS[flow] | changes))


def _filled(site_: Site, template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(site_.base.rstrip("/") + before), T.percent_encode(value), F.lit(after))


def result_links(pages: DataFrame, *told: str) -> DataFrame:
    """(url, position, href, text) of the links that a search page can list, with what else is told of the page; pages: (url, links, told)."""
    links = pages.select("url", *told, F.posexplode("links").alias("position", "x")).select("url", *told, "position", F.col("x.url").alias("href"), F.col("x.text").alias("text"))
    return links.where(H.is_result_link(F.col("href")))


def _routed(queries: DataFrame, s: Site) -> DataFrame:
    """Adds how (direct_url, direct_id, detail, search) and target (NULL: a search comes first) to queries that the source serves."""
    served = F.lit(True) if not s.routes else F.col("route").isin(*s.routes)
    good_id = F.when(F.col("direct_id").rlike(f"^(?:{s.id_form})$"), F.col("direct_id"))
    numbered = F.col("number").isNotNull() & served
    how = F.when(F.col("direct_url").isNotNull(), "direct_url").when(good_id.isNotNull(), "direct_id")
    how = how.when(numbered & F.lit(s.direct_first or s.search is None), "detail").when(numbered, "search")
    target = (
        F.when(F.col("how") == "direct_url", U.absolute_url(F.lit(s.base), F.col("direct_url"))).when(F.col("how") == "direct_id", _filled(s, s.detail, F.col("direct_id")))
        .when(F.col("how") == "detail", _filled(s, s.detail, F.col("number")))
    )
    return queries.withColumn("how", how).where("how is not null").withColumn("target", target)


def _searches(routed: DataFrame, s: Site) -> DataFrame:
    return routed.where("how = 'search'").withColumn("search_url", _filled(s, s.search, F.col("number")))


def searched_links(queries: DataFrame, pages: DataFrame, s: Site) -> DataFrame:
    """What ``result_links`` gives for the search pages that a query asks for; others are not parsed. pages: (url, html)."""
    asked = spread(_searches(_routed(queries, s), s).select("search_url"), "search_url")
    pages = spread(pages, "url").join(asked, F.col("url") == asked.search_url, "left_semi")
    return result_links(pages.select("url", H.page_texts("html", "url", "links")["links"].alias("links")))


def targets(queries: DataFrame, links: DataFrame, s: Site) -> DataFrame:
    """Adds how (direct_url, direct_id, detail, search, fallback) and target, the page that answers a query.

    queries: query_id, direct_url, direct_id, number, route.  A query with
    several matching results takes the first on the page.
    """
    out = _routed(queries, s)
    if s.search is None:
        return out
    asked = _searches(out, s)
    hits = asked.join(links, asked.search_url == links.url).where(H.mentions(F.col("text"), F.col("href"), F.col("number")))
    first = hits.groupBy("query_id").agg(F.min(F.struct("position", "href")).alias("hit")).select(F.col("query_id").alias("q"), F.col("hit.href").alias("href"))
    found = asked.join(first, F.col("query_id") == F.col("q"), "left")
    found = found.withColumns({"how": F.when(F.col("href").isNull(), "fallback").otherwise("search"), "target": F.coalesce("href", "search_url")})
    if not s.fallback:
        found = found.where("href is not null")
    return out.where("how <> 'search'").unionByName(found.select(out.columns))


def detailed(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds d, what the target says as a detail page, to queries whose target there is; pages: (url, html).

    Only pages that a query has as its target are parsed, over all cores: the join would
    else be left with few tasks, as its rows are small.
    """
    asked, pages = spread(asked, "target"), spread(pages, "url")
    return asked.join(pages, asked.target == pages.url).withColumn("d", H.detail_texts("html", "url")).drop("html")


def candidates(asked: DataFrame, pages: DataFrame, s: Site) -> DataFrame:
    """Candidates of queries whose target page there is; asked: from ``targets``; pages: (url, html)."""
    d = lambda f: F.col(f"d.{f}")
    rows = detailed(asked, pages)
    # The texts are read for a number in turn, up to the first that has one; a filter instead of a generator would read them once more.
    said = (T.catalog_number(T.filename_tokens(c))["number"] for c in (d("number"), d("title"), F.col("target"), d("body")))
    named = F.struct(F.coalesce(*said, "number").alias("av"), F.coalesce(d("title"), F.col("number")).alias("title"))
    rows = rows.select("*", F.inline(F.filter(F.array(named), lambda x: x["av"].isNotNull() & x["title"].isNotNull())))
    date = F.coalesce(d("release_date"), V.first_iso_date(d("body")))
    labelled = lambda c, k: F.transform(c, lambda v: F.concat(F.lit(f"{k}:"), v))
    makers = F.array_compact(F.array(*(F.when(d(k).isNotNull(), F.concat(F.lit(f"{k}:"), d(k))) for k in ("maker", "label", "series", "director"))))
    pictures = F.transform(d("backdrop_urls"), lambda u: F.struct(F.lit("backdrop").alias("kind"), u.alias("url"))).cast(ART)
    return _candidates(
        rows, s.provider,
        provider_id=F.concat(F.lit(f"{s.provider}:"), F.coalesce(U.page_id(F.col("target")), F.col("av"))), title=F.col("title"), sort_title=F.col("av"), overview=d("overview"),
        release_date=date, release_year=V.first_year(date), runtime_minutes=V.first_integer(d("runtime")), genres=non_empty(d("tags")), tags=F.concat(labelled(d("actors"), "actor"), makers),
        score_milli=H.rating(d("rating")), votes=V.first_integer(d("wanted")), external_ids=external_ids(("av_number", F.col("av")), (f"{s.provider}_url", F.col("target"))),
        artwork=F.concat(artwork(("poster", d("poster_url"))), pictures, artwork(("trailer", d("trailer_url")))), outcome=F.concat(F.lit("page_"), F.col("how")),
    )


def search_then_detail(queries: DataFrame, links: DataFrame, pages: DataFrame, provider: str, search_of: Column, most: int = 3) -> DataFrame:
    """A source that is searched by title: the first ``most`` results' pages each give a candidate."""
    asked = queries.withColumn("search_url", search_of)
    hits = asked.join(links, asked.search_url == links.url).select("query_id", "query_title", "position", F.col("href").alias("target"))
    first = hits.groupBy("query_id", "query_title").agg(F.slice(F.array_sort(F.collect_set(F.struct("position", "target"))), 1, most).alias("hits"))
    rows = detailed(first.select("query_id", "query_title", F.explode("hits").alias("hit")).select("query_id", "query_title", "hit.target"), pages)
    title = F.coalesce(F.col("d.title"), F.col("query_title"))
    date = F.coalesce(F.col("d.release_date"), V.first_iso_date(F.col("d.body")))
    return _candidates(
        rows, provider,
        provider_id=F.concat(F.lit(f"{provider}:"), F.col("target")), title=title, sort_title=title, overview=F.col("d.overview"), release_date=date, release_year=V.first_year(date),
        runtime_minutes=V.first_integer(F.col("d.runtime")), genres=non_empty(F.col("d.tags")), score_milli=H.rating(F.col("d.rating")), outcome="page_enriched",
    )


def generic(rows: DataFrame) -> DataFrame:
    """Pages named by a query's own ids: kind text gives a text candidate, kind recipe one by the generic recipe.

    rows: query_id, query_title, query_language, kind, source_url, and f from ``page_texts`` of the page that was
    rendered for the query: an address alone does not tell it, as two renderings of one address can differ.
    """
    f = H.recipe(F.col("f"))
    by_recipe = F.col("kind") == "recipe"
    only = lambda c: F.when(by_recipe, c)
    title = F.coalesce(T.non_blank(f["title"]), F.col("query_title"))
    posters = F.transform(f["poster_urls"], lambda u: F.struct(F.lit("poster").alias("kind"), u.alias("url"))).cast(ART)
    return _candidates(
        rows, "browser_worker",
        provider_id=F.concat(F.when(by_recipe, "browser-worker:recipe:").otherwise("browser-worker:"), F.col("source_url")), title=title, sort_title=title,
        original_title=F.when(title != F.col("query_title"), F.col("query_title")), overview=F.when(by_recipe, f["overview"]).otherwise(T.safe_excerpt(F.col("f.body"))),
        release_date=only(f["release_date"]), release_year=only(f["release_year"]), runtime_minutes=only(f["runtime_minutes"]), genres=only(non_empty(f["genres"])),
        tags=F.coalesce(only(f["tags"]), F.array().cast(STRINGS)), language=F.col("query_language"), score_milli=only(f["score_milli"]), votes=only(f["vote_count"]),
        artwork=F.coalesce(only(posters), F.array().cast(ART)), outcome=F.when(by_recipe, "recipe_extracted").otherwise("text_extracted"),
    )
