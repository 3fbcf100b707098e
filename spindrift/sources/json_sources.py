"""JSON sources: responses held as text become candidate records.

Every source is a function of a DataFrame with query_id, query_title,
query_language and its responses, and gives rows of ``CANDIDATE``; so sources
can be united, resolved, fused and ranked.  All of it is column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import values as V

CANDIDATE = (
    "query_id", "provider", "provider_id", "title", "original_title", "sort_title", "overview", "release_date", "release_year", "runtime_minutes", "tagline",
    "genres", "tags", "alternate_titles", "language", "score_milli", "votes", "external_ids", "artwork", "outcome",
)
IMAGES = "https://image.tmdb.org/t/p/original"
# The genre numbers that a search result names.
GENRES = {12: "Adventure", 16: "Animation", 18: "Drama", 28: "Action", 35: "Comedy", 878: "Science Fiction"}
STRINGS, IDS, ART = "array<string>", "array<struct<provider:string,value:string>>", "array<struct<kind:string,url:string>>"


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*map(T.non_blank, columns))


def non_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def tenths(c: Column) -> Column:
    """One decimal, exact ties to the even one."""
    return F.format_string("%.1f", F.bround(c, 1))


def tag(prefix: str, c: Column, text: Column | None = None) -> Column:
    """``prefix:value`` where there is a value."""
    return F.when(c.isNotNull(), F.concat(F.lit(f"{prefix}:"), c.cast("string") if text is None else text))


def genre_names(ids: Column) -> Column:
    """Names of the known genre numbers, in order."""
    table = F.create_map(*(F.lit(x) for pair in GENRES.items() for x in pair))
    return F.array_compact(F.transform(ids, lambda i: F.try_element_at(table, i.cast("int"))))


def named(values: Column) -> Column:
    """The names that are not blank, of (id, name) structs whose id is not 0."""
    return F.array_compact(F.transform(F.filter(values, lambda x: F.coalesce(x["id"], F.lit(1)) != 0), lambda x: T.non_blank(x["name"])))


def alternates(selected: Column, titles: Column) -> Column:
    """Trimmed titles that are neither blank nor the selected one, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(titles, T.trimmed), lambda t: t.isNotNull() & (t != "") & ~t.eqNullSafe(selected)))


def external_ids(*pairs: tuple[str | Column, Column]) -> Column:
    """(provider, value) structs of the values that are not blank."""
    make = lambda p, v: F.when(T.non_blank(v).isNotNull(), F.struct((F.lit(p) if isinstance(p, str) else p).alias("provider"), T.non_blank(v).alias("value")))
    return F.array_compact(F.array(*(make(p, v) for p, v in pairs))).cast(IDS)


def artwork(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(u.isNotNull(), F.struct(F.lit(k).alias("kind"), u.alias("url"))) for k, u in pairs))).cast(ART)


def image_url(path: Column) -> Column:
    p = T.non_blank(path)
    return F.concat(F.lit(IMAGES + "/"), F.regexp_replace(p, "^/+", ""))


def optional(text: Column, schema: str) -> tuple[Column, Column]:
    """A nested member parsed by itself, and whether it was there but unusable."""
    parsed = F.from_json(text, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    there = text.isNotNull() & (text != "null")
    return F.when(there, parsed), there & parsed["_broken"].isNotNull()


def _candidates(rows: DataFrame, provider: str, **fields: Column | str) -> DataFrame:
    """Rows of CANDIDATE; fields that are not given are NULL or empty."""
    empty = {"tags": STRINGS, "alternate_titles": STRINGS, "external_ids": IDS, "artwork": ART}
    kinds = {"release_year": "int", "runtime_minutes": "int", "score_milli": "int", "votes": "long", "genres": STRINGS}
    out = {"query_id": F.col("query_id"), "provider": F.lit(provider)} | {k: F.lit(v) if isinstance(v, str) else v for k, v in fields.items()}
    missing = lambda name: F.array().cast(empty[name]) if name in empty else F.lit(None).cast(kinds.get(name, "string"))
    return rows.select(*((out[n].cast(kinds[n]) if n in kinds else out[n]).alias(n) if n in out else missing(n).alias(n) for n in CANDIDATE))


def other_than(value: Column, selected: Column) -> Column:
    return F.when(~value.eqNullSafe(selected), value)


SEARCH = "id long, title string, original_title string, name string, original_name string, overview string, release_date string, first_air_date string, poster_path string, backdrop_path string, genre_ids array<int>, vote_average double, vote_count long"
DETAIL = SEARCH.replace("genre_ids array<int>", "genres array<struct<id:long,name:string>>") + (
    ", runtime int, tagline string, original_language string, external_ids string, alternative_titles string, episode_run_time array<int>, origin_country array<string>"
    ", networks array<struct<id:long,name:string>>, number_of_seasons int, number_of_episodes int, status string"
)
LINKS = "imdb_id string, tvdb_id string, wikidata_id string, facebook_id string, instagram_id string, twitter_id string"


def _parsed(rows: DataFrame) -> DataFrame:
    """Search and detail responses; a detail counts only where it is of the same id."""
    read = rows.withColumns({"s": F.from_json("search", SEARCH), "d": F.from_json("detail", DETAIL)}).where("s.id is not null")
    return read.withColumn("d", F.when(F.col("d.id") == F.col("s.id"), F.col("d")))


def movies(rows: DataFrame) -> DataFrame:
    """rows: search, and detail where enrichment got one; a search result alone gives a degraded candidate."""
    return _screen(rows, "movie", "title", "original_title", "release_date")


def shows(rows: DataFrame) -> DataFrame:
    return _screen(rows, "tv", "name", "original_name", "first_air_date")


def _screen(rows: DataFrame, kind: str, name: str, original_name: str, date: str) -> DataFrame:
    s, d = (lambda f: F.col(f"s.{f}")), (lambda f: F.col(f"d.{f}"))
    rows = _parsed(rows)
    enriched = F.col("d").isNotNull()
    links, broken_links = optional(d("external_ids"), LINKS)
    others, broken_titles = optional(d("alternative_titles"), "titles array<struct<title:string>>, results array<struct<title:string>>")
    partial = F.coalesce(broken_links, F.lit(False)) | F.coalesce(broken_titles, F.lit(False))
    # Bound in a projection of their own, as later fields name them.
    rows = rows.withColumns({
        "title": F.coalesce(first_non_blank(d(name), s(name), d(original_name), s(original_name)), F.col("query_title")),
        "original": first_non_blank(d(original_name), s(original_name)),
        "date": first_non_blank(d(date), s(date)), "average": F.coalesce(d("vote_average"), s("vote_average")), "votes": F.coalesce(d("vote_count"), s("vote_count")),
        "links": links, "others": F.coalesce(others["titles" if kind == "movie" else "results"]["title"], F.array().cast(STRINGS)), "partial": partial,
    })
    title, average = F.col("title"), F.col("average")
    known = F.array("original", d(name), s(name), d(original_name), s(original_name))
    tags = [F.lit("tmdb")]
    if kind == "tv":
        each = lambda prefix, values: F.transform(values, lambda v: F.concat(F.lit(f"{prefix}:"), v))
        countries = F.array_compact(F.transform(d("origin_country"), T.non_blank))
        extra = F.concat(F.array(F.lit("tmdb_tv")), F.coalesce(each("tmdb_origin_country", countries), F.array().cast(STRINGS)), F.coalesce(each("tmdb_network", named(d("networks"))), F.array().cast(STRINGS)))
        positive = lambda f: F.when(d(f) > 0, d(f))
        tags += [tag("tmdb_number_of_seasons", positive("number_of_seasons")), tag("tmdb_number_of_episodes", positive("number_of_episodes")), tag("tmdb_status", T.non_blank(d("status")))]
    else:
        extra = F.array().cast(STRINGS)
    tags = [tags[0], F.when(~enriched, "tmdb_degraded"), *tags[1:], tag("tmdb_vote_average", average, tenths(average)), tag("tmdb_vote_count", F.col("votes"))]
    all_tags = F.array_compact(F.array(*tags))
    picture = lambda f: F.when(enriched, image_url(d(f))).otherwise(image_url(s(f)))
    ids = external_ids(("tmdb" if kind == "movie" else "tmdb_tv", s("id").cast("string")), *((n, F.col(f"links.{n}_id")) for n in ("imdb", *(("tvdb",) if kind == "tv" else ()), "wikidata", "facebook", "instagram", "twitter")))
    runtime = d("runtime") if kind == "movie" else F.get(F.filter(d("episode_run_time"), lambda m: m > 0), F.lit(0))
    return _candidates(
        rows, "tmdb",
        provider_id=F.concat(F.lit(f"tmdb:{kind}:"), s("id").cast("string")), title=title, sort_title=title, original_title=other_than(F.col("original"), title),
        overview=first_non_blank(d("overview"), s("overview")), release_date=F.col("date"), release_year=V.year_of_date(F.col("date")), runtime_minutes=runtime,
        tagline=T.non_blank(d("tagline")), genres=F.coalesce(non_empty(named(d("genres"))), non_empty(genre_names(s("genre_ids")))),
        tags=F.concat(F.slice(all_tags, 1, 1), extra, F.slice(all_tags, 2, 100)), alternate_titles=alternates(title, F.concat(known, F.col("others"))),
        language=F.coalesce(T.non_blank(d("original_language")), F.col("query_language")), score_milli=V.vote_average_milli(average), votes=F.col("votes"),
        external_ids=ids, artwork=artwork(("poster", picture("poster_path")), ("backdrop", picture("backdrop_path"))),
        outcome=F.concat(F.lit(f"{kind}_"), F.when(~enriched, "degraded").when(F.col("partial"), "partially_enriched").otherwise("enriched")),
    )


SUBJECT = "id long, type int, name string, name_cn string, summary string, date string, platform string, infobox string, meta_tags array<string>, tags array<struct<name:string,count:int>>, rating struct<rank:int,score:double,total:int>, collection struct<wish:int,collect:int,doing:int,on_hold:int,dropped:int>, eps int, nsfw boolean"
# Infobox keys.
TITLE_KEYS = ("别名", "中文名", "英文名", "日文名", "简体中文名", "繁体中文名", "原名", "原作名", "alias", "aliases", "title", "original title", "english title")
PRODUCTION_KEYS = ("动画制作", "動畫製作", "アニメーション制作", "制作", "製作", "制作公司", "制作会社")
BOX = "array<struct<key:string,value:variant>>"


def box_texts(value: Column) -> Column:
    """The texts of an infobox value: a string, or a list of strings, of {v} objects and of lists of them."""
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.v", "string"))
    items = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))
    # Lists in lists are opened twice; the sources nest no deeper.
    flat = F.flatten(F.transform(items(value), items))
    return F.array_compact(F.transform(flat, text))


def box_keyed(value: Column, keys: tuple[str, ...]) -> Column:
    """The texts of {k, v} objects in a value whose k is one of the keys."""
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    wanted = F.array(*map(F.lit, keys))
    own = F.filter(items, lambda x: F.coalesce(F.array_contains(wanted, T.ascii_lower(T.trimmed(F.try_variant_get(x, "$.k", "string")))), F.lit(False)))
    return F.array_compact(F.transform(own, lambda x: F.try_variant_get(x, "$.v", "string")))


def box_values(box: Column, keys: tuple[str, ...], most: int = 4) -> Column:
    """Up to ``most`` distinct texts of the entries with one of the keys, else of {k, v} objects inside entries."""
    keys = tuple(k.lower() for k in keys)
    wanted = F.array(*map(F.lit, keys))
    own = lambda x: F.coalesce(F.array_contains(wanted, T.ascii_lower(T.trimmed(x["key"]))), F.lit(False))
    found = F.flatten(F.transform(box, lambda x: F.when(own(x), box_texts(x["value"])).otherwise(box_keyed(x["value"], keys))))
    return F.slice(F.array_distinct(F.array_compact(F.transform(found, lambda t: F.nullif(T.collapsed(t), F.lit(""))))), 1, most)


def collection_total(c: Column) -> Column:
    """The sum of a collection's parts, NULL where it is 0."""
    total = sum((F.coalesce(c[p].cast("long"), F.lit(0)) for p in ("wish", "collect", "doing", "on_hold", "dropped")), F.lit(0))
    return F.when(c.isNotNull(), F.nullif(total, F.lit(0)))


def genre_tags(meta: Column, tags: Column, most: int = 8) -> Column:
    """Meta tags first, then the most counted tags; equal counts keep their order."""
    placed = F.transform(tags, lambda t, i: F.struct((-F.coalesce(t["count"], F.lit(0))).alias("n"), i.alias("i"), t["name"].alias("name")))
    top = F.transform(F.slice(F.array_sort(placed), 1, most), lambda t: t["name"])
    names = F.array_compact(F.transform(F.concat(F.coalesce(meta, F.array().cast(STRINGS)), F.coalesce(top, F.array().cast(STRINGS))), T.non_blank))
    return non_empty(F.array_distinct(names))


def title_matches(query: Column, title: Column) -> Column:
    return F.coalesce((title == query) | (T.normalize_title(title) == T.normalize_title(query)), F.lit(False)) & T.non_blank(title).isNotNull()


def preferred_title(query: Column, matching: list[Column], by_language: list[Column]) -> Column:
    """The first title that matches the query, else the first that is not blank."""
    out = reduce(lambda w, t: w.when(title_matches(query, t), t), matching[1:], F.when(title_matches(query, matching[0]), matching[0]))
    return F.coalesce(out, first_non_blank(*by_language))


def subjects(rows: DataFrame) -> DataFrame:
    """rows: search, and detail where there is one (subjects with names in two languages and an infobox)."""
    s, d = (lambda f: F.col(f"s.{f}")), (lambda f: F.col(f"d.{f}"))
    rows = rows.withColumns({"s": F.from_json("search", SUBJECT), "d": F.from_json("detail", SUBJECT)}).where("s.id is not null")
    boxes = F.concat(*(F.coalesce(F.try_variant_get(F.try_parse_json(x("infobox")), "$", BOX), F.array().cast(BOX)) for x in (d, s)))
    rows = rows.withColumns({
        "original": first_non_blank(d("name"), s("name")), "localized": first_non_blank(d("name_cn"), s("name_cn")), "box": boxes,
        "date": first_non_blank(d("date"), s("date")), "rating": F.coalesce(d("rating"), s("rating")),
        "total": F.coalesce(collection_total(d("collection")), collection_total(s("collection"))),
    })
    original, localized = F.col("original"), F.col("localized")
    by_language = F.when(T.ascii_lower(F.col("query_language")).startswith("zh"), F.coalesce(localized, original)).otherwise(F.coalesce(original, localized))
    rows = rows.withColumns({"title": preferred_title(F.col("query_title"), [localized, original], [by_language]), "makers": box_values(F.col("box"), PRODUCTION_KEYS)})
    title, score = F.col("title"), F.col("rating.score")
    makers = F.transform("makers", lambda m: F.concat(F.lit("bangumi_production:"), m))
    tags = F.array_compact(F.array(
        F.lit("bangumi"), F.when(F.col("d").isNull(), "bangumi_degraded"), F.when(F.coalesce(d("nsfw"), s("nsfw")), "bangumi_nsfw"), tag("bangumi_subject_type", F.coalesce(d("type"), s("type"))),
        tag("bangumi_eps", F.coalesce(d("eps"), s("eps"))), tag("bangumi_platform", first_non_blank(d("platform"), s("platform"))), tag("bangumi_rank", F.col("rating.rank")),
        tag("bangumi_rating_total", F.col("rating.total")), tag("bangumi_score", score, tenths(score)), tag("bangumi_collection_total", F.col("total")),
    ))
    known = F.concat(F.array(original, localized, s("name"), s("name_cn")), box_values(F.col("box"), TITLE_KEYS, 100))
    return _candidates(
        rows, "bangumi",
        provider_id=F.concat(F.lit("bangumi:subject:"), s("id").cast("string")), title=title, sort_title=title, original_title=other_than(original, title),
        overview=first_non_blank(d("summary"), s("summary")), release_date=F.col("date"), release_year=V.year_of_date(F.col("date")),
        genres=F.coalesce(genre_tags(d("meta_tags"), d("tags")), genre_tags(s("meta_tags"), s("tags"))), tags=F.concat(tags, makers),
        alternate_titles=alternates(title, known), language=F.when(localized == title, "zh-CN"), score_milli=V.vote_average_milli(score), votes=F.col("rating.total"),
        external_ids=external_ids(("bangumi", s("id").cast("string"))), outcome=F.when(F.col("d").isNull(), "subject_degraded").otherwise("subject_enriched"),
    )


MEDIA = "id long, idMal long, isAdult boolean, siteUrl string, title struct<userPreferred:string,english:string,romaji:string,native:string>, description string, startDate struct<year:int,month:int,day:int>, format string, status string, episodes int, duration int, averageScore int, meanScore int, genres array<string>, tags array<struct<name:string,rank:int,isMediaSpoiler:boolean,isGeneralSpoiler:boolean>>, coverImage struct<extraLarge:string,large:string>, bannerImage string"


def media(rows: DataFrame, include_adult: bool = False) -> DataFrame:
    """rows: response, a page of media as a list (GraphQL ``Page.media``); adult ones are left out by default."""
    page = F.from_json(F.get_json_object("response", "$.data.Page.media"), f"array<struct<{_colons(MEDIA)}>>")
    rows = rows.select("query_id", "query_title", "query_language", F.explode(page).alias("m")).where("m.id > 0")
    if not include_adult:
        rows = rows.where(~F.coalesce(F.col("m.isAdult"), F.lit(False)))
    m = lambda f: F.col(f"m.{f}")
    names = {n: m(f"title.{n}") for n in ("userPreferred", "english", "romaji", "native")}
    english = T.ascii_lower(F.col("query_language")).startswith("en")
    by_language = F.when(english, first_non_blank(names["english"], names["userPreferred"], names["romaji"], names["native"])).otherwise(first_non_blank(*(names[n] for n in ("userPreferred", "romaji", "native", "english"))))
    rows = rows.withColumns({"title": F.coalesce(preferred_title(F.col("query_title"), list(names.values()), [by_language]), F.col("query_title")), "original": first_non_blank(names["romaji"], names["native"])})
    title, original = F.col("title"), F.col("original")
    shown = F.filter(m("tags"), lambda t: ~F.coalesce(t["isMediaSpoiler"], F.lit(False)) & ~F.coalesce(t["isGeneralSpoiler"], F.lit(False)) & (F.coalesce(t["rank"], F.lit(0)) >= 50))
    labels = F.array_compact(F.transform(F.slice(shown, 1, 8), lambda t: T.non_blank(t["name"])))
    facts = F.array_compact(F.array(F.lit("anilist"), tag("format", T.non_blank(m("format"))), tag("status", T.non_blank(m("status"))), tag("episodes", m("episodes"))))
    date = V.iso_date(m("startDate.year"), m("startDate.month"), m("startDate.day"))
    return _candidates(
        rows, "anilist",
        provider_id=F.concat(F.lit("anilist:media:"), m("id").cast("string")), title=title, sort_title=title, original_title=other_than(original, title),
        overview=F.nullif(T.strip_markup(m("description")), F.lit("")), release_date=date, release_year=m("startDate.year"), runtime_minutes=m("duration"),
        tagline=T.non_blank(m("format")), genres=non_empty(F.array_distinct(F.array_compact(F.transform(m("genres"), T.non_blank)))),
        tags=F.array_distinct(F.concat(facts, F.coalesce(labels, F.array().cast(STRINGS)))), alternate_titles=alternates(original, F.array(*names.values())), language=F.col("query_language"),
        score_milli=V.hundred_point_milli(F.coalesce(m("averageScore"), m("meanScore"))),
        external_ids=external_ids(("anilist", m("id").cast("string")), ("mal", F.when(m("idMal") > 0, m("idMal").cast("string"))), ("anilist_url", m("siteUrl"))),
        artwork=artwork(("poster", first_non_blank(m("coverImage.extraLarge"), m("coverImage.large"))), ("backdrop", T.non_blank(m("bannerImage")))), outcome="media_mapped",
    )


def _colons(ddl: str) -> str:
    """A list of columns as fields of a struct type."""
    parts, start, depth = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            parts.append(ddl[start:i].strip().replace(" ", ":", 1))
            start = i + 1
    return ",".join(parts)


SCENE = "slug string, url string, title string, description string, date string, duration string, sku string, external_id string, rating string, performers array<struct<name:string>>, directors array<struct<name:string>>, tags array<struct<name:string>>, site struct<name:string,network:struct<name:string>>, poster string, image string, back_image string, background struct<large:string,full:string>, trailer string, hashes array<struct<hash:string,type:string>>"


def scene_hash(value: Column, kind: str) -> Column:
    """A file hash to look a scene up by: hexadecimal digits, dashes and underscores, in lower case."""
    v = T.trimmed(value)
    return F.when(v.rlike("^[0-9A-Fa-f_-]+$"), F.struct(F.lit(kind).alias("type"), F.lower(v).alias("hash")))


def scenes(rows: DataFrame) -> DataFrame:
    """rows: response, one scene."""
    d = lambda f: F.col(f"d.{f}")
    slug = F.coalesce(T.non_blank(d("slug")), F.nullif(F.regexp_extract(F.regexp_replace(d("url"), "[?#].*$", ""), "/scenes/([^/]+)", 1), F.lit("")))
    rows = rows.withColumn("d", F.from_json("response", SCENE)).withColumns({"slug": slug, "title": T.non_blank(d("title"))}).where("title is not null and slug is not null")
    number = lambda c: T.catalog_number(T.filename_tokens(c))["number"]
    name = F.coalesce(*(number(c) for c in (d("sku"), d("external_id"), F.col("title"))))
    poster = first_non_blank(d("poster"), d("image"))
    people = lambda c: F.array_distinct(F.array_compact(F.transform(c, lambda x: T.non_blank(x["name"]))))
    backs = F.array_compact(F.array(T.non_blank(d("back_image")), first_non_blank(d("background.full"), d("background.large"))))
    pictures = F.transform(F.filter(F.array_distinct(backs), lambda u: ~u.eqNullSafe(poster)), lambda u: F.struct(F.lit("backdrop").alias("kind"), u.alias("url")))
    hashes = F.transform(F.filter(d("hashes"), lambda h: scene_hash(h["hash"], "").isNotNull()), lambda h: F.struct(F.concat(F.lit("hash_"), T.ascii_lower(h["type"])).alias("provider"), F.lower(T.trimmed(h["hash"])).alias("value")))
    date = F.coalesce(F.nullif(F.regexp_extract(T.trimmed(d("date")), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), V.first_iso_date(d("date")))
    return _candidates(
        rows, "theporndb",
        provider_id=F.concat(F.lit("theporndb:scene:"), F.col("slug")), title=F.col("title"), sort_title=F.coalesce(name, F.col("title")), overview=T.non_blank(d("description")),
        release_date=date, release_year=V.first_year(date), runtime_minutes=V.minutes_of_seconds(T.trimmed(d("duration")).try_cast("long")), genres=non_empty(people(d("tags"))),
        tags=F.concat(*(F.coalesce(F.transform(people(d(c)), _labelled(k)), F.array().cast(STRINGS)) for c, k in (("performers", "performer"), ("directors", "director")))),
        alternate_titles=F.array_compact(F.array(name)), score_milli=V.rating_milli(T.trimmed(d("rating")).try_cast("double")), tagline=T.non_blank(d("site.name")), language=T.non_blank(d("site.network.name")),
        external_ids=F.concat(external_ids(("theporndb", F.col("slug")), ("theporndb_source_url", d("url"))), F.coalesce(hashes, F.array().cast(IDS))),
        artwork=F.concat(artwork(("poster", poster)), F.coalesce(pictures, F.array().cast(ART)), artwork(("trailer", T.non_blank(d("trailer"))))), outcome="scene_parsed",
    )


def _labelled(kind: str):
    return lambda name: F.concat(F.lit(f"{kind}:"), name)


PRODUCT = "productUuid string, title string, body string, deliveryItemId string, playTime string, sku array<struct<skuId:string,salesStartAt:string>>, actress array<struct<name:string>>, genre array<struct<name:string>>, directors array<struct<name:string>>, maker struct<name:string>, label struct<name:string>, series struct<name:string>, thumbnail struct<path:string>, packageImage struct<path:string>, media array<struct<path:string>>, movie struct<path:string>"
HIT = "array<struct<_source:struct<productUuid:string,deliveryItemId:string>>>"


def product_hit(response: Column, number: Column) -> Column:
    """The first search hit whose item number is the wanted one: its product id."""
    hits = F.from_json(F.get_json_object(response, "$.hits.hits"), HIT)
    same = F.filter(hits, lambda h: (T.compact(h["_source"]["deliveryItemId"]) == T.compact(number)) & T.non_blank(h["_source"]["productUuid"]).isNotNull())
    return F.get(same, F.lit(0))["_source"]["productUuid"]


def products(rows: DataFrame, media_base: str = "https://media.example.test") -> DataFrame:
    """rows: response (one product) and number, the wanted number; products of another route are left out."""
    d = lambda f: F.col(f"d.{f}")
    number = lambda c: T.catalog_number(T.filename_tokens(c))
    sku = F.get(F.array_compact(F.transform(d("sku"), lambda x: T.non_blank(x["skuId"]))), F.lit(0))
    rows = rows.withColumn("d", F.from_json("response", PRODUCT)).where(T.non_blank(d("title")).isNotNull())
    rows = rows.withColumn("av", F.coalesce(number(d("deliveryItemId")), number(sku), number(d("title")), number(F.col("number")))).where("av.route = 'censored'")
    url = lambda path: F.concat(F.lit(media_base + "/"), F.regexp_replace(T.non_blank(path), "^/+", ""))
    thumb = url(d("thumbnail.path"))
    poster = F.coalesce(url(d("packageImage.path")), thumb)
    backs = F.array_compact(F.transform(d("media"), lambda x: url(x["path"])))
    backs = F.array_distinct(F.concat(F.coalesce(backs, F.array().cast(STRINGS)), F.array_compact(F.array(other_than(thumb, poster)))))
    starts = F.transform(d("sku"), lambda x: F.nullif(F.regexp_extract(T.trimmed(x["salesStartAt"]), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    date = F.get(F.array_compact(starts), F.lit(0))
    people = lambda c: F.array_distinct(F.array_compact(F.transform(c, lambda x: T.non_blank(x["name"]))))
    title = T.non_blank(d("title"))
    makers = F.array_compact(F.array(*(tag(k, T.non_blank(d(f"{k}.name"))) for k in ("maker", "label", "series"))))
    return _candidates(
        rows, "prestige",
        provider_id=F.concat(F.lit("prestige:product:"), F.coalesce(T.non_blank(d("productUuid")), F.col("query_id").cast("string"))), title=title, sort_title=F.col("av.number"), overview=T.non_blank(d("body")),
        release_date=date, release_year=V.first_year(date), runtime_minutes=V.whole_number(d("playTime")), genres=non_empty(people(d("genre"))),
        tags=F.concat(makers, *(F.coalesce(F.transform(people(d(c)), _labelled(k)), F.array().cast(STRINGS)) for c, k in (("actress", "actor"), ("directors", "director")))), language=F.lit("ja"),
        external_ids=external_ids(("av_number", F.col("av.number")), ("prestige", d("productUuid"))),
        artwork=F.concat(artwork(("poster", poster)), F.transform(backs, lambda u: F.struct(F.lit("backdrop").alias("kind"), u.alias("url"))), artwork(("trailer", url(d("movie.path"))))), outcome="product_parsed",
    )


def fixture(queries: DataFrame) -> DataFrame:
    """One certain candidate for each query; queries: query_id, query_title, query_year, query_language."""
    year = F.col("query_year").cast("string")
    return _candidates(
        queries, "fixture",
        provider_id=F.concat(F.lit("fixture:"), F.replace(F.lower("query_title"), F.lit(" "), F.lit("-"))), title=F.concat("query_title", F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit(""))),
        original_title=F.col("query_title"), sort_title=F.col("query_title"), overview="Fixture metadata suggestion.", release_date=F.concat(year, F.lit("-01-01")), release_year=F.col("query_year"),
        genres=F.array(F.lit("Unknown")), tags=F.array(F.lit("fixture")), language=F.col("query_language"), outcome="fixture_static",
    )


def united(*sources: DataFrame) -> DataFrame:
    """All sources' candidates; their order is the sources' order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("source_ordinal", F.lit(i)) for i, s in enumerate(sources)))
