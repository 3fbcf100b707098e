"""Queries over sources: responses and pages, made of the tables, become candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import html as H
from spindrift.functions import text as T
from spindrift.functions import values as V
from spindrift.sources import json_sources as J
from spindrift.sources.page_sources import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(c: str, a: str, b: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit("="), x[b])), "|")


def flat(candidates: DataFrame) -> DataFrame:
    """Candidates with their lists joined into texts."""
    lists = {c: F.array_join(c, "|") for c in ("genres", "tags", "alternate_titles")}
    pairs = {"external_ids": _pairs("external_ids", "provider", "value"), "artwork": _pairs("artwork", "kind", "url")}
    return candidates.withColumns(lists | pairs)


def _json(**fields: Column | str) -> Column:
    """A JSON object; NULL members are left out."""
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())))


def _mod(n: int, *at: int) -> Column:
    return (F.col("p_size") % n).isin(*at)


def _text(c: Column) -> Column:
    return c.cast("string")


def _parts(spark: SparkSession, sf_dir: str, language: str = "en-US") -> DataFrame:
    p = spread(read(spark, sf_dir, "part"), "p_partkey")
    return p.withColumns({"query_id": F.col("p_partkey"), "query_title": F.concat(F.lit("Query "), F.col("p_brand")), "query_language": F.lit(language)})



def _day() -> Column:
    return F.format_string("%04d-%02d-%02d", F.col("p_size") + 1950, F.col("p_size") % 12 + 1, F.col("p_size") % 28 + 1)


def _screen(spark: SparkSession, sf_dir: str, name: str, original: str, date: str, titles: str) -> DataFrame:
    p, key = _parts(spark, sf_dir), F.col("p_partkey")
    search = _json(**{
        "id": key, name: F.when(~_mod(7, 0), F.col("p_name")), original: F.col("p_brand"), "overview": F.when(_mod(5, 0), "  ").otherwise(F.col("p_type")), date: F.when(_mod(6, 0), "").otherwise(_day()),
        "poster_path": F.when(~_mod(3, 0), F.concat(F.lit("/p"), _text(key), F.lit(".jpg"))), "genre_ids": F.array(F.lit(18), F.col("p_size"), F.lit(35)),
        "vote_average": (F.col("p_size") % 97) / 10, "vote_count": key * 3,
    })
    links = F.when(_mod(5, 1), '"oops"').otherwise(F.concat(F.lit('{"imdb_id":"tt'), _text(key), F.lit('","wikidata_id":" ","tvdb_id":'), _text(F.col("p_size")), F.lit("}")))
    rest = _json(**{
        "id": F.when(key % 4 == 1, key + 1).otherwise(key), original: F.when(_mod(2, 0), "Original").otherwise(F.col("p_brand")), "runtime": F.col("p_size") + 60, "tagline": F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")),
        "genres": F.when(_mod(3, 1), F.array(F.struct(F.lit(1).alias("id"), F.col("p_type").alias("name")), F.struct(F.lit(0).alias("id"), F.lit("x").alias("name")))),
        "original_language": F.when(_mod(4, 0), "ja"), "backdrop_path": "//b.jpg", "episode_run_time": F.array(F.lit(0), F.col("p_size")), "origin_country": F.array(F.lit("JP"), F.lit(" ")),
        "networks": F.array(F.struct(F.lit(1).alias("id"), F.col("p_brand").alias("name"))), "number_of_seasons": F.col("p_size") % 3, "status": "Ended",
    })
    more = F.concat(F.lit(f',"alternative_titles":{{"{titles}":[{{"title":"'), F.col("p_brand"), F.lit('"},{"title":"Alt '), F.col("p_name"), F.lit('"},{"title":"Alt '), F.col("p_name"), F.lit('"}]}}'))
    detail = F.concat(F.regexp_replace(rest, "}$", ""), F.lit(',"external_ids":'), links, more)
    return p.withColumns({"search": search, "detail": F.when(key % 4 != 0, detail)})


def movie_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(J.movies(_screen(spark, sf_dir, "title", "original_title", "release_date", "titles")))


def show_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(J.shows(_screen(spark, sf_dir, "name", "original_name", "first_air_date", "results")))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = _parts(spark, sf_dir), F.col("p_partkey")
    p = p.withColumns({"query_title": F.when(_mod(4, 1), F.col("p_name")).when(_mod(4, 2), F.col("p_type")).otherwise("other"), "query_language": F.when(_mod(2, 0), "zh-CN").otherwise("en")})
    tags = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).cast("int").alias("count")) for n, c in (("low", 1), ("high", 9), ("same", 5), (" ", 50), ("also", 5), ("high", 3))))
    box = F.concat(
        F.lit('[{"key":"别名","value":[{"v":"Alias "},{"v":"'), F.col("p_brand"), F.lit('"}]},{"key":" 制作 ","value":"Studio '), _text(F.col("p_size")),
        F.lit('"},{"key":"staff","value":[{"k":"制作","v":"Inner"},{"k":"x","v":"no"}]},{"key":"Alias","value":"'), F.col("p_type"), F.lit('"},{"key":"n","value":7}]'),
    )
    counts = F.struct(F.col("p_size").alias("wish"), F.lit(2).alias("collect"), F.when(_mod(3, 0), 5).alias("doing"))
    search = _json(id=key, type=F.lit(2), name=F.col("p_name"), name_cn=F.when(~_mod(5, 0), F.col("p_type")), date=_day(), meta_tags=F.array(F.lit("TV"), F.lit("high")), tags=tags, collection=F.when(~_mod(7, 0), counts), eps=F.col("p_size"))
    detail = F.concat(F.regexp_replace(_json(id=key, summary=F.col("p_brand"), rating=F.struct(F.col("p_size").alias("rank"), ((F.col("p_size") % 97) / 10).alias("score"), (key * 2).cast("int").alias("total")), platform=" Web ", nsfw=_mod(9, 0)), "}$", ""), F.lit(',"infobox":'), box, F.lit("}"))
    return p.withColumns({"search": search, "detail": F.when(key % 3 != 0, detail)})


def subject_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(J.subjects(_subjects(spark, sf_dir)))


def media_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = _parts(spark, sf_dir), F.col("p_partkey")
    p = p.withColumn("query_title", F.when(_mod(4, 1), F.col("p_type")).otherwise("other"))
    labels = F.array(*(F.struct(F.lit(f"tag{i}").alias("name"), (F.col("p_size") + i * 5).alias("rank"), F.lit(i % 4 == 3).alias("isMediaSpoiler")) for i in range(14)))
    names = F.struct(F.when(_mod(3, 0), F.col("p_brand")).alias("userPreferred"), F.when(~_mod(5, 0), F.col("p_name")).alias("english"), F.col("p_type").alias("romaji"), F.lit("原題").alias("native"))
    first = F.struct(
        key.alias("id"), F.when(_mod(2, 0), key + 7).alias("idMal"), (key % 5 == 0).alias("isAdult"), F.concat(F.lit("https://a.example/"), _text(key)).alias("siteUrl"), names.alias("title"),
        F.lit("<b>Bold</b> and <i>more").alias("description"), F.struct((F.col("p_size") + 1950).alias("year"), (F.col("p_size") % 13).alias("month"), F.lit(7).alias("day")).alias("startDate"), F.lit("TV").alias("format"),
        F.col("p_size").alias("duration"), F.when(_mod(2, 1), F.col("p_size") * 2).alias("averageScore"), F.lit(61).alias("meanScore"), F.array(F.lit("Drama"), F.lit(" "), F.lit("Drama")).alias("genres"), labels.alias("tags"), F.lit("https://i.example/b.jpg").alias("bannerImage"),
    )
    response = F.to_json(F.struct(F.struct(F.struct(F.array(first).alias("media")).alias("Page")).alias("data")))
    return flat(J.media(p.withColumn("response", response)))


def scene_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = _parts(spark, sf_dir), F.col("p_partkey")
    people = F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit(" ").alias("name")), F.struct(F.col("p_brand").alias("name")))
    hashes = F.array(F.struct(F.lit("AB-12_F").alias("hash"), F.lit("OSHASH").alias("type")), F.struct(F.lit("no hash").alias("hash"), F.lit("PHASH").alias("type")))
    response = _json(
        slug=F.when(~_mod(3, 0), F.concat(F.lit("scene-"), _text(key))), url=F.concat(F.lit("https://s.example/scenes/u"), _text(key), F.lit("/more?x=1")), title=F.when(~_mod(10, 3), F.col("p_name")), date=F.concat(_day(), F.lit(" 10:00")),
        duration=F.when(_mod(2, 0), _text(key)), sku=F.when(_mod(4, 0), F.concat(F.lit("ABC-"), F.lpad(_text(F.col("p_size")), 3, "0"))), rating=_text(F.col("p_size") / 10), performers=people, tags=people, site=F.struct(F.lit("Site").alias("name")),
        poster=F.when(_mod(2, 1), "https://i.example/p.jpg"), image="https://i.example/i.jpg", back_image="https://i.example/p.jpg", background=F.struct(F.lit("https://i.example/f.jpg").alias("full")), trailer=F.when(_mod(5, 0), "https://i.example/t.mp4"), hashes=hashes,
    )
    return flat(J.scenes(p.withColumn("response", response)))


def product_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that a search found by their number."""
    p, key = _parts(spark, sf_dir), F.col("p_partkey")
    number = F.concat(F.lit("XYZ-"), F.lpad(_text(F.col("p_size")), 3, "0"))
    hit = lambda i, n: F.struct(F.struct(F.lit(i).alias("productUuid"), n.alias("deliveryItemId")).alias("_source"))
    found = F.to_json(F.struct(F.struct(F.array(hit("no", F.lit("OTHER-001")), hit(" ", number), hit("uuid-1", F.when(~_mod(9, 0), F.replace(number, F.lit("-"), F.lit("")))), hit("uuid-2", number)).alias("hits")).alias("hits")))
    response = _json(
        title=F.col("p_name"), body=F.when(_mod(2, 0), F.col("p_type")), deliveryItemId=F.when(~_mod(8, 0), number), playTime=F.when(_mod(3, 0), "12x").when(_mod(3, 1), " 90 ").otherwise("120"),
        sku=F.array(F.struct(F.lit(" ").alias("skuId"), F.lit("soon").alias("salesStartAt")), F.struct(F.lit("FC2-PPV-1234567").alias("skuId"), F.concat(_day(), F.lit("T00:00")).alias("salesStartAt"))),
        actress=F.array(F.struct(F.col("p_brand").alias("name"))), genre=F.array(F.struct(F.lit("g").alias("name")), F.struct(F.lit("g").alias("name"))), maker=F.struct(F.lit("M").alias("name")), thumbnail=F.struct(F.lit("/t.jpg").alias("path")),
        packageImage=F.when(_mod(2, 0), F.struct(F.lit("p.jpg").alias("path"))), media=F.array(F.struct(F.lit("m1.jpg").alias("path")), F.struct(F.lit(" ").alias("path"))), productUuid=F.lit(None).cast("string"),
    )
    rows = p.withColumns({"number": number, "response": response, "uuid": J.product_hit(found, number)})
    made = J.products(rows)
    return flat(made).join(rows.select("query_id", "uuid"), "query_id").select(*made.columns, "uuid")


def fixture_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _parts(spark, sf_dir).withColumns({"query_title": F.col("p_name"), "query_year": F.when(_mod(3, 0), F.lit(None)).otherwise(F.col("p_size") + 1950)})
    return flat(J.fixture(q))


def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources' candidates in one frame, counted by source, with their ends."""
    q = _parts(spark, sf_dir).withColumns({"query_title": F.col("p_name"), "query_year": F.col("p_size") + 1950})
    every = J.united(J.movies(_screen(spark, sf_dir, "title", "original_title", "release_date", "titles")), J.subjects(_subjects(spark, sf_dir)), J.fixture(q))
    return every.groupBy("source_ordinal", "provider").agg(F.count("*").alias("n"), F.min("provider_id").alias("first_id"), F.max("title").alias("last_title"), F.sum("release_year").alias("years"))


QUERIES = {f.__name__: f for f in (movie_candidates, show_candidates, subject_candidates, media_candidates, scene_candidates, product_candidates, fixture_candidates, source_totals)}
