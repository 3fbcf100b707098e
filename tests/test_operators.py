"""Operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import batch, fuse, links, planning, rank, resolve
from spindrift.sources import catalog, sinks

PAIR = "query_id long, query_title string, query_year int, query_language string, query_ids array<struct<provider:string,value:string>>, provider string, provider_id string, titles array<string>, year int, language string, ids array<struct<provider:string,value:string>>, score_milli int, votes int"


@pytest.mark.parametrize(
    "titles, year, language, ids, confidence, outcomes",
    [
        (["Harbour Lights"], 1999, "EN_us", [("IMDB ", " TT1")], 1000, ("exact", "exact", "exact", "exact")),
        (["harbour  lights!"], 2000, "fr", [("imdb", "tt2")], 350, ("normalized", "mismatch", "mismatch", "mismatch")),
        ([None, " "], None, None, [], 250, ("missing_candidate", "candidate_missing", "candidate_missing", "candidate_missing")),
        (["Other"], 1998, None, None, 0, ("mismatch", "mismatch", "candidate_missing", "candidate_missing")),
    ],
)
def test_score(spark, titles, year, language, ids, confidence, outcomes):
    row = (1, "Harbour Lights", 1999, "en-US", [("imdb", "tt1")], "p", "i", titles, year, language, ids, None, None)
    got = rank.scored(spark.createDataFrame([row], PAIR)).first()
    assert got.confidence_milli == confidence
    assert (got.title_outcome, got.year_outcome, got.language_outcome, got.id_outcome) == outcomes
    assert got.reasons[0] == "base:base:250"


def test_rank_keeps_twelve_in_order(spark):
    rows = [(1, "t", None, "en", [], f"p{i:02}", str(i), ["t"] if i % 2 else ["u"], None, None, [], None, None) for i in range(30)]
    got = rank.ranked(rank.scored(spark.createDataFrame(rows, PAIR))).orderBy("rank").collect()
    assert [r.provider for r in got] == [f"p{i:02}" for i in range(1, 24, 2)]


def test_clusters_follow_bridges_and_chains(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None), *[(10 + i, f"k{i}") for i in range(40)], *[(11 + i, f"k{i}") for i in range(40)]]
    got = dict(resolve.clusters(spark.createDataFrame(rows, "fact long, id string")).collect())
    assert [got[k] for k in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 5]
    assert {got[10 + i] for i in range(41)} == {10}
    assert resolve.clusters(spark.createDataFrame([], "fact long, id string")).count() == 0


def test_fusion_prefers_then_base_then_first(spark):
    rows = [("c", "a", "1", 1, 500, None, "x"), ("c", "b", "1", 2, 900, None, None), ("c", "z", "1", 3, 100, 7, "y"), ("d", "a", "2", 4, 1, None, None)]
    facts = spark.createDataFrame(rows, "cluster string, provider string, provider_id string, arrival long, confidence_milli int, runtime int, title string")
    got = {r.cluster: r for r in fuse.fused(facts, {"runtime": ["z"], "title": []}).collect()}
    assert (got["c"].provider, got["c"].runtime, got["c"].title) == ("b", 7, None)
    assert (got["d"].provider, got["d"].runtime) == ("a", None)
    got = {r.cluster: r for r in fuse.fused(facts, {"title": ["q"]}).collect()}
    assert got["c"].title == "x"


def test_links_merge_and_group(spark):
    rows = [(1, "a", 5, 0, "https://PAN.QUARK.CN/s/Zk41?a=B#part2", "s2"), (2, "b", 4, 0, "https://pan.quark.cn/s/Zk41?a=B", "s1"), (2, "b", 4, 1, "magnet:?X", "s1"), (3, "c", 3, 0, " ", "s1")]
    rows = spark.createDataFrame(rows, "id long, title string, score int, place int, url string, source string")
    typed = links.typed(rows)
    got = {r.normalized_url: r for r in links.merged(typed).collect()}
    assert got["https://pan.quark.cn/s/Zk41?a=B"].sources == ["s1", "s2"]
    assert got["https://pan.quark.cn/s/Zk41?a=B"].url == "https://PAN.QUARK.CN/s/Zk41?a=B#part2"
    assert [r.link_type for r in links.grouped(links.merged(typed)).collect()] == ["quark", "magnet"]
    assert links.best(rows, 1).count() == 1


def test_breaker(spark):
    steps = [(True, "timeout"), (True, "timeout"), (True, "timeout"), (True, "x"), (False, None), (True, "auth_or_forbidden"), (True, "not_found")]
    rows = [("p", i, f, r, {"timeout": "retryable", "auth_or_forbidden": "operator_action", "not_found": "permanent"}.get(r)) for i, (f, r) in enumerate(steps)]
    got = batch.replay(spark.createDataFrame(rows, "provider string, item_index long, failed boolean, reason string, retry_class string")).orderBy("item_index").collect()
    assert [r.outcome for r in got] == ["failed", "failed", "suppressed", "suppressed", "suppressed", "failed", "suppressed"]
    assert [r.cooldown_remaining for r in got] == [0, 3, 2, 1, 0, 3, 2]


def test_streaks_history_reuse(spark):
    e = spark.createDataFrame([("p", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1])], "provider string, item_index long, failed int").withColumn("failed", F.col("failed") == 1)
    assert [r.in_a_row for r in batch.consecutive_failures(e).orderBy("item_index").collect()] == [1, 2, 0, 1, 2, 3]
    assert [r.item_index for r in batch.last_attempts(e, "provider", "item_index", 2).collect()] == [5, 4]
    assert batch.last_attempts(e, "provider", "item_index", 0).count() == 0
    assert [r.reused_from for r in batch.first_occurrence(e, "failed").orderBy("item_index").collect()] == [None, 0, None, 0, 0, 0]


def test_sources(spark):
    got = {r.provider: r.status for r in catalog.statuses(catalog.catalog(spark), ["tmdb"], F.lit("fc2"), 3).collect()}
    assert [got[p] for p in ("fc2", "fc2ppvdb", "airav", "avsox", "tmdb", "dmm")] == ["selected", "selected", "selected", "budget_exhausted", "suppressed", "skipped_by_route"]
    first = catalog.by_quality(catalog.catalog(spark), "community").first().providers
    assert first[:4] == ["theporndb", "javlibrary", "javdb", "jav321"]


def test_planning(spark):
    df = spark.createDataFrame([("q", '{"external_id":{"kind":"","value":"x"},"external_id_kind":"a","external_id_value":"b"}'), ("http://x", "{}"), ("q", '{"title":" "}'), ("q", None)], "q string, e string")
    assert [r.i for r in df.select(planning.intent(F.col("q"), F.col("e")).alias("i")).collect()] == ["free_text", "exact_link", "free_text", "free_text"]
    assert spark.range(1).select(planning.languages(F.array(F.lit("B"), F.lit("a "), F.lit("b"), F.lit("x_"))).alias("l")).first().l == ["a", "b"]


def test_guarded(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, True), (3, True, False)], "id int, valid boolean, allowed boolean")
    got = sinks.guarded(df, F.col("valid"), F.col("allowed"), F.when(F.col("id") < 4, F.lit("{}"))).orderBy("id").collect()
    assert [r.write_status for r in got] == ["submitted", "failed", "failed"]


def test_best_types_the_chosen_links_alone(spark):
    rows = spark.createDataFrame([(1, "a", 5, 0, "https://a.example/x", "s"), (1, "a", 5, 1, "magnet:?x", "s"), (2, "b", 9, 0, "ed2k://y", "s")], "id int, title string, score int, place int, url string, source string")
    got = links.best(rows, 1, ["web"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and [(r.id, r.url) for r in got.collect()] == [(1, "https://a.example/x")]


def test_search_shuffles_links_of_asked_sources_alone(spark, tmp_path):
    rows = spark.createDataFrame([(1, p, 7, "t", 3, k, f"https://{p}.example/{k}", p) for k, p in enumerate("aab")], "request int, provider string, id int, title string, score int, place int, url string, source string")
    asked = spark.createDataFrame([(1, ["A"], ["web"], 5)], "request int, sources array<string>, link_types array<string>, limit int")
    rows.write.parquet(f"{tmp_path}/rows")
    asked.write.parquet(f"{tmp_path}/asked")
    got = links.search(spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/asked"))
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.url for r in got.collect()) == ["https://a.example/0", "https://a.example/1"]
