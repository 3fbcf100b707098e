"""Pages: selectors, the recipe, detail pages and payloads, on small literal inputs."""

import json
import re

from pyspark.sql import functions as F

from spindrift.functions import html as H
from spindrift.functions import values as V
from spindrift.operators import batch, planning, presets
from spindrift.plans import evidence, requests
from spindrift.sources import catalog, sinks
from spindrift.sources import json_sources as J
from spindrift.sources import page_sources

PAGE = """<html><head><meta name="description" content=" Plain  words. "><meta property="og:description" content="other">
<meta property="og:image" content="/img/a.png"><link rel="canonical" href="/film/9"><title>Late / Title</title></head>
<body><h1>A Long / Way</h1><time datetime="2003-04-05">x</time><span itemprop="duration" content="PT97M"></span>
<p class="score">7.5 of 10</p><div class="votes">1 204 votes</div><div class="genres"><a href="/g/1">Drama, War</a><a>Drama</a></div>
<a href="/tag/old" rel="tag">Old、New</a><div class="poster"><p><img src="//cdn.example/p.jpg"></p></div><ul><li>Length： 12 min</li></ul></body></html>"""


def test_recipe_reads_every_field():
    f = dict(zip(H.FOUND, H.found(PAGE, "https://h.example/film/x?y"), strict=True))
    assert (f["title"], f["overview"], f["date"], f["runtime"], f["score"], f["vote_count"]) == ("A Long", "Plain words.", "2003-04-05", "PT97M", "7.5 of 10", "1 204 votes")
    assert (f["genres"], f["tags"]) == (["Drama", "War", "War Drama"], ["Old", "New"])
    assert f["poster_urls"] == ["https://h.example/img/a.png", "https://cdn.example/p.jpg"] and f["canonical_url"] == "https://h.example/film/9"


def test_recipe_falls_back_to_labels():
    rows = dict(zip(H.FOUND, H.found("<body><p>评分： 4.5</p><li>Air Date: 1999-01-02 tv</li>x Duration: 50 min Votes: 8 Rating: 1</body>", "u"), strict=True))
    assert (rows["score"], rows["date"], rows["runtime"], rows["vote_count"], rows["title"]) == ("4.5", "1999-01-02 tv", "50 min", "8", None)
    assert H.found(None, "u") == (None,) * len(H.FOUND) and H.detail(None, None) == (None,) * len(H.OWN)


def test_recipe_columns(spark):
    r = spark.createDataFrame([(PAGE,)], "html string").select(H.page_texts("html", F.lit("https://h.example/")).alias("f"))
    got = r.select(*(c.alias(n) for n, c in H.recipe(F.col("f")).items())).first()
    assert (got.release_date, got.release_year, got.runtime_minutes, got.score_milli, got.vote_count) == ("2003-04-05", 2003, 97, 750, 1)


def test_a_sign_that_begins_no_tag_stays_in_its_text():
    title = lambda text: H.found(f"<head><script>a</script></head><body><h1>{text}</h1>", "u", ("title",))[0]
    assert [title(x) for x in ("i<3u", "a < 3 &amp; b", "5<", "<3", "x<!-- c -->y", "x<br>y")] == ["i<3u", "a < 3 & b", "5<", "<3", "x y", "x y"]
    # Text ahead of the body's tag begins it, and the last text of a page has no tag after it.
    assert [H.found(x, "u", ("body",))[0] for x in (" <3<p>a<4", "<script>1</script>2<3")] == ["<3 a<4", "2<3"]


def test_selectors():
    p = H.Page('<div class="a b"><p><a href="xgenrey" rel="t">1</a></p></div><a class="a">2</a><img class="poster" src="">')
    picked = lambda s: [e.name for e in p.select(s)]
    assert picked("div.a a, img.poster") == ["a", "img"] and picked(".a.b") == ["div"] and picked('a[href*="genre"]') == ["a"] and picked('[rel="t"]') == ["a"] and picked("p div") == []
    assert p.first_attribute("img", "src") is None and p.first_attribute("a", "href") == "xgenrey"


def test_detail_page_takes_the_poster_from_its_pictures():
    page = "<main><h1>T</h1><img src='/p.jpg'></main><div class='gallery'><img src='/p.jpg'><img src='q.jpg'></div><a href='/sample/x.mp4'>v</a><p>女優: A、B</p>"
    d = dict(zip(H.OWN, H.detail(page, "https://h.example/v/1"), strict=True))
    assert (d["title"], d["poster_url"], d["backdrop_urls"], d["trailer_url"], d["actors"]) == ("T", "https://h.example/p.jpg", ["https://h.example/v/1/q.jpg"], "https://h.example/sample/x.mp4", ["A", "B"])


def test_default_policy_orders(spark):
    got = {r.field: r.providers for r in presets.with_aliases(presets.preferences(spark, catalog.catalog(spark))).collect()}
    assert got["title"] == ["theporndb", "mgstage", "dmm", "javbus", "jav321", "javlibrary"] and got["community_score_milli"] == ["jav321", "javlibrary", "javdb"] and got["trailer_url"] == ["mgstage", "dmm"]


def test_numbered_names_keep_gaps(spark):
    r = spark.range(1).select(V.numbered(F.array(F.lit(" Ann "), F.lit(""), F.lit("ann"), F.lit("Bo"))).alias("x")).first()
    assert [(n.name, n.order) for n in r.x] == [("Ann", 1), ("Bo", 4)]


def test_infobox_is_walked_in_lists_and_objects(spark):
    box = '[{"key":"制作","value":[{"v":"A"},["B",{"v":"C"}],7]},{"key":"x","value":[{"k":"制作公司","v":"D"}]},{"key":" 製作 ","value":"E"}]'
    r = spark.range(1).select(J.box_values(F.try_variant_get(F.try_parse_json(F.lit(box)), "$", J.BOX), J.PRODUCTION_KEYS, 9).alias("x")).first()
    assert r.x == ["A", "B", "C", "D", "E"]


def test_unusable_details_make_a_candidate_partial(spark):
    rows = [(1, "q", "en", '{"id":5,"title":"S"}', '{"id":5,"external_ids":"oops","title":"D"}'), (2, "q", "en", '{"id":5,"title":"S"}', '{"id":6,"title":"D"}'), (3, "q", "en", '{"id":5}', None), (4, "q", "en", "{}", None), (5, None, None, None, None)]
    got = {r.query_id: (r.title, r.outcome) for r in J.movies(spark.createDataFrame(rows, "query_id int, query_title string, query_language string, search string, detail string")).collect()}
    assert got == {1: ("D", "movie_partially_enriched"), 2: ("S", "movie_degraded"), 3: ("q", "movie_degraded")}


def test_a_run_goes_on_from_its_states(spark):
    schema = "run int, item_index int, ordinal int, provider string, serves boolean, status string, candidate_count int, reason string, retry_class string"
    rows = [(1, i, 0, "p", True, "failed", 0, None, None) for i in range(8)]
    whole = batch.scrape(spark.createDataFrame(rows, schema))
    first = batch.scrape(spark.createDataFrame(rows[:4], schema))
    rest = batch.scrape(spark.createDataFrame(rows[4:], schema), batch.resume_states(first))
    get = lambda df: [(r.item_index, r.status, r.failures, r.cooldown_remaining) for r in df.orderBy("item_index").collect()]
    assert get(whole) == get(first) + get(rest)
    assert [s for _, s, _, _ in get(whole)] == ["failed", "failed", "suppressed", "suppressed", "suppressed", "failed", "failed", "suppressed"]


def test_fan_out_stops_at_the_first_failure(spark):
    rows = [(1, 0, "a", 204), (1, 1, "b", 503), (1, 2, "c", 204), (2, 0, "a", None), (2, 1, "b", 200)]
    got = {(r.event_id, r.provider): (r.provider_status, r.retryable) for r in sinks.fan_out(spark.createDataFrame(rows, "event_id int, ordinal int, provider string, http_status int")).collect()}
    assert got == {(1, "a"): ("sent", None), (1, "b"): ("failed", True), (1, "c"): ("not_sent", None), (2, "a"): ("disabled", None), (2, "b"): ("sent", None)}


def test_payloads_are_json(spark):
    event = {k: F.lit(k) for k in ("event_id", "event_kind", "subject_kind", "subject_id", "occurred_at")} | {"attempt": F.lit(2)}
    r = spark.range(1).select(sinks.webhook_payload(event, F.lit("s"), F.array(F.lit("k"))).alias("w"), sinks.embed_payload(event, F.lit('"'), F.array().cast("array<string>")).alias("e")).first()
    assert json.loads(r.w)["event"]["attempt"] == 2 and json.loads(r.e)["embeds"][0]["fields"][4]["value"] == "none" and json.loads(r.e)["content"] == '"'


def test_render_urls(spark):
    cases = {"https://h/x": None, "HTTPS://h": None, " ": "missing_url", "nothing": "invalid_render_url", "file:///x": "invalid_render_url_scheme", "http://u@h/": "invalid_render_url_credentials", "http://h/a@b": None, "https://": "invalid_render_url"}
    got = {r.u: r.f for r in spark.createDataFrame([(u,) for u in cases], "u string").select("u", planning.render_url_fault(F.col("u")).alias("f")).collect()}
    assert got == cases


def test_selectors_test_only_elements_that_can_match(monkeypatch):
    """A page's cost does not grow with selectors times elements."""
    tested = []
    simple = H._simple
    monkeypatch.setattr(H, "_simple", lambda part: lambda e: tested.append(part) or simple(part)(e))
    H.matcher.cache_clear()
    try:
        p = H.Page("<div>" * 5 + '<a class="x y" href="/genre/1">g</a>' + "</div>" * 5 + '<p class="score">1</p>')
        assert [e.name for e in p.select('.y, a[href*="genre"], p')] == ["a", "p"] and len(tested) == 1
    finally:
        H.matcher.cache_clear()


def test_named_texts_alone_are_read(spark):
    df = spark.createDataFrame([(PAGE, "https://h.example/"), (None, "u")], "html string, url string")
    got = df.select(H.page_texts("html", "url", "links", "title").alias("f"))
    assert got.schema["f"].dataType.names == ["links", "title"]
    first, none = (r.f for r in got.collect())
    assert first.title == "A Long" and first.links[0].text == "Drama, War" and (none.links, none.title) == (None, None)


def test_rows_of_a_small_file_are_spread(spark):
    from spindrift.plans.records import spread

    assert spread(spark.range(1000).coalesce(1), "id").rdd.getNumPartitions() == 16


def test_results_of_a_batch_are_held_in_parts(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS_HELD", 3)
    df = spark.range(20).coalesce(1).selectExpr("id", "concat('<h1>', id, '</h1>') html").select("id", H.page_texts("html", F.lit("u"), "title").alias("f"))
    assert {r.id: r.f.title for r in df.collect()} == {k: str(k) for k in range(20)}


def test_search_results_of_pages_with_one_address(spark, tmp_path):
    page = lambda path: f'<body><a href="/a">first</a><a href="/{path}">red</a></body>'
    spark.createDataFrame([(1, "https://h.example/x", page("one")), (2, "https://h.example/x", page("two")), (3, "https://h.example/y", page("one"))], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = evidence.search_results(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "https://h.example/one"), (2, 1, "https://h.example/two"), (3, 1, "https://h.example/one")]


def test_generic_candidates_of_pages_with_one_address(spark, tmp_path):
    rows = [(1, "https://h.example/x", "<h1>One</h1><p>a</p>"), (2, "https://h.example/x", "<h1>Two</h1>"), (3, "https://h.example/x", "<h1>Three</h1>"), (4, "https://h.example/x", "<p>none</p>"), (5, "https://h.example/y", "<h1>&quot;a&quot; &amp</h1>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = evidence.generic_page_candidates(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.title) for r in got) == [(1, "One"), (2, "Two"), (3, "Three"), (4, "asked"), (5, '"a" &')]


def test_pages_are_parsed_once_after_the_exchanges(spark):
    plans = {q: query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for q, query in (evidence.QUERIES | requests.QUERIES).items() if q in ("html_links", "page_candidates", "rendered_candidates", "titled_candidates", "official_fields")}
    evaluated = lambda plan: len([x for x in plan.split("Initial Plan")[-1].splitlines() if "ArrowEvalPython" in x.split("[")[0]])
    # One for links and one for the pages that answer.
    assert {q: evaluated(plan) for q, plan in plans.items()} == {"html_links": 1, "page_candidates": 2, "rendered_candidates": 2, "titled_candidates": 2, "official_fields": 1}


def test_only_pages_that_answer_are_parsed(spark):
    pages = spark.createDataFrame([("https://h.example/v/1", "<h1>One</h1>"), ("https://h.example/v/2", None)], "url string, html string")
    asked = spark.createDataFrame([(1, "https://h.example/v/1"), (2, "https://h.example/v/1"), (3, "https://h.example/v/3")], "query_id int, target string")
    got = page_sources.detailed(asked, pages)
    assert sorted((r.query_id, r.d.title) for r in got.collect()) == [(1, "One"), (2, "One")]
    assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_plain_pages_are_read_as_others(monkeypatch):
    told = lambda html: [(e.name, e.attributes, e.parent and e.parent.name, e.pieces) for e in H.Page(html).elements]
    texts = ["a<p class='x y' title=\"\">b &amp; c<br/>d</p></p>e", "<li>1<li>2</ul> &copy", "<script>if (a > b) '</p>'</script>", "<P>x</P>", "<a href='a&amp;b'>x", "<td id=q>x</td>", "<p>1 < 2</p>", "<!-- <p> --><p>x", "<h1>", "plain", "</p class='x'>y", "<title>a &lt; b</title>"]
    got = [told(x) for x in texts]
    assert [H.Page(x)._plain(x) for x in texts] == [True, True, False, False, False, False, False, False, True, False, False, False]
    monkeypatch.setattr(H.Page, "_plain", lambda self, html: False)
    assert got == [told(x) for x in texts]


def test_pages_of_one_site_share_a_layout(monkeypatch):
    """Selectors are tested once for pages that differ in texts and addresses alone, not for each page."""
    tested = []
    simple = H._simple
    monkeypatch.setattr(H, "_simple", lambda part: lambda e: tested.append(part) or simple(part)(e))
    monkeypatch.setattr(H, "_layouts", {})
    H.matcher.cache_clear()
    page = lambda text, path: f'<main><p class="x">{text}</p><div class="y"><a href="{path}">{text}</a></div></main>'
    try:
        told = lambda *of: [e.attributes["href"] + e.text() for e in H.Page(page(*of)).select('.y a, a[href*="star"]')]
        assert told("one", "/v/1") == ["/v/1one"]
        once = len(tested)
        assert told("two &amp; a", "/v/2") == ["/v/2two & a"] and len(tested) == once
        # A word that a selector looks for, an attribute's value and a text that begins the body make another layout.
        picked = lambda html, selector: [e.text() for e in H.Page(html).select(selector)]
        assert [picked(page("t", path), 'a[href*="star"]') for path in ("/v/1", "/star/1", "/v/2")] == [[], ["t"], []]
        assert [picked(f'<b class="{c}">t</b>', ".y") for c in "xyx"] == [[], ["t"], []]
        assert [picked(f"{text}<meta name='a'><p>t</p>", "body") for text in (" ", "x", " ")] == [["t"], ["x t"], ["t"]]
        # No shape has this value: the selector is tested for each page.
        assert [picked(page("t", path), 'a[href="/v/2"]') for path in ("/v/1", "/v/2")] == [[], ["t"]]
    finally:
        H.matcher.cache_clear()


def test_layouts_are_bounded(monkeypatch):
    monkeypatch.setattr(H, "_layouts", {})
    for k in range(3 * H.LAYOUTS):
        assert [e.text() for e in H.Page("<p>" * (k + 1) + "t").select("p")][-1] == "t"
    H.Page("<p>t</p>" * H.LAYOUT_TAGS)
    assert len(H._layouts) == H.LAYOUTS and max(len(tags) for tags, _ in H._layouts) <= H.LAYOUT_TAGS


def test_only_search_pages_that_are_asked_are_parsed(spark):
    s = page_sources.site("javdb", "https://h.example")
    pages = spark.createDataFrame([(f"https://h.example/search?q={n}", f"<a href='/v/{n}'>{n}</a>") for n in ("A-1", "B-2", "C-3")], "url string, html string")
    queries = spark.createDataFrame([(1, None, None, "A-1", "censored"), (2, None, None, "A-1", "censored"), (3, None, None, "B-2", "fc2"), (4, "/v/9", None, "C-3", "censored")], "query_id int, direct_url string, direct_id string, number string, route string")
    assert [(r.position, r.href, r.text) for r in page_sources.searched_links(queries, pages, s).collect()] == [(0, "https://h.example/v/A-1", "A-1")]


def test_a_candidates_number_is_looked_for_up_to_the_first_text_that_has_one(spark):
    for query in (evidence.page_candidates, requests.rendered_candidates):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        (body,) = re.finditer(r"substring_index\(d#\d+\.body", plan)
        # In the generator's one coalesce, and in no projection or filter of its own.
        assert re.findall(r"Project \[|Filter \(|Generate inline", plan[: body.start()])[-1] == "Generate inline"
