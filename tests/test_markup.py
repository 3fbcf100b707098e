"""Pages that leave end tags or the body out, addresses by the reference vectors, links of many requests."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import html as H
from spindrift.functions import urls as U
from spindrift.operators import links, lookups


def facts(html, url="https://h.example/p"):
    return dict(zip(H.FOUND, H.found(html, url), strict=True))


@pytest.mark.parametrize("html", [
    "<ul><li>Runtime: 90<li>Rating: 7.5<li>Votes: 12</ul>", "<ul><li>Runtime: 90</li><li>Rating: 7.5</li><li>Votes: 12</li></ul>", "<table><tr><td>Runtime: 90<tr><td>Rating: 7.5<tr><td>Votes: 12</table>",
    "<p>Runtime: 90<p>Rating: 7.5<p>Votes: 12<div>other: 1</div>", "<html><head><title>t</title><body><ul><li>Runtime: 90<ul><li>inner</ul><li>Rating: 7.5<li><p>Votes: 12</ul>x",
])
def test_end_tags_left_out(html):
    f = facts(html)
    assert (f["score"], f["vote_count"]) == ("7.5", "12") and f["runtime"].split()[0] == "90"


def test_rows_of_a_nested_list_stay_inside():
    lines = facts("<ul><li>A: 1<ul><li>B: 2<li>C: 3</ul><li>D: 4</ul>")["lines"]
    assert [(x["label"], x["value"]) for x in lines] == [("A", "1 B: 2 C: 3"), ("B", "2"), ("C", "3"), ("D", "4")]


@pytest.mark.parametrize(("html", "body"), [
    ("plain words", "plain words"), ("<title>T</title><meta name=x><h1>Head</h1> Runtime: 12 min", "Head Runtime: 12 min"), ("<html><head><title>T</title></head><div>a</div></html>tail", "a tail"),
    ("<head><script>var x</script></head>\n <body class=c>b</body>", "b"), ("<body>one<body>two", "one two"), ("", ""), ("<title>only</title>", ""),
])
def test_the_body_may_be_implied(html, body):
    assert facts(html)["body"] == body


def test_labels_are_found_without_a_body_tag():
    assert facts("<h1>T</h1>Runtime: 95 Rating: 8")["runtime"] == "95"


def test_cells_and_options_and_paragraphs_end():
    page = H.Page("<table><tr><th>Maker<td>M<tr><td>Label<td>L</table><select><option>a<option>b</select><p>x<div>y</div><dl><dt>k<dd>v<dt>w</dl>")
    texts = lambda s: [e.text() for e in page.select(s)]
    assert (texts("tr"), texts("td"), texts("option"), texts("p"), texts("dt"), texts("dd")) == (["Maker M", "Label L"], ["M", "Label", "L"], ["a", "b"], ["x"], ["k", "w"], ["v"])


def test_trailers():
    own = lambda html: dict(zip(H.OWN, H.detail(html, "https://h.example/a"), strict=True))["trailer_url"]
    assert own('<a href="/x.mp4#t=1">a</a><a href="/y.MP4?z=1">b</a>') == "https://h.example/y.MP4?z=1"
    assert own('<video src="/v.mp4"></video><source src="/s.webm"><video><source src="/in.m3u8"></video>') == "https://h.example/in.m3u8"
    assert own('<source type="video/mp4" src="/t.mp4">') == "https://h.example/t.mp4"


def test_address_vectors(spark):
    rows = [
        ("https://host/index.html", "host", "host", False), ("https://host", "host", "host", False), ("https://h/a/detail/", "a", "a", False), ("https://h/d?id=77&x=1", "d", "77", False), ("/v/abc?q#f", "abc", "abc", False),
        ("https://h/id=9/z", "z", "9", False), ("https://h/v.mp4#t=1", "v.mp4", "v.mp4", False), ("https://h/v.MP4?t=1", "v.MP4", "v.MP4", True), ("v.webm", "v.webm", "v.webm", True), ("a.m3u8?", "a.m3u8", "a.m3u8", True), ("index.html", None, None, False),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "u string")
    got = df.select("u", U.last_segment(F.col("u")), U.page_id(F.col("u")), U.is_video_url(F.col("u"))).collect()
    assert [tuple(r) for r in got] == rows


def test_hosts_by_their_last_labels(spark):
    kinds = {"https://pan.quark.cn/s": "quark", "https://x.pan.quark.cn/s": "quark", "https://quark.cn/s": "web", "https://notuc.cn/": "web", "https://a.b.uc.cn/": "uc", "https://115.com": "115", "https://x115.com": "web", "https://localhost/": "web", "none": "other", "MAGNET:?xt": "magnet"}
    got = spark.createDataFrame([(u,) for u in kinds], "u string").select("u", U.link_type(F.col("u"))).collect()
    assert dict(map(tuple, got)) == kinds


def test_an_entity_keeps_its_own_kind(spark):
    q = spark.createDataFrame([("e1",), ("e2",)], "external_id string")
    t = spark.createDataFrame([("e1", "b", "x"), ("e1", "a", "z"), ("e1", "a", "y")], "external_id string, entity string, kind string")
    u = spark.createDataFrame([("e2", "c", None), ("e1", "0", "0")], t.schema)
    assert sorted(map(tuple, lookups.by_external_id(q, t, u).collect())) == [("e1", "a", "y"), ("e2", "c", None)]


LINKS = "request long, provider string, id long, title string, score int, place int, url string, source string, password string, note string"


def test_each_request_has_its_own_limit_sources_and_types(spark):
    rows = [(r, p, i, f"t{i % 2}", 10 - i // 2, 0, f"https://pan.quark.cn/s/{i}" if i % 3 else f"magnet:?x={i}", f"{p}:{i}", f"pw{i}", None) for r in (1, 2, 3) for i in range(9) for p in ("a", "b")]
    requests = spark.createDataFrame([(1, [], [], 2), (2, ["B"], ["magnet"], 50), (3, ["none"], [], 5), (4, [], [], 5)], "request long, sources array<string>, link_types array<string>, limit int")
    got = {}
    for r in links.search(spark.createDataFrame(rows, LINKS), requests).collect():
        got.setdefault(r.request, {})[r.normalized_url] = (r.password, r.sources)
    assert got == {1: {"magnet:?x=0": ("pw0", ["a:0", "b:0"]), "https://pan.quark.cn/s/1": ("pw1", ["a:1", "b:1"])}, 2: {f"magnet:?x={i}": (f"pw{i}", [f"b:{i}"]) for i in (0, 3, 6)}}


def test_a_merged_link_says_what_its_first_one_says(spark):
    rows = [(1, "a", 1, "t", 5, 1, "https://H.example/x#1", "s1", "late", "n1"), (1, "a", 1, "t", 5, 0, "https://h.example/x", "s2", None, "n2"), (1, "a", 2, "t", 9, 3, "https://h.example/x#2", "s2", "best", None)]
    requests = spark.createDataFrame([(1, [], [], 0)], "request long, sources array<string>, link_types array<string>, limit int")
    assert [(r.url, r.password, r.note, r.sources) for r in links.search(spark.createDataFrame(rows, LINKS), requests).collect()] == [("https://h.example/x#2", "best", None, ["s2"])]
    more = requests.withColumn("limit", F.lit(2))
    assert [(r.password, r.sources) for r in links.search(spark.createDataFrame(rows, LINKS), more).collect()] == [("best", ["s1", "s2"])]


def test_a_hot_request_passes_on_few_results_a_task(spark):
    rows = spark.range(50_000).selectExpr("id div 60000 + 1 request", "'a' provider", "id", "concat('t', id) title", "cast(id % 7 as int) score", "0 place", "concat('https://h.example/', id) url", "'s' source")
    requests = spark.createDataFrame([(1, [], [], 3)], "request long, sources array<string>, link_types array<string>, limit int")
    out = links.search(rows, requests)
    assert out.count() == 3 and "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
