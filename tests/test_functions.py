"""Scalar functions on literal values."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import html
from spindrift.functions import text as T
from spindrift.functions import urls as U
from spindrift.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name, number, route",
    [
        ("[UHD] qzkw00917 2160p hevc.webm", "QZKW-917", "censored"),
        ("/y/FC2-PPV-7004812.mkv", "FC2-7004812", "fc2"),
        ("fc2ppv 7004812", "FC2-7004812", "fc2"),
        ("MDX0123", "MDX-123", "domestic"),
        ("MKY-HS-004", "MKY-HS-004", "domestic"),
        ("Studio.24.01.05.title.mp4", "STUDIO.24.01.05", "western"),
        ("300MIUM-763", "300MIUM-763", "amateur"),
        ("010120_001", "010120_001", "uncensored"),
        ("n1234.wmv", "N1234", "uncensored"),
        ("HD 1080 plain", None, None),
        ("", None, None),
    ],
)
def test_catalog_number(spark, name, number, route):
    found = one(spark, T.catalog_number(T.filename_tokens(F.lit(name))))
    assert (found and found.number, found and found.route) == (number, route)


@pytest.mark.parametrize(
    "title, variants",
    [
        ("The Show (2020) [HD]", ["The Show (2020) [HD]", "The Show", "the show 2020 hd"]),
        ("(only)", ["(only)", "only"]),
        ("x ( )", ["x ( )", "x"]),
        ("  ", []),
        ("Ä-b", ["Ä-b", "ä b"]),
    ],
)
def test_title_variants(spark, title, variants):
    assert one(spark, T.search_title_variants(F.lit(title))) == variants


def test_titles(spark):
    assert one(spark, T.normalize_title(F.lit("  Spider-Man: ÉTÉ 2!"))) == "spidermanété2"
    assert one(spark, T.collapsed(F.lit("　a \n b\t"))) == "a b"
    assert one(spark, T.strip_markup(F.lit("a<b>c</b> d <e"))) == "a c d"
    assert one(spark, T.percent_encode(F.lit("a b*~/"))) == "a%20b%2A~%2F"
    assert one(spark, T.labeled_value(F.lit("Runtime: 90 min  Date： 2001"), "Runtime", ["Runtime", "Date"])) == "90 min"


@pytest.mark.parametrize("template, status", [("{{event_id}}", "ok"), ("{{event_id", "unclosed"), ("a }} b", "unclosed"), ("{{ }}", "empty"), ("{{x}}", "unknown"), ("{{x}} {{", "unknown"), ("plain", "ok")])
def test_template_status(spark, template, status):
    assert one(spark, T.template_status(F.lit(template))) == status


def test_template_render(spark):
    values = {"event_id": F.lit("$1\\{{attempt}}"), "attempt": F.lit("2")}
    assert one(spark, T.render_template(F.lit("<{{ event_id }}|{{attempt}}>"), values)) == "<$1\\{{attempt}}|2>"


@pytest.mark.parametrize(
    "url, normal, kind",
    [
        (" HTTPS://PAN.QUARK.CN/s/Demo#frag ", "https://pan.quark.cn/s/Demo", "quark"),
        ("magnet:?xt=URN:ABC", "magnet:?xt=urn:abc", "magnet"),
        ("http://u@www.alipan.com:80/x", "http://u@www.alipan.com:80/x", "aliyun"),
        ("https://notuc.cn/", "https://notuc.cn/", "web"),
        ("no scheme", "no scheme", "other"),
        ("#only", None, "other"),
        ("  ", None, "other"),
    ],
)
def test_urls(spark, url, normal, kind):
    assert one(spark, U.normalize_url(F.lit(url))) == normal
    assert one(spark, U.link_type(F.lit(url))) == kind


@pytest.mark.parametrize("url, safe", [("http://h/x", True), ("https://u@h/x", False), ("ftp://h", False), ("http://h/Bearer", False), ("http:///x", False), ("http://h/a b", False), ("https://h/file://x", False)])
def test_safe_url(spark, url, safe):
    assert one(spark, U.is_safe_url(F.lit(url))) is safe


def test_resolved_url(spark):
    base = F.lit("https://h.x/a/b")
    assert one(spark, U.resolved_url(base, F.lit("/c"))) == "https://h.x/c"
    assert one(spark, U.resolved_url(base, F.lit("c"))) == "https://h.x/a/b/c"
    assert one(spark, U.resolved_url(base, F.lit("//c/d"))) == "https://c/d"


@pytest.mark.parametrize("score, votes, bonus", [(900, 24, 0), (649, 25, 0), (675, 25, 1), (650, 100, 2), (1000, 999, 12), (1000, 10000, 16), (None, 100, 0), (800, None, 0)])
def test_community_bonus(spark, score, votes, bonus):
    assert one(spark, V.community_bonus(F.lit(score).cast("int"), F.lit(votes).cast("int"))) == bonus


def test_dates(spark):
    assert one(spark, V.first_iso_date(F.lit("on 2020-01-02x 1999-01-01"))) == "2020-01-02"
    assert one(spark, V.first_iso_date(F.lit("2020/01/02"))) is None
    assert one(spark, V.first_year(F.lit("12345 1887 1999"))) == 1999
    assert one(spark, V.year_of_date(F.lit("20201"))) is None
    assert one(spark, V.iso_date(F.lit(2020), F.lit(2), F.lit(31))) == "2020-02-31"
    assert one(spark, V.iso_date(F.lit(2020), F.lit(13), F.lit(1))) is None


def test_arrays(spark):
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, V.append_distinct(names("A"), names(" a ", "b", "B", " "))) == ["A", "b"]
    assert one(spark, V.without(names("x", "y", "x", "z"), F.lit("y"))) == ["x", "z"]
    assert one(spark, V.payload_keys(F.lit('{"b":1,"a":2}'))) == ["a", "b"]
    assert one(spark, V.payload_keys(F.lit("[]"))) == []


def test_page_facts():
    page = '<html><head><title>T</title><meta property="og:title" content=" O  t "><link rel="canonical" href="/c"><meta property="og:image" content="//i/p.jpg"></head><body><h1>H</h1><p>Runtime: 95 min</p><p>Rating: 4.2</p><time datetime="2001-02-03">x</time><a href="/l">L</a><img src="i.png"><script>no</script></body></html>'
    f = dict(zip(html.FOUND, html.found(page, "https://h/x/y"), strict=True))
    assert (f["title"], f["overview"], f["date"], f["runtime"], f["score"], f["poster_urls"]) == ("O t", None, "2001-02-03", "95 min", "4.2", ["https://i/p.jpg"])
    assert f["canonical_url"] == "https://h/c" and f["links"] == [{"url": "https://h/l", "text": "L"}] and f["images"] == ["https://h/x/y/i.png"]
    assert html.found("", "")[0] is None
