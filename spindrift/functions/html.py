"""Facts from HTML pages: Arrow-batched functions over the standard library's parser.

Spark has no HTML operator, and selectors need the element tree, so this is the
one place where text goes to Python, in batches.  What is found there are plain
texts; numbers, dates and matches are made of them by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from . import text as T
from . import values as V

# Where a page's fields are looked for, in order: selector, and the attribute to read (None: the text).
RECIPE = {
    "title": (('meta[property="og:title"]', "content"), ('meta[name="twitter:title"]', "content"), ("h1", None), ('.title, .movie-title, .video-title, [itemprop="name"]', None), ("title", None)),
    "overview": (('meta[name="description"]', "content"), ('meta[property="og:description"]', "content"), ('[itemprop="description"], .summary, .overview, .description, .synopsis', None)),
    "release_date": (("time[datetime]", "datetime"), ('[itemprop="datePublished"]', "content"), (".release-date, .air-date, .published-date", None)),
    "runtime": (('[itemprop="duration"]', "content"), ('[itemprop="duration"], .runtime, .duration', None)),
    "genres": ((".genres a, .genre a, a[href*=\"genre\"]", None), ('.genres, .genre, [itemprop="genre"]', None)),
    "tags": ((".tags a, .tag, a[href*=\"tag\"], [rel=\"tag\"]", None), (".keyword, .keywords a", None)),
    "poster_urls": (('meta[property="og:image"]', "content"), ('meta[name="twitter:image"]', "content"), ('[itemprop="image"]', "content"), ("img.poster, .poster img, .cover img", "src")),
    "score": (('[itemprop="ratingValue"]', "content"), ('[itemprop="ratingValue"], .score, .rating-value', None)),
    "vote_count": (('[itemprop="ratingCount"]', "content"), ('[itemprop="ratingCount"], .vote-count, .votes', None)),
    "canonical_url": (('link[rel="canonical"]', "href"), ('meta[property="og:url"]', "content")),
}
ROWS = "tr, li, p, .meta, .info, .detail"
LABELS = {
    "release_date": ("Release Date", "Released", "Air Date", "Published", "Date", "上映日期", "放送开始", "播放开始", "播出日期"),
    "runtime": ("Runtime", "Duration", "Length", "时长", "片长"),
    "score": ("Rating", "Score", "评分", "評価"),
    "vote_count": ("Votes", "Vote Count", "Reviews", "评分人数", "评价人数"),
}
KNOWN = tuple(label for labels in LABELS.values() for label in labels)
# Labels of a detail page's rows.
DETAIL = {
    "number": ("Number", "ID", "品番", "識別碼", "识别码", "番號", "番号"),
    "release_date": ("Release Date", "Released", "発売日", "發行日期", "发行日期", "公開日", "配信開始日"),
    "runtime": ("Runtime", "Duration", "Length", "収録時間", "再生時間", "長度", "长度"),
    "actors": ("Actor", "Actors", "Actress", "Cast", "出演", "出演者", "女優"),
    "tags": ("Genre", "Genres", "Tag", "Category", "ジャンル", "類別", "类别"),
    "maker": ("Maker", "Studio", "Manufacturer", "メーカー", "製作商", "制作商"),
    "label": ("Label", "Publisher", "レーベル", "發行商", "发行商"),
    "series": ("Series", "シリーズ", "系列"),
    "director": ("Director", "監督", "導演", "导演"),
    "rating": ("Rating", "Score", "評価"),
    "wanted": ("Wanted", "Want", "Favorites", "想看"),
}
DETAIL_KNOWN = tuple(label for labels in DETAIL.values() for label in labels)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


# Fixed values of HTML: a start tag ends open elements of these names, unless one of the others lies between.
_PARTS = frozenset("table td th tr tbody thead tfoot caption section article main aside nav header footer form fieldset figure blockquote body html".split())
_SCOPE = frozenset("table td th caption button object template html".split())
ENDED = {
    "li": (frozenset(["li"]), _PARTS | {"ul", "ol", "menu", "dl"}), "dt": (frozenset(["dt", "dd"]), _PARTS | {"ul", "ol", "dl"}), "dd": (frozenset(["dt", "dd"]), _PARTS | {"ul", "ol", "dl"}),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "tr": (frozenset(["td", "th", "tr", "caption"]), frozenset(["table"])),
    **{t: (frozenset(["td", "th", "tr", "caption", "tbody", "thead", "tfoot"]), frozenset(["table"])) for t in ("tbody", "thead", "tfoot")},
}
# Fixed values of HTML: elements that end an open paragraph, and those that may stand before the body.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd".split())
HEAD = frozenset("html head title meta link script style base noscript template".split())

_MARKUP = re.compile("(<[^>]*>)")
# A tag in lower case whose attributes have quoted values without character references.
_TAG = re.compile(r"""<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z-]*=(?:"[^"&<>]*"|'[^'&<>]*'))*)(/?)>""")
_ATTRIBUTE = re.compile(r""" ([a-z-]+)=(?:"([^"]*)"|'([^']*)')""")
# Fixed values of HTML: elements whose content is no markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
# Attributes whose values selectors test, and the words that they look for in addresses.
TESTED = frozenset("class itemprop name property rel type".split())
WORDS = ("actor", "actress", "star", "cast", "idol", "genre", "tag", "category", "sample", "gallery")

#: Layouts that a Python worker remembers, the tags that such a page can have, and the length of tags that are remembered.
LAYOUTS, LAYOUT_TAGS, TAG_LENGTH = 64, 500, 256


class Element:
    """A node: name, attributes, parent and the pieces of text below it."""

    __slots__ = ("name", "attributes", "parent", "pieces")

    def __init__(self, name: str, attributes: dict, parent: Element | None, pieces: list[str] | None = None):
        self.name, self.attributes, self.parent, self.pieces = name, attributes, parent, [] if pieces is None else pieces

    def text(self) -> str:
        return " ".join(" ".join(self.pieces).split())


@lru_cache(maxsize=4096)
def _tag(tag: str) -> tuple[str, str, str, bool, dict[str, str]] | None:
    """A plain tag's shape, which is all of it that selectors can test, then its slash, name, whether it is empty, and its attributes."""
    if not (m := _TAG.fullmatch(tag)):
        return None
    ends, name, written, empty = m.groups()
    if name in _RAW or ends and (written or empty):
        return None
    attributes = {k: v or w for k, v, w in reversed(_ATTRIBUTE.findall(written))}
    told = [(k, v if k in TESTED else [w for w in WORDS if w in v] if k == "href" else None) for k, v in attributes.items()]
    return repr((ends, name, empty, told)), ends, name, bool(empty), attributes


@lru_cache(maxsize=256)
def _by_shape(selector: str) -> bool:
    """Whether the shapes of a page's tags alone decide what the selector matches."""
    return all(a in TESTED or a == "href" and how == "*=" and v in WORDS for a, how, v in re.findall(r'\[([\w-]+)(\*?=)"([^"]*)"\]', selector))


class Layout:
    """What pages have in common whose tags have the same shapes: each element's name, parent, tag and texts, and what selectors choose."""

    __slots__ = ("elements", "places", "chosen")

    def __init__(self):
        self.elements: list[tuple[str, int | None, int | None, list[int]]] = []
        self.places: dict[str, list[int]] = {}
        self.chosen: dict[str, list[int]] = {}


_layouts: dict[tuple, Layout] = {}


class Page(HTMLParser):
    """A page's elements in document order."""

    def __init__(self, html: str):
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.body: Element | None = None
        if not self._plain(html):
            self.layout = Layout()
            self.held: list[str] = []
            super().__init__(convert_charrefs=True)
            self.feed(html)
            self.close()
            self._say()
        # Places of the elements by name, .class and [attribute: a selector tests those alone that can match.
        self.places = self.layout.places
        if not self.places:
            for at, e in enumerate(self.elements):
                for key in (e.name, *(f"[{a}" for a in e.attributes), *(f".{c}" for c in set(e.attributes.get("class", "").split()))):
                    self.places.setdefault(key, []).append(at)
        self.lines: dict[str, tuple[list[str], str]] = {}

    def _plain(self, html: str) -> bool:
        """Read a page that is made of plain tags and text alone, as ``feed`` would; False, and nothing read, for others.

        Pages of one site differ in texts and addresses; where the elements lie is found once for them.
        """
        parts = _MARKUP.split(html)
        texts, tags = parts[::2], [_tag(t) if len(t) <= TAG_LENGTH else _tag.__wrapped__(t) for t in parts[1::2]]
        if not tags or None in tags or html.count("<") != len(tags):
            return False
        if "&" in html:
            texts = [unescape(t) for t in texts]
        key = (tuple([t[0] for t in tags]), tuple([not t or t.isspace() for t in texts]))
        if layout := _layouts.get(key):
            for name, parent, tag, own in layout.elements:
                self.elements.append(Element(name, {} if tag is None else tags[tag][4], None if parent is None else self.elements[parent], [t for k in own if (t := texts[k])]))
            self.layout = layout
            return True
        self.layout = Layout()
        made: dict[int, tuple[int | None, list[int]]] = {}  # an element's tag and texts
        for k, text in enumerate(texts):
            before = len(self.elements)
            if k and tags[k - 1][1]:
                self._stop(tags[k - 1][2])
            elif k:
                self._start(tags[k - 1][2], tags[k - 1][4], tags[k - 1][3])
            read = len(self.elements)
            if text:
                self._text(text)
            # A tag's own element is the last one; what comes before it, or with a text, is implied.
            made |= {id(e): (k - 1 if at == read - 1 else None, []) for at, e in enumerate(self.elements[before:], before)}
            for e in self.open:
                made[id(e)][1].append(k)
        if len(tags) <= LAYOUT_TAGS:
            at = {id(e): k for k, e in enumerate(self.elements)}
            self.layout.elements = [(e.name, e.parent and at[id(e.parent)], *made[id(e)]) for e in self.elements]
            if len(_layouts) >= LAYOUTS:
                del _layouts[next(iter(_layouts))]
            _layouts[key] = self.layout
        return True

    def updatepos(self, i, j):
        return j  # no line numbers are asked for

    def _end(self, names: frozenset[str], bounds: frozenset[str]) -> None:
        """Close the outermost open element of these names above the first bound."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].name in bounds:
                break
            if self.open[k].name in names:
                cut = k
                while cut and self.open[cut - 1].name in names:
                    cut -= 1
                del self.open[cut:]
                break

    def _begin_body(self, attributes: dict | None = None) -> None:
        """The body begins with its tag, or without one where something stands that no head can have."""
        self.open = [e for e in self.open if e.name == "html"][:1]
        self.body = Element("body", attributes or {}, self.open[-1] if self.open else None)
        self.elements.append(self.body)
        self.open.append(self.body)

    def _start(self, tag: str, attributes: dict[str, str], empty: bool) -> None:
        if tag == "body":
            if self.body is None:
                self._begin_body(attributes)
            return
        if self.body is None and tag not in HEAD and not any(e.name in ("noscript", "template") for e in self.open):
            self._begin_body()
        if tag in BLOCKS:
            self._end(frozenset(["p"]), _SCOPE)
        if tag in ENDED:
            self._end(*ENDED[tag])
        element = Element(tag, attributes, self.open[-1] if self.open else None)
        self.elements.append(element)
        if tag not in VOID and not empty:
            self.open.append(element)

    def _stop(self, tag: str) -> None:
        if tag in ("body", "html"):  # what follows still belongs to the body
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def _text(self, data: str) -> None:
        if self.body is None and data.strip() and all(e.name in ("html", "head") for e in self.open):
            self._begin_body()
        for element in self.open:
            element.pieces.append(data)

    def _say(self) -> None:
        """What the parser gave in parts, as it does at a < that begins no tag, is one text."""
        if self.held:
            self._text("".join(self.held))
            self.held.clear()

    def handle_starttag(self, tag, attrs):
        self._say()
        self._start(tag, {k: v or "" for k, v in reversed(attrs)}, False)

    def handle_startendtag(self, tag, attrs):
        self._say()
        self._start(tag, {k: v or "" for k, v in reversed(attrs)}, True)

    def handle_endtag(self, tag):
        self._say()
        self._stop(tag)

    def handle_data(self, data):
        self.held.append(data)

    def handle_comment(self, data):
        self._say()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def select(self, selector: str) -> Iterator[Element]:
        """Elements that one of the comma-separated selectors matches, in document order."""
        chosen = self.layout.chosen.get(selector)
        if chosen is None:
            found: set[int] = set()
            for key, test in matcher(selector):
                if near := self.places.get(key):
                    found.update(near if test is None else [k for k in near if test(self.elements[k])])
            chosen = sorted(found)
            if _by_shape(selector):
                self.layout.chosen[selector] = chosen
        return map(self.elements.__getitem__, chosen)

    def first_text(self, selector: str) -> str | None:
        """The text of the first element, None where it is blank."""
        found = next(self.select(selector), None)
        return (found.text() or None) if found else None

    def first_attribute(self, selector: str, name: str) -> str | None:
        """The first element's attribute of that name; a blank one ends the search."""
        found = next((e.attributes[name] for e in self.select(selector) if name in e.attributes), None)
        return found if found and found.strip() else None

    def texts(self, selector: str) -> list[str]:
        return list(dict.fromkeys(t for t in (e.text() for e in self.select(selector)) if t))

    def values(self, where: tuple, base: str = "") -> list[str]:
        """All values for a field's selectors: texts split at separators, attributes as addresses."""
        out: dict[str, None] = {}
        for selector, attribute in where:
            for e in self.select(selector):
                if attribute is None:
                    parts = [" ".join(p.split()) for p in re.split("[,/|、]", e.text())]
                else:
                    whole = " ".join(e.attributes.get(attribute, "").split())
                    parts = [absolute(base, whole) if base and whole else whole]
                out.update(dict.fromkeys(p for p in parts if p))
        return list(out)

    def labelled(self, rows: str, body: str, labels: tuple[str, ...], known: tuple[str, ...]) -> str | None:
        """What follows one of the labels in a row, or else in the whole text up to the next known label."""
        if rows not in self.lines:
            own = [t for t in (e.text() for e in self.select(rows)) if ":" in t or "：" in t]
            self.lines[rows] = own, "\n".join(own)
        lines, whole = self.lines[rows]
        labels = [label for label in labels if label in whole or label in body]
        for line in lines:
            for label in labels:
                for mark in (f"{label}:", f"{label}："):
                    at = line.find(mark)
                    if at >= 0:
                        if value := " ".join(line[at + len(mark) :].split()):
                            return value
                        break
        for label in labels:
            for mark in (f"{label}:", f"{label}："):
                at = body.find(mark)
                if at >= 0:
                    rest = body[at + len(mark) :].strip()
                    stops = (rest.find(f"{k}{c}") for k in known for c in ":：" if f"{k}{c}" != mark)
                    if value := " ".join(rest[: min((s for s in stops if s >= 0), default=len(rest))].split()):
                        return value
        return None

    def image_urls(self, selector: str, base: str) -> list[str]:
        """Addresses in href, src, or the first image inside."""
        out: dict[str, None] = {}
        for e in self.select(selector):
            inner = next((x.attributes.get("src") for x in self.elements if x.name == "img" and _inside(x, e)), None) if "href" not in e.attributes and "src" not in e.attributes else None
            value = e.attributes.get("href", e.attributes.get("src", inner))
            if value is not None and (url := absolute(base, value)).strip():
                out[url] = None
        return list(out)


def _inside(element: Element, ancestor: Element) -> bool:
    while element := element.parent:
        if element is ancestor:
            return True
    return False


@lru_cache(maxsize=256)
def matcher(selector: str) -> tuple[tuple[str, Callable[[Element], bool] | None], ...]:
    """For each selector of names, classes and attributes, with descendants (the forms that RECIPE uses): a key and a test.

    ``Page.places`` has the key for every element that the selector matches; where
    the key says it all there is no test.
    """

    def chained(last: Callable, above: list[Callable]) -> Callable[[Element], bool]:
        def test(element: Element) -> bool:
            if not last(element):
                return False
            up = element.parent
            for one in above:
                while up and not one(up):
                    up = up.parent
                if not up:
                    return False
                up = up.parent
            return True

        return test

    out = []
    for chain in re.split(r",(?![^\[]*\])", selector):
        *above, last = chain.split()
        key = re.match(r"[a-z0-9]+|[.\[][\w-]+", last)[0]
        whole = not above and last in (key, f"{key}]")
        out.append((key, None if whole else chained(_simple(last), [_simple(part) for part in reversed(above)])))
    return tuple(out)


def _simple(part: str) -> Callable[[Element], bool]:
    name = re.match(r"[a-z0-9]*", part)[0]
    classes = re.findall(r"\.([\w-]+)", re.sub(r"\[.*?\]", "", part))
    tests = re.findall(r'\[([\w-]+)(?:(\*?=)"([^"]*)")?\]', part)

    if len(tests) == 1 and tests[0][1:2] == ("*=",) and tests[0][2] and not classes:
        (attribute, _, within), = tests
        return lambda e: within in e.attributes.get(attribute, "") and (not name or e.name == name)

    def one(e: Element) -> bool:
        if name and e.name != name or classes and not set(classes) <= set(e.attributes.get("class", "").split()):
            return False
        return all(a in e.attributes and (not how or (v == e.attributes[a] if how == "=" else v in e.attributes[a])) for a, how, v in tests)

    return one


def absolute(base: str, value: str) -> str:
    """A root-relative value goes to the base's origin, others are put after the base."""
    value = value.strip()
    if value.startswith("/") and not value.startswith("//") and (origin := re.match(r".*?://[^/]*", base)):
        return origin[0] + value
    if value.startswith(("http://", "https://")):
        return value
    if value.startswith("//"):
        return "https:" + value
    return base.rstrip("/") + "/" + value.lstrip("/")


_LIST = "array<string>"
FOUND = {
    "title": "string", "overview": "string", "date": "string", "runtime": "string", "score": "string", "vote_count": "string", "canonical_url": "string", "body": "string",
    "genres": _LIST, "tags": _LIST, "poster_urls": _LIST, "links": "array<struct<url:string,text:string>>", "images": _LIST, "lines": "array<struct<label:string,value:string>>",
}


def found(html: str | None, url: str | None, names: tuple[str, ...] = tuple(FOUND)) -> tuple:
    """The texts of FOUND that are named; None where a page has none."""
    if html is None:
        return (None,) * len(names)
    page, base = Page(html), url or ""
    body = page.first_text("body") or ""
    first = lambda field: next(iter(page.values(RECIPE[field])), None)
    either = lambda field: first(field) or page.labelled(ROWS, body, LABELS[field], KNOWN)

    def links() -> list[dict]:
        own = dict.fromkeys((absolute(base, e.attributes["href"]), e.text()) for e in page.select("a[href]") if e.attributes["href"].strip())
        return [{"url": u, "text": t} for u, t in own]

    def lines() -> list[dict]:
        own = dict.fromkeys((m[1], m[2]) for e in page.select("tr, li, p") if (m := re.match(r"([^:：]{1,40})[:：]\s*(.+)", e.text())))
        return [{"label": k, "value": v} for k, v in own]

    def canonical() -> str | None:
        own = first("canonical_url")
        return absolute(base, own) if own else None

    make = {
        "title": lambda: first("title"), "overview": lambda: first("overview"), "date": lambda: either("release_date"), "runtime": lambda: either("runtime"), "score": lambda: either("score"),
        "vote_count": lambda: either("vote_count"), "canonical_url": canonical, "body": lambda: body, "genres": lambda: page.values(RECIPE["genres"], base), "tags": lambda: page.values(RECIPE["tags"], base),
        "poster_urls": lambda: page.values(RECIPE["poster_urls"], base), "links": links, "images": lambda: page.image_urls("img[src]", base), "lines": lines,
    }
    return tuple(make[n]() for n in names)


OWN = {
    "title": "string", "number": "string", "body": "string", "overview": "string", "release_date": "string", "runtime": "string", "maker": "string", "label": "string", "series": "string",
    "director": "string", "rating": "string", "wanted": "string", "actors": _LIST, "tags": _LIST, "poster_url": "string", "backdrop_urls": _LIST, "trailer_url": "string",
}


def detail(html: str | None, url: str | None) -> tuple:
    """The texts of OWN from a detail page."""
    if html is None:
        return (None,) * len(OWN)
    page, base = Page(html), url or ""
    body = page.first_text("body") or ""
    info = page.first_text("article, main, .movie, .video, .detail, .info, .movie-info, table, body") or body
    value = lambda field: page.labelled("tr, li, p, .info, .detail", info, DETAIL[field], DETAIL_KNOWN)
    parts = lambda field: [p for p in (" ".join(x.split()) for x in re.split("[,/、，]", value(field) or "")) if p]
    title = page.first_text("h1, h2, h3, .title, .movie-title, .video-title") or page.first_attribute('meta[property="og:title"]', "content") or page.first_text("title")
    overview = page.first_text(".description, .outline, .summary, .story, .introduction, .comment, .box-description") or page.first_attribute('meta[name="description"]', "content")
    actors = dict.fromkeys(parts("actors") or page.texts('a[href*="actor"], a[href*="actress"], a[href*="star"], a[href*="cast"], a[href*="idol"]'))
    tags = dict.fromkeys([*page.texts('a[href*="genre"], a[href*="tag"], a[href*="category"], .tag a, .genre a'), *parts("tags")])
    poster = page.first_attribute('meta[property="og:image"]', "content") or page.first_attribute(".poster img, .cover img, .package img, .movie-image img, .main-image img, article img, main img", "src")
    poster = absolute(base, poster) if poster else None
    pictures = page.image_urls('.sample img, .gallery img, .preview img, .sample-box img, a[href*="sample"], a[href*="gallery"]', base)
    moving = lambda u: re.search(r"\.(?:mp4|m3u8|webm)(?:$|\?)", u.lower())
    media = [e.attributes.get("src", e.attributes.get("href", "")).strip() for e in page.select('video source, source[type*="video"], a[href]')]
    return (
        title, value("number"), body, overview, value("release_date"), value("runtime"), value("maker"), value("label"), value("series"), value("director"),
        page.first_text(".score, .rating, .review") or value("rating"), value("wanted"), list(actors), list(tags), poster,
        [u for u in pictures if u != poster and not moving(u)], next((absolute(base, u) for u in media if moving(u)), None),
    )


#: Rows whose results a Python worker holds at once.
ROWS_HELD = 256


def _arrow(kind: str) -> pa.DataType:
    """Arrow's type for a text, a struct of texts or an array of either."""
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return pa.struct([(f.split(":")[0], pa.string()) for f in kind[7:-1].split(",")]) if kind.startswith("struct<") else pa.string()


def _udf(make: Callable[[str | None, str | None], tuple], fields: dict[str, str]):
    types = [_arrow(kind) for kind in fields.values()]

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, texts = None, None
        for html, url in batches:
            for k in range(0, len(html), ROWS_HELD):
                rows = []
                for page in zip(html[k : k + ROWS_HELD].to_pylist(), url[k : k + ROWS_HELD].to_pylist(), strict=True):
                    if page != last:  # rows that a join made of one page lie together
                        last, texts = page, make(*page)
                    rows.append(texts)
                yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(fields))

    schema = ", ".join(f"{k} {v}" for k, v in fields.items())
    # As deterministic, a filter on what is found would be pushed below it and below exchanges, with a second parse in few tasks.
    return lambda html, url: F.arrow_udf(run, schema, ArrowUDFType.SCALAR_ITER).asNondeterministic()(html, url)


def page_texts(html: Column, url: Column, *names: str) -> Column:
    """The texts of FOUND, or those alone that are named."""
    named = names or tuple(FOUND)
    return _udf(lambda h, u: found(h, u, named), {n: FOUND[n] for n in named})(html, url)


detail_texts = _udf(detail, OWN)


def recipe(f: Column) -> dict[str, Column]:
    """The fields of a page by the generic recipe, from the struct that ``page_texts`` gives."""
    iso = V.first_iso_date(f["date"])
    return {
        "title": f["title"], "overview": f["overview"], "release_date": F.coalesce(iso, T.non_blank(f["date"])), "release_year": F.coalesce(V.first_year(f["date"]), V.first_year(f["body"])),
        "runtime_minutes": V.first_integer(f["runtime"]).cast("int"), "score_milli": rating(f["score"]),
        "vote_count": V.first_integer(f["vote_count"]), "genres": f["genres"], "tags": f["tags"], "poster_urls": f["poster_urls"], "canonical_url": f["canonical_url"],
    }


def mentions(text: Column, url: Column, number: Column) -> Column:
    """A text or address that names a catalog number, as its own number or within its letters and digits."""
    named = lambda c: F.coalesce(T.catalog_number(T.filename_tokens(c))["number"] == number, F.lit(False))
    within = lambda c: F.coalesce(T.compact(c).contains(T.compact(number)), F.lit(False))
    return within(text) | within(url) | named(text) | named(url)


def is_result_link(url: Column) -> Column:
    """An address that a search page's result can have: no fragment, script or further search."""
    u = T.trimmed(url)
    return (u != "") & ~u.startswith("#") & ~u.startswith("javascript:") & ~u.contains("/search") & ~u.contains("result_published")


def is_outline(value: Column, title: Column, labels: tuple[str, ...]) -> Column:
    """A text long enough to be an outline, which is neither the title nor has a row's label."""
    found_ = F.lit(False)
    for label in labels:
        found_ = found_ | value.contains(label)
    return (F.length(value) >= 24) & ~value.eqNullSafe(title) & ~found_


def snapshot_text(text: Column) -> Column:
    """A rendered page's text with runs of white space as one space."""
    return T.collapsed(text)


def rating(text: Column) -> Column:
    """The first token that is a number, as a rating in thousandths."""
    number = r"(?:^|\s)([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?=\s|$)"
    return V.rating_milli(F.nullif(F.regexp_extract(text, number, 1), F.lit("")).cast("double"))
