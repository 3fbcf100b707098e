"""URL functions over columns: normalization, classes, safety, parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, trimmed

# Link types in their declared order, and the hosts of each (exact or as a dotted suffix).
LINK_TYPES = ("aliyun", "baidu", "quark", "tianyi", "uc", "mobile", "115", "pikpak", "xunlei", "123", "magnet", "ed2k", "web", "other")
HOSTS = {
    "aliyun": ("aliyundrive.com", "alipan.com"),
    "baidu": ("pan.baidu.com", "yun.baidu.com"),
    "quark": ("pan.quark.cn", "drive.quark.cn"),
    "tianyi": ("cloud.189.cn",),
    "uc": ("drive.uc.cn", "uc.cn"),
    "mobile": ("caiyun.139.com", "yun.139.com"),
    "115": ("115.com", "115cdn.com"),
    "pikpak": ("mypikpak.com", "pikpakdrive.com"),
    "xunlei": ("pan.xunlei.com", "xunlei.com"),
    "123": ("123pan.com", "123684.com"),
}
# Other names of link types.
ALIASES = {"ali": "aliyun", "189": "tianyi", "139": "mobile", "123pan": "123", "others": "other"}
# Words that a transport URL must not contain.
FORBIDDEN = ("bearer", "source_locator", "file://", "local://")


def without_fragment(c: Column) -> Column:
    return trimmed(F.substring_index(trimmed(c), "#", 1))


def normalized(u: Column) -> Column:
    """The normal form of an address that is trimmed and has no fragment: peer-to-peer links all lower case, others in scheme and authority."""
    low = ascii_lower(u)
    at = F.instr(u, "://")
    rest = F.substring(u, at + 3, F.length(u))
    authority = F.regexp_extract(rest, "^[^/?]*", 0)
    whole = F.concat(ascii_lower(F.substring(u, F.lit(1), at + 2)), ascii_lower(authority), F.substring(rest, F.length(authority) + 1, F.length(rest)))
    return F.when(u == "", None).when(low.startswith("magnet:?") | low.startswith("ed2k://"), low).when(at > 0, whole).otherwise(u)


def normalize_url(c: Column) -> Column:
    return normalized(without_fragment(c))


def host(c: Column) -> Column:
    authority = F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1)
    return F.nullif(trimmed(F.substring_index(F.substring_index(authority, "@", -1), ":", 1)), F.lit(""))


def type_of(low: Column, name: Column) -> Column:
    """The class of an address in lower case, whose host is ``name``.

    Hosts are looked up by their last two and last three labels, which is as many
    as any of HOSTS has.
    """
    table = F.create_map(*(F.lit(x) for kind, hosts in HOSTS.items() for h in hosts for x in (h, kind)))
    known = F.coalesce(*(F.try_element_at(table, F.substring_index(name, ".", -n)) for n in (2, 3)))
    return F.when(low.startswith("magnet:?"), "magnet").when(low.startswith("ed2k://"), "ed2k").when(name.isNull(), "other").otherwise(F.coalesce(known, F.lit("web")))


def link_type(c: Column) -> Column:
    low = ascii_lower(trimmed(c))
    return type_of(low, host(low))


def parse_link_type(c: Column) -> Column:
    low = ascii_lower(trimmed(c))
    named = F.when(low.isin(*LINK_TYPES), low)
    for alias, name in ALIASES.items():
        named = named.when(low == alias, name)
    return named


def link_health(kind: Column, source: Column) -> Column:
    cloud = kind.isin(*HOSTS)
    fixture = ascii_lower(F.split(source, ":")[0]) == "fixture"
    return F.when(fixture & cloud, "reachable").when(kind.isin("magnet", "ed2k", "other"), "unsupported").otherwise("unknown")


def is_exact_link(c: Column) -> Column:
    return ascii_lower(trimmed(c)).rlike(r"^(?:magnet:\?|ed2k://|https?://)")


def is_safe_url(c: Column, token_prefixes: tuple[str, ...] = ()) -> Column:
    """http(s), a host, no user name, no white space, none of the forbidden words.

    token_prefixes: what a deployment's own access tokens begin with; these are forbidden too.
    """
    low = ascii_lower(trimmed(c))
    safe = low.rlike(r"^https?://[^/]") & ~low.rlike(r"(?U)\s") & ~F.regexp_extract(low, r"^https?://([^/]*)", 1).contains("@")
    for word in (*FORBIDDEN, *token_prefixes):
        safe = safe & ~low.contains(word)
    return safe


def absolute_url(base: Column, value: Column) -> Column:
    v = trimmed(value)
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(v, "^/+", ""))
    return F.when(v.rlike("^https?://"), v).when(v.startswith("//"), F.concat(F.lit("https:"), v)).otherwise(joined)


def origin(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(.*?://[^/]*)", 1), F.lit(""))


def resolved_url(base: Column, value: Column) -> Column:
    """A root-relative path goes to the base's origin; others as ``absolute_url``."""
    v = trimmed(value)
    rooted = v.startswith("/") & ~v.startswith("//") & origin(base).isNotNull()
    return F.when(rooted, F.concat(origin(base), v)).otherwise(absolute_url(base, v))


def query_value(c: Column, key: str) -> Column:
    """What follows the first ``key=``, which is found as a substring."""
    return F.nullif(F.regexp_extract(c, rf"(?s)^.*?\Q{key}=\E([^/?#&]*)", 1), F.lit(""))


def last_segment(c: Column) -> Column:
    """The last segment, the host included, that is neither empty nor a page's fixed name; query and fragment do not count."""
    path = F.regexp_replace(c, r"[?#].*$", "")
    return F.try_element_at(F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.isin("index.html", "detail")), F.lit(-1))


def page_id(c: Column) -> Column:
    """What an address names: its value of ``id``, else its last segment."""
    return F.coalesce(query_value(c, "id"), last_segment(c))


def is_video_url(c: Column) -> Column:
    """An address that ends with a video's extension or has one before its query."""
    return ascii_lower(c).rlike(r"\.(?:mp4|m3u8|webm)(?:$|\?)")
