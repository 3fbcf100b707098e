"""String functions over columns: titles, file-name tokens, slugs, templates, reasons.

Case folding is ASCII unless said otherwise, white space is Unicode white space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"(?U)\s+"
#: All characters that are white space in Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)``, with the value evaluated once for a row, however often it is named."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def trimmed(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(WHITE))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def non_blank(c: Column) -> Column:
    """Trimmed, NULL where nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def normalize_title(c: Column) -> Column:
    """Letters and digits of any script, lower case, nothing else."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def normalize_search_title(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))


def strip_qualifiers(c: Column) -> Column:
    """Without trailing (...) and [...] groups; NULL where there is none to strip."""
    one = r"(?U)^(.*\S)\s*(?:\([^(]*[^(\s][^(]*\)|\[[^\[]*[^\[\s][^\[]*\])\s*$"
    start = F.regexp_replace(c, r"(?U)\s+$", "")
    closers = F.length(F.regexp_replace(c, r"[^)\]]", ""))
    steps = F.sequence(F.lit(0), closers)
    stripped = F.aggregate(steps, start, lambda s, _: F.regexp_replace(s, "(?s)" + one, "$1"))
    return F.when(stripped != start, stripped)


def search_title_variants(c: Column) -> Column:
    """Raw, stripped, normalized, stripped and normalized; distinct without regard to ASCII case."""
    raw = trimmed(c)
    stripped = strip_qualifiers(raw)
    values = F.array_compact(F.array(raw, trimmed(stripped), normalize_search_title(raw), normalize_search_title(stripped)))
    distinct = lambda kept, v: F.when((v == "") | F.exists(kept, lambda k: ascii_lower(k) == ascii_lower(v)), kept).otherwise(F.array_append(kept, v))
    return F.aggregate(values, F.array().cast("array<string>"), distinct)


def compact(c: Column) -> Column:
    return ascii_upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def _named(s: Column, default: str) -> Column:
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def slug(c: Column, default: str = "query") -> Column:
    """Runs of other characters become one dash."""
    return _named(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), default)


def slug_dropping(c: Column, default: str = "subtitle") -> Column:
    """White space, dashes and underscores become a dash each; other characters go."""
    return _named(F.regexp_replace(F.regexp_replace(ascii_lower(c), r"(?U)[\s_-]", "-"), "[^a-z0-9-]", ""), default)


def slug_each(c: Column, default: str = "device") -> Column:
    """Each other character becomes a dash."""
    return _named(F.regexp_replace(ascii_lower(c), "[^a-z0-9]", "-"), default)


def safe_excerpt(c: Column, size: int = 240) -> Column:
    return F.substring(F.translate(c, "\r\n", "  "), 1, size)


def strip_markup(c: Column) -> Column:
    """Text outside <...>; an unclosed < drops the rest."""
    return collapsed(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "(?s)<.*$", " "))


def strip_year_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\([0-9]{4}\)\s*$", "")


def percent_encode(c: Column) -> Column:
    """RFC 3986: unreserved characters stay, everything else as upper-case hex."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def split_values(c: Column) -> Column:
    parts = F.split(c, "[,/、，]")
    return F.filter(F.transform(parts, trimmed), lambda v: v != "")


def labeled_value(text: Column, label: str, known: list[str]) -> Column:
    """What follows ``label:`` up to the next known label."""
    others = "|".join(rf"\Q{k}\E[:：]" for k in known if k != label)
    stop = rf"(?=(?:{others})|$)" if others else "$"
    return F.nullif(collapsed(F.regexp_extract(text, rf"(?s)\Q{label}\E[:：](.*?){stop}", 1)), F.lit(""))


# File extensions, quality words and number prefixes of the file-name grammar.
EXTENSIONS = ("avi", "flv", "m2ts", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "webm", "wmv")
NOISE = ("AAC", "AVC", "BD", "FHD", "HD", "HEVC", "HDR", "UHD", "WEB", "XVID")
SERIES = ("SIRO", "LUXU", "ARA", "GANA", "MAAN", "MIUM")
QUALITY_WORDS = ("1080p", "2160p", "720p", "x264", "x265", "h264", "h265", ".mp4", ".mkv", ".avi")


def filename_tokens(c: Column) -> Column:
    """Upper-case ASCII tokens of a file's base name, known extension removed, one space between."""
    name = F.substring_index(F.substring_index(c, "/", -1), "\\", -1)
    base = F.regexp_replace(trimmed(name), rf"(?i)\.({'|'.join(EXTENSIONS)})$", "")
    return F.trim(F.regexp_replace(ascii_upper(base), "[^A-Z0-9]+", " "))


def short_digits(c: Column) -> Column:
    """Leading zeros go from more than three digits, unless nothing would be left."""
    return bound(c, lambda v: F.when(F.length(v) > 3, F.coalesce(F.nullif(F.ltrim(v, F.lit("0")), F.lit("")), v)).otherwise(v))


def _extract(tokens: Column, pattern: str, group: int = 1) -> Column:
    return bound(F.regexp_extract(tokens, pattern, group), lambda v: F.nullif(v, F.lit("")))


def catalog_number(tokens: Column) -> Column:
    """(number, route) by the first form that matches the tokens; NULL without one."""
    # No form is without a digit.
    return bound(F.concat(F.lit(" "), tokens, F.lit(" ")), lambda t: F.when(t.rlike("[0-9]"), _catalog_number(t)))


def _catalog_number(t: Column) -> Column:
    noise = "|".join(NOISE)
    serial = _extract(t, " FC2(?:PPV|PPV | PPV | )?([0-9]{5,})")
    home = " (?:(MD[A-Z]*)([0-9][0-9A-Z]*)|MKY ([A-Z]+) ([0-9]+)) "
    domestic = F.coalesce(F.concat(_extract(t, home), F.lit("-"), short_digits(_extract(t, home, 2))), F.concat(F.lit("MKY-"), _extract(t, home, 3), F.lit("-"), _extract(t, home, 4)))
    dated = r" ([A-Z]{3,}) ([0-9]{2}|[0-9]{4}) (0[1-9]|1[0-2]) (0[1-9]|[12][0-9]|3[01]) "
    western = F.when(_extract(t, dated).isNotNull(), F.concat_ws(".", *(_extract(t, dated, k) for k in (1, 2, 3, 4))))
    names = "|".join(SERIES)
    amateur_form = rf" ((?:{names})|[0-9A-Z]*[0-9][0-9A-Z]*(?:{names})) ([0-9]{{3,}}) "
    amateur = F.when(_extract(t, amateur_form).isNotNull(), F.concat_ws("-", _extract(t, amateur_form), _extract(t, amateur_form, 2)))
    pair = " ([0-9]{6}) ([0-9]{2,4}) "
    date_id = F.when(_extract(t, pair).isNotNull(), F.concat_ws("_", _extract(t, pair), _extract(t, pair, 2)))
    five = _extract(t, " ([CHN][0-9]{4}) ")
    generic_form = rf" (?!(?:{noise})[0-9 ])([A-Z]{{2,10}}) ?([0-9]{{2,7}}) "
    generic = F.when(_extract(t, generic_form).isNotNull(), F.concat(_extract(t, generic_form), F.lit("-"), short_digits(_extract(t, generic_form, 2))))
    forms = [(F.concat(F.lit("FC2-"), serial), "fc2"), (domestic, "domestic"), (western, "western"), (amateur, "amateur"), (date_id, "uncensored"), (five, "uncensored"), (generic, "censored")]
    routed = lambda route: lambda n: F.when(n.isNotNull(), F.struct(n.alias("number"), F.lit(route).alias("route")))
    return F.coalesce(*(bound(n, routed(route)) for n, route in forms))


def search_terms(number: Column) -> Column:
    return F.array_distinct(F.array(number, F.translate(number, "-_. ", "")))


def looks_like_file(title: Column) -> Column:
    low = ascii_lower(title)
    found = low.contains("/") | low.contains("\\")
    for word in QUALITY_WORDS:
        found = found | low.contains(word)
    return found


def strip_number_prefix(title: Column, number: Column) -> Column:
    """A title without its leading article number in one of three spellings, and what joins them."""
    whole = collapsed(title)
    tried = []
    for prefix in ("FC2-", "FC2PPV-", ""):
        head = F.concat(F.lit(prefix), number)
        rest = trimmed(F.regexp_replace(trimmed(F.substring(whole, F.length(head) + 1, F.length(whole))), "^[-:：]+", ""))
        tried.append(F.when(whole.startswith(head) & (rest != ""), rest))
    return F.coalesce(*tried, whole)


def imdb_id(c: Column) -> Column:
    """tt and digits, the letters in any case; NULL for others."""
    v = trimmed(c)
    return F.when(v.rlike("^[tT]{2}[0-9]+$"), F.concat(F.lit("tt"), F.substring(v, F.lit(3), F.length(v))))


def setting_label(c: Column, aliases: dict[str, str]) -> Column:
    """A setting's value as one of the labels it can have: dashes and spaces as underscores, aliases resolved."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.try_element_at(table, F.translate(ascii_lower(trimmed(c)), "- ", "__"))


def outcome_note(outcomes: Column, notes: dict[str, str], legacy: Column) -> Column:
    """The safe notes of a record's outcomes, then a note of its own; NULL where there is none."""
    table = F.create_map(*(F.lit(x) for pair in notes.items() for x in pair))
    parts = F.array_compact(F.concat(F.transform(outcomes, lambda o: F.try_element_at(table, o)), F.array(non_blank(legacy))))
    return F.when(F.size(parts) > 0, F.array_join(parts, " "))


# What a template may name.
TOKENS = ("event_id", "event_kind", "subject_kind", "subject_id", "occurred_at", "attempt", "payload_keys")


def template_status(template: Column) -> Column:
    """ok, or the fault that is met first from the left: unclosed, empty or unknown."""
    whole = r"(?s)\{\{(.*?)\}\}"
    names = F.transform(F.regexp_extract_all(template, F.lit(whole), F.lit(1)), trimmed)
    known = F.array(*map(F.lit, TOKENS))
    faults = F.filter(F.transform(names, lambda n: F.when(n == "", "empty").when(~F.array_contains(known, n), "unknown").otherwise("")), lambda f: f != "")
    rest = F.regexp_replace(template, whole, "")
    return F.when(F.size(faults) > 0, F.get(faults, F.lit(0))).when(rest.contains("{{") | rest.contains("}}"), "unclosed").otherwise("ok")


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """The template with its tokens replaced; NULL where it is faulty."""
    parts = F.split(template, r"(?s)\{\{.*?\}\}", -1)
    names = F.transform(F.regexp_extract_all(template, F.lit(r"(?s)\{\{(.*?)\}\}"), F.lit(1)), trimmed)
    table = F.create_map(*(x for name in TOKENS for x in (F.lit(name), F.coalesce(values.get(name, F.lit("")), F.lit("")))))
    filled = F.zip_with(parts, F.transform(names, lambda n: F.element_at(table, n)), lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    return F.when(template_status(template) == "ok", F.array_join(filled, ""))


def failure_reason(message: Column) -> Column:
    """A safe reason by what the message contains, tested in order."""
    low = ascii_lower(message)

    def has(*needles: str) -> Column:
        found = F.lit(False)
        for needle in needles:
            found = found | low.contains(needle)
        return found

    return (
        F.when(has("timed out", "timeout"), "timeout")
        .when(has("429", "rate limit"), "rate_limited")
        .when(has("401", "403", "unauthorized", "forbidden", "proxy_required", "operator_action"), "auth_or_forbidden")
        .when(has("404", "not found"), "not_found")
        .when(has("parse", "malformed"), "parse_error")
        .otherwise("provider_error")
    )


def retry_class(reason: Column) -> Column:
    return F.when(reason.isin("timeout", "rate_limited", "provider_error"), "retryable").when(reason == "auth_or_forbidden", "operator_action").when(reason.isin("not_found", "parse_error"), "permanent")
