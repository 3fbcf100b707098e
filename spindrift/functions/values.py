"""Dates held as strings, scores in thousandths, arrays of named values, JSON scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, bound, non_blank, trimmed


def first_iso_date(c: Column) -> Column:
    """The first token that begins like a date; the second separator may be anything."""
    return F.nullif(F.regexp_extract(c, r"(?U)(?:^|\s)(\d{4}-\d{2}\S\d{2})", 1), F.lit(""))


def first_year(c: Column) -> Column:
    """The first run of exactly four digits between 1888 and 2100."""
    runs = F.filter(F.regexp_extract_all(c, F.lit(r"([0-9]+)"), F.lit(1)), lambda r: (F.length(r) == 4) & r.between("1888", "2100"))
    return F.get(runs, F.lit(0)).cast("int")


def year_of_date(c: Column) -> Column:
    """The four leading digits, unless a fifth follows; 1 to 9999."""
    y = F.nullif(F.regexp_extract(trimmed(c), r"^([0-9]{4})(?:[^0-9]|$)", 1), F.lit("")).cast("int")
    return F.when(y >= 1, y)


def iso_date(y: Column, m: Column, d: Column) -> Column:
    """Parts in range, without regard to the calendar."""
    ok = y.between(1, 9999) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")))


def first_integer(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).try_cast("bigint")


def minutes_of_seconds(c: Column) -> Column:
    return F.when(c >= 0, F.ceil(c / 60).cast("bigint"))


def rating_milli(c: Column) -> Column:
    """Of five up to 5, else of ten; rounded, 0 to 1000."""
    scaled = F.when(c <= 5, c * 200).otherwise(c * 100)
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.round(scaled))).cast("int"))


def vote_average_milli(c: Column) -> Column:
    """Of ten, in thousandths; rounded, 0 to 1000."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.round(c * 100)))).cast("int")


def hundred_point_milli(c: Column) -> Column:
    """Of a hundred, in thousandths, 1000 at most."""
    return F.when(c.isNotNull(), F.least(c * 10, F.lit(1000))).cast("int")


def whole_number(c: Column) -> Column:
    """An unsigned number or a numeric text, NULL for anything else."""
    return F.when(trimmed(c.cast("string")).rlike("^[0-9]{1,18}$"), trimmed(c.cast("string")).cast("bigint"))


def year_range(year: Column) -> Column:
    """The half-open range of days of a year, as its two ends."""
    ends = F.struct(F.format_string("%04d-01-01", year.cast("int")).alias("since"), F.format_string("%04d-01-01", year.cast("int") + 1).alias("before"))
    return F.when(year.between(1, 9999), ends)


def numbered(names: Column) -> Column:
    """(name, order) of names that no earlier one equals; order counts in the given list, so it has gaps."""
    placed = F.transform(names, lambda n, i: F.struct(trimmed(n).alias("name"), (i + 1).cast("int").alias("order")))
    there = F.filter(placed, lambda x: x["name"].isNotNull() & (x["name"] != ""))
    keys = F.transform(there, lambda x: ascii_lower(x["name"]))
    return F.filter(there, lambda x, i: F.array_position(keys, ascii_lower(x["name"])) == i + 1)


def community_bonus(score_milli: Column, votes: Column) -> Column:
    steps = F.least(F.floor(F.greatest(score_milli - 650, F.lit(0)) / 25), F.lit(10)).cast("int")
    tier = F.when(votes < 100, 0).when(votes < 1000, 2).when(votes < 10000, 4).otherwise(6)
    return F.coalesce(F.when((votes >= 25) & score_milli.isNotNull(), steps + tier), F.lit(0)).cast("int")


def area(width: Column, height: Column) -> Column:
    return F.coalesce(width.cast("bigint") * height.cast("bigint"), F.lit(0).cast("bigint"))


def milli_percent(fraction: Column) -> Column:
    bad = fraction.isNull() | F.isnan(fraction) | (fraction < 0) | (fraction == float("inf"))
    return F.when(~bad, F.least(F.round(fraction * 100000), F.lit(100000.0)).cast("int"))


def retry_delay_ms(attempt: Column, retry_after_ms: Column, base: int = 100, most: int = 30_000) -> Column:
    return F.greatest(F.lit(base) * attempt, F.coalesce(F.when(retry_after_ms.isNotNull(), F.least(retry_after_ms, F.lit(most))), F.lit(0)))


def is_retryable_status(status: Column) -> Column:
    return status.isin(408, 429) | status.between(500, 599)


def append_distinct(existing: Column, new: Column) -> Column:
    """Appends trimmed values that no earlier one equals without regard to ASCII case."""

    def add(kept: Column, v: Column) -> Column:
        t = trimmed(v)
        return F.when(t.isNull() | (t == "") | F.exists(kept, lambda k: ascii_lower(trimmed(k)) == ascii_lower(t)), kept).otherwise(F.array_append(kept, t))

    return F.aggregate(new, existing, add)


def without(values: Column, selected: Column) -> Column:
    """Distinct values but the selected one, in order."""
    return F.filter(F.array_distinct(values), lambda v: v != F.coalesce(selected, F.lit("")))


def json_text(payload: Column, key: str) -> Column:
    """A string member, trimmed, NULL where blank or of another kind."""
    member = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    return bound(member, lambda v: F.when(F.schema_of_variant(v) == "STRING", non_blank(F.try_variant_get(v, "$", "string"))))


def json_scalar(payload: Column, key: str) -> Column:
    """A string or whole-number member as text."""
    member = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(member).isin("STRING", "BIGINT"), F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "string"))


def json_strings(payload: Column, key: str) -> Column:
    """A member that is a text or a list of texts, as a list of trimmed texts without blanks."""
    member = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    listed = F.coalesce(F.try_variant_get(member, "$", "array<variant>"), F.array(member))
    texts = F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING")
    return F.array_compact(F.transform(texts, lambda v: non_blank(F.try_variant_get(v, "$", "string"))))


IDS = "array<struct<provider:string,value:string>>"


def _scalar(v: Column) -> Column:
    """A text or whole number of a variant as trimmed text, NULL where it is blank or of another kind."""
    return F.when(F.schema_of_variant(v).isin("STRING", "BIGINT"), non_blank(F.try_variant_get(v, "$", "string")))


def external_ids(payload: Column, aliases: dict[str, str], positive: tuple[str, ...] = ()) -> Column:
    """(provider, value) structs of a payload's ids, distinct, in order.

    ``external_ids`` may be an object (values: scalars or lists of them) or a list
    of objects with a provider and a value, id or external_id; then come the
    top-level members that ``aliases`` names with their providers.  Whole numbers
    that are not above 0 are no ids of the ``positive`` providers.
    """
    root = F.try_parse_json(payload)
    ids = F.try_variant_get(root, "$.external_ids", "variant")
    pair = lambda p, v: F.struct(ascii_lower(non_blank(p)).alias("provider"), v.alias("value"))
    many = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    by_name = F.flatten(F.transform(F.map_entries(F.try_variant_get(ids, "$", "map<string,variant>")), lambda e: F.transform(many(e["value"]), lambda v: pair(e["key"], _scalar(v)))))
    member = lambda x, k: _scalar(F.try_variant_get(x, f"$.{k}", "variant"))
    listed = F.transform(F.try_variant_get(ids, "$", "array<variant>"), lambda x: pair(member(x, "provider"), F.coalesce(member(x, "value"), member(x, "id"), member(x, "external_id"))))
    top = F.array(*(pair(F.lit(p), _scalar(F.try_variant_get(root, f"$.{k}", "variant"))) for k, p in aliases.items()))
    none = F.array().cast(IDS)
    every = F.concat(F.coalesce(by_name, none), F.coalesce(listed, none), top.cast(IDS))
    numeric = lambda x: x["provider"].isin(*positive) if positive else F.lit(False)
    bad = lambda x: numeric(x) & F.coalesce(x["value"].try_cast("decimal(38,0)") <= 0, F.lit(False))
    return F.array_distinct(F.filter(every, lambda x: x["provider"].isNotNull() & x["value"].isNotNull() & ~bad(x)))


def payload_keys(payload: Column) -> Column:
    return F.coalesce(F.array_sort(F.json_object_keys(payload)), F.array().cast("array<string>"))
