"""Evidence, score and rank of candidate records against queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import ascii_lower, normalize_title, trimmed
from spindrift.functions.values import community_bonus

# The score's parts in thousandths.
BASE = 250
DELTAS = {
    "title": {"exact": 360, "normalized": 320, "mismatch": -160},
    "year": {"exact": 180, "mismatch": -120},
    "external_id": {"exact": 300, "mismatch": -100},
    "language": {"exact": 40, "mismatch": 0},
}
#: Candidates that a query keeps.
MOST = 12


def title_match(query: Column, titles: Column, normal: Column | None = None) -> Column:
    """titles: the candidate's title, original title, sort title and alternates, in this order.

    normal: the query's normal form where it is known already.
    """
    there = F.filter(titles, lambda t: t.isNotNull() & (trimmed(t) != ""))
    normal = normalize_title(query) if normal is None else normal
    return (
        F.when(F.size(there) == 0, "missing_candidate").when(F.exists(there, lambda t: t == query), "exact")
        .when(F.exists(there, lambda t: normalize_title(t) == normal), "normalized").otherwise("mismatch")
    )


def year_match(query: Column, candidate: Column) -> Column:
    return F.when(query.isNull(), "query_missing").when(candidate.isNull(), "candidate_missing").when(query == candidate, "exact").otherwise("mismatch")


def id_keys(ids: Column) -> Column:
    """provider and value of (provider, value) structs as one comparable key each."""
    return F.transform(ids, lambda x: F.concat(ascii_lower(trimmed(x["provider"])), F.lit("\x1f"), ascii_lower(trimmed(x["value"]))))


def external_id_match(query_ids: Column, candidate_ids: Column) -> Column:
    none = lambda ids: ids.isNull() | (F.size(ids) == 0)
    return F.when(none(query_ids), "query_missing").when(none(candidate_ids), "candidate_missing").when(F.arrays_overlap(id_keys(query_ids), id_keys(candidate_ids)), "exact").otherwise("mismatch")


def language_match(query: Column, candidate: Column) -> Column:
    primary = lambda c: ascii_lower(trimmed(F.split(c, "[-_]")[0]))
    blank = lambda c: c.isNull() | (trimmed(c) == "")
    same = (ascii_lower(query) == ascii_lower(candidate)) | (primary(query) == primary(candidate))
    return F.when(blank(query), "query_missing").when(blank(candidate), "candidate_missing").when(same, "exact").otherwise("mismatch")


def delta(kind: str, outcome: Column) -> Column:
    out = F.lit(0)
    for name, value in DELTAS[kind].items():
        out = F.when(outcome == name, value).otherwise(out)
    return out


PARTS = {"title": "title_outcome", "year": "year_outcome", "external_id": "id_outcome", "language": "language_outcome"}


def outcomes(pairs: DataFrame) -> DataFrame:
    """Adds the four outcomes, the community bonus and confidence_milli.

    pairs: query_title, query_year, query_language, query_ids; titles, year,
    language, ids, score_milli, votes; query_normal, the title's normal form, if known.
    """
    normal = F.col("query_normal") if "query_normal" in pairs.columns else None
    out = pairs.withColumns({
        "title_outcome": title_match(F.col("query_title"), F.col("titles"), normal), "year_outcome": year_match(F.col("query_year"), F.col("year")),
        "id_outcome": external_id_match(F.col("query_ids"), F.col("ids")), "language_outcome": language_match(F.col("query_language"), F.col("language")),
        "community": community_bonus(F.col("score_milli"), F.col("votes")),
    })
    total = F.lit(BASE) + F.col("community")
    for kind, column in PARTS.items():
        total = total + delta(kind, F.col(column))
    return out.withColumn("confidence_milli", F.greatest(F.lit(0), F.least(F.lit(1000), total)).cast("int"))


def with_reasons(rows: DataFrame) -> DataFrame:
    """Adds the reasons that the outcomes stand for."""
    reasons = [F.format_string("base:base:%d", F.lit(BASE))]
    for kind, column in PARTS.items():
        reasons.append(F.when(F.col(column).isin(*DELTAS[kind]), F.concat_ws(":", F.lit(kind), F.col(column), delta(kind, F.col(column)).cast("string"))))
    reasons.append(F.when(F.col("community") > 0, F.concat(F.lit("community_score:boost:"), F.col("community").cast("string"))))
    return rows.withColumn("reasons", F.array_compact(F.array(*reasons)))


def scored(pairs: DataFrame) -> DataFrame:
    return with_reasons(outcomes(pairs))


def ranked(pairs: DataFrame, query_key: str = "query_id", most: int = MOST) -> DataFrame:
    """The best candidates of each query: confidence, then provider and provider id."""
    order = Window.partitionBy(query_key).orderBy(F.col("confidence_milli").desc(), "provider", "provider_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
