"""Validation and plans of requests: device commands, subtitle searches, search intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import ascii_lower, non_blank, trimmed
from spindrift.functions.urls import is_exact_link, is_safe_url
from spindrift.functions.values import json_text


def command_fault(protocol: str, target_kind: Column, known: Column, urls: Column, command: Column, mode: Column, position_ms: Column, volume: Column) -> Column:
    """The first fault of a command, NULL where it can be carried out; urls: (kind, url, content_type)."""
    wanted = F.when(mode == "hls", "playlist").otherwise("stream")
    play = play_url(urls, wanted)
    return (
        F.when(target_kind != protocol, "unsupported_protocol").when(~known, "unknown_target").when(F.exists(urls, lambda u: ~is_safe_url(u["url"])), "unsafe_transport_url")
        .when((command == "play") & (F.size(urls) == 0), "missing_transport_url").when((command == "play") & (trimmed(play["content_type"]) == ""), "missing_content_type")
        .when((command == "seek") & position_ms.isNull(), "missing_seek_position").when((command == "set_volume") & volume.isNull(), "missing_volume")
    )


def play_url(urls: Column, wanted: Column) -> Column:
    """The first of the wanted kind, else the first."""
    return F.coalesce(F.get(F.filter(urls, lambda u: u["kind"] == wanted), F.lit(0)), F.get(urls, F.lit(0)))


def languages(requested: Column) -> Column:
    """Valid tokens in lower case, sorted and distinct; English where none is left."""
    valid = F.filter(F.transform(requested, trimmed), lambda x: x.rlike("^[A-Za-z0-9-]{1,32}$"))
    found = F.array_sort(F.array_distinct(F.transform(valid, ascii_lower)))
    return F.when(F.size(found) == 0, F.array(F.lit("en"))).otherwise(found)


def effective_limit(limit: Column, default: int, most: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(limit, F.lit(default)), F.lit(most)))


def intent(query: Column, ext: Column) -> Column:
    """exact_link, external_id, media_title or free_text; ext: a JSON object.

    An external_id object with a blank part ends the search for ids.
    """
    nested = F.schema_of_variant(F.try_variant_get(F.try_parse_json(ext), "$.external_id", "variant")).startswith("OBJECT")
    flat = json_text(ext, "external_id_kind").isNotNull() & json_text(ext, "external_id_value").isNotNull()
    inner = json_text(ext, "external_id.kind").isNotNull() & json_text(ext, "external_id.value").isNotNull()
    has_id = F.when(F.coalesce(nested, F.lit(False)), inner).otherwise(flat)
    media = F.try_variant_get(F.try_parse_json(ext), "$.media_title", "variant")
    title = F.when(media.isNotNull(), json_text(ext, "media_title")).otherwise(json_text(ext, "title"))
    return F.when(is_exact_link(query), "exact_link").when(has_id, "external_id").when(title.isNotNull(), "media_title").otherwise("free_text")


def endpoint_status(n_endpoints: Column, valid: Column, template_ok: Column, enabled: Column) -> Column:
    """How a notification endpoint is configured, by the first of these that holds."""
    return F.when(n_endpoints > 1, "multiple").when(~valid, "invalid").when(~template_ok, "template").when(enabled, "ready").otherwise("ack_only")


def cast_fault(target_kind: Column, app_id: Column, known: Column, live: Column, urls: Column, command: Column, mode: Column, position_ms: Column, volume: Column) -> Column:
    """The first fault of a cast command: as ``command_fault``, with the receiver's id and live discovery."""
    play = play_url(urls, F.when(mode == "hls", "playlist").otherwise("stream"))
    return (
        F.when(target_kind != "chromecast", "unsupported_protocol").when(non_blank(app_id).isNull(), "receiver_app_id_missing").when(~known & ~live, "unknown_target")
        .when(F.exists(urls, lambda u: ~is_safe_url(u["url"])), "unsafe_transport_url").when((command == "play") & (F.size(urls) == 0), "missing_transport_url")
        .when((command == "play") & (trimmed(play["content_type"]) == ""), "missing_content_type")
        .when((command == "seek") & position_ms.isNull(), "missing_seek_position").when((command == "set_volume") & volume.isNull(), "missing_volume")
    )


def envelope_ok(envelope: dict[str, Column], expected: dict[str, str]) -> Column:
    """Whether an event's envelope has each expected value."""
    out = F.lit(True)
    for name, value in expected.items():
        out = out & envelope[name].eqNullSafe(F.lit(value))
    return out


def no_candidate_reason(n_candidates: Column, failed: Column, selected: Column, suppressed: Column, budget: Column, skipped: Column) -> Column:
    """Why an item has no candidate, by counts of its sources' statuses; NULL where it has one."""
    none = selected == 0
    return F.when(n_candidates == 0, (
        F.when(failed > 0, "provider_failed").when(none & (suppressed > 0), "provider_suppressed").when(none & (budget > 0), "provider_budget_exhausted")
        .when(none & (skipped > 0), "provider_skipped_by_route").otherwise("no_candidates")
    ))


def drift_status(checks: list[Column]) -> Column:
    """ok where every check that could be made is true, drift where one is false."""
    return F.when(F.forall(F.array_compact(F.array(*checks)), lambda c: c), "ok").otherwise("drift")


def render_url_fault(url: Column) -> Column:
    """Why a page must not be rendered, by the first test that fails; NULL where it may be."""
    low = ascii_lower(trimmed(url))
    authority = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*:/*([^/?#]*)", 1)
    return (
        F.when(non_blank(url).isNull(), "missing_url").when(~low.rlike("^[a-z][a-z0-9+.-]*:.") | (low.rlike("^https?:") & (F.regexp_replace(authority, "^.*@", "") == "")), "invalid_render_url")
        .when(~low.rlike("^https?:"), "invalid_render_url_scheme").when(F.regexp_replace(authority, "@[^@]*$", "@").rlike("^[^@:].*@|^:.+@"), "invalid_render_url_credentials")
    )


def suite_status(cases: DataFrame) -> DataFrame:
    """(suite, n_cases, n_failed, status): a suite is ok where none of its cases failed."""
    failed = F.count_if(F.col("status") != "ok")
    return cases.groupBy("suite").agg(F.count("*").alias("n_cases"), failed.alias("n_failed")).withColumn("status", F.when(F.col("n_failed") == 0, "ok").otherwise("failed"))


def link_request(query: Column, limit: Column, refresh: Column, link_types: Column, default_types: list[str], ext: Column) -> Column:
    """The request to a link search source, as JSON: wanted types that it knows, else the configured ones."""
    wanted = F.when(F.size(link_types) > 0, link_types).otherwise(F.array(*map(F.lit, default_types)))
    known = F.filter(wanted, lambda t: ~t.isin("web", "other"))
    fields = F.struct(query.alias("kw"), refresh.alias("refresh"), F.lit("results").alias("res"), F.when(F.size(known) > 0, known).alias("cloud_types"), limit.alias("limit"), ext.alias("ext"))
    return F.to_json(fields)
