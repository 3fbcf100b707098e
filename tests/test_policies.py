"""Policies as rows: whose values a record takes, what a run does with each source, and how the joins hold under skew."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import fuse, policies, presets
from spindrift.sources import catalog

FACTS = "policy string, cluster string, provider string, provider_id string, arrival long, confidence_milli int, title string, overview string, genres array<string>"


def fused(spark, facts, rows, fields=None):
    fields = fields or {"title": "string", "overview": "string", "genres": "array<string>"}
    table = spark.createDataFrame(rows, "policy string, field string, source string, rank long")
    out = policies.records(policies.fused_values(spark.createDataFrame(facts, FACTS), table, list(fields)), fields)
    return {r.cluster: tuple(r[f] for f in fields) for r in out.collect()}


def test_preferred_then_base_then_first(spark):
    facts = [
        ("p", "c", "a", "1", 0, 900, "base", None, None), ("p", "c", "b", "2", 1, 500, "second", "b's", ["g"]), ("p", "c", "d", "3", 2, 500, None, "d's", ["h", "i"]),
        ("p", "alone", "a", "1", 0, 900, "base", None, None),
    ]
    # d is preferred for titles but has none; nothing is said of overviews; genres name a source that is not there.
    got = fused(spark, facts, [("p", "title", "d", 0), ("p", "title", "b", 1), ("p", "genres", "z", 0), ("q", "overview", "b", 0)])
    assert got == {"c": ("second", None, ["g"]), "alone": ("base", None, None)}
    assert fused(spark, facts, [])["c"] == ("base", None, None)


def test_each_request_has_its_own_policy(spark):
    facts = [(p, p, s, s, k, 500, f"{s} says", None, None) for p in ("x", "y", "none") for k, s in enumerate("abc")]
    got = fused(spark, facts, [("x", "title", "c", 0), ("y", "title", "b", 0)])
    assert {c: v[0] for c, v in got.items()} == {"x": "c says", "y": "b says", "none": "a says"}


def test_request_policies_become_rows(spark):
    requests = spark.createDataFrame([(1, '{"Title":[" DMM ","dmm","B"],"outline":["o"],"overview":"w"}'), (2, None), (3, "{}"), (4, "[1]"), (5, '{"overview":"w","outline":["o"],"title":["dmm","b"]}')], "request long, policy string")
    default = presets.preferences(spark, catalog.catalog(spark))
    assigned, rows = policies.field_policies(requests, default, ["title", "overview", "year"])
    policy = {r.request: r.policy for r in assigned.collect()}
    assert policy[2] == policy[4] == policies.DEFAULT and len({policy[k] for k in (1, 2, 3)}) == 3 and policy[1] == policy[5]
    listed = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        listed.setdefault((r.policy, r.field), []).append(r.source)
    assert listed[policy[1], "title"] == ["dmm", "b"] and listed[policy[1], "overview"] == ["w", "o"]
    assert listed[policies.DEFAULT, "title"] == ["theporndb", "mgstage", "dmm", "javbus", "jav321", "javlibrary"]
    assert not [k for k in listed if k[0] == policy[3]]


@pytest.mark.parametrize(("payload", "disabled", "most"), [
    ('{"provider_execution_policy":{"disabled_provider_ids":[" JavDB ","javdb","dmm"],"max_selected_providers":"2"}}', ["x", "javdb", "dmm"], 2),
    ('{"provider_run_policy":{"suppressed_provider_ids":"FC2","max_selected_providers_per_item":3}}', ["x", "fc2"], 3),
    ('{"disabled_provider_ids":["a",7," "],"max_selected_providers":1}', ["x", "a"], 9), ('{"provider_execution_policy":{"max_selected_providers":0}}', ["x"], None),
    ('{"provider_execution_policy":[],"disabled_provider_ids":"b"}', ["x", "b"], 9), ('{"provider_execution_policy":{"max_selected_providers":-4}}', ["x"], 9), ("no json", ["x"], 9), (None, ["x"], 9),
])
def test_run_policies(spark, payload, disabled, most):
    got = policies.run_policy(F.col("p"), F.array(F.lit("x")), F.lit(9))
    row = spark.createDataFrame([(payload,)], "p string").select(got[0].alias("d"), got[1].alias("m")).first()
    assert (row.d, row.m) == (disabled, most)


def test_statuses_of_requests(spark):
    requests = spark.createDataFrame([(1, ["dmm"], "fc2", 2), (2, [], None, None)], "request long, disabled array<string>, route string, most int")
    got = {}
    for r in policies.statuses(requests, catalog.catalog(spark)).orderBy("ordinal").collect():
        got.setdefault((r.request, r.status), []).append(r.provider)
    assert got[1, "suppressed"] == ["dmm"] and got[1, "selected"] == ["fc2", "fc2ppvdb"] and "airav" in got[1, "budget_exhausted"] and "javdb" in got[1, "skipped_by_route"]
    assert len(got[2, "selected"]) == 22 and set(got) & {(2, "suppressed"), (2, "skipped_by_route")} == set()


def test_one_policy_for_all_is_the_same_operator(spark):
    facts = spark.createDataFrame([("p", "c", s, s, k, 500, f"{s} says", None, [s]) for k, s in enumerate("abc")], FACTS).drop("policy")
    got = fuse.fused(facts, {"title": ["b"], "genres": []}).first()
    assert (got.title, got.genres, got.provider, got.n_facts) == ("b says", ["a"], "a", 3)


def test_a_policy_that_most_facts_share_is_split(spark):
    """Without a broadcast, the cells of one policy and field are dealt over several tasks."""
    changes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    old = {k: spark.conf.get(k, None) for k in changes}
    for k, v in changes.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(40_000).selectExpr("'p' policy", "id % 5000 cluster", "concat('s', id % 4) provider", "cast(id as string) provider_id", "id arrival", "cast(id % 900 as int) confidence_milli", "concat('title ', id) title").repartition(6)
        rows = spark.createDataFrame([("p", "title", "s3", 0), ("q", "title", "s1", 0)], "policy string, field string, source string, rank long")
        out = policies.fused_values(facts, rows, ["title"])
        assert out.count() == 5000
        rows_ = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan and len(rows_) == 5000


def test_one_policy_for_all_joins_nothing(spark):
    """Cells of one policy are not dealt by field, where each field would be one task's."""
    facts = spark.range(100).selectExpr("id % 10 cluster", "concat('s', id % 3) provider", "'x' provider_id", "id arrival", "1 confidence_milli", "id title")
    out = fuse.fused(facts, {"title": ["s2", "s1", "s2"]})
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.cluster: r.title for r in out.collect()} == {c: min(i for i in range(c, 100, 10) if i % 3 == 2) for c in range(10)}
