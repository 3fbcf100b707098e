"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from spindrift.plans import evidence, evidence_oracles, oracles, queries, record_oracles, records, request_oracles, requests

ORACLES = oracles.ORACLES | record_oracles.ORACLES | evidence_oracles.ORACLES | request_oracles.ORACLES
QUERIES = queries.QUERIES | records.QUERIES | evidence.QUERIES | requests.QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return "NULL"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
