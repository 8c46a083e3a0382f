"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from lureframe.plans import registry
from tools.check import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the provided tables")
entry.queries()
QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    result = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert result.startswith(("ok", "rows only")), result


def test_entry_is_the_campaign_question(spark):
    assert {"fingerprint", "session_count", "attacker_ip_count"} <= set(entry.entry(spark).columns)


def test_retention_counts_every_citation(spark):
    """All events that kept claims cite are referenced, not those of one claim in fifty."""
    cited = QUERIES["claims_kept"](spark, FOLDER).selectExpr("event_id", "substr(ts, 1, 10) AS partition").distinct().groupBy("partition").count()
    got = {r["partition"]: r["referenced"] for r in QUERIES["retention_all"](spark, FOLDER).collect()}
    assert all(got[r["partition"]] >= r["count"] for r in cited.collect())


def test_coverage_has_its_evidence(spark):
    covered = {r["technique_id"]: r for r in QUERIES["coverage"](spark, FOLDER).collect()}
    seen = {}
    for r in QUERIES["coverage_evidence"](spark, FOLDER).collect():
        seen.setdefault(r["technique_id"], set()).add(r["session_id"])
    assert {t: r["session_count"] for t, r in covered.items()} == {t: len(seen.get(t, ())) for t in covered}
    totals = QUERIES["coverage_totals"](spark, FOLDER).collect()
    assert sum(r["total"] for r in totals) == len(covered) and sum(r["observed"] for r in totals) == sum(r["observed"] for r in covered.values())
