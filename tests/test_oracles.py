import pytest

from ledgerlens.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_twin(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and df.columns


def test_consensus_as_walked(spark):
    """Each proposal joins the first cluster whose head it is near; the largest cluster, the earliest of equals, wins."""
    rows = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "round(value / 10, 0) AS v", "event_id").orderBy("event_id").collect():
        rows.setdefault(r.user_id, []).append(r.v)
    want = set()
    for q, values in rows.items():
        clusters = []
        for v in values:
            near = [c for c in clusters if abs(c[0] - v) <= max(0.02, 2e-4 * max(abs(c[0]), abs(v)))]
            if near:
                near[0][1] += 1
            else:
                clusters.append([v, 1])
        want.add((q, *max(clusters, key=lambda c: c[1])))
    got = {tuple(r) for r in QUERIES["numeric_consensus"](spark, SF).select("qid", "value", "members").collect()}
    assert got == want
