"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from noteskein.plans.catalogue import ORACLES, QUERIES
from tests.compare import connect, difference


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    plans = []

    def build(session, folder):
        df = QUERIES[name](session, folder)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    assert difference(spark, duck, build, ORACLES.get(name), sf_dir) is None
    assert "CartesianProduct" not in plans[0] and "BroadcastNestedLoopJoin" not in plans[0]


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    plan = QUERIES["slow_requests"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,5.0)" in plan
    plan = QUERIES["chunk_coverage"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["company", "n_people"]
