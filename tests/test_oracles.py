"""Every query of the core that SQL can say, against DuckDB."""

import pytest

from oracle import connect, rows_of_spark, rows_of_sql
from strandloom.plans import catalog, problems, registry, roundtrip, rules  # noqa: F401

ALL = [(m, k) for m in (problems, registry) for k in m.QUERIES]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize(("module", "name"), ALL, ids=[k for _, k in ALL])
def test_query(spark, sf, con, module, name):
    df = module.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = rows_of_spark(df)
    if name in module.ORACLES:
        assert got == rows_of_sql(con, module.ORACLES[name])
