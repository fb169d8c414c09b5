"""Every query of the library's own operators against its SQL on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

from triagelake.plans import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connection(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.difference(spark, con, registry.queries()[name], SQL[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    registry.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
