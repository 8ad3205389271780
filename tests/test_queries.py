"""Every query with SQL gives the rows of its SQL."""

import pytest

from gaugeworks.plans import crowded, more_queries  # noqa: F401
from gaugeworks.plans import queries as core
from oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, core.QUERIES[name], core.ORACLE_SQL[name], SF)
