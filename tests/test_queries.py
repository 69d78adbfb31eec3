"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from tessera.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_filter_and_columns_reach_the_scan(spark, capsys):
    QUERIES["flagship_pricing"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan
