"""Every value-checkable registered query equals its DuckDB SQL (the driver's
check), on the smallest scale so the suite stays quick."""

import pytest

from corpusmap.plans.registry import ORACLE_SQL

from .conftest import SF_SMALL
from .oracle import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["status"] == "match", r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
    assert set(E.oracle_sql()) <= set(E.queries())
