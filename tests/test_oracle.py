"""Every registered query against its DuckDB oracle (rows-only where none)."""

import pytest

import __spark_entry__ as E
from roundlearn.plans import registry
from conftest import SF_SMALL
from oracle_compare import compare

QUERIES = {k: f for k, f in E.queries().items() if k in registry.QUERIES}
ORACLE = E.oracle_sql()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    if key not in ORACLE:
        assert df.count() > 0 and df.columns
        return
    ok, msg = compare(df, SF_SMALL, ORACLE[key])
    assert ok, msg


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["scope", "class", "class_order", "metric", "value"]
