"""Every registered query with SQL semantics against its DuckDB oracle, on
the smallest test tables (the driver runs the same check at sf0.01)."""

import pytest

import __spark_entry__ as E
from compare import compare
from conftest import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    ok, _ = compare(spark, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert ok, name


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert [f.name for f in df.schema] == ["date", "units_sold", "revenue", "num_invoices",
                                           "num_customers"]
    assert df.count() > 0
