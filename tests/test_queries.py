"""Every registered query against its DuckDB form at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import difference, duck
from workload.queries import registered

SF = os.environ.get("AUDITLOOM_TEST_SF", "/root/testdata/sf0.001")
QUERIES = entry.queries()
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def test_every_query_of_the_library_has_a_sql_form():
    assert set(registered()) <= set(SQL) <= set(QUERIES)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], SF, duck(SF)) is None
