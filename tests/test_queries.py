"""Every registered query that has SQL gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
import check_oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check_oracle.tables(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    verdict = check_oracle.compare(spark, connection, name, FOLDER)
    assert verdict.startswith("ok") and "types differ" not in verdict, verdict


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "finite", "better_than_mean"] and not df.isEmpty()
