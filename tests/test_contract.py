"""Driver contract: entry(), queries() and oracle_sql() agree at sf0.001."""

import pytest

import __spark_entry__ as E
from actlake.catalog import QUERIES as REGISTERED
from actlake.catalog.check import compare, duckdb_con

from .conftest import SF

# the queries of the llm folder have tests of their own there
QUERIES = {n: E.queries()[n] for n in REGISTERED}
ORACLE = E.oracle_sql()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["rid", "n_tokens", "was_truncated"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE) and set(ORACLE) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert ok, msg
