"""Every registered query against its DuckDB oracle (rows, columns, values) on the fixtures."""

import pytest

from conftest import SF_SMALL
from corpuspack.plans.queries import QUERIES
from tools.check_oracle import compare

import __spark_entry__ as E


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, name):
    assert compare(spark, SF_SMALL, [name])


def test_every_query_has_an_oracle():
    """Queries that SQL cannot express have brute-force tests instead; subword ids are held against the library."""
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) - set(E.oracle_sql()) == {"subword_ids", "subword_shards"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"source", "shard_idx", "n_tokens"}
