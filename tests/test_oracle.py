"""Every relational query against its independent DuckDB statement (sf0.001)."""

from tools.oracle_check import compare

from .conftest import SF001


def test_all_oracle_queries_match(spark):
    results = compare(spark, SF001, verbose=False)
    assert results and all(results.values()), [k for k, v in results.items() if not v]
