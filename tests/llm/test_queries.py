"""Every registered query against DuckDB where SQL can express it."""

import pytest

from compare import compare, duck
from merchlens.llm import queries

SF = "/root/testdata/sf0.001"


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, name):
    report = compare(queries.QUERIES[name](spark, SF), duck(SF), queries.oracle_sql()[name])
    assert report["columns_match"] and report["values_match"], report
