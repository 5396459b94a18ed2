"""Differential tests: every registered query against its DuckDB oracle at sf0.01."""

import pytest

import __spark_entry__ as entry
from compare import SF_ORACLE, compare
from merchlens.plans import catalog, maintained, oracle

QUERIES = {name: entry.queries()[name] for name in catalog.QUERIES | maintained.QUERIES}
ORACLE = oracle.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_oracle, name):
    report = compare(QUERIES[name](spark, SF_ORACLE), duck_oracle, ORACLE[name])
    assert report["columns_match"], report
    assert report["spark_rows"] == report["oracle_rows"], report
    assert report["values_match"], report


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["created_date", "name", "Members"]


def test_stacked_inputs_share_rows(spark, duck_oracle):
    """The distinct has rows to drop."""
    parts = [duck_oracle.sql(ORACLE[n]).fetchall() for n in ("attributed_value_split", "funnel_rollup")]
    union = duck_oracle.sql(f"SELECT count(*) FROM ({ORACLE['union_measures']})").fetchall()[0][0]
    assert union < sum(map(len, parts))
