"""Hot keys: one shop owns a third of the orders and one supplier (app) sells a
third of the lines. The reports that shuffle on those keys must still equal
the oracle. The skewed tables are derived from the sf0.001 tables in a temp
folder."""

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from compare import SF_SMALL, TABLES, compare, duck

HOT_SHOP = 0
HOT_SUPPLIER = 0
NAMES = ["regional_app_gmv_monthly", "merchant_tracker", "regional_merchant_list", "partner_outbound_list",
         "campaign_scorecard", "vendor_line_items", "checkout_duration_by_event", "kpi_mart"]


def _every_third(keys: pa.ChunkedArray) -> pa.Array:
    return pa.array(keys.to_numpy() % 3 == 0)


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    for t in TABLES:
        table = pq.read_table(f"{SF_SMALL}/{t}.parquet")
        if t == "orders":
            hot = _every_third(table["o_orderkey"])
            table = table.set_column(table.schema.get_field_index("o_custkey"), "o_custkey",
                                     pc.if_else(hot, pa.scalar(HOT_SHOP, pa.int64()), table["o_custkey"]))
        if t == "lineitem":
            hot = _every_third(table["l_orderkey"])
            table = table.set_column(table.schema.get_field_index("l_suppkey"), "l_suppkey",
                                     pc.if_else(hot, pa.scalar(HOT_SUPPLIER, pa.int64()), table["l_suppkey"]))
        pq.write_table(table, out / f"{t}.parquet")
    return str(out)


def test_hot_keys_hold_a_third(skewed_dir):
    orders = pq.read_table(f"{skewed_dir}/orders.parquet")
    share = pc.sum(pc.equal(orders["o_custkey"], HOT_SHOP)).as_py() / orders.num_rows
    assert share > 0.3


@pytest.mark.parametrize("name", NAMES)
def test_reports_equal_oracle_under_skew(spark, skewed_dir, name):
    con = duck(skewed_dir)
    report = compare(entry.queries()[name](spark, skewed_dir), con, entry.oracle_sql()[name])
    assert report["columns_match"] and report["values_match"], report
    assert report["spark_rows"] == report["oracle_rows"], report
