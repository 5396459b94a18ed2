"""Plan checks: no cartesian products or Python UDFs, semi joins where cohorts are
used, filters and column pruning reaching the parquet scans."""

import re

import pytest

from merchlens.plans import maintained
from merchlens.plans.catalog import QUERIES
from compare import SF_SMALL


# members, history, opportunities, attribution and rollup
LINEITEM_SCANS = 5


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES | maintained.QUERIES))
def test_no_cartesian_no_python(spark, name):
    text = plan_text((QUERIES | maintained.QUERIES)[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in text, f"{name}: {bad}"


@pytest.mark.parametrize("name", ["merchant_tracker", "regional_merchant_list", "vendor_line_items",
                                  "account_upgrade_targets", "campaign_scorecard"])
def test_cohorts_are_semi_joins(spark, name):
    assert "LeftSemi" in plan_text(QUERIES[name](spark, SF_SMALL))


DATED = {
    "regional_app_gmv_monthly": "l_shipdate", "plan_vs_actual_monthly": "l_shipdate", "merchant_tracker": "l_shipdate",
    "merchant_age_band_summary": "o_orderdate", "regional_merchant_list": "l_shipdate", "account_upgrade_targets": "o_orderdate",
    "partner_outbound_list": "o_orderdate", "vendor_line_items": "l_shipdate", "gateway_gmv_monthly": "l_shipdate",
    "channel_gmv_monthly": "o_orderdate", "app_gmv_monthly": "l_shipdate", "month_spine": "o_orderdate", "order_rollup": "l_shipdate",
    "trailing_year_totals": "o_orderdate", "shop_totals_since": "o_orderdate", "activity_semi_join": "l_shipdate",
    "threshold_after_agg": "o_orderdate", "complete_months": "o_orderdate",
    # the funnel's inputs: rollup rows by their ship date, opportunities by their order's date
    "kpi_mart": "l_shipdate|o_orderdate", "kpi_campaign_names": "l_shipdate|o_orderdate", "campaign_selector": "l_shipdate|o_orderdate",
    "campaign_scorecard": "l_shipdate|o_orderdate", "campaign_leads_extract": "l_shipdate|o_orderdate",
    "campaign_members_mql": "l_shipdate|o_orderdate", "attributed_value_split": "o_orderdate",
}


@pytest.mark.parametrize("name", sorted(DATED))
def test_date_range_reaches_the_scan(spark, name):
    """A range comparison on the raw date column is among the scan's pushed filters (not only IsNotNull)."""
    # The formatted plan prints each scan's pushed filters whole.
    text = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = [line for line in text.splitlines() if line.startswith("PushedFilters")]
    for column in DATED[name].split("|"):
        assert any(re.search(rf"(GreaterThan|GreaterThanOrEqual|LessThan|LessThanOrEqual)\({column},", line) for line in pushed), pushed


def test_scan_bounds_drop_no_needed_row(spark):
    """Around leap days and year ends, every row that the report's own filter keeps is inside the bounds."""
    import datetime as dt

    from pyspark.sql import functions as F

    from merchlens.sources.constants import YEAR_SHIFT
    from merchlens.sources.warehouse import Warehouse, shifted_date
    days = [dt.datetime(y, m, d, h) for y in (1996, 1997, 1999, 2000) for m, d in ((1, 1), (2, 28), (3, 1), (12, 31)) for h in (0, 23)]
    days += [dt.datetime(y, 2, 29, 12) for y in (1996, 2000)]
    df = spark.createDataFrame([(x,) for x in days], "d timestamp_ntz")
    for day in days:
        cut = dt.date(day.year + YEAR_SHIFT, day.month, day.day)
        for since, until in ((cut, None), (None, cut)):
            want = F.col("day") >= F.lit(cut) if since else F.col("day") <= F.lit(cut)
            seen = df.select("d", shifted_date("d").alias("day")).where(want)
            assert seen.count() == Warehouse.bounded(seen, "d", since, until).count()


def test_only_needed_columns_are_read(spark):
    text = plan_text(QUERIES["regional_merchant_list"](spark, SF_SMALL))
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "l_shipdate" in line]
    assert scans and all("l_tax" not in s and "l_quantity" not in s for s in scans)


def test_activity_keys_are_distinct_before_the_shuffle(spark):
    """A partial aggregate on the key stands below the exchange of the facts."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("activity_semi_join", "regional_merchant_list"):
            text = plan_text(QUERIES[name](spark, SF_SMALL))
            assert re.search(r"Exchange hashpartitioning\(_shop_key#\d+L, \d+\)[^\n]*\n[^\n]*HashAggregate\(keys=\[_shop_key#\d+L\], functions=\[\]", text), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_outbound_filters_are_comparisons(spark):
    for name in ("partner_outbound_list", "calendar_age_filter"):
        assert "datediff" not in plan_text(QUERIES[name](spark, SF_SMALL)).lower()


def test_scorecard_reads_each_table_once_a_use(spark):
    """Executed plan: members, history and opportunities once each, and the two inputs of the name set."""
    df = QUERIES["campaign_scorecard"](spark, SF_SMALL)
    df.collect()
    final = plan_text(df).split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan parquet" in line and "[l_" in line]
    assert len(scans) <= LINEITEM_SCANS, scans


def scans_of(df, *tables):
    """File scans of an executed plan, by table."""
    df.collect()
    final = plan_text(df).split("== Initial Plan ==")[0]
    lines = [line for line in final.splitlines() if "FileScan parquet" in line]
    return {t: sum(f"/{t}.parquet]" in line for line in lines) for t in tables}


def test_app_gmv_reads_its_facts_once(spark):
    """Q01: apps without a partner don't double what stands below their join."""
    scans = scans_of(QUERIES["regional_app_gmv_monthly"](spark, SF_SMALL), "lineitem", "orders", "supplier")
    assert scans == {"lineitem": 1, "orders": 1, "supplier": 1}
    text = plan_text(QUERIES["regional_app_gmv_monthly"](spark, SF_SMALL))
    assert "Union" not in text


def test_outbound_totals_are_of_the_selected_shops(spark):
    """Q10: the window's rows are semi-joined to the selected merchants' primary shops before they are summed."""
    text = plan_text(QUERIES["partner_outbound_list"](spark, SF_SMALL))
    below = text[re.search(r"HashAggregate\(keys=\[shop_id#\d+L\], functions=\[partial_sum\(daily_gmv_usd", text).start():]
    assert "LeftSemi" in below.split("FileScan parquet [o_custkey")[0]


def test_vendor_items_scans(spark):
    """Q12: line items, facts and installs each read the lines at most once a use."""
    scans = scans_of(QUERIES["vendor_line_items"](spark, SF_SMALL), "lineitem", "orders")
    assert scans["lineitem"] <= 4 and scans["orders"] <= 4, scans


def test_outbound_list_never_pairs_facts_with_snapshots(spark):
    """Q10 joins one pre-aggregated snapshot row per shop, never fact x snapshot pairs."""
    text = plan_text(QUERIES["partner_outbound_list"](spark, SF_SMALL))
    # the snapshot is aggregated per shop (the join key) before it is joined
    assert re.search(r"HashAggregate\(keys=\[shop_id#\d+L\], functions=\[sum\(daily_gmv_usd", text)


def test_mart_regrain_is_not_partitioned_by_country(spark):
    """The country label is a broadcast join, so no exchange partitions the mart by country alone."""
    text = plan_text(QUERIES["kpi_mart"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in text
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", text)
    assert keys and not any(re.fullmatch(r"country_code#\d+, \d+", k) for k in keys)
