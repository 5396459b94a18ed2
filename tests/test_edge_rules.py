"""Rules that the test tables alone would not show: order, wide decimals, null names, literal suffixes, filters that matter."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from compare import SF_ORACLE
from merchlens.operators import campaign, enrich, funnel, rollup
from merchlens.plans import catalog, reports
from merchlens.sources.constants import DEFAULT_AS_OF
from merchlens.sources.warehouse import Warehouse


@pytest.fixture(scope="module")
def w(spark):
    return Warehouse(spark, SF_ORACLE)


def test_ordered_reports_are_ordered(spark):
    keys = [r["_merchant_key"] for r in catalog.QUERIES["merchant_tracker"](spark, SF_ORACLE).collect()]
    assert keys == sorted(keys) and len(set(keys)) > 5
    gmv = [r["shop_gmv"] for r in catalog.QUERIES["regional_merchant_list"](spark, SF_ORACLE).collect()]
    known = [g for g in gmv if g is not None]
    assert known == sorted(known, reverse=True) and gmv[:len(known)] == known and len(set(known)) > 5


def test_attributed_value_keeps_seven_digits(spark):
    opps = spark.createDataFrame(
        [(1, dt.datetime(2022, 1, 1), True, True, Decimal("1234567.1234567"), *["x"] * 9)],
        "_plus_opportunity_key long, opportunity_closed_date timestamp_ntz, is_closed boolean, is_won boolean, "
        "monthly_contract_value decimal(38,7), cost_center string, cost_center_track string, market_segment string, inferred_region string, "
        "inferred_country_code string, deal_type_category string, sales_region string, upgrade_type string, attributed_source string")
    facts = spark.createDataFrame([(1, 1, 1, Decimal("0.0333333333"))] * 3,
                                  "_plus_opportunity_key long, _revenue_touchpoint_attribution_key long, _plus_marketing_channel_key long, count_w_shaped decimal(38,10)")
    touch = spark.createDataFrame([(1, *["t"] * 5)], "_revenue_touchpoint_attribution_key long, ad_campaign_name string, ad_content string, "
                                                     "keyword_text string, medium string, touchpoint_source string")
    channels = spark.createDataFrame([(1, *["c"] * 3)], "_plus_marketing_channel_key long, marketing_channel string, "
                                                        "adjusted_marketing_channel_path string, marketing_channel_path string")
    row = funnel.attributed_value_split(opps, facts, touch, channels).first()
    exact = Decimal("1234567.1234567") * Decimal("0.0333333333") * 3
    assert row["net_new_monthly_contract_value"] == round(exact, 7)
    assert row["net_new_deals_won"] == round(exact / 2000, 7)


def test_totals_keep_the_scale_of_their_measure(spark):
    df = spark.createDataFrame([("a", Decimal("1.2345")), ("a", Decimal("2.0001"))], "k string, m decimal(12,4)")
    assert rollup.shop_totals_since(df, "k", {"m": "m"}).first()["m"] == Decimal("3.2346")
    assert dict(rollup.shop_totals_since(df, "k", {"m": "m"}).dtypes)["m"] == "decimal(38,4)"


def crm(spark, name, domains):
    day = dt.datetime(2022, 5, 1)
    campaigns = spark.createDataFrame([("C", name, day)], "id string, name string, created_date timestamp_ntz")
    members = spark.createDataFrame([("C", f"L{i}", f"L{i}") for i in range(len(domains))] + [("C", None, "X"), ("C", None, None)],
                                    "campaign_id string, lead_id string, lead_or_contact_id string")
    leads = spark.createDataFrame([(f"L{i}", "Qualified", f"co{i}", d) for i, d in enumerate(domains)], "id string, status string, company string, domain_name string")
    history = spark.createDataFrame([("L0", day - dt.timedelta(days=1)), ("L1", day)], "lead_id string, created_at timestamp_ntz")
    return campaigns, members, leads, history


def test_suffix_is_literal_and_names_may_be_null(spark):
    row = campaign.campaign_members_mql(*crm(spark, None, ["a.com", None, "b.my_shop", "b.myxshop", "c.my%shop"]), domain_suffix="my_shop").first()
    assert row["name"] is None and (row["members"], row["MQL"], row["net_new_mql"]) == (5, 4, 3)
    row = campaign.campaign_members_mql(*crm(spark, "n", ["a", "b"]), domain_suffix="zz").first()
    assert (row["members"], row["MQL"], row["net_new_mql"]) == (3, 2, 1)


def test_label_is_not_forced_to_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("IN",), (None,), ("??",)], "country_code string")
        names = spark.createDataFrame([("IN", "India")], "country_code string, country_name string")
        out = enrich.label_unknown(df, names)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["country"] for r in out.collect()) == ["India", "Unknown country_name", "Unknown country_name"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_elapsed_seconds_across_midnight(spark):
    events = spark.createDataFrame([(1, "e", "t")], "shop_id long, event_name string, checkout_token string")
    facts = spark.createDataFrame([("t", dt.datetime(2022, 1, 1, 23, 59, 50), dt.datetime(2022, 1, 2, 0, 0, 10), True)],
                                  "checkout_token string, created_at timestamp_ntz, completed_at timestamp_ntz, is_pay_user_at_time_of_checkout boolean")
    assert reports.checkout_duration_by_event(events, facts).first()["time_taken"] == -86380
    assert reports.checkout_duration_by_event(events, facts, elapsed=True).first()["time_taken"] == 20


# Each clause changes its result on the test tables: (query, the same without the clause).
def rows(df):
    return sorted(map(repr, df.collect()))


def test_filters_matter(w):
    start = "1990-01-01"
    app = lambda since: reports.regional_app_gmv_monthly(w.app_gmv_daily(), w.shops(), w.merchants(), w.api_clients(), w.partners(), since=since)
    assert rows(app("2020-12-31")) != rows(app(start))
    cod = lambda **how: rollup.gateway_gmv_monthly(w.gmv_facts(), w.gateways(), w.shops(), w.fulfillments(), country_codes=["IN"],
                                                   gateway_names=reports.COD_GATEWAY_NAMES, as_of=DEFAULT_AS_OF, **how)
    usual = rows(cod(since="2021-12-31", cap=20_000))
    assert usual != rows(cod(since=start, cap=20_000)) and usual != rows(cod(since="2021-12-31"))
    off = lambda since: rollup.app_gmv_monthly(w.app_gmv_daily(), w.shops(), country_codes=["IN"], since=since, as_of=DEFAULT_AS_OF)
    assert rows(off("2021-12-31")) != rows(off(start))
    listed = lambda since: reports.regional_merchant_list(w.shops(), w.channel_gmv_daily(), w.gmv_facts(), since=since)
    assert rows(listed("2021-12-31")) != rows(listed(start))
    assert rows(rollup.order_rollup(w.gmv_facts(), after_year=2021)) != rows(rollup.order_rollup(w.gmv_facts(), after_year=1990))
    value = lambda since: funnel.attributed_value_split(w.opportunity_dim(), w.attribution_facts(), w.touchpoints(), w.marketing_channels(), since=since)
    assert rows(value("2019-02-01")) != rows(value("1990-01-01"))


def test_cap_of_the_registered_queries_removes_rows(w):
    assert w.gmv_facts().where(F.col("transaction_amount_usd") > catalog.TEST_PARAMS["cap"]).count() > 0


def test_funnel_inputs_share_grains(w):
    a, b = catalog._stacked(w)
    inputs = a.count() + b.count()
    assert catalog.q_regrain(w).count() < inputs  # grains of both inputs meet
    assert a.count() < w.funnel_rollup_daily().count()
    labelled = enrich.label_unknown(a, w.country_dimension())
    assert 0 < labelled.where("country = 'Unknown country_name'").count() < labelled.count()
    assert w.outbound_list().where("last_30d_online_gmv > 0 and last_180d_online_gmv > 0").count() > 0


def test_union_drops_equal_rows(w):
    """Rows that both inputs hold (all measures zero) come once."""
    a, b = catalog._stacked(w)
    same = a.limit(50)
    assert rollup.union_measures(a, same).count() == a.distinct().count()
    assert rollup.union_measures(a, same, distinct=False).count() == a.count() + 50
