"""Hand-made fixtures for rules the synthetic tables cannot show."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlens.functions import dates as D
from merchlens.operators import campaign as camp
from merchlens.operators import cohort, enrich, rollup
from merchlens.plans import reports
from compare import SF_SMALL

TS = dt.datetime


def test_s1_cast_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(Decimal("1.50"),), (Decimal("-1.50"),), (Decimal("2.49"),), (Decimal("2.50"),)],
                               "x decimal(10,2)")
    got = [r[0] for r in df.select(D.round_half_away_to_long("x")).collect()]
    assert got == [2, -2, 2, 3]


def test_s2_month_boundaries(spark):
    df = spark.createDataFrame([(dt.date(2022, 1, 31), dt.date(2022, 2, 1)),
                                (dt.date(2022, 2, 1), dt.date(2022, 2, 28)),
                                (dt.date(2021, 12, 31), dt.date(2023, 1, 1))], "s date, e date")
    got = [r[0] for r in df.select(D.month_boundaries_between("s", "e")).collect()]
    assert got == [1, 0, 13]


def test_s3_time_of_day_difference(spark):
    df = spark.createDataFrame([(TS(2024, 1, 1, 23, 59, 50), TS(2024, 1, 2, 0, 0, 10)),
                                (TS(2024, 1, 1, 10, 0, 10, 900000), TS(2024, 1, 1, 10, 0, 12, 100000))],
                               "created timestamp_ntz, completed timestamp_ntz")
    got = [r[0] for r in df.select(D.time_of_day_diff_seconds("completed", "created")).collect()]
    assert got == [-86380, 2]


def test_trailing_year_clamps_feb_29(spark):
    daily = spark.createDataFrame([(1, dt.date(2023, 2, 28), Decimal("5.00")),
                                   (1, dt.date(2023, 3, 1), Decimal("7.00"))], "k int, date date, gmv decimal(18,2)")
    out = rollup.trailing_year_totals(daily, "k", "gmv", as_of="2024-02-29").collect()
    # as_of - 1 year = 2023-02-28 (clamped); strictly after it only Mar 1 counts.
    assert out[0]["annual_gmv"] == Decimal("7.00")


def test_period_flags(spark):
    df = spark.createDataFrame([(TS(2025, 6, 3),), (TS(2025, 5, 20),), (TS(2024, 4, 1),)], "event_date timestamp_ntz")
    flags = D.period_flags("event_date", dt.datetime(2025, 6, 15))
    rows = df.select(*[c.alias(n) for n, c in flags.items()]).collect()
    assert rows[0]["is_current_month"] and rows[0]["is_in_month_to_date_range"]
    assert not rows[1]["is_current_month"] and not rows[1]["is_in_month_to_date_range"]
    assert rows[1]["is_current_quarter"] and rows[1]["is_current_year"]
    assert rows[2]["is_in_quarter_to_date_range"] and not rows[2]["is_current_year"]


def test_semi_join_drops_null_keys_and_never_multiplies(spark):
    facts = spark.createDataFrame([(1, 10), (1, 11), (None, 12), (2, 13)], "k int, v int")
    cohort_df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    got = sorted(r["v"] for r in cohort.cohort_semi_join(facts, cohort_df, "k").collect())
    assert got == [10, 11]


def test_party_fallback_both_branches(spark):
    df = spark.createDataFrame([(None, 7, None, "dev shop"), (5, 7, "partner", "dev shop")],
                               "pid long, dev long, pname string, dname string")
    rows = enrich.party_fallback(df, "pid", "dev", "pname", "dname").collect()
    assert (rows[0]["is_api_developed_by_a_shop"], rows[0]["partner_shop_id"], rows[0]["partner_merchant_name"]) \
        == (True, 7, "dev shop")
    assert (rows[1]["is_api_developed_by_a_shop"], rows[1]["partner_shop_id"], rows[1]["partner_merchant_name"]) \
        == (False, 5, "partner")


def test_label_unknown(spark):
    df = spark.createDataFrame([("IN",), ("XX",), (None,)], "country_code string")
    names = spark.createDataFrame([("IN", "India")], "country_code string, country_name string")
    got = sorted(r["country"] for r in enrich.label_unknown(df, names).collect())
    assert got == ["India", "Unknown country_name", "Unknown country_name"]


def _crm(spark):
    campaigns = spark.createDataFrame(
        [("C1", "spring", TS(2022, 3, 1)), ("C2", "summer", TS(2021, 6, 1)), ("C3", "autumn", TS(2022, 9, 1))],
        "id string, name string, created_date timestamp_ntz")
    members = spark.createDataFrame(
        [("C1", "L1", "L1"), ("C1", "L2", "L2"), ("C1", "L3", "L3"), ("C1", None, "K9"), ("C1", "L4", "L4"),
         ("C3", "L1", "L1")],
        "campaign_id string, lead_id string, lead_or_contact_id string")
    leads = spark.createDataFrame(
        [("L1", "Qualified", "Acme", "acme.com"), ("L2", "Qualified", "Acme", None),
         ("L3", "Qualified", "Beta", "beta.platform.example"), ("L4", "Open", "Gamma", "gamma.com")],
        "id string, status string, company string, domain_name string")
    history = spark.createDataFrame(
        [("L1", TS(2022, 1, 1)), ("L1", TS(2022, 1, 2)), ("L2", TS(2022, 5, 1))],
        "lead_id string, created_at timestamp_ntz")
    return campaigns, members, leads, history


def test_members_mql_and_net_new(spark):
    campaigns, members, leads, history = _crm(spark)
    names = spark.createDataFrame([("spring",), ("summer",), ("autumn",)], "ad_campaign_name string")
    selected = camp.campaign_selector(campaigns, names, since="2022-01-01")
    rows = {r["campaign_id"]: r for r in camp.campaign_members_mql(selected, members, leads, history).collect()}
    assert set(rows) == {"C1", "C3"}          # C2 created before the since date
    c1 = rows["C1"]
    # L3 is excluded by its platform.example domain; the member without a lead (K9) is kept.
    assert c1["members"] == 4
    assert c1["MQL"] == 1                      # Acme (L1, L2)
    # Acme counts as net new because L2 has no history before Mar 1, although L1 has.
    assert c1["net_new_mql"] == 1
    assert rows["C3"]["net_new_mql"] == 0     # L1 has history before Sep 1


def test_net_new_history_equals_literal_left_join(spark):
    campaigns, members, leads, history = _crm(spark)
    a = campaigns.alias("a")
    literal = (a.join(members.alias("b"), F.col("a.id") == F.col("b.campaign_id"))
               .join(leads.alias("c"), F.col("b.lead_id") == F.col("c.id"), "left")
               .join(history.alias("e"), (F.col("c.id") == F.col("e.lead_id"))
                     & (F.col("e.created_at") < F.col("a.created_date")), "left")
               .groupBy("a.id")
               .agg(F.count_distinct(F.when((F.col("c.status") == "Qualified") & F.col("e.lead_id").isNull(),
                                            F.col("c.company"))).alias("n")))
    names = spark.createDataFrame([("spring",), ("summer",), ("autumn",)], "ad_campaign_name string")
    ours = camp.campaign_members_mql(camp.campaign_selector(campaigns, names, since="2000-01-01"),
                                     members, leads.withColumn("domain_name", F.lit(None).cast("string")), history)
    assert {r["id"]: r["n"] for r in literal.collect()} == \
        {r["campaign_id"]: r["net_new_mql"] for r in ours.collect()}


def test_stage_pivot_totals_add_up(spark):
    opps = spark.createDataFrame(
        [("C1", "Closed Won", Decimal("10.00")), ("C1", "Closed Lost", Decimal("3.00")),
         ("C1", "Negotiation", Decimal("4.00")), ("C1", "Disqualified", Decimal("5.00")),
         ("C1", "Closed Won", Decimal("1.00"))], "campaign_id string, stage_name string, amount decimal(18,2)")
    r = camp.stage_pivot(opps).collect()[0]
    assert (r["closed_won_amount"], r["closed_lost_amount"], r["in_progress_amount"]) == \
        (Decimal("11.00"), Decimal("3.00"), Decimal("4.00"))
    assert (r["closed_won_optys"], r["closed_lost_optys"], r["in_progress_optys"]) == (2, 1, 1)
    # won + lost + open + other stages = everything
    assert r["closed_won_optys"] + r["closed_lost_optys"] + r["in_progress_optys"] + 1 == 5


def test_s6_plan_joins_on_fact_month(spark):
    """A month with brokered GMV but no cash-on-delivery GMV shows nulls (as written)."""
    shops = spark.createDataFrame([(1, "IN")], "_shop_key long, shop_country_code string")
    gateways = spark.createDataFrame([(1, "cash_on_delivery")], "_payment_gateway_key long, payment_gateway_name string")
    gmv = spark.createDataFrame(
        [("o1", 1, 1, TS(2022, 3, 5), "1", Decimal("100.00"), "Included in Reported GMV")],
        "order_id string, _shop_key long, _payment_gateway_key long, reported_at timestamp_ntz, "
        "transaction_index string, transaction_amount_usd decimal(18,2), reported_gmv_inclusion_status string")
    fulfil = spark.createDataFrame([("o1",)], "order_id string")
    channel = spark.createDataFrame(
        [(1, dt.date(2022, 3, 1), Decimal("50.00"), True), (1, dt.date(2022, 4, 1), Decimal("70.00"), True)],
        "_shop_key long, month date, channel_gmv_usd decimal(18,2), is_platform_gmv boolean")
    daily = spark.createDataFrame([(1, dt.date(2022, 4, 2), Decimal("9.00"))],
                                  "_shop_key long, date date, total_off_platform_gmv_usd decimal(18,2)")
    dates = spark.createDataFrame([(dt.date(2022, 3, 1), "2022"), (dt.date(2022, 4, 1), "2022")],
                                  "date date, year string")
    plan = [("2022-03-01", 1, 1, 1, 1), ("2022-04-01", 2, 2, 2, 2)]
    out = reports.plan_vs_actual_monthly(spark, dates, fulfil, gmv, gateways, shops, channel, daily,
                                         plan_rows=plan, as_of="2023-01-01")
    rows = {r["reported_at"]: r for r in out.collect()}
    assert rows[dt.date(2022, 3, 1)]["brokered_gmv"] == Decimal("50.00")
    april = rows[dt.date(2022, 4, 1)]
    assert april["date_calculated"] is None and april["brokered_gmv"] is None \
        and april["total_off_platform_gmv_usd"] is None


def test_union_without_distinct_regrains_equal(spark):
    schema = "k string, a decimal(38,7), b decimal(38,7)"
    x = spark.createDataFrame([("p", Decimal(0), Decimal(0)), ("q", Decimal(2), Decimal(0))], schema)
    y = spark.createDataFrame([("p", Decimal(0), Decimal(0)), ("q", Decimal(0), Decimal(3))], schema)
    with_distinct = rollup.regrain(rollup.union_measures(x, y, distinct=True), ["k"], ["a", "b"])
    without = rollup.regrain(rollup.union_measures(x, y, distinct=False), ["k"], ["a", "b"])
    assert sorted(map(tuple, with_distinct.collect())) == sorted(map(tuple, without.collect()))


def test_campaign_names_shortcut_equals_mart(spark):
    from merchlens.operators import funnel
    from merchlens.sources.warehouse import Warehouse
    w = Warehouse(spark, SF_SMALL)
    inputs = dict(opps=w.opportunity_dim(), attribution=w.attribution_facts(), touchpoints=w.touchpoints(),
                  channels=w.marketing_channels(), rollup=w.funnel_rollup_daily(), sources=w.sources())
    mart = funnel.kpi_mart(**inputs, countries=w.country_dimension(), as_of="2025-06-15")
    for region in ("APAC", "EMEA"):
        full = {r[0] for r in mart.filter(F.col("sales_region") == region)
                .select("ad_campaign_name").distinct().collect()}
        short = {r[0] for r in funnel.kpi_campaign_names(**inputs, sales_region=region).collect()}
        assert full == short and full


def test_outbound_preaggregation_equals_pairs(spark):
    """Q10: summing per-shop window totals equals summing the fact x snapshot pairs."""
    from merchlens.sources.warehouse import Warehouse
    w = Warehouse(spark, "/root/testdata/sf0.01")
    as_of = dt.date(2025, 6, 15)
    ours = reports.partner_outbound_list(w.state_facts(), w.merchants(), w.region_map(), w.partners(),
                                         w.shops(), w.shop_state_daily(), w.outbound_list(), as_of=as_of,
                                         min_gmv=0)
    f = w.state_facts().alias("f")
    md = w.merchants().alias("md")
    ssd = w.shop_state_daily().alias("ssd")
    pairs = (f.join(md, "_merchant_key")
             .join(ssd, (F.col("md.current_merchant_primary_shop_id") == F.col("ssd.shop_id"))
                   & (D.days_between("ssd.datetime", as_of) <= 365))
             .groupBy("merchant_id", F.col("transition_at").alias("Transition_Date"))
             .agg(D.round_half_away_to_long(F.sum("daily_gmv_usd")).alias("g")))
    expected = {(r["merchant_id"], r["Transition_Date"]): r["g"] for r in pairs.collect()}
    got = {(r["merchant_id"], r["Transition_Date"]): r["GMV_L12M"] for r in ours.collect()}
    assert got and all(expected[k] == v for k, v in got.items())


def test_app_install_shops_keeps_zero_net(spark):
    installs = spark.createDataFrame([(1, "7", 1), (1, "7", -1), (2, "7", 1), (3, "8", 1)],
                                     "shop_id long, api_client_id string, net_install_count long")
    got = {r["shop_id"]: r["install_count"] for r in cohort.app_install_shops(installs, "7").collect()}
    assert got == {1: 0, 2: 1}


def test_order_rollup_after_year(spark):
    gmv = spark.createDataFrame([("o1", 3, TS(2021, 12, 31, 23), Decimal("1.00")),
                                 ("o1", 2, TS(2022, 1, 1), Decimal("2.00")),
                                 ("o1", 5, TS(2022, 6, 1), Decimal("-0.50"))],
                                "order_id string, _payment_gateway_key long, reported_at timestamp_ntz, "
                                "gmv_adjustment_usd decimal(18,2)")
    r = rollup.order_rollup(gmv, after_year=2021).collect()[0]
    assert (r["payment_gateway_key"], r["order_gmv"]) == (2, Decimal("1.50"))


def test_schema_types_are_stable(spark):
    from merchlens.plans.catalog import QUERIES
    df = QUERIES["plan_vs_actual_monthly"](spark, SF_SMALL)
    types = dict(df.dtypes)
    assert types["reported_at"] == "date" and types["brokered_projection"] == "bigint"
    assert types["transaction_amount_usd"].startswith("decimal(")
    assert isinstance(df.schema["date_calculated"].dataType, T.DateType)


def test_s4_counts_non_null_and_repeated_region_rows_multiply(spark):
    merchants = spark.createDataFrame(
        [(1, "IN", "India", "APAC", True, True, "1: <5K", dt.date(2024, 1, 31), None),
         (2, "IN", "India", "APAC", True, True, "1: <5K", dt.date(2024, 1, 31), 3)],
        "_merchant_key long, country_code string, country_name string, geographic_region_code string, "
        "is_active boolean, is_included_in_historical_reporting boolean, latest_annualized_gmv_band string, "
        "first_contract_start_date date, current_shop_count long")
    region_map = spark.createDataFrame([("IN", "South Asia"), ("IN", "South Asia")],
                                       "country_code string, commercial_subregion_code string")
    daily = spark.createDataFrame([(1, dt.date(2025, 1, 1), Decimal("10.00"))],
                                  "_merchant_key long, date date, gmv decimal(18,2)")
    rows = {r["_merchant_key"]: r for r in reports.merchant_age_band_summary(
        merchants, region_map, daily, as_of="2025-06-15").collect()}
    assert rows[1]["merchant_count"] == 2 and rows[1]["shop_count"] == 0      # repeated map row, null count
    assert rows[2]["merchant_count"] == 2 and rows[2]["shop_count"] == 2
    assert rows[1]["platform_gmv"] == Decimal("20.00")                        # multiplied as written
    assert rows[1]["age_in_months"] == 17


def test_s10_duplicate_output_columns_emitted_once(spark):
    from merchlens.plans.catalog import QUERIES
    for name in ("vendor_line_items", "campaign_leads_extract"):
        cols = QUERIES[name](spark, SF_SMALL).columns
        assert len(cols) == len(set(cols)), name


def test_s12_annualized_is_a_plain_sum(spark):
    daily = spark.createDataFrame([(1, dt.date(2022, 3, 29), 5), (1, dt.date(2022, 3, 30), 7),
                                   (1, dt.date(2023, 1, 1), 11)], "shop_id long, date date, n long")
    out = rollup.shop_totals_since(daily, "shop_id", {"n_annualized": "n"},
                                   F.col("date") > D.lit_date("2022-03-29")).collect()
    assert out[0]["n_annualized"] == 18


def test_s13_snapshot_window_has_no_lower_bound_on_future_rows(spark):
    """Q10 counts snapshots dated after the reporting date (only an upper bound on age)."""
    as_of = dt.date(2025, 6, 15)
    facts = spark.createDataFrame([(1, 1, TS(2020, 1, 1), 1, 0)],
                                  "_merchant_key long, _commercial_region_mapping_key long, "
                                  "transition_at timestamp_ntz, activation_count int, plus_upgrade_count int")
    merchants = spark.createDataFrame(
        [(1, 100, "M", "Japan", 7, 10, "Development Shop Referral", "Standard", "Active")],
        "_merchant_key long, merchant_id long, merchant_name string, merchant_country_name string, "
        "currently_associated_platform_partner_id long, current_merchant_primary_shop_id long, "
        "currently_associated_referral_type string, merchant_type string, current_merchant_active_status string")
    region_map = spark.createDataFrame([(1, "APAC")], "_commercial_region_mapping_key long, commercial_region_code string")
    partners = spark.createDataFrame([(7, "P", "Japan", "PM", "APAC", "JP")],
                                     "platform_partner_id long, partner_name string, partner_country_name string, "
                                     "current_partner_manager string, current_commercial_region_code string, "
                                     "partner_country string")
    shops = spark.createDataFrame([(10, True, "Is Using Platform Payments")],
                                  "shop_id long, eligible_for_platform_payments boolean, using_platform_payments string")
    snap = spark.createDataFrame(
        [(10, TS(2024, 1, 1), Decimal("40000.00"), Decimal("1.00")),      # older than 365 days: out
         (10, TS(2025, 1, 1), Decimal("30000.00"), Decimal("1.00")),      # inside the window
         (10, TS(2027, 1, 1), Decimal("25000.50"), Decimal("1.00"))],     # future: counted (S13)
        "shop_id long, datetime timestamp_ntz, daily_gmv_usd decimal(18,2), "
        "daily_gross_platform_payments_revenue_amount_usd decimal(18,2)")
    outbound = spark.createDataFrame([(100, 2)], "merchant_id long, collaborators long").select(
        "merchant_id", "collaborators", *[F.lit(None).cast("string").alias(c) for c in (
            "became_customer_at", "first_sale_at", "current_plan_name", "shop_internal_dashboard_url",
            "shop_permanent_domain", "primary_industry", "apps_score", "top_apps_installed",
            "last_30d_online_gmv", "last_90d_online_gmv", "last_180d_online_gmv")])
    out = reports.partner_outbound_list(facts, merchants, region_map, partners, shops, snap, outbound,
                                        as_of=as_of).collect()
    assert len(out) == 1
    assert out[0]["GMV_L12M"] == 55001          # 55,000.50 rounds half away from zero (S1)
    assert out[0]["Payments_Revenue_L12M"] == 2


def test_q01_both_fallback_branches_occur(spark):
    from merchlens.plans.catalog import QUERIES
    flags = {r[0] for r in QUERIES["regional_app_gmv_monthly"](spark, "/root/testdata/sf0.01")
             .select("is_api_developed_by_a_shop").distinct().collect()}
    assert flags == {True, False}
