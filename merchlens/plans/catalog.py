"""Registered queries: each report and stage wired to the source adapter.

Every entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables in ``sf_dir``. Parameters are the reference's own values
except those of ``TEST_PARAMS``, which have no counterpart in the test data.
Fact methods of the adapter also get the parameters' dates, so that they bound
the scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import datetime as dt

from ..functions.dates import (complete_months, lit_date, month_boundaries_between,
                               month_start, period_flags)
from ..operators import campaign as camp
from ..operators import cohort, enrich, funnel, rollup
from ..sources.constants import DEFAULT_AS_OF
from ..sources.warehouse import Warehouse
from . import reports

# FIXED VALUES: parameters for which the reference's literal has no
# counterpart in the test tables.
TEST_PARAMS = {
    "vendor": "Brand#17",       # a p_brand value (reference: a product vendor name)
    "api_client_id": "7",       # a supplier key as app id (reference: a numeric app id)
    "min_annual_gmv": 400_000,   # reference: 1,000,000; test shops sell less per year
    "cap": 90_000,               # reference: 1,000,000; the test amounts end at 104,997.88
    "plan": "plus",              # a plan name of the adapter; the reference has its own
    "payments": "Is Using Platform Payments",  # likewise, a payments label
    "domain_suffix": "platform.example",       # likewise, the suffix of domains to leave out
}

# Dates of the reports' parameters, as bounds for the adapter's scans.
APP_SINCE, PLAN_SINCE, TRACKER_SINCE = dt.date(2021, 1, 1), dt.date(2022, 1, 1), dt.date(2022, 3, 30)
PLAN_YEARS = dict(since=dt.date(2022, 1, 1), until=dt.date(2023, 12, 31))
YEAR_2022 = dict(since=dt.date(2022, 1, 1), until=dt.date(2022, 12, 31))
MART_SINCE, VALUE_SINCE = dt.date(2019, 7, 1), dt.date(2019, 2, 1)
COMPLETE = DEFAULT_AS_OF.replace(day=1) - dt.timedelta(days=1)  # last day of the last complete month
LAST_YEAR = DEFAULT_AS_OF - dt.timedelta(days=366)


def _mart_inputs(w: Warehouse) -> dict:
    """Inputs of the mart and its name set: events before ``MART_SINCE`` are in neither."""
    return dict(opps=w.opportunity_dim(MART_SINCE), attribution=w.attribution_facts(), touchpoints=w.touchpoints(),
                channels=w.marketing_channels(), rollup=w.funnel_rollup_daily(MART_SINCE), sources=w.sources())


def _kpi_names(w: Warehouse) -> DataFrame:
    return funnel.kpi_campaign_names(**_mart_inputs(w), sales_region="APAC")


# ------------------------------------------------------------------------- reports
def q_regional_app_gmv_monthly(w: Warehouse):
    return reports.regional_app_gmv_monthly(w.app_gmv_daily(since=APP_SINCE), w.shops(), w.merchants(),
                                            w.api_clients(), w.partners())


def q_plan_vs_actual_monthly(w: Warehouse):
    return reports.plan_vs_actual_monthly(w.spark, w.calendar(**PLAN_YEARS), w.fulfillments(), w.gmv_facts(PLAN_SINCE, COMPLETE),
                                          w.gateways(), w.shops(), w.channel_gmv_daily(**PLAN_YEARS),
                                          w.app_gmv_daily(PLAN_SINCE, COMPLETE), cap=TEST_PARAMS["cap"])


def q_merchant_tracker(w: Warehouse):
    return reports.merchant_tracker(w.shop_merchant_lookup(), w.merchants(), w.shops(),
                                    w.checkout_daily(TRACKER_SINCE), w.app_gmv_daily(TRACKER_SINCE),
                                    w.shop_daily_gmv(TRACKER_SINCE), w.migration())


def q_campaign_scorecard(w: Warehouse):
    return reports.campaign_scorecard(w.campaigns(), w.campaign_members(), w.leads(), w.leads_history(),
                                      w.opportunities(), kpi_names=_kpi_names(w), domain_suffix=TEST_PARAMS["domain_suffix"])


def q_campaign_leads_extract(w: Warehouse):
    return reports.campaign_leads_extract(w.campaigns(), w.campaign_members(), w.leads(), w.leads_history(),
                                          w.opportunities(), kpi_names=_kpi_names(w), domain_suffix=TEST_PARAMS["domain_suffix"])


def q_checkout_duration_by_event(w: Warehouse):
    return reports.checkout_duration_by_event(w.checkout_events(), w.checkout_facts())


def q_merchant_age_band_summary(w: Warehouse):
    return reports.merchant_age_band_summary(w.merchants(), w.region_map(), w.merchant_daily(LAST_YEAR))


def q_regional_merchant_list(w: Warehouse):
    return reports.regional_merchant_list(w.shops(), w.channel_gmv_daily(PLAN_SINCE), w.gmv_facts(PLAN_SINCE))


def q_account_upgrade_targets(w: Warehouse):
    return reports.account_upgrade_targets(w.channel_gmv_monthly(**YEAR_2022), w.shops(), w.account_lookup(), w.accounts(),
                                           min_gmv=TEST_PARAMS["min_annual_gmv"], plan=TEST_PARAMS["plan"],
                                           payments=TEST_PARAMS["payments"])


def q_partner_outbound_list(w: Warehouse):
    return reports.partner_outbound_list(w.state_facts(), w.merchants(), w.region_map(), w.partners(),
                                         w.shops(), w.shop_state_daily(LAST_YEAR), w.outbound_list())


def q_churn_risk_list(w: Warehouse):
    return reports.churn_risk_list(w.merchants(), w.shops())


def q_vendor_line_items(w: Warehouse):
    return reports.vendor_line_items(w.line_items(), w.gmv_facts(PLAN_SINCE), w.products(), w.installs(), w.gateways(),
                                     vendor=TEST_PARAMS["vendor"], api_client_id=TEST_PARAMS["api_client_id"])


# -------------------------------------------------------------------------- stages
def q_kpi_mart(w: Warehouse):
    return funnel.kpi_mart(**_mart_inputs(w), countries=w.country_dimension(), as_of=DEFAULT_AS_OF)


def q_kpi_campaign_names(w: Warehouse):
    return _kpi_names(w)


def q_attributed_value_split(w: Warehouse):
    return funnel.attributed_value_split(w.opportunity_dim(VALUE_SINCE), w.attribution_facts(), w.touchpoints(),
                                         w.marketing_channels())


def q_funnel_rollup(w: Warehouse):
    return rollup.funnel_rollup(w.funnel_rollup_daily(), w.sources(), w.touchpoints(), w.marketing_channels())


def q_gateway_gmv_monthly(w: Warehouse):
    return rollup.gateway_gmv_monthly(w.gmv_facts(PLAN_SINCE, COMPLETE), w.gateways(), w.shops(), w.fulfillments(),
                                      country_codes=["IN"], gateway_names=reports.COD_GATEWAY_NAMES,
                                      since="2021-12-31", as_of=DEFAULT_AS_OF, cap=TEST_PARAMS["cap"])


def q_channel_gmv_monthly(w: Warehouse):
    return rollup.channel_gmv_monthly(w.channel_gmv_daily(**PLAN_YEARS), w.shops(), country_code="IN",
                                      years=[2022, 2023], as_of=DEFAULT_AS_OF)


def q_app_gmv_monthly(w: Warehouse):
    return rollup.app_gmv_monthly(w.app_gmv_daily(PLAN_SINCE, COMPLETE), w.shops(), country_codes=["IN"],
                                  since="2021-12-31", as_of=DEFAULT_AS_OF)


def q_month_spine(w: Warehouse):
    return rollup.month_spine(w.calendar(**PLAN_YEARS), ["2022", "2023"])


def q_fulfilled_orders(w: Warehouse):
    return cohort.fulfilled_orders(w.fulfillments())


def q_app_install_shops(w: Warehouse):
    return cohort.app_install_shops(w.installs(), TEST_PARAMS["api_client_id"])


def q_order_rollup(w: Warehouse):
    return rollup.order_rollup(w.gmv_facts(PLAN_SINCE), after_year=2021)


def q_trailing_year_totals(w: Warehouse):
    return rollup.trailing_year_totals(w.merchant_daily(LAST_YEAR), "_merchant_key", "gmv",
                                       as_of=DEFAULT_AS_OF)


def q_shop_totals_since(w: Warehouse):
    return rollup.shop_totals_since(w.shop_daily_gmv(TRACKER_SINCE), "shop_id",
                                    {"platform_gmv_annualized": "daily_gmv_amount_usd"},
                                    F.col("date") > lit_date("2022-03-29"))


def q_stage_pivot(w: Warehouse):
    return camp.stage_pivot(w.opportunities())


def q_campaign_members_mql(w: Warehouse):
    selected = camp.campaign_selector(w.campaigns(), _kpi_names(w))
    return camp.campaign_members_mql(selected, w.campaign_members(), w.leads(), w.leads_history(),
                                     domain_suffix=TEST_PARAMS["domain_suffix"])


def q_activity_semi_join(w: Warehouse):
    return cohort.activity_semi_join(w.shops().select("_shop_key", "shop_id", "shop_country_code"),
                                     w.gmv_facts(PLAN_SINCE), "_shop_key",
                                     F.col("reported_at") >= F.lit("2022-01-01").cast("timestamp_ntz"))


def q_cohort_semi_join(w: Warehouse):
    """(merchant, shop) pairs of the active merchants of India (two-hop cohort)."""
    active = w.merchants().filter((F.col("country_code") == "IN") & F.col("is_active")).select("_merchant_key")
    return cohort.cohort_semi_join(w.shop_merchant_lookup(), active, "_merchant_key").distinct()


def q_star_enrich(w: Warehouse):
    """Every shop-merchant pair with shop, merchant and migration attributes."""
    return enrich.star_enrich(w.shop_merchant_lookup(), [
        (w.shops(), "shop_id", ["shop_name", "shop_country_code", "current_plan_name"]),
        (w.merchants(), "_merchant_key", ["merchant_name", "current_msm_name"]),
        (w.migration(), "shop_id", ["is_on_c1", "migration_experience_type"]),
    ])


def q_party_fallback(w: Warehouse):
    """Each app's partner, or its developer shop's merchant when it has no partner."""
    apps = w.api_clients().select("api_client_id", "partner_id", "application_developer_shop_id")
    partners = w.partners().select(F.col("platform_partner_id").alias("partner_id"), "platform_partner_id",
                                   "partner_name")
    dev = w.shops().select(F.col("shop_id").alias("application_developer_shop_id"),
                           F.col("current_merchant_name").alias("developer_merchant_name"))
    out = apps.join(partners, "partner_id", "left").join(dev, "application_developer_shop_id", "left")
    return enrich.party_fallback(out, "platform_partner_id", "application_developer_shop_id", "partner_name",
                                 "developer_merchant_name").select(
        "api_client_id", "is_api_developed_by_a_shop", "partner_shop_id", "partner_merchant_name")


def _stacked(w: Warehouse) -> DataFrame:
    funnel_part = rollup.funnel_rollup(w.funnel_rollup_daily(), w.sources(), w.touchpoints(), w.marketing_channels())
    value_part = funnel.attributed_value_split(w.opportunity_dim(VALUE_SINCE), w.attribution_facts(), w.touchpoints(),
                                              w.marketing_channels())
    return funnel_part, value_part


def q_union_measures(w: Warehouse):
    """Funnel and value rows stacked with SQL UNION (distinct)."""
    a, b = _stacked(w)
    return rollup.union_measures(a, b, distinct=True)


def q_label_unknown(w: Warehouse):
    """The stacked funnel rows with the full country name (or the unknown label)."""
    a, b = _stacked(w)
    return enrich.label_unknown(rollup.union_measures(a, b, distinct=False), w.country_dimension())


def q_net_new_history(w: Warehouse):
    """Every lead with the time of its earliest history row."""
    return camp.net_new_history(w.leads().select("id", "status", "company"), w.leads_history())


def q_campaign_selector(w: Warehouse):
    """Campaigns created since 2022 whose name occurs in the APAC funnel mart."""
    return camp.campaign_selector(w.campaigns(), _kpi_names(w))


def q_threshold_after_agg(w: Warehouse):
    """Shops whose 2022 on-platform channel GMV exceeds the threshold."""
    facts = w.channel_gmv_monthly(**YEAR_2022).filter(F.col("is_platform_gmv") & rollup.year_in(F.col("month_begin_date"), [2022]))
    totals = rollup.shop_totals_since(facts, "shop_id", {"sum_gmv": "channel_gmv_usd"})
    return rollup.threshold_after_agg(totals, "sum_gmv", TEST_PARAMS["min_annual_gmv"])


def q_calendar_age_filter(w: Warehouse):
    """State transitions at least 180 days before the reporting date."""
    return w.state_facts().filter(reports.transitions_of_age(DEFAULT_AS_OF, 180))


def q_age_in_months(w: Warehouse):
    """Every merchant's age in calendar months at the reporting date."""
    m = w.merchants()
    return m.select("merchant_id", "first_contract_start_date",
                    month_boundaries_between("first_contract_start_date", DEFAULT_AS_OF).alias("age_in_months"))


def q_regrain(w: Warehouse):
    """The labelled funnel and value rows summed to the 21 mart dimensions."""
    a, b = _stacked(w)
    labelled = enrich.label_unknown(rollup.union_measures(a, b, distinct=False), w.country_dimension())
    dims = rollup.FUNNEL_DIMS[:6] + ["country"] + rollup.FUNNEL_DIMS[6:]
    return rollup.regrain(labelled, dims, rollup.ALL_MEASURES)


def q_non_conversion_columns(w: Warehouse):
    """The funnel rollup with its ten stage-difference columns."""
    return funnel.non_conversion_columns(
        rollup.funnel_rollup(w.funnel_rollup_daily(), w.sources(), w.touchpoints(), w.marketing_channels()))


def q_period_flags(w: Warehouse):
    """month/quarter/year-to-date flags of every funnel event day."""
    days = w.funnel_rollup_daily().select(F.col("date").cast("timestamp_ntz").alias("event_date")).distinct()
    return days.withColumns(period_flags("event_date", dt.datetime.combine(DEFAULT_AS_OF, dt.time())))


def q_complete_months(w: Warehouse):
    """Channel GMV per month, complete months before the reporting month only."""
    facts = w.channel_gmv_daily(until=COMPLETE).filter(complete_months("month", DEFAULT_AS_OF))
    return facts.groupBy(month_start("month").alias("reported_date")).agg(
        rollup.sum_like(facts, "channel_gmv_usd").alias("channel_gmv_usd"))


BUILDERS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "regional_app_gmv_monthly": q_regional_app_gmv_monthly,
    "plan_vs_actual_monthly": q_plan_vs_actual_monthly,
    "merchant_tracker": q_merchant_tracker,
    "campaign_scorecard": q_campaign_scorecard,
    "campaign_leads_extract": q_campaign_leads_extract,
    "checkout_duration_by_event": q_checkout_duration_by_event,
    "merchant_age_band_summary": q_merchant_age_band_summary,
    "regional_merchant_list": q_regional_merchant_list,
    "account_upgrade_targets": q_account_upgrade_targets,
    "partner_outbound_list": q_partner_outbound_list,
    "churn_risk_list": q_churn_risk_list,
    "vendor_line_items": q_vendor_line_items,
    "kpi_mart": q_kpi_mart,
    "kpi_campaign_names": q_kpi_campaign_names,
    "attributed_value_split": q_attributed_value_split,
    "funnel_rollup": q_funnel_rollup,
    "gateway_gmv_monthly": q_gateway_gmv_monthly,
    "channel_gmv_monthly": q_channel_gmv_monthly,
    "app_gmv_monthly": q_app_gmv_monthly,
    "month_spine": q_month_spine,
    "fulfilled_orders": q_fulfilled_orders,
    "app_install_shops": q_app_install_shops,
    "order_rollup": q_order_rollup,
    "trailing_year_totals": q_trailing_year_totals,
    "shop_totals_since": q_shop_totals_since,
    "stage_pivot": q_stage_pivot,
    "campaign_members_mql": q_campaign_members_mql,
    "activity_semi_join": q_activity_semi_join,
    "cohort_semi_join": q_cohort_semi_join,
    "star_enrich": q_star_enrich,
    "party_fallback": q_party_fallback,
    "union_measures": q_union_measures,
    "label_unknown": q_label_unknown,
    "net_new_history": q_net_new_history,
    "campaign_selector": q_campaign_selector,
    "threshold_after_agg": q_threshold_after_agg,
    "calendar_age_filter": q_calendar_age_filter,
    "age_in_months": q_age_in_months,
    "regrain": q_regrain,
    "non_conversion_columns": q_non_conversion_columns,
    "period_flags": q_period_flags,
    "complete_months": q_complete_months,
}


def _runner(build: Callable[[Warehouse], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Warehouse(spark, sf_dir))
    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    return run


# The driver contract: (spark, sf_dir) -> DataFrame over the whole tables in sf_dir.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _runner(b) for n, b in BUILDERS.items()}
