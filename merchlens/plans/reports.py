"""End-to-end reports (Q01-Q12): warehouse DataFrames in, one DataFrame out.

Each report is the composition of the stage operators with the reference's
semantics; countries, dates, thresholds and the reporting date ``as_of``
are parameters. Dimension keys (``_shop_key``, ``shop_id``, ``merchant_id``,
...) are assumed unique in their dimension, as warehouse dimensions are;
under that assumption a left join to a dimension never multiplies rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import (lit_date, lit_ts, month_boundaries_between, month_start,
                               round_half_away_to_long, time_of_day_diff_seconds)
from ..operators.campaign import campaign_members_mql, campaign_selector, stage_pivot
from ..operators.cohort import activity_semi_join, app_install_shops, cohort_semi_join
from ..operators.enrich import display_projection, party_fallback, star_enrich
from ..operators.rollup import (app_gmv_monthly, channel_gmv_monthly, gateway_gmv_monthly,
                                month_spine, order_rollup, plan_table, shop_totals_since,
                                threshold_after_agg, trailing_year_totals, year_in)
from ..sources.constants import (APAC_APP_COUNTRIES, COD_GATEWAY_NAMES, DEFAULT_AS_OF,
                                 GREATER_CHINA_COUNTRIES, PLAN_FACT_YEARS, PLAN_ROWS, PLAN_YEARS)


def _d(value: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def _day_after_ts(since: str | dt.date):
    """``DATE(ts) > since`` as ``ts >= since + 1 day`` (pushable to the scan)."""
    return lit_ts(dt.datetime.combine(_d(since) + dt.timedelta(days=1), dt.time()))


def transitions_of_age(as_of: dt.date, min_age_days: int, col: str = "transition_at"):
    """At least ``min_age_days`` days before ``as_of``, as a comparison of the column with a literal."""
    return F.col(col) < lit_ts(dt.datetime.combine(as_of - dt.timedelta(days=min_age_days - 1), dt.time()))


# ----------------------------------------------------------------------------- Q01
Q01_COLUMNS = [
    "api_client_id", "app_name", "app_type", "name", "channel_provider_name",
    "current_funnel_state", "current_merchant_active_status", "current_merchant_deal_type",
    "current_merchant_success_manager", "current_mrr_band_ranked_range", "month",
    "partner_company_name", "platform_partner_id", "partner_url", "shop_id", "shop_name",
    "shop_permanent_domain", "shop_storefront_url", "handle", "app_handle", "shop_country_code",
    "is_api_developed_by_a_shop", "partner_shop_id", "partner_merchant_name",
]
Q01_MEASURES = ["total_platform_gmv_usd", "total_off_platform_gmv_usd", "total_gmv_usd"]


def regional_app_gmv_monthly(daily_gmv: DataFrame, shops: DataFrame, merchants: DataFrame,
                             api_clients: DataFrame, partners: DataFrame, *,
                             countries: Sequence[str] = tuple(APAC_APP_COUNTRIES),
                             since: str | dt.date = "2020-12-31") -> DataFrame:
    """Q01: GMV per app x shop x month for shops of ``countries``, with merchant,
    app and partner attributes and the partner-or-developer-shop fallback.

    Plan: filter the daily facts by date, keep the cohort's shops and
    aggregate to (shop, app, month): semi join and aggregation share one
    exchange on the shop key. The attribute joins then see one row per group
    instead of one per day; a final sum to the 24 report columns keeps the
    result exact even if two keys share all attributes.
    """
    shop_cols = ["current_funnel_state", "current_merchant_active_status", "current_merchant_deal_type",
                 "current_mrr_band_ranked_range", "shop_id", "shop_name", "shop_permanent_domain",
                 "shop_storefront_url", "shop_country_code", "current_merchant_id"]
    cohort = shops.filter(F.col("shop_country_code").isin(list(countries)))
    facts = daily_gmv.filter(F.col("date") > lit_date(since))
    facts = cohort_semi_join(facts, cohort.select("_shop_key"), "_shop_key")
    monthly = (facts.groupBy("_shop_key", "_api_client_key", "api_client_id", month_start("date").alias("month"))
           .agg(*[F.sum(m).alias(m) for m in Q01_MEASURES]))
    enriched = monthly.join(cohort.select("_shop_key", *shop_cols), "_shop_key")
    enriched = star_enrich(enriched, [
        (api_clients, "_api_client_key", ["app_name", "app_type", "name", "channel_provider_name",
                                          "handle", "app_handle", "partner_id",
                                          "application_developer_shop_id"]),
    ])
    managers = merchants.select(F.col("merchant_id").alias("current_merchant_id"),
                           "current_merchant_success_manager")
    partner = partners.select(F.col("platform_partner_id").cast("string").alias("_partner_key"),
                              F.col("platform_partner_id"), "partner_company_name", "partner_url",
                              "partner_name")
    developers = shops.select(F.col("shop_id").alias("application_developer_shop_id"),
                          F.col("current_merchant_name").alias("developer_merchant_name"))
    # Apps without a partner match nothing; keys of their own keep them out of one partition.
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("api_client_id", "_shop_key"), F.lit(4096)).cast("string"))
    enriched = enriched.withColumn("_partner_key", F.coalesce(F.col("partner_id").cast("string"), spread))
    enriched = (enriched.join(partner, "_partner_key", "left").join(managers, "current_merchant_id", "left")
                .join(developers, "application_developer_shop_id", "left"))
    enriched = party_fallback(enriched, "platform_partner_id", "application_developer_shop_id",
                              "partner_name", "developer_merchant_name")
    return (enriched.groupBy(*Q01_COLUMNS)
            .agg(*[F.sum(m).alias(m) for m in Q01_MEASURES]))


# ----------------------------------------------------------------------------- Q02
def plan_vs_actual_monthly(spark: SparkSession, dates: DataFrame, fulfillments: DataFrame, gmv: DataFrame,
                           gateways: DataFrame, shops: DataFrame, channel_gmv: DataFrame,
                           daily_gmv: DataFrame, *, plan_rows=PLAN_ROWS, country: str = "IN",
                           years: Sequence[str] = tuple(PLAN_YEARS),
                           fact_years: Sequence[int] = tuple(PLAN_FACT_YEARS),
                           since: str | dt.date = "2021-12-31", cap: int = 1_000_000,
                           gateway_names: Sequence[str] = tuple(COD_GATEWAY_NAMES),
                           as_of: str | dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Q02: monthly plan rows left-joined to the month spine and three actuals.

    As written in the reference (S6), the plan joins on the *fact* month
    ``reported_date`` of the cash-on-delivery GMV, not on the spine month, so
    a month without such GMV shows nulls for all actuals. All inputs of the
    final joins are at most one row per month; the plan is 25 literal rows.
    """
    plan = plan_table(spark, plan_rows)
    spine = month_spine(dates, years)
    cod = gateway_gmv_monthly(gmv, gateways, shops, fulfillments, country_codes=[country],
                              gateway_names=gateway_names, since=since, as_of=as_of, cap=cap)
    brokered = channel_gmv_monthly(channel_gmv, shops, country_code=country, years=fact_years, as_of=as_of)
    hijacked = app_gmv_monthly(daily_gmv, shops, country_codes=[country], since=since, as_of=as_of)
    # Every frame below holds at most one row per calendar month of a bounded
    # period (the plan years, or since..as_of), so broadcasting them is safe
    # whatever the size of the facts they were aggregated from.
    actuals = (cod.join(F.broadcast(brokered), "reported_date", "left")
               .join(F.broadcast(hijacked), "reported_date", "left"))
    months = spine.join(F.broadcast(actuals), spine["date_calculated"] == actuals["reported_date"], "left")
    return plan.join(F.broadcast(months), plan["reported_at"] == months["reported_date"], "left")


# ----------------------------------------------------------------------------- Q03
def merchant_tracker(lookup: DataFrame, merchants: DataFrame, shops: DataFrame, checkout_daily: DataFrame,
                     hijack_daily: DataFrame, gmv_daily: DataFrame, migration: DataFrame, *,
                     country: str = "IN", since: str | dt.date = "2022-03-29") -> DataFrame:
    """Q03: one row per (merchant, shop) of the active merchants of a country,
    with shop and merchant attributes and three per-shop totals since a date.

    The cohort (shops of active merchants of the country) is built once and
    pushed into each fact before its aggregation, so only cohort rows are
    shuffled; all per-shop frames are keyed by ``shop_id`` and joined to the
    cohort. Ordered by merchant key.
    """
    active = merchants.filter((F.col("country_code") == country) & F.col("is_active"))
    pairs = cohort_semi_join(lookup.select("_merchant_key", "shop_id"), active.select("_merchant_key"),
                          "_merchant_key").distinct()
    cohort_shops = pairs.select("shop_id")
    after = F.col("date") > lit_date(since)
    shop_names = shops.select("shop_id", "shop_name", "shop_domain", "currently_associated_platform_partner_id",
                      "currently_associated_partner_name")  # the join from the cohort restricts it
    merchant_names = active.select("_merchant_key", "merchant_name", "current_msm_name")
    checkouts = shop_totals_since(checkout_daily, "shop_id", {
        "checkout_one_checkouts_annualized": "checkout_one_checkouts",
        "checkout_classic_checkouts_annualized": "checkout_classic_checkouts",
        "checkout_one_gmv_annualized": "checkout_one_gmv",
        "checkout_classic_gmv_annualized": "checkout_classic_gmv",
    }, after, cohort_shops)
    off_platform = shop_totals_since(hijack_daily, "shop_id", {"hijack_gmv_annualized": "total_off_platform_gmv_usd"},
                           after, cohort_shops)
    platform = shop_totals_since(gmv_daily, "shop_id", {"platform_gmv_annualized": "daily_gmv_amount_usd"},
                           after, cohort_shops)
    migrated = migration.select("shop_id", "is_on_c1", "migration_experience_type")
    out = (pairs.join(shop_names, "shop_id", "left").join(merchant_names, "_merchant_key", "left")
           .join(checkouts, "shop_id", "left").join(off_platform, "shop_id", "left").join(platform, "shop_id", "left")
           .join(migrated, "shop_id", "left"))
    return out.select(
        "_merchant_key", "shop_id", "shop_name", "shop_domain", "currently_associated_platform_partner_id",
        "currently_associated_partner_name", "merchant_name", "current_msm_name",
        "checkout_one_checkouts_annualized", "checkout_classic_checkouts_annualized",
        "checkout_one_gmv_annualized", "checkout_classic_gmv_annualized", "hijack_gmv_annualized",
        "platform_gmv_annualized", "is_on_c1", "migration_experience_type",
    ).orderBy("_merchant_key")


# ------------------------------------------------------------------------- Q04/Q05
SCORECARD_DISPLAY = [
    ("created_date", "created_date"),
    ("name", "name"),
    ("members", "Members"),
    ("MQL", "MQL"),
    ("net_new_mql", "Net New MQL"),
    ("closed_lost_amount", "Closed Lost ($)"),
    ("closed_won_amount", "Closed Won ($)"),
    ("closed_lost_optys", "Closed Lost (#)"),
    ("closed_won_optys", "Closed Won (#)"),
    ("in_progress_amount", "In Progress ($)"),
    ("in_progress_optys", "In Progress (#)"),
]


def campaign_leads_extract(campaigns: DataFrame, members: DataFrame, leads: DataFrame,
                           leads_history: DataFrame, opportunities: DataFrame, *, kpi_names: DataFrame,
                           since: str | dt.datetime = "2022-01-01",
                           domain_suffix: str = "platform.example") -> DataFrame:
    """Q05: per campaign, member and MQL counts plus the opportunity stage pivot.

    ``kpi_names`` is the set of campaign names of the funnel mart for the
    wanted sales region (``kpi_campaign_names``). The reference repeats the
    whole campaign query inside ``IN`` to restrict opportunities and then
    left-joins them to that same campaign set (S9); here opportunities are
    semi-joined to the selected campaigns once. ``campaign_id``, which the
    reference outputs twice, is output once (S10).
    """
    selected = campaign_selector(campaigns, kpi_names, since=since)
    counts = campaign_members_mql(selected, members, leads, leads_history, domain_suffix=domain_suffix)
    stages = stage_pivot(opportunities, campaign_ids=selected.select(F.col("id").alias("campaign_id")))
    return counts.join(stages, "campaign_id", "left").select(
        "created_date", "campaign_id", "name", "members", "MQL", "net_new_mql",
        "closed_won_amount", "closed_lost_amount", "in_progress_amount",
        "closed_won_optys", "closed_lost_optys", "in_progress_optys")


def campaign_scorecard(*args, **kwargs) -> DataFrame:
    """Q04: Q05 projected and renamed to the 11 display columns."""
    return display_projection(campaign_leads_extract(*args, **kwargs), SCORECARD_DISPLAY)


# ----------------------------------------------------------------------------- Q06
def checkout_duration_by_event(checkout_events: DataFrame, checkout_facts: DataFrame, *, elapsed: bool = False) -> DataFrame:
    """Q06: per (shop, event name, is-pay-user) the average time-of-day difference
    between completion and creation (S3) and the number of event rows with a token.

    A left join: events without checkout facts form groups with a null third key.
    ``elapsed`` takes the whole seconds from creation to completion instead of
    the difference of the times of day (which is negative across midnight).
    """
    secs = (F.unix_seconds(F.col("completed_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
            if elapsed else time_of_day_diff_seconds("completed_at", "created_at"))
    durations = checkout_facts.select("checkout_token", "is_pay_user_at_time_of_checkout",
                               secs.alias("secs"))
    joined = checkout_events.select("shop_id", "event_name", "checkout_token").join(
        durations, "checkout_token", "left")
    return (joined.groupBy("shop_id", "event_name", "is_pay_user_at_time_of_checkout")
            .agg(F.avg("secs").alias("time_taken"), F.count("checkout_token").alias("total_checkouts")))


# ----------------------------------------------------------------------------- Q07
def merchant_age_band_summary(merchants: DataFrame, region_map: DataFrame, merchant_daily: DataFrame, *,
                              region: str = "APAC", as_of: str | dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Q07: per (merchant, subregion, GMV band, country, age in months):
    trailing-year GMV, count of merchant keys and count of non-null shop counts (S4)."""
    included = merchants.filter((F.col("geographic_region_code") == region)
                          & F.col("is_included_in_historical_reporting") & F.col("is_active"))
    subregions = region_map.select("country_code", "commercial_subregion_code")
    last_year = trailing_year_totals(merchant_daily, "_merchant_key", "gmv", as_of=as_of)
    last_year = cohort_semi_join(last_year, included.select("_merchant_key"), "_merchant_key")
    joined = included.join(subregions, "country_code", "left").join(last_year, "_merchant_key", "left")
    return (joined.groupBy("_merchant_key", "commercial_subregion_code", "latest_annualized_gmv_band",
                           "country_name",
                           month_boundaries_between("first_contract_start_date", _d(as_of)).alias("age_in_months"))
            .agg(F.sum("annual_gmv").alias("platform_gmv"),
                 F.count("_merchant_key").alias("merchant_count"),
                 F.count("current_shop_count").alias("shop_count")))


# ----------------------------------------------------------------------------- Q08
def regional_merchant_list(shops: DataFrame, channel_gmv: DataFrame, gmv_facts: DataFrame, *,
                           countries: Sequence[str] = tuple(GREATER_CHINA_COUNTRIES),
                           since: str | dt.date = "2021-12-31") -> DataFrame:
    """Q08: shops of ``countries`` with reported GMV after ``since``, with their
    channel GMV after ``since``, ordered by that GMV (descending, nulls last)."""
    listed = shops.filter(F.col("shop_country_code").isin(list(countries)))
    listed = activity_semi_join(listed, gmv_facts, "_shop_key", F.col("reported_at") >= _day_after_ts(since))
    listed = listed.select("shop_id", "current_merchant_name", "facebook_social_handle", "instagram_social_handle",
                   "shop_company_name", "shop_domain", "shop_name")
    totals = shop_totals_since(channel_gmv, "shop_id", {"shop_gmv": "channel_gmv_usd"},
                           F.col("date") > lit_date(since), listed.select("shop_id"))
    return listed.join(totals, "shop_id", "left").orderBy(F.col("shop_gmv").desc_nulls_last())


# ----------------------------------------------------------------------------- Q09
def account_upgrade_targets(monthly_gmv: DataFrame, shops: DataFrame, account_lookup: DataFrame,
                            accounts: DataFrame, *, country: str = "JP", plan: str = "plus",
                            payments: str = "Is Using Platform Payments", year: int = 2022,
                            min_gmv=1_000_000) -> DataFrame:
    """Q09: shops of one country, not on ``plan``, using payments, whose on-platform
    GMV in ``year`` exceeds ``min_gmv``, with every account column."""
    cohort = shops.filter((F.col("shop_country_code") == country) & (F.col("current_plan_name") != plan)
                          & (F.col("using_platform_payments") == payments)).select("shop_id")
    facts = monthly_gmv.filter(F.col("is_platform_gmv") & year_in(F.col("month_begin_date"), [year]))
    sellers = shop_totals_since(facts, "shop_id", {"sum_gmv": "channel_gmv_usd"}, None, cohort)
    sellers = threshold_after_agg(sellers, "sum_gmv", min_gmv)
    out = (sellers.join(account_lookup.select("shop_id", "account_id"), "shop_id", "left")
           .join(accounts, F.col("account_id") == accounts["id"], "left"))
    return out.select("shop_id", F.col("sum_gmv").alias("annual_gmv"), *accounts.columns)


# ----------------------------------------------------------------------------- Q10
def partner_outbound_list(state_facts: DataFrame, merchants: DataFrame, region_map: DataFrame,
                          partners: DataFrame, shops: DataFrame, shop_daily: DataFrame, outbound: DataFrame,
                          *, as_of: str | dt.date = DEFAULT_AS_OF, window_days: int = 365,
                          min_age_days: int = 180, min_gmv=50_000, since: str | dt.date = "2018-01-01",
                          referral_types: Sequence[str] = ("Development Shop Referral",),
                          merchant_type: str = "Standard", region: str = "APAC",
                          country_name: str = "Japan", partner_country: str = "JP",
                          status: str = "Active") -> DataFrame:
    """Q10: activated or upgraded partner-referred merchants at least
    ``min_age_days`` old with at least ``min_gmv`` GMV in the snapshot window,
    enriched from an outbound list.

    The snapshot condition (``as_of - date(datetime) <= window_days``, an upper
    bound only, S13) does not involve the fact row, so the snapshot is
    aggregated per shop first and joined as one row per shop: the group sums
    are the same as over the reference's fact x snapshot pairs, which are
    never formed.
    """
    as_of = _d(as_of)
    transitions = state_facts.filter(
        ((F.coalesce("activation_count", F.lit(0)) > 0) | (F.coalesce("plus_upgrade_count", F.lit(0)) > 0))
        & (F.col("transition_at") >= lit_ts(dt.datetime.combine(_d(since), dt.time())))
        & transitions_of_age(as_of, min_age_days))
    referred = merchants.filter(F.col("currently_associated_referral_type").isin(list(referral_types))
                          & (F.col("merchant_type") == merchant_type)
                          & (F.col("merchant_country_name") == country_name)
                          & (F.col("current_merchant_active_status") == status)).select(
        "_merchant_key", "merchant_id", "merchant_name", "merchant_country_name",
        "currently_associated_platform_partner_id", "current_merchant_primary_shop_id")
    region_keys = region_map.filter(F.col("commercial_region_code") == region).select("_commercial_region_mapping_key")
    local_partners = partners.filter((F.col("current_commercial_region_code") == region)
                          & (F.col("partner_country") == partner_country)).select(
        F.col("platform_partner_id").alias("currently_associated_platform_partner_id"),
        "partner_name", "partner_country_name", "current_partner_manager")
    payment_flags = shops.select(F.col("shop_id").alias("current_merchant_primary_shop_id"),
                      "eligible_for_platform_payments", "using_platform_payments")
    selected = (transitions.join(referred, "_merchant_key").join(region_keys, "_commercial_region_mapping_key")
                .join(local_partners, "currently_associated_platform_partner_id"))
    # Few merchants are left: only their primary shops' days are summed.
    chosen_days = cohort_semi_join(
        shop_daily.filter(F.col("datetime") >= lit_ts(dt.datetime.combine(as_of - dt.timedelta(days=window_days), dt.time()))),
        selected.select(F.col("current_merchant_primary_shop_id").alias("shop_id")).distinct(), "shop_id")
    window_totals = (chosen_days.groupBy(F.col("shop_id").alias("current_merchant_primary_shop_id"))
           .agg(F.sum("daily_gmv_usd").alias("gmv_window"),
                F.sum("daily_gross_platform_payments_revenue_amount_usd").alias("revenue_window")))
    joined = (selected.join(payment_flags, "current_merchant_primary_shop_id")
              .join(window_totals, "current_merchant_primary_shop_id"))
    summed = (joined.groupBy("merchant_id", "merchant_name", "merchant_country_name", "partner_name",
                          "partner_country_name", "current_partner_manager", "eligible_for_platform_payments",
                          "using_platform_payments", F.col("transition_at").alias("Transition_Date"))
           .agg(F.sum("gmv_window").alias("gmv_total"), F.sum("revenue_window").alias("revenue_total")))
    moves = threshold_after_agg(summed, "gmv_total", min_gmv, strict=False).select(
        "merchant_id", "merchant_name", "merchant_country_name", "partner_name", "partner_country_name",
        "current_partner_manager", "eligible_for_platform_payments", "using_platform_payments", "Transition_Date",
        round_half_away_to_long("gmv_total").alias("GMV_L12M"),
        round_half_away_to_long("revenue_total").alias("Payments_Revenue_L12M"))
    contacts = outbound.select("merchant_id", "collaborators", "became_customer_at", "first_sale_at",
                         "current_plan_name", "shop_internal_dashboard_url", "shop_permanent_domain",
                         "primary_industry", "apps_score", "top_apps_installed", "last_30d_online_gmv",
                         "last_90d_online_gmv", "last_180d_online_gmv")
    return moves.join(contacts, "merchant_id", "left")


# ----------------------------------------------------------------------------- Q11
def churn_risk_list(merchants: DataFrame, shops: DataFrame, *, country_name: str = "India",
                    as_of: str | dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Q11: active merchants of a country with success manager, partner name,
    age in calendar months and GMV band."""
    active = merchants.filter((F.col("country_name") == country_name) & F.col("is_active"))
    primary_shops = shops.select(F.col("shop_id").alias("current_primary_shop_id"), "currently_associated_partner_name")
    return active.join(primary_shops, "current_primary_shop_id", "left").select(
        "merchant_name", "current_msm_name", "currently_associated_partner_name",
        month_boundaries_between("first_contract_start_date", _d(as_of)).alias("age_in_months"),
        "latest_annualized_gmv_band")


# ----------------------------------------------------------------------------- Q12
def vendor_line_items(line_items: DataFrame, gmv_facts: DataFrame, products: DataFrame, installs: DataFrame,
                      gateways: DataFrame, *, vendor: str, api_client_id: str, after_year: int = 2021,
                      key_filter: Callable[[DataFrame, DataFrame, str], DataFrame] = cohort_semi_join) -> DataFrame:
    """Q12: line items of one vendor's products sold in shops that have install
    facts for one app, with the order's GMV and smallest gateway key after a
    year, and that gateway's category.

    The order roll-up is only needed for the selected line items' orders, so
    the GMV facts are semi-joined to those order ids before aggregating.
    ``price``, which the reference outputs twice, is output once (S10).
    ``key_filter`` keeps the facts' rows whose key is in a set (products, orders):
    ``bloom_semi_join`` for sets too large to broadcast. Line items stored with
    an ``order_key`` (the order's id as a string) are joined on it as it is.
    """
    shops_with_app = app_install_shops(installs, api_client_id).select("shop_id")
    product_ids = cohort_semi_join(products.filter(F.col("product_vendor") == vendor),
                                   shops_with_app, "shop_id").select("product_id")
    if "order_key" not in line_items.columns:
        line_items = line_items.withColumn("order_key", F.col("order_id").cast("string"))
    items = key_filter(line_items.withColumn("product_id", F.col("product_id").cast("string")), product_ids, "product_id")
    orders = order_rollup(key_filter(gmv_facts, items.select(F.col("order_key").alias("order_id")), "order_id"), after_year=after_year)
    priced = items.join(orders.withColumnRenamed("order_id", "order_key"), "order_key", "left").select(
        "created_at", "order_id", "shop_id", "title", "quantity", "price", "order_gmv",
        "payment_gateway_key", "fulfillment_status")
    categories = gateways.select(F.col("_payment_gateway_key").alias("payment_gateway_key"), "payment_gateway_category")
    return priced.join(categories, "payment_gateway_key", "left").select(*priced.columns, "payment_gateway_category")
