"""Registered queries over stored tables and by the mechanisms for large data.

Each gives the result of a report or stage of ``catalog`` by another route
(stored layouts, carried totals, refreshed days, Bloom filters, salted keys),
so it has the same oracle, or adds a result that those can't give (counts that
roll up, rows in a range before an event). Stored tables are written when a
query is built; the caller of the class behind it drops them, a registered
query leaves them to the shared folder's own cleaning since its rows are read later.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bitmaps, campaign, cohort, enrich, funnel, ranges, rollup
from ..operators.bloom import bloom_narrowed_join, bloom_semi_join
from ..operators.checks import KeyChecks
from ..operators.skew import salted_join
from ..operators.trailing import TrailingTotals
from ..sources.constants import APAC_APP_COUNTRIES, DEFAULT_AS_OF
from ..sources.stored import AnalyzedWarehouse, BucketedWarehouse, MonthlyFunnel, stored
from ..sources.warehouse import Warehouse
from . import catalog, reports
from .mart_store import MartStore, touched_days

HISTORY_RANGE = dt.timedelta(days=60)


# ------------------------------------------------------------- tables stored by month
def q_kpi_mart_by_month(w: Warehouse) -> DataFrame:
    """O19c over inputs stored by month: partitions before the mart's first day are not read."""
    return catalog.q_kpi_mart(MonthlyFunnel(w.spark, w.sf_dir).store())


def q_kpi_campaign_names_by_month(w: Warehouse) -> DataFrame:
    """O20's name set over inputs stored by month."""
    return catalog.q_kpi_campaign_names(MonthlyFunnel(w.spark, w.sf_dir).store())


def q_attributed_value_by_month(w: Warehouse) -> DataFrame:
    """O14 over inputs stored by month."""
    return catalog.q_attributed_value_split(MonthlyFunnel(w.spark, w.sf_dir).store())


# ------------------------------------------------------------------ days refreshed
LATE_FROM = dt.date(2025, 1, 1)


def late_split(w: Warehouse) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Funnel inputs that came first, and those that come late: upgrades of 2025 (days that the mart has) and large deals of its last days."""
    def late(df: DataFrame, day: str, large: str):
        late_row = (F.to_date(day) >= F.lit(LATE_FROM)) & ((F.col("upgrade_type") == "Upgrade") | (F.col(large) == "Large"))
        return df.filter(~late_row), df.filter(late_row)

    opps, late_opps = late(w.opportunity_dim(), "opportunity_closed_date", "deal_type_category")
    rolled, late_rolled = late(w.funnel_rollup_daily(), "date", "deal_type")
    facts, key = w.attribution_facts(), "_plus_opportunity_key"
    return (dict(opps=opps, attribution=facts.join(late_opps.select(key), key, "left_anti"), rollup=rolled),
            dict(opps=late_opps, attribution=facts.join(late_opps.select(key), key, "left_semi"), rollup=late_rolled))


def mart_of(w: Warehouse) -> DataFrame:
    return funnel.mart_rows(**catalog._mart_inputs(w), countries=w.country_dimension())


def q_kpi_mart_refreshed(w: Warehouse) -> DataFrame:
    """O19c stored by day, from what came first; then the days that late rows touch are rewritten, and no others."""
    first, late = late_split(w)
    tables = MonthlyFunnel(w.spark, w.sf_dir).store(**first)
    store = MartStore(w.spark).load(mart_of(tables))
    tables.append(**late)
    days = touched_days(late["opps"].select("opportunity_closed_date"), late["rollup"].select("date"))
    store.refresh(mart_of(tables.of_months([d.replace(day=1) for d in days])), days)
    return store.read(DEFAULT_AS_OF)


# ------------------------------------------------------------------ totals carried on
def carried(totals: TrailingTotals, facts: DataFrame, start: dt.date, until: dt.date, steps: int = 3) -> DataFrame:
    """The window (start, until] reached by ``steps`` days' steps from one built whole."""
    totals.load(facts)
    at = (start - dt.timedelta(days=steps), until - dt.timedelta(days=steps))
    totals.build(*at)
    for _ in range(steps):
        after = tuple(d + dt.timedelta(days=1) for d in at)
        totals.advance(at, after)
        totals.forget(*at)
        at = after
    return totals.totals(start, until)


LAST_DAY = dt.date(2025, 12, 31)  # behind all facts
YEAR_AGO = DEFAULT_AS_OF.replace(year=DEFAULT_AS_OF.year - 1)


def q_trailing_year_totals_carried(w: Warehouse) -> DataFrame:
    """O12 from daily partial sums, carried on day by day."""
    facts = w.merchant_daily(YEAR_AGO - dt.timedelta(days=3))
    return carried(TrailingTotals(w.spark, ["_merchant_key"], {"annual_gmv": "gmv"}), facts, YEAR_AGO, LAST_DAY).select(
        "_merchant_key", F.col("annual_gmv").cast("decimal(38,2)").alias("annual_gmv"))


def q_shop_totals_carried(w: Warehouse) -> DataFrame:
    """O11 from daily partial sums, carried on day by day."""
    since = dt.date(2022, 3, 29)
    facts = w.shop_daily_gmv(since - dt.timedelta(days=3))
    return carried(TrailingTotals(w.spark, ["shop_id"], {"platform_gmv_annualized": "daily_gmv_amount_usd"}), facts, since, LAST_DAY).select(
        "shop_id", F.col("platform_gmv_annualized").cast("decimal(38,2)").alias("platform_gmv_annualized"))


# ------------------------------------------------------------------------ Bloom filters
def q_vendor_line_items_bloom(w: Warehouse) -> DataFrame:
    """Q12 with its product and order sets as Bloom filters before the facts' shuffles."""
    p = catalog.TEST_PARAMS

    def selected(fact: DataFrame, keys: DataFrame, on: str) -> DataFrame:
        kept = bloom_semi_join(fact, keys, on)
        return stored(kept, "line-items") if on == "product_id" else kept  # the items are read for their orders' keys (three times) and for the result

    return reports.vendor_line_items(w.line_items(), w.gmv_facts(catalog.PLAN_SINCE), w.products(), w.installs(), w.gateways(),
                                     vendor=p["vendor"], api_client_id=p["api_client_id"], key_filter=selected)


def q_gateway_gmv_monthly_bloom(w: Warehouse) -> DataFrame:
    """O08, whose facts are few once filtered: a Bloom filter of their orders keeps most fulfilments out of the shuffle."""
    return rollup.gateway_gmv_monthly(w.gmv_facts(catalog.PLAN_SINCE, catalog.COMPLETE), w.gateways(), w.shops(), w.fulfillments(),
                                      country_codes=["IN"], gateway_names=reports.COD_GATEWAY_NAMES, since="2021-12-31",
                                      as_of=DEFAULT_AS_OF, cap=catalog.TEST_PARAMS["cap"], key_filter=bloom_narrowed_join)


def q_cohort_gmv_bloom(w: Warehouse) -> DataFrame:
    """Platform GMV of the shops of active Indian merchants, the cohort as a Bloom filter."""
    shops = catalog.q_cohort_semi_join(w).select("shop_id")
    facts = bloom_semi_join(w.shop_daily_gmv(), shops, "shop_id")
    return rollup.shop_totals_since(facts, "shop_id", {"platform_gmv": "daily_gmv_amount_usd"})


# ----------------------------------------------------------------------- bucketed tables
def bucketed(w: Warehouse, **keys: str) -> BucketedWarehouse:
    return BucketedWarehouse(w.spark, w.sf_dir, keys).store()


def q_regional_app_gmv_bucketed(w: Warehouse) -> DataFrame:
    """Q01 over facts and shops stored in buckets of the shop key."""
    return catalog.q_regional_app_gmv_monthly(bucketed(w, app_gmv_daily="_shop_key", shops="_shop_key"))


def q_merchant_tracker_bucketed(w: Warehouse) -> DataFrame:
    """Q03 over facts and dimensions stored in buckets of the shop."""
    return catalog.q_merchant_tracker(bucketed(w, shop_merchant_lookup="shop_id", shops="shop_id", checkout_daily="shop_id",
                                               app_gmv_daily="shop_id", shop_daily_gmv="shop_id", migration="shop_id"))


def q_regional_merchant_list_bucketed(w: Warehouse) -> DataFrame:
    """Q08 over facts and shops stored in buckets of the shop key."""
    return catalog.q_regional_merchant_list(bucketed(w, gmv_facts="_shop_key", shops="_shop_key"))


def q_vendor_line_items_bucketed(w: Warehouse) -> DataFrame:
    """Q12 over line items and facts stored in buckets of the order."""
    return catalog.q_vendor_line_items(bucketed(w, line_items="order_key", gmv_facts="order_id"))


# ------------------------------------------------------------------ counts that roll up
def q_campaign_members_rollup(w: Warehouse) -> DataFrame:
    """O21's three distinct counts for campaigns, for days and over all, from bitmaps of the campaigns."""
    selected = campaign.campaign_selector(w.campaigns(), catalog._kpi_names(w))
    rows = campaign.member_rows(selected, w.campaign_members(), w.leads(), w.leads_history(), domain_suffix=catalog.TEST_PARAMS["domain_suffix"])
    return campaign.member_counts_rollup(stored(rows, "member-rows"))  # read for the dictionary and for the bitmaps


# ---------------------------------------------------------------------------- the others
def q_star_enrich_checked(w: Warehouse) -> DataFrame:
    """O03 with the row counts of each join observed in the same job."""
    return KeyChecks().enrich(w.shop_merchant_lookup(), {
        "shops": (w.shops(), "shop_id", ["shop_name", "shop_country_code", "current_plan_name"]),
        "merchants": (w.merchants(), "_merchant_key", ["merchant_name", "current_msm_name"]),
        "migration": (w.migration(), "shop_id", ["is_on_c1", "migration_experience_type"])})


def q_partner_outbound_list_analyzed(w: Warehouse) -> DataFrame:
    """Q10 over tables with column statistics."""
    return catalog.q_partner_outbound_list(AnalyzedWarehouse(w.spark, w.sf_dir, ["state_facts", "merchants", "partners", "shops", "shop_state_daily", "outbound_list"]).store())


def q_recent_lead_history(w: Warehouse) -> DataFrame:
    """O22's kind of join with a range that no minimum replaces: rows of a lead's history in the 60 days before a campaign of his was created."""
    created = w.campaigns().select(F.col("id").alias("campaign_id"), F.col("created_date").alias("campaign_created"))
    asked = w.campaign_members().where(F.col("lead_id").isNotNull()).join(created, "campaign_id").select("lead_id", "campaign_created")
    return ranges.recent_counts(asked, w.leads_history(), "lead_id", "campaign_created", "created_at", HISTORY_RANGE, "recent_rows")


def q_label_unknown_salted(w: Warehouse) -> DataFrame:
    """O17 with the hot country codes salted."""
    a, b = catalog._stacked(w)
    names = w.country_dimension().select("country_code", F.col("country_name").alias("_name"))
    out = salted_join(rollup.union_measures(a, b, distinct=False), names, "country_code", share=0.05, salts=8)
    return out.withColumn("country", F.coalesce("_name", F.lit("Unknown country_name"))).drop("_name")


BUILDERS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "kpi_mart_by_month": q_kpi_mart_by_month,
    "kpi_campaign_names_by_month": q_kpi_campaign_names_by_month,
    "attributed_value_by_month": q_attributed_value_by_month,
    "kpi_mart_refreshed": q_kpi_mart_refreshed,
    "trailing_year_totals_carried": q_trailing_year_totals_carried,
    "shop_totals_carried": q_shop_totals_carried,
    "vendor_line_items_bloom": q_vendor_line_items_bloom,
    "gateway_gmv_monthly_bloom": q_gateway_gmv_monthly_bloom,
    "cohort_gmv_bloom": q_cohort_gmv_bloom,
    "regional_app_gmv_bucketed": q_regional_app_gmv_bucketed,
    "merchant_tracker_bucketed": q_merchant_tracker_bucketed,
    "regional_merchant_list_bucketed": q_regional_merchant_list_bucketed,
    "vendor_line_items_bucketed": q_vendor_line_items_bucketed,
    "campaign_members_rollup": q_campaign_members_rollup,
    "partner_outbound_list_analyzed": q_partner_outbound_list_analyzed,
    "star_enrich_checked": q_star_enrich_checked,
    "recent_lead_history": q_recent_lead_history,
    "label_unknown_salted": q_label_unknown_salted,
}
QUERIES = {n: catalog._runner(b) for n, b in BUILDERS.items()}
