"""Funnel mart: attributed contract value, conversion columns, period flags (O14, O19a-c)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lit_ts, period_flags
from ..sources.stored import CLOSED_MONTH
from .enrich import label_unknown
from .rollup import (ALL_MEASURES, CHANNEL_KEY, FUNNEL_DIMS, FUNNEL_MEASURES, MART_DECIMAL, NARROW_DIMS, ROW_COUNT,
                     ROW_VALUE, TOUCHPOINT_KEY, VALUE_MEASURES, described, funnel_rows, narrow_sums, with_standing_keys)

def opportunity_keys(opps: DataFrame, attribution: DataFrame) -> list[str]:
    """Columns to join the two on: the opportunity's key, and the month of its closing if both are stored by it."""
    stored = CLOSED_MONTH in opps.columns and CLOSED_MONTH in attribution.columns
    return ["_plus_opportunity_key", CLOSED_MONTH] if stored else ["_plus_opportunity_key"]


def value_rows(opps: DataFrame, attribution: DataFrame, touchpoints: DataFrame, channels: DataFrame,
               *, since: str | dt.datetime = "2019-02-01") -> DataFrame:
    """Closed opportunities from ``since`` on, joined to attribution rows and
    summed on (day, opportunity dimensions, touchpoint key, channel key), then
    joined to touchpoints and channels by key: rows at ``NARROW_DIMS`` with the
    attributed value of won rows and no counts. Nothing but keys and the
    opportunity's own short columns is shuffled at line grain.

    S5: the value is taken as DECIMAL(25,7) and the weight as DECIMAL(12,10);
    their product keeps every digit in 38.

    If both tables are stored by the month of the opportunity's closing
    (``CLOSED_MONTH``), they are joined on it as well: then the bound on
    opportunities, and whatever else selects them, prunes partitions of the
    attribution facts."""
    if isinstance(since, str):
        since = dt.datetime.fromisoformat(since)
    pod = opps.filter(F.col("is_closed") & (F.col("opportunity_closed_date") >= lit_ts(since)))
    value = F.col("monthly_contract_value").cast("decimal(25,7)") * F.col("count_w_shaped").cast("decimal(12,10)")
    dims = {"cost_center": "cost_center", "cost_center_track": "cost_center_track", "segment": "market_segment", "region": "inferred_region",
            "country_code": "inferred_country_code", "deal_type": "deal_type_category", "sales_region": "sales_region",
            "upgrade_type": "upgrade_type", "source": "attributed_source"}
    on = opportunity_keys(opps, attribution)
    keyed = (pod.select(*on, "is_won", "monthly_contract_value", *[F.col(c).alias(n) for n, c in dims.items()],
                        F.date_trunc("day", "opportunity_closed_date").cast("timestamp_ntz").alias("event_date"))
             .join(attribution, on)
             .groupBy("event_date", TOUCHPOINT_KEY, CHANNEL_KEY, *dims)
             .agg(F.sum(F.when(F.col("is_won"), value).otherwise(F.lit(0)).cast(ROW_VALUE)).cast(ROW_VALUE).alias("net_new_monthly_contract_value")))
    return with_standing_keys(keyed, touchpoints, channels).select(
        *NARROW_DIMS, *[F.lit(0).cast(ROW_COUNT).alias(m) for m in FUNNEL_MEASURES], "net_new_monthly_contract_value")


def attributed_value_split(opps: DataFrame, attribution: DataFrame, touchpoints: DataFrame,
                           channels: DataFrame, *, since: str | dt.datetime = "2019-02-01") -> DataFrame:
    """Per day and reporting dimensions, won contract value split by attribution weight.

    Closed opportunities from ``since`` on are joined to their attribution
    rows, touchpoints and channels (inner joins). ``net_new_monthly_contract_value``
    is the sum over won rows of value x weight; ``net_new_deals_won`` is the same
    divided by 2000. The eight funnel measures are zero.

    Decimal rule (S5): see ``value_rows``; totals are cast to DECIMAL(38,7).
    """
    rows = value_rows(opps, attribution, touchpoints, channels, since=since)
    return described(narrow_sums(rows), touchpoints, channels)


# (output, minuend, subtrahend), in the reference's order.
CONVERSION_PAIRS = [
    ("_net_new_sessions_not_leads", "net_new_sessions", "net_new_leads"),
    ("_net_new_leads_not_qualified", "net_new_leads", "net_new_qualified_leads"),
    ("_net_new_qualified_leads_not_prequalified", "net_new_qualified_leads", "net_new_prequalified"),
    ("_net_new_qualified_leads_not_interested", "net_new_qualified_leads", "net_new_interested"),
    ("_net_new_qualified_leads_not_closed_won", "net_new_qualified_leads", "net_new_closed_won"),
    ("_net_new_prequalified_not_interested", "net_new_prequalified", "net_new_interested"),
    ("_net_new_prequalified_not_closed_won", "net_new_prequalified", "net_new_closed_won"),
    ("_net_new_created_opportunities_not_interested", "net_new_created_opportunities", "net_new_interested"),
    ("_net_new_created_opportunities_not_closed_won", "net_new_created_opportunities", "net_new_closed_won"),
    ("_net_new_interested_not_closed_won", "net_new_interested", "net_new_closed_won"),
]


def non_conversion_columns(df: DataFrame, pairs=CONVERSION_PAIRS) -> DataFrame:
    """Stage differences used for conversion-rate displays."""
    return df.withColumns({out: (F.col(a) - F.col(b)).cast(MART_DECIMAL) for out, a, b in pairs})


def kpi_mart(*, opps: DataFrame, attribution: DataFrame, touchpoints: DataFrame, channels: DataFrame,
             rollup: DataFrame, sources: DataFrame, countries: DataFrame,
             as_of: str | dt.datetime, since: str | dt.datetime = "2019-07-01",
             value_since: str | dt.datetime = "2019-02-01") -> DataFrame:
    """The funnel mart — O15 and O14 stacked, labelled, re-grained, with
    conversion columns and period flags, events from ``since`` on (equal to
    the stage-by-stage composition; see the comment below).

    The date filter is on a grouping column, so Catalyst pushes it below the
    re-grain and into both stacked inputs.
    """
    mart = mart_rows(opps=opps, attribution=attribution, touchpoints=touchpoints, channels=channels, rollup=rollup,
                     sources=sources, countries=countries, since=since, value_since=value_since)
    return with_flags(mart, as_of)


def with_flags(mart: DataFrame, as_of: str | dt.date | dt.datetime) -> DataFrame:
    """The mart's period flags at a reporting date: the only columns that change as it moves."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    elif isinstance(as_of, dt.date) and not isinstance(as_of, dt.datetime):
        as_of = dt.datetime.combine(as_of, dt.time())
    return mart.withColumns(period_flags("event_date", as_of))


def mart_rows(*, opps: DataFrame, attribution: DataFrame, touchpoints: DataFrame, channels: DataFrame,
              rollup: DataFrame, sources: DataFrame, countries: DataFrame, since: str | dt.datetime = "2019-07-01",
              value_since: str | dt.datetime = "2019-02-01") -> DataFrame:
    """The mart without its period flags, which alone depend on the reporting date."""
    if isinstance(since, str):
        since = dt.datetime.fromisoformat(since)
    # Stacked (S7: no distinct is needed) and summed once, in short columns; names of
    # touchpoints, channels and countries are joined to the sums.
    funnel = funnel_rows(rollup, sources, touchpoints, channels)
    value = value_rows(opps, attribution, touchpoints, channels, since=value_since)
    stacked = funnel.unionByName(value).filter(F.col("event_date") >= lit_ts(since))
    labelled = label_unknown(described(narrow_sums(stacked), touchpoints, channels), countries)
    mart = labelled.select(*FUNNEL_DIMS[:6], "country", *FUNNEL_DIMS[6:], *ALL_MEASURES)
    return non_conversion_columns(mart)


def kpi_campaign_names(*, opps: DataFrame, attribution: DataFrame, touchpoints: DataFrame,
                       channels: DataFrame, rollup: DataFrame, sources: DataFrame,
                       sales_region: str, since: str | dt.datetime = "2019-07-01",
                       value_since: str | dt.datetime = "2019-02-01") -> DataFrame:
    """Distinct ``ad_campaign_name`` of the mart rows of one sales region.

    Same set as ``kpi_mart(...).filter(sales_region).select(ad_campaign_name).distinct()``:
    stacking, labelling (a left join), re-graining and adding columns neither
    add nor remove names, so the set is the union of the names that reach each
    stacked input. Computing it from the inputs' distinct touchpoint keys
    skips the wide joins and aggregations that only the measures need (S8).
    """
    if isinstance(since, str):
        since = dt.datetime.fromisoformat(since)
    if isinstance(value_since, str):
        value_since = dt.datetime.fromisoformat(value_since)
    tp_key, ch_key = "_revenue_touchpoint_attribution_key", "_plus_marketing_channel_key"
    tp = touchpoints.select(tp_key, "ad_campaign_name")
    ch = channels.select(ch_key)
    # The source and channel joins only test that a row's keys exist; the
    # name depends on the touchpoint key alone. So each input is reduced to its
    # distinct touchpoint keys (narrow integer keys, combined map-side) before
    # the names are looked up.
    # a DATE is at or after the timestamp ``since`` from the first whole day on
    first_day = since.date() if since.time() == dt.time() else since.date() + dt.timedelta(days=1)
    funnel_keys = (rollup.filter((F.col("sales_region") == sales_region)
                                 & (F.col("date") >= F.lit(first_day)))
                   .select("_source_key", tp_key, ch_key)
                   .join(sources.select("_source_key"), "_source_key", "left_semi")
                   .join(ch, ch_key, "left_semi")
                   .select(tp_key))
    start = max(since, value_since)
    pod = (opps.filter(F.col("is_closed") & (F.col("sales_region") == sales_region)
                       & (F.col("opportunity_closed_date") >= lit_ts(value_since))
                       & (F.date_trunc("day", "opportunity_closed_date") >= lit_ts(start)))
           .select(*opportunity_keys(opps, attribution)))
    value_keys = (attribution.select(*pod.columns, tp_key, ch_key)
                  .join(pod, pod.columns, "left_semi")
                  .join(ch, ch_key, "left_semi")
                  .select(tp_key))
    keys = funnel_keys.unionByName(value_keys).distinct()
    return keys.join(tp, tp_key).select("ad_campaign_name").distinct()


__all__ = ["attributed_value_split", "non_conversion_columns", "kpi_mart", "kpi_campaign_names",
           "CONVERSION_PAIRS", "VALUE_MEASURES"]
