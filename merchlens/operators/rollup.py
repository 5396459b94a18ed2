"""Aggregations: literal plans, month spines, monthly GMV, per-key totals and
re-grained funnel measures (O05, O06, O08, O10, O11, O12, O15, O16, O18, O24, O25).

Every aggregation here is a ``groupBy().agg()`` with sums, counts or minima,
so Spark aggregates partially on the map side before the shuffle; the shuffle
then carries one row per key and partition, which also defuses hot keys.
Filters compare columns with literals, so that they reach a parquet scan whose
columns they are; the test adapter, which shifts its dates, adds the same bounds
on its raw columns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.dates import complete_months, lit_date, lit_ts, month_start
from ..sources.warehouse import literal_table
from .cohort import cohort_semi_join


def _date(value: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def sum_like(df: DataFrame, c: str | Column) -> Column:
    """``sum`` that keeps integers integral and carries decimals at 38 digits."""
    if isinstance(c, str):
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.DecimalType):
            return F.sum(c).cast(T.DecimalType(38, dtype.scale))
        return F.sum(c)
    return F.sum(c)


def year_in(c: Column, years: Sequence[int]) -> Column:
    """``EXTRACT(year FROM c) IN years`` plus an equivalent range on the raw column.

    The range is redundant for the result but, on a column of the table
    itself, lets the parquet reader skip row groups, which ``year(c)`` alone
    would not.
    """
    ys = sorted(int(y) for y in years)
    return ((c >= lit_date(dt.date(ys[0], 1, 1))) & (c < lit_date(dt.date(ys[-1] + 1, 1, 1)))
            & F.year(c).isin(ys))


def plan_table(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Literal monthly plan rows (month + four integer measures), duplicates kept."""
    schema = T.StructType([
        T.StructField("reported_at", T.DateType(), False),
        T.StructField("brokered_projection", T.LongType(), False),
        T.StructField("hijacked_projection", T.LongType(), False),
        T.StructField("cod_projection", T.LongType(), False),
        T.StructField("captured", T.LongType(), False),
    ])
    data = [(_date(d), *vals) for d, *vals in rows]
    return literal_table(spark, data, schema)


def month_spine(dates: DataFrame, years: Sequence[str], date_col: str = "date",
                year_col: str = "year", out: str = "date_calculated") -> DataFrame:
    """Distinct month starts of a calendar for the given (string) years."""
    return (dates.filter(F.col(year_col).isin(list(years)))
            .select(month_start(date_col).alias(out)).distinct())


def gateway_gmv_monthly(gmv: DataFrame, gateways: DataFrame, shops: DataFrame, fulfillments: DataFrame,
                        *, country_codes: Sequence[str], gateway_names: Sequence[str],
                        since: str | dt.date, as_of: str | dt.date, cap: int = 1_000_000,
                        status: str = "Included in Reported GMV", transaction_index: str = "1",
                        key_filter: Callable[[DataFrame, DataFrame, str], DataFrame] = cohort_semi_join) -> DataFrame:
    """Monthly sum of first-transaction amounts through the given gateways.

    Rows must be included in reported GMV, reported after ``since``, be the
    first transaction of their order, belong to a shop of ``country_codes``,
    not exceed ``cap`` (a row-level outlier cap), belong to a fulfilled
    order, and fall in a month before the month of ``as_of``.

    The reference writes the gateway and shop lookups as left joins filtered
    in WHERE, i.e. inner joins; they are inner joins on key-only projections
    here. Join strategies are left to Spark's size check: the filtered gateway
    list is a handful of rows and is broadcast on that evidence. The fulfilled
    orders are a set as large as a fact: ``key_filter`` may be ``bloom_semi_join``.
    """
    after = lit_ts(dt.datetime.combine(_date(since) + dt.timedelta(days=1), dt.time()))
    facts = gmv.filter(
        (F.col("reported_gmv_inclusion_status") == status)
        & (F.col("reported_at") >= after)
        & (F.col("transaction_index") == transaction_index)
        & (F.col("transaction_amount_usd") <= F.lit(cap))
        & (F.col("reported_at") < lit_ts(dt.datetime.combine(_date(as_of).replace(day=1), dt.time()))))
    gw = gateways.filter(F.col("payment_gateway_name").isin(list(gateway_names))).select("_payment_gateway_key")
    shop_keys = shops.filter(F.col("shop_country_code").isin(list(country_codes))).select("_shop_key")
    facts = facts.join(gw, "_payment_gateway_key").join(shop_keys, "_shop_key")
    facts = key_filter(facts, fulfillments.select("order_id"), "order_id")
    return (facts.groupBy(month_start("reported_at").alias("reported_date"))
            .agg(sum_like(facts, "transaction_amount_usd").alias("transaction_amount_usd")))


def channel_gmv_monthly(channel_gmv: DataFrame, shops: DataFrame, *, country_code: str,
                        years: Sequence[int], as_of: str | dt.date, on_platform: bool = True) -> DataFrame:
    """Monthly on-platform (``on_platform=True``) channel GMV of one country's shops."""
    shop_keys = shops.filter(F.col("shop_country_code") == country_code).select("_shop_key")
    facts = channel_gmv.filter(
        year_in(F.col("month"), years)
        & (F.col("is_platform_gmv") == F.lit(on_platform))
        & complete_months("month", as_of))
    facts = cohort_semi_join(facts, shop_keys, "_shop_key")
    return (facts.groupBy(month_start("month").alias("reported_date"))
            .agg(sum_like(facts, "channel_gmv_usd").alias("brokered_gmv")))


def app_gmv_monthly(app_gmv: DataFrame, shops: DataFrame, *, country_codes: Sequence[str],
                    since: str | dt.date, as_of: str | dt.date,
                    measure: str = "total_off_platform_gmv_usd") -> DataFrame:
    """O10 twin: monthly off-platform (hijacked) GMV of the given countries' shops."""
    shop_keys = shops.filter(F.col("shop_country_code").isin(list(country_codes))).select("_shop_key")
    facts = app_gmv.filter((F.col("date") > lit_date(since)) & complete_months("date", as_of))
    facts = facts.join(shop_keys, "_shop_key")
    return facts.groupBy(month_start("date").alias("reported_date")).agg(sum_like(facts, measure).alias(measure))


def shop_totals_since(daily: DataFrame, key: str, measures: Mapping[str, str | Column],
                      date_condition: Column | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """Per-key sums of daily measures, filtered and cohort-restricted before the shuffle.

    ``measures`` maps output name -> input column. The cohort semi join is
    applied before aggregating so that only cohort rows are shuffled.
    """
    facts = daily if date_condition is None else daily.filter(date_condition)
    if cohort is not None:
        facts = cohort_semi_join(facts, cohort, key)
    aggs = [sum_like(facts, c).alias(name) for name, c in measures.items()]
    return facts.groupBy(key).agg(*aggs)


def trailing_year_totals(daily: DataFrame, key: str, measure: str, *, as_of: str | dt.date,
                         date_col: str = "date", out: str = "annual_gmv") -> DataFrame:
    """Per-key sum over ``date > as_of - 1 year`` (Feb 29 clamps to Feb 28)."""
    start = F.add_months(lit_date(as_of), -12)
    return (daily.filter(F.col(date_col) > start)
            .groupBy(key).agg(sum_like(daily, measure).alias(out)))


def threshold_after_agg(df: DataFrame, measure: str | Column, minimum, strict: bool = True) -> DataFrame:
    """Filter on an aggregate (outer WHERE or HAVING)."""
    m = F.col(measure) if isinstance(measure, str) else measure
    return df.filter(m > minimum if strict else m >= minimum)


def order_rollup(gmv_facts: DataFrame, *, after_year: int) -> DataFrame:
    """Per order, the smallest gateway key and the sum of adjustments after a year."""
    # ``year(x) > y`` written as ``x >= Jan 1 of y+1`` so that it reaches the scan.
    return (gmv_facts.filter(F.col("reported_at") >= lit_ts(dt.datetime(after_year + 1, 1, 1)))
            .groupBy("order_id")
            .agg(F.min("_payment_gateway_key").alias("payment_gateway_key"),
                 sum_like(gmv_facts, "gmv_adjustment_usd").alias("order_gmv")))


# --------------------------------------------------------------------------- funnel
# Reporting dimensions of the funnel mart, in the reference's column order.
FUNNEL_DIMS = [
    "event_date", "cost_center", "cost_center_track", "segment", "region", "country_code",
    "deal_type", "sales_region", "upgrade_type", "source", "ad_campaign_name", "ad_content",
    "keyword_text", "MEDIUM", "touchpoint_source", "marketing_channel",
    "adjusted_marketing_channel_path", "marketing_channel_path", "lead_acquisition_path",
    "lead_acquisition_sub_path",
]
FUNNEL_MEASURES = [
    "net_new_sessions", "net_new_leads", "net_new_qualified_leads", "net_new_prequalified",
    "net_new_interested", "net_new_closed_won", "net_new_closed_lost", "net_new_created_opportunities",
]
VALUE_MEASURES = ["net_new_monthly_contract_value", "net_new_deals_won"]
ALL_MEASURES = FUNNEL_MEASURES + VALUE_MEASURES
MART_DECIMAL = "decimal(38,7)"


# Measure types before the last sum: counts are BIGINT; attributed value is an
# exact product of DECIMAL(25,7) and DECIMAL(12,10).
ROW_COUNT = "bigint"
ROW_VALUE = "decimal(38,17)"
# Scale factor applied to attributed contract value to count "deals won".
# ``x / 2000`` is written as ``x * 0.0005``: the same value, and a product
# keeps the decimal digits where a decimal quotient would be rounded.
DEALS_PER_VALUE = "0.0005"

ROLLUP_MEASURES = {
    "net_new_sessions": "total_sessions",
    "net_new_leads": "net_new_leads",
    "net_new_qualified_leads": "qualified_leads",
    "net_new_prequalified": "prequalified_opportunity_transitions",
    "net_new_interested": "total_interested_opportunity_transitions",
    "net_new_closed_won": "total_closed_won_opportunities",
    "net_new_closed_lost": "total_closed_lost_opportunities",
    "net_new_created_opportunities": "created_opportunities",
}

# The mart's grain in short columns: eight of its dimensions are attributes of the
# touchpoint and the channel, and the acquisition path repeats the cost centre.
TOUCHPOINT, CHANNEL = "_touchpoint", "_channel"
NARROW_DIMS = FUNNEL_DIMS[:10] + [TOUCHPOINT, CHANNEL]
TOUCHPOINT_KEY, CHANNEL_KEY = "_revenue_touchpoint_attribution_key", "_plus_marketing_channel_key"
_TOUCHPOINT_NAMES = {"ad_campaign_name": "ad_campaign_name", "ad_content": "ad_content", "keyword_text": "keyword_text", "MEDIUM": F.lower, "touchpoint_source": "touchpoint_source"}
_CHANNEL_NAMES = {n: n for n in ("marketing_channel", "adjusted_marketing_channel_path", "marketing_channel_path")}


def _named(dim: DataFrame, key: str, names: Mapping) -> DataFrame:
    return dim.select(key, *[(of("medium") if callable(of) else F.col(of)).alias(out) for out, of in names.items()])


def with_standing_keys(facts: DataFrame, touchpoints: DataFrame, channels: DataFrame) -> DataFrame:
    """Inner joins to touchpoints and channels by key alone: each key is replaced by the least one with equal
    reporting attributes, so that the grain of the mart can be summed without its strings."""
    for dim, key, names, out in ((touchpoints, TOUCHPOINT_KEY, _TOUCHPOINT_NAMES, TOUCHPOINT), (channels, CHANNEL_KEY, _CHANNEL_NAMES, CHANNEL)):
        standing = _named(dim, key, names).select(key, F.min(key).over(Window.partitionBy(*names)).alias(out))
        facts = facts.join(standing, key).drop(key)
    return facts


def described(narrow: DataFrame, touchpoints: DataFrame, channels: DataFrame) -> DataFrame:
    """Sums at ``NARROW_DIMS`` with the 20 reporting columns and ten measures of the mart."""
    tp = _named(touchpoints, TOUCHPOINT_KEY, _TOUCHPOINT_NAMES).withColumnRenamed(TOUCHPOINT_KEY, TOUCHPOINT)
    ch = _named(channels, CHANNEL_KEY, _CHANNEL_NAMES).withColumnRenamed(CHANNEL_KEY, CHANNEL)
    value = F.col("net_new_monthly_contract_value")
    out = narrow.join(tp, TOUCHPOINT).join(ch, CHANNEL).withColumns({
        "lead_acquisition_path": F.col("cost_center"), "lead_acquisition_sub_path": F.col("cost_center_track"),
        "net_new_deals_won": value * F.lit(DEALS_PER_VALUE).cast("decimal(5,4)")})
    return out.select(*FUNNEL_DIMS, *[F.col(m).cast(MART_DECIMAL).alias(m) for m in ALL_MEASURES])


def narrow_sums(rows: DataFrame) -> DataFrame:
    """Rows summed to ``NARROW_DIMS``: counts and the attributed value, uncut."""
    value = F.sum("net_new_monthly_contract_value").cast(ROW_VALUE).alias("net_new_monthly_contract_value")
    return rows.groupBy(*NARROW_DIMS).agg(*[F.sum(m).alias(m) for m in FUNNEL_MEASURES], value)


def funnel_rows(rollup: DataFrame, sources: DataFrame, touchpoints: DataFrame, channels: DataFrame) -> DataFrame:
    """Rollup rows (inner joins to the three dimensions) at ``NARROW_DIMS`` with the eight counts and no value."""
    joined = with_standing_keys(rollup.join(sources, "_source_key"), touchpoints, channels)
    return joined.select(
        F.col("date").cast("timestamp_ntz").alias("event_date"),
        F.col("lead_acquisition_path").alias("cost_center"),
        F.col("lead_acquisition_sub_path").alias("cost_center_track"),
        F.col("segment_for_quota").alias("segment"),
        F.col("merchant_region").alias("region"),
        "country_code", "deal_type", "sales_region", "upgrade_type",
        F.col("cleaned_source").alias("source"), TOUCHPOINT, CHANNEL,
        *[F.col(src).cast(ROW_COUNT).alias(name) for name, src in ROLLUP_MEASURES.items()],
        F.lit(0).cast(ROW_VALUE).alias("net_new_monthly_contract_value"))


def funnel_rollup(rollup: DataFrame, sources: DataFrame, touchpoints: DataFrame,
                  channels: DataFrame) -> DataFrame:
    """Re-aggregate the daily funnel rollup to the 20 reporting columns.

    Eight measures come from the rollup; the two value measures are zero.
    Measures are DECIMAL(38,7) so that the result stacks with O14's. Keys and
    short codes are shuffled; touchpoint and channel names are joined to the sums.
    """
    return described(narrow_sums(funnel_rows(rollup, sources, touchpoints, channels)), touchpoints, channels)


def union_measures(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    """Stack two frames of the same columns by name; SQL ``UNION`` when ``distinct``.

    Before a re-grain (O18) the distinct is not needed (S7): the two inputs
    zero each other's measures and are unique at their grain, so the only
    rows a distinct could drop are all-zero duplicates, which add nothing to
    the sums. ``kpi_mart`` therefore stacks without it and saves a shuffle.
    """
    out = a.unionByName(b)
    return out.distinct() if distinct else out


def regrain(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum the measures to the given dimensions so that the grain is unique."""
    return df.groupBy(*dims).agg(*[F.sum(m).cast(MART_DECIMAL).alias(m) for m in measures])
