"""Source adapter: warehouse-shaped tables derived from the test tables.

The reports take warehouse tables (shop and merchant dimensions, GMV facts,
CRM tables, a funnel rollup) as DataFrame arguments. The test data holds a
TPC-H-like schema instead, so this module derives every argument frame from
it with plain projections, filters, joins and aggregations. Everything stays
lazy: a report reads only the columns and rows it needs, and Catalyst prunes
and pushes filters through these projections to the parquet scans.

Mapping, in one line each:

* ``customer``  -> shops; ``c_custkey div 4`` groups shops into merchants.
* ``supplier``  -> apps and marketing channels; merchant groups double as partners.
* ``orders``    -> shop-day GMV facts, CRM leads, opportunities.
* ``lineitem``  -> transaction-level GMV facts (joined to ``orders`` for the
  shop), app installs, campaign members, opportunities per campaign,
  attribution facts and the funnel rollup.
* ``part``      -> products, campaigns and marketing touchpoints.
* ``events``    -> checkout events and checkout facts.
* ``nation`` / ``region`` -> countries and the region map.

Dates are moved forward by ``YEAR_SHIFT`` years so that the reports' default
periods fall inside the data. Money is cast to DECIMAL(18,2) so that sums are
exact and do not depend on summation order.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import COUNTRIES, GATEWAYS, YEAR_SHIFT

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
# Declared schemas of the source tables: no schema-inference job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
SHOPS_PER_MERCHANT = 4      # c_custkey div 4 -> merchant
TOUCHPOINTS, CHANNELS = 40, 2  # keys of the funnel inputs: few, so that many rows share a grain
CUSTOMERS_PER_SUPPLIER = 15  # TPC-H cardinality ratio: partner of a shop


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def shifted(c: str) -> Column:
    """Timestamp moved forward by YEAR_SHIFT years (Feb 29 clamps to Feb 28)."""
    return F.col(c) + F.expr(f"INTERVAL {YEAR_SHIFT} YEARS")


def shifted_date(c: str) -> Column:
    return shifted(c).cast("date")


def _raw_bound(day: dt.date, extra_days: int) -> Column:
    """The shifted date ``day`` as a raw timestamp, ``extra_days`` later."""
    first = dt.date(day.year - YEAR_SHIFT, day.month, min(day.day, 28))
    if extra_days > 0:  # never earlier than the day itself
        first += dt.timedelta(days=day.day - min(day.day, 28))
    return F.lit(dt.datetime.combine(first + dt.timedelta(days=extra_days), dt.time())).cast("timestamp_ntz")


def idiv(c: str, n: int) -> Column:
    return F.expr(f"{c} div {n}")


_COUNTRY_ATTRS = {"code": 1, "name": 2, "region": 3, "subregion": 4}


def country_of(nation_col: str, attr: str) -> Column:
    """Country attribute of a nation key, looked up in a literal map.

    A 25-entry lookup written as an expression instead of a join: no shuffle
    or broadcast, and the frame keeps the size estimate of its scan (a join
    would be estimated as the product of both sides' sizes and would stop the
    frame from ever qualifying for a broadcast). Unknown keys give null.
    """
    i = _COUNTRY_ATTRS[attr]
    pairs = [x for row in COUNTRIES for x in (F.lit(row[0]), F.lit(row[i]))]
    return F.try_element_at(F.create_map(*pairs), F.col(nation_col))


def literal_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small fixed table as literal rows.

    Built from literals (not ``createDataFrame``, whose RDD-backed scan has no
    size estimate), so Catalyst knows it is tiny and can size-check joins
    against it and against anything derived from it.
    """
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
               for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


class Warehouse:
    """Lazily derived warehouse tables over one folder of test parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def dated(self, name: str, column: str, since: dt.date | None, until: dt.date | None) -> DataFrame:
        """A fact table with bounds on its raw date column, so that they reach the parquet scan.

        ``since`` and ``until`` are dates of the shifted column (rows before
        ``since`` and after ``until`` aren't needed). A report's own filter is
        on the shifted expression, which no reader can use; these bounds are
        the same dates moved back, a day wider on either side for Feb 29, and
        leave the exact comparison to the report.
        """
        return self.bounded(self.raw(name), column, since, until)

    @staticmethod
    def bounded(df: DataFrame, column: str, since: dt.date | None, until: dt.date | None) -> DataFrame:
        if since is not None:
            df = df.filter(F.col(column) >= _raw_bound(since, -1))
        if until is not None:
            df = df.filter(F.col(column) < _raw_bound(until, 2))
        return df

    # ------------------------------------------------------------------ geography
    @cached_property
    def countries(self) -> DataFrame:
        """One row per nation with ISO code, name and commercial region."""
        schema = T.StructType([
            T.StructField("n_nationkey", T.IntegerType(), False),
            T.StructField("country_code", T.StringType(), False),
            T.StructField("country_name", T.StringType(), False),
            T.StructField("commercial_region_code", T.StringType(), False),
            T.StructField("commercial_subregion_code", T.StringType(), False),
        ])
        fixed = literal_table(self.spark, COUNTRIES, schema)
        # 25 fixed rows: broadcasting is bounded by construction.
        return self.raw("nation").select("n_nationkey").join(F.broadcast(fixed), "n_nationkey")

    def country_dimension(self) -> DataFrame:
        """Country names; every fifth nation is missing, so some codes have no name."""
        return self.countries.filter(F.col("n_nationkey") % 5 != 4).select("country_code", "country_name")

    def region_map(self) -> DataFrame:
        return self.countries.select(
            F.col("n_nationkey").cast("bigint").alias("_commercial_region_mapping_key"),
            "country_code", "commercial_region_code", "commercial_subregion_code")

    # ---------------------------------------------------------------------- shops
    def shops(self) -> DataFrame:
        c = self.raw("customer")
        key = F.col("c_custkey").cast("string")
        partner = idiv("c_custkey", CUSTOMERS_PER_SUPPLIER)
        has_partner = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
        bal = F.col("c_acctbal")
        return c.select(
            (F.col("c_custkey") + 1).alias("_shop_key"),
            F.col("c_custkey").alias("shop_id"),
            F.col("c_name").alias("shop_name"),
            F.concat(F.lit("shop-"), key, F.lit(".com")).alias("shop_domain"),
            F.concat(F.lit("shop-"), key, F.lit(".store.example")).alias("shop_permanent_domain"),
            F.concat(F.lit("https://shop-"), key, F.lit(".com")).alias("shop_storefront_url"),
            F.concat(F.lit("Company "), key).alias("shop_company_name"),
            country_of("c_nationkey", "code").alias("shop_country_code"),
            idiv("c_custkey", SHOPS_PER_MERCHANT).alias("current_merchant_id"),
            F.concat(F.lit("Merchant "), idiv("c_custkey", SHOPS_PER_MERCHANT).cast("string"))
             .alias("current_merchant_name"),
            F.col("c_mktsegment").alias("current_funnel_state"),
            F.when(bal >= 0, "Active").otherwise("Inactive").alias("current_merchant_active_status"),
            F.when(bal >= 5000, "Plus").otherwise("Standard").alias("current_merchant_deal_type"),
            F.when(bal < 0, "0: none").when(bal < 2500, "1: low").when(bal < 7500, "2: mid")
             .otherwise("3: high").alias("current_mrr_band_ranked_range"),
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", "plus")
             .when(F.col("c_mktsegment") == "BUILDING", "advanced")
             .when(F.col("c_mktsegment") == "FURNITURE", "basic")
             .when(F.col("c_mktsegment") == "HOUSEHOLD", "professional")
             .otherwise("unlimited").alias("current_plan_name"),
            F.when(bal >= 1000, "Is Using Platform Payments")
             .otherwise("Not Using Platform Payments").alias("using_platform_payments"),
            (bal >= 0).alias("eligible_for_platform_payments"),
            F.concat(F.lit("fb.shop"), key).alias("facebook_social_handle"),
            F.concat(F.lit("@shop"), key).alias("instagram_social_handle"),
            F.when(has_partner, partner).alias("currently_associated_platform_partner_id"),
            F.when(has_partner, F.concat(F.lit("Partner "), partner.cast("string")))
             .alias("currently_associated_partner_name"),
        )

    def shop_merchant_lookup(self) -> DataFrame:
        return self.raw("customer").select(
            (idiv("c_custkey", SHOPS_PER_MERCHANT) + 1).alias("_merchant_key"),
            F.col("c_custkey").alias("shop_id"))

    def migration(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("shop_id"),
            F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "MACHINERY").alias("is_on_c1"),
            F.when(F.col("c_acctbal") >= 5000, "assisted").otherwise("self-serve")
             .alias("migration_experience_type"))

    def account_lookup(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("shop_id"),
            F.concat(F.lit("ACC-"), F.col("c_custkey").cast("string")).alias("account_id"))

    def accounts(self) -> DataFrame:
        return self.raw("customer").select(
            F.concat(F.lit("ACC-"), F.col("c_custkey").cast("string")).alias("id"),
            F.col("c_name").alias("account_name"),
            F.col("c_mktsegment").alias("industry"),
            money("c_acctbal").alias("account_balance"),
            F.col("c_nationkey").alias("billing_nation_key"))

    # ------------------------------------------------------------------ merchants
    def merchants(self) -> DataFrame:
        """Merchant dimension: customers grouped by ``c_custkey div 4``."""
        c = self.raw("customer")
        m = (c.groupBy(idiv("c_custkey", SHOPS_PER_MERCHANT).alias("merchant_id"))
             .agg(F.min("c_custkey").alias("current_primary_shop_id"),
                  F.count(F.lit(1)).alias("n_shops"),
                  F.min("c_nationkey").alias("n_nationkey"),
                  F.sum(money("c_acctbal")).alias("total_balance"),
                  F.min("c_acctbal").alias("min_balance"),
                  F.max("c_acctbal").alias("max_balance"),
                  F.min("c_mktsegment").alias("first_segment")))
        active = F.col("total_balance") > 0
        return m.select(
            (F.col("merchant_id") + 1).alias("_merchant_key"),
            "merchant_id",
            F.concat(F.lit("Merchant "), F.col("merchant_id").cast("string")).alias("merchant_name"),
            "current_primary_shop_id",
            F.col("current_primary_shop_id").alias("current_merchant_primary_shop_id"),
            F.when(F.col("n_shops") > 1, F.col("n_shops")).alias("current_shop_count"),
            country_of("n_nationkey", "code").alias("country_code"),
            country_of("n_nationkey", "name").alias("country_name"),
            country_of("n_nationkey", "name").alias("merchant_country_name"),
            country_of("n_nationkey", "region").alias("geographic_region_code"),
            active.alias("is_active"),
            (F.col("min_balance") > -500).alias("is_included_in_historical_reporting"),
            F.when(F.col("total_balance") < 5000, "1: <5K")
             .when(F.col("total_balance") < 15000, "2: 5K-15K")
             .otherwise("3: 15K+").alias("latest_annualized_gmv_band"),
            F.date_add(F.lit(dt.date(2016, 1, 31)),
                       (F.col("merchant_id") * 53 % 3000).cast("int")).alias("first_contract_start_date"),
            F.concat(F.lit("MSM "), F.col("first_segment")).alias("current_msm_name"),
            F.concat(F.lit("MSM "), F.col("first_segment")).alias("current_merchant_success_manager"),
            F.when(F.col("max_balance") < 9000, "Standard").otherwise("Plus").alias("merchant_type"),
            F.when(active, "Active").otherwise("Inactive").alias("current_merchant_active_status"),
            F.col("merchant_id").alias("currently_associated_platform_partner_id"),
            F.when(F.col("first_segment") == "AUTOMOBILE", "Direct")
             .otherwise("Development Shop Referral").alias("currently_associated_referral_type"),
        )

    def outbound_list(self) -> DataFrame:
        m = self.merchants()
        return m.select(
            "merchant_id",
            F.coalesce(F.col("current_shop_count"), F.lit(1)).alias("collaborators"),
            F.col("first_contract_start_date").alias("became_customer_at"),
            F.date_add("first_contract_start_date", 30).alias("first_sale_at"),
            F.lit("plus").alias("current_plan_name"),
            F.concat(F.lit("https://admin.example/shops/"),
                     F.col("current_primary_shop_id").cast("string")).alias("shop_internal_dashboard_url"),
            F.concat(F.lit("shop-"), F.col("current_primary_shop_id").cast("string"),
                     F.lit(".store.example")).alias("shop_permanent_domain"),
            F.col("current_msm_name").alias("primary_industry"),
            (F.col("merchant_id") % 100).alias("apps_score"),
            F.concat(F.lit("app-"), (F.col("merchant_id") % 7).cast("string")).alias("top_apps_installed"),
            F.when(F.col("merchant_id") % 3 > 0, money(F.col("merchant_id") % 1000)).alias("last_30d_online_gmv"),
            money(F.col("merchant_id") % 1000 * 3 + 1).alias("last_90d_online_gmv"),
            money(F.col("merchant_id") % 1000 * 6 + 2).alias("last_180d_online_gmv"),
        )

    def state_facts(self) -> DataFrame:
        c = self.raw("customer")
        days = F.floor((F.col("c_acctbal") + 1000) / 4).cast("int")
        return c.select(
            (idiv("c_custkey", SHOPS_PER_MERCHANT) + 1).alias("_merchant_key"),
            F.col("c_nationkey").cast("bigint").alias("_commercial_region_mapping_key"),
            F.date_add(F.lit(dt.date(2018, 1, 1)), days).cast("timestamp_ntz").alias("transition_at"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), F.lit(1))
             .alias("activation_count"),
            F.when(F.col("c_acctbal") > 8000, 1).otherwise(0).alias("plus_upgrade_count"))

    # --------------------------------------------------------------- partners, apps
    def partners(self) -> DataFrame:
        """Partner dimension: every merchant group is also registered as a partner
        (its development agency), under the merchant's id and in its country."""
        m = self.merchants()
        key = F.col("merchant_id").cast("string")
        return m.select(
            F.col("merchant_id").alias("platform_partner_id"),
            F.concat(F.lit("Partner "), key).alias("partner_name"),
            F.concat(F.lit("Partner "), key, F.lit(" Studio")).alias("partner_company_name"),
            F.concat(F.lit("https://partner-"), key, F.lit(".dev")).alias("partner_url"),
            F.col("country_code").alias("partner_country"),
            F.col("country_name").alias("partner_country_name"),
            F.concat(F.lit("PM "), F.col("country_code")).alias("current_partner_manager"),
            F.col("geographic_region_code").alias("current_commercial_region_code"))

    def api_clients(self) -> DataFrame:
        s = self.raw("supplier")
        key = F.col("s_suppkey").cast("string")
        return s.select(
            (F.col("s_suppkey") + 1).alias("_api_client_key"),
            key.alias("api_client_id"),
            F.concat(F.lit("App "), key).alias("app_name"),
            F.when(F.col("s_acctbal") >= 0, "public").otherwise("custom").alias("app_type"),
            F.concat(F.col("s_name"), F.lit(" app")).alias("name"),
            F.concat(F.lit("Provider "), F.col("s_nationkey").cast("string")).alias("channel_provider_name"),
            F.concat(F.lit("app-"), key).alias("handle"),
            F.concat(F.lit("app-"), key, F.lit("-handle")).alias("app_handle"),
            F.when(F.col("s_acctbal") >= 1000, F.col("s_suppkey")).alias("partner_id"),
            (F.col("s_suppkey") * CUSTOMERS_PER_SUPPLIER).alias("application_developer_shop_id"))

    # ------------------------------------------------------------------ GMV facts
    def order_lines(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        """Line items with the shop (``o_custkey``) and order date of their order; bounds are on the ship date."""
        o = self.raw("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
        return self.dated("lineitem", "l_shipdate", since, until).join(o, "l_orderkey")

    def app_gmv_daily(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        lines = self.order_lines(since, until)
        gmv = money("l_extendedprice")
        zero = F.lit(0).cast("decimal(18,2)")
        return lines.select(
            (F.col("o_custkey") + 1).alias("_shop_key"),
            F.col("o_custkey").alias("shop_id"),
            (F.col("l_suppkey") + 1).alias("_api_client_key"),
            F.col("l_suppkey").cast("string").alias("api_client_id"),
            shifted_date("l_shipdate").alias("date"),
            F.when(F.col("l_returnflag") == "N", gmv).otherwise(zero).alias("total_platform_gmv_usd"),
            F.when(F.col("l_returnflag") != "N", gmv).otherwise(zero).alias("total_off_platform_gmv_usd"),
            gmv.alias("total_gmv_usd"))

    def gmv_facts(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        lines = self.order_lines(since, until)
        amount = money("l_extendedprice")
        return lines.select(
            F.col("l_orderkey").cast("string").alias("order_id"),
            (F.col("o_custkey") + 1).alias("_shop_key"),
            (F.col("l_partkey") % len(GATEWAYS)).alias("_payment_gateway_key"),
            shifted("l_shipdate").alias("reported_at"),
            F.col("l_linenumber").cast("string").alias("transaction_index"),
            amount.alias("transaction_amount_usd"),
            F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).alias("gmv_adjustment_usd"),
            F.when(F.col("l_linestatus") == "F", "Included in Reported GMV")
             .otherwise("Excluded from Reported GMV").alias("reported_gmv_inclusion_status"))

    def gateways(self) -> DataFrame:
        schema = T.StructType([
            T.StructField("_payment_gateway_key", T.LongType(), False),
            T.StructField("payment_gateway_name", T.StringType(), False),
            T.StructField("payment_gateway_category", T.StringType(), False),
        ])
        return literal_table(self.spark, GATEWAYS, schema)

    def fulfillments(self) -> DataFrame:
        return (self.raw("lineitem").filter(F.col("l_returnflag") == "A")
                .select(F.col("l_orderkey").cast("string").alias("order_id")))

    def calendar(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        """Date dimension: every shifted order date with its year as a string."""
        d = shifted_date("o_orderdate")
        return self.dated("orders", "o_orderdate", since, until).select(d.alias("date"), F.year(d).cast("string").alias("year"))

    def channel_gmv_daily(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        d = shifted_date("o_orderdate")
        return self.dated("orders", "o_orderdate", since, until).select(
            (F.col("o_custkey") + 1).alias("_shop_key"),
            F.col("o_custkey").alias("shop_id"),
            F.trunc(d, "month").alias("month"),
            d.alias("date"),
            money("o_totalprice").alias("channel_gmv_usd"),
            (F.col("o_orderstatus") != "P").alias("is_platform_gmv"))

    def channel_gmv_monthly(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        d = shifted_date("o_orderdate")
        return self.dated("orders", "o_orderdate", since, until).select(
            F.col("o_custkey").alias("shop_id"),
            F.trunc(d, "month").alias("month_begin_date"),
            money("o_totalprice").alias("channel_gmv_usd"),
            (F.col("o_orderstatus") != "P").alias("is_platform_gmv"))

    def checkout_daily(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        one = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        gmv = money("o_totalprice")
        zero = F.lit(0).cast("decimal(18,2)")
        return self.dated("orders", "o_orderdate", since, until).select(
            F.col("o_custkey").alias("shop_id"),
            shifted_date("o_orderdate").alias("date"),
            F.when(one, 1).otherwise(0).cast("bigint").alias("checkout_one_checkouts"),
            F.when(one, 0).otherwise(1).cast("bigint").alias("checkout_classic_checkouts"),
            F.when(one, gmv).otherwise(zero).alias("checkout_one_gmv"),
            F.when(one, zero).otherwise(gmv).alias("checkout_classic_gmv"))

    def shop_daily_gmv(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        return self.dated("orders", "o_orderdate", since, until).select(
            F.col("o_custkey").alias("shop_id"),
            shifted_date("o_orderdate").alias("date"),
            money("o_totalprice").alias("daily_gmv_amount_usd"))

    def merchant_daily(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        return self.dated("orders", "o_orderdate", since, until).select(
            (idiv("o_custkey", SHOPS_PER_MERCHANT) + 1).alias("_merchant_key"),
            shifted_date("o_orderdate").alias("date"),
            money("o_totalprice").alias("gmv"))

    def shop_state_daily(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        gmv = money("o_totalprice")
        return self.dated("orders", "o_orderdate", since, until).select(
            F.col("o_custkey").alias("shop_id"),
            shifted("o_orderdate").alias("datetime"),
            gmv.alias("daily_gmv_usd"),
            (gmv * F.lit(0.03).cast("decimal(3,2)")).alias("daily_gross_platform_payments_revenue_amount_usd"))

    # ----------------------------------------------------------- line items, apps
    def line_items(self) -> DataFrame:
        lines = self.order_lines()
        return lines.select(
            shifted("o_orderdate").alias("created_at"),
            F.col("l_orderkey").alias("order_id"),
            F.col("o_custkey").alias("shop_id"),
            F.col("l_partkey").alias("product_id"),
            F.concat(F.lit("Item "), F.col("l_partkey").cast("string")).alias("title"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            money("l_extendedprice").alias("price"),
            F.when(F.col("l_linestatus") == "F", "fulfilled").alias("fulfillment_status"))

    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").cast("string").alias("product_id"),
            idiv("p_partkey", 2).alias("shop_id"),
            F.col("p_brand").alias("product_vendor"))

    def installs(self) -> DataFrame:
        lines = self.order_lines()
        return lines.select(
            F.col("o_custkey").alias("shop_id"),
            F.col("l_suppkey").cast("string").alias("api_client_id"),
            F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("bigint").alias("net_install_count"))

    # -------------------------------------------------------------------- checkout
    def checkout_events(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("shop_id"),
            F.col("event_type").alias("event_name"),
            F.concat(F.lit("chk-"), idiv("event_id", 2).cast("string")).alias("checkout_token"))

    def checkout_facts(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") != "error")
        return (e.groupBy(F.concat(F.lit("chk-"), idiv("event_id", 2).cast("string")).alias("checkout_token"))
                .agg(F.min("ts").alias("created_at"),
                     F.max("ts").alias("completed_at"),
                     (F.max("value") >= 25).alias("is_pay_user_at_time_of_checkout")))

    # ------------------------------------------------------------------------- CRM
    def campaigns(self) -> DataFrame:
        return self.raw("part").select(
            F.concat(F.lit("CMP-"), F.col("p_partkey").cast("string")).alias("id"),
            F.col("p_name").alias("name"),
            F.date_add(F.lit(dt.date(2021, 7, 1)), F.col("p_size") * 10)
             .cast("timestamp_ntz").alias("created_date"))

    def campaign_members(self) -> DataFrame:
        lead = F.concat(F.lit("LD-"), F.col("l_orderkey").cast("string"))
        return self.raw("lineitem").select(
            F.concat(F.lit("CMP-"), F.col("l_partkey").cast("string")).alias("campaign_id"),
            F.when(F.col("l_returnflag") != "N", lead).alias("lead_id"),
            lead.alias("lead_or_contact_id"))

    def leads(self) -> DataFrame:
        cust = F.col("o_custkey").cast("string")
        return self.raw("orders").select(
            F.concat(F.lit("LD-"), F.col("o_orderkey").cast("string")).alias("id"),
            F.when(F.col("o_orderstatus") == "F", "Qualified")
             .when(F.col("o_orderstatus") == "O", "Open").otherwise("Nurturing").alias("status"),
            F.concat(F.lit("Company "), cust).alias("company"),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("c"), cust, F.lit(".platform.example")))
             .when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("c"), cust, F.lit(".com"))).alias("domain_name"))

    def leads_history(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.concat(F.lit("LD-"), F.col("l_orderkey").cast("string")).alias("lead_id"),
            shifted("l_shipdate").alias("created_at"))

    def opportunities(self) -> DataFrame:
        rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
        stage = (F.when((rf == "A") & (ls == "F"), "Closed Won")
                 .when((rf == "R") & (ls == "F"), "Closed Lost")
                 .when((rf == "N") & (ls == "F"), "Disqualified")
                 .when(rf == "A", "Negotiation")
                 .when(rf == "R", "Discovery")
                 .otherwise("Proposal"))
        return self.raw("lineitem").select(
            F.concat(F.lit("CMP-"), F.col("l_partkey").cast("string")).alias("campaign_id"),
            stage.alias("stage_name"),
            money("l_extendedprice").alias("amount"))

    # ------------------------------------------------------------------ funnel mart
    def opportunity_dim(self, since: dt.date | None = None) -> DataFrame:
        """Opportunities: one per order, closed at some hour of a quarter's first day (not after the order's).

        ``since``: opportunities closed before that day aren't needed."""
        o = self.dated("orders", "o_orderdate", since and since - dt.timedelta(days=1), None)
        c = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        n = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
        r = self.raw("region")
        # Looked up for a customer, not for each of its orders.
        c = c.join(n, "c_nationkey").join(r, "r_regionkey").select("o_custkey", "r_regionkey", "r_name", country_of("c_nationkey", "region").alias("_region"),
                                                                  country_of("c_nationkey", "code").alias("_code"))
        region = F.col("_region")
        path = F.when(F.col("r_regionkey") % 2 == 0, "Inbound").otherwise("Outbound")
        closed = (F.date_trunc("quarter", shifted("o_orderdate")).cast("timestamp_ntz")
                  + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int")))
        return o.join(c, "o_custkey").select(
            F.col("o_orderkey").alias("_plus_opportunity_key"),
            closed.alias("opportunity_closed_date"),
            (F.col("o_orderstatus") != "O").alias("is_closed"),
            (F.col("o_orderstatus") == "F").alias("is_won"),
            # five more digits, so that seven count
            (money("o_totalprice") * F.lit("0.14285").cast("decimal(6,5)")).cast("decimal(25,7)").alias("monthly_contract_value"),
            path.alias("cost_center"),
            F.lower("r_name").alias("cost_center_track"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Enterprise")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "Mid-Market").otherwise("SMB").alias("market_segment"),
            region.alias("inferred_region"),
            F.col("_code").alias("inferred_country_code"),
            F.when(F.col("o_totalprice") >= 250000, "Large").otherwise("Core").alias("deal_type_category"),
            region.alias("sales_region"),
            F.when(F.col("o_orderstatus") == "F", "New").otherwise("Upgrade").alias("upgrade_type"),
            F.concat(F.lit("source "), F.lower("r_name")).alias("attributed_source"))

    def attribution_facts(self) -> DataFrame:
        ln = F.col("l_linenumber")
        weight = (F.when(ln == 1, F.lit("0.4")).when(ln == 2, F.lit("0.3333333333")).otherwise(F.lit("0.1"))
                  .cast("decimal(12,10)"))
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("_plus_opportunity_key"),
            (F.col("l_partkey") % TOUCHPOINTS).alias("_revenue_touchpoint_attribution_key"),
            (F.col("l_suppkey") % CHANNELS).alias("_plus_marketing_channel_key"),
            weight.alias("count_w_shaped"))

    def touchpoints(self) -> DataFrame:
        size = F.col("p_size")
        return self.raw("part").select(
            F.col("p_partkey").alias("_revenue_touchpoint_attribution_key"),
            F.col("p_name").alias("ad_campaign_name"),
            F.col("p_type").alias("ad_content"),
            F.col("p_brand").alias("keyword_text"),
            F.when(size <= 15, "Email").when(size <= 35, "Paid Social").otherwise("CPC").alias("medium"),
            F.concat(F.lit("tp-"), F.lower("p_type")).alias("touchpoint_source"))

    def marketing_channels(self) -> DataFrame:
        bal = F.col("s_acctbal")
        channel = F.when(bal < 3000, "Paid").when(bal < 6000, "Organic").otherwise("Partner")
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("_plus_marketing_channel_key"),
            channel.alias("marketing_channel"),
            F.concat(channel, F.lit(" > "), F.col("s_nationkey").cast("string"))
             .alias("adjusted_marketing_channel_path"),
            F.concat(channel, F.lit(" > all")).alias("marketing_channel_path"))

    def sources(self) -> DataFrame:
        r = self.raw("region")
        return r.select(
            F.col("r_regionkey").alias("_source_key"),
            F.when(F.col("r_regionkey") % 2 == 0, "Inbound").otherwise("Outbound")
             .alias("lead_acquisition_path"),
            F.lower("r_name").alias("lead_acquisition_sub_path"),
            F.concat(F.lit("source "), F.lower("r_name")).alias("cleaned_source"))

    def funnel_rollup_daily(self, since: dt.date | None = None) -> DataFrame:
        """Rollup rows, dated with their quarter's first day (not after the ship date); rows dated before ``since`` aren't needed.

        Lines with hardly a discount are days without activity: their measures are zero, as those of lost opportunities'
        attributed value are, so the stacked inputs of the mart share whole rows."""
        s = self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        n = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        # Looked up for a supplier, not for each of its lines.
        s = s.join(n, "s_nationkey").select("l_suppkey", "n_regionkey", country_of("s_nationkey", "region").alias("_region"),
                                            country_of("s_nationkey", "code").alias("_code"))
        region = F.col("_region")
        rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
        active = F.col("l_discount") >= 0.015
        one = lambda cond: F.when(active & cond, 1).otherwise(0).cast("bigint")
        return (self.dated("lineitem", "l_shipdate", since, None).join(s, "l_suppkey")
                .select(
                    F.trunc(shifted("l_shipdate"), "quarter").alias("date"),
                    F.col("n_regionkey").alias("_source_key"),
                    (F.col("l_partkey") % TOUCHPOINTS).alias("_revenue_touchpoint_attribution_key"),
                    (F.col("l_suppkey") % CHANNELS).alias("_plus_marketing_channel_key"),
                    F.when(rf == "A", "Enterprise").when(rf == "R", "Mid-Market")
                     .otherwise("SMB").alias("segment_for_quota"),
                    region.alias("merchant_region"),
                    F.col("_code").alias("country_code"),
                    F.when(F.col("l_quantity") >= 25, "Large").otherwise("Core").alias("deal_type"),
                    region.alias("sales_region"),
                    F.when(ls == "F", "New").otherwise("Upgrade").alias("upgrade_type"),
                    F.when(active, F.col("l_quantity")).otherwise(0).cast("bigint").alias("total_sessions"),
                    one(F.lit(True)).alias("net_new_leads"),
                    one(rf != "R").alias("qualified_leads"),
                    one(ls == "F").alias("prequalified_opportunity_transitions"),
                    one(F.col("l_discount") >= 0.05).alias("total_interested_opportunity_transitions"),
                    one((rf == "A") & (ls == "F")).alias("total_closed_won_opportunities"),
                    one((rf == "R") & (ls == "F")).alias("total_closed_lost_opportunities"),
                    one(F.col("l_linenumber") == 1).alias("created_opportunities")))
