"""Key-set filters: cohorts, activity, fulfilment and install sets.

All of them are semi joins. A semi join never multiplies the left side, and
Spark plans it as a broadcast or shuffled hash/sort-merge semi join depending
on the measured size of the key set (adaptive execution re-plans it at run
time), so no explicit broadcast hint is given for key sets whose size grows
with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cohort_semi_join(df: DataFrame, cohort: DataFrame, on: str | list[str],
                     cohort_on: str | None = None) -> DataFrame:
    """Keep rows of ``df`` whose key occurs in ``cohort`` (``key IN (SELECT ...)``).

    Two-hop cohorts (``shop IN lookup WHERE merchant IN active``) are built by
    semi-joining the lookup first and passing it as ``cohort``. Null keys
    never match, as with SQL ``IN``.
    """
    if cohort_on and isinstance(on, str) and cohort_on != on:
        cohort = cohort.select(F.col(cohort_on).alias(on))
    return df.join(cohort, on, "left_semi")


def activity_semi_join(dim: DataFrame, facts: DataFrame, on: str, since_condition: Column) -> DataFrame:
    """Dimension rows with at least one fact satisfying ``since_condition``.

    The facts are reduced to distinct keys first, which combines map-side: a
    key with very many facts is one row per map task in the shuffle.
    """
    return dim.join(facts.filter(since_condition).select(on).distinct(), on, "left_semi")


def fulfilled_orders(fulfillments: DataFrame, order_col: str = "order_id") -> DataFrame:
    """Number of fulfilments per order.

    Reports only use the key set; for that, semi-join against
    ``fulfillments`` directly, which needs no aggregation.
    """
    return fulfillments.groupBy(order_col).agg(F.count(F.lit(1)).alias("number_of_fulfillments"))


def app_install_shops(installs: DataFrame, api_client_id: str) -> DataFrame:
    """Shops with install facts for one app, with their net install count.

    The sum is computed but not filtered on, so shops whose installs net to
    zero are kept, as in the reference.
    """
    return (installs.filter(F.col("api_client_id") == api_client_id)
            .groupBy("shop_id").agg(F.sum("net_install_count").alias("install_count")))
