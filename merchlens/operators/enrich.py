"""Star-schema enrichment and presentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_enrich(fact: DataFrame, dims: Sequence[tuple[DataFrame, str | list[str], Sequence[str]]]) -> DataFrame:
    """Chain of left joins from a fact to dimensions, selected columns only.

    Each entry is ``(dimension, key, columns)``; only ``key`` plus ``columns``
    of the dimension are carried, so the scan of the dimension is pruned.
    Row count is preserved when dimension keys are unique. The join strategy
    (broadcast or shuffle) is left to Spark, which checks the dimension's
    size against ``spark.sql.autoBroadcastJoinThreshold`` and re-plans from
    measured sizes under adaptive execution.
    """
    out = fact
    for dim, key, cols in dims:
        keys = [key] if isinstance(key, str) else list(key)
        out = out.join(dim.select(*keys, *cols), keys, "left")
    return out


def party_fallback(df: DataFrame, primary_id: str, fallback_id: str, primary_name: str,
                   fallback_name: str, flag: str = "is_api_developed_by_a_shop",
                   id_out: str = "partner_shop_id", name_out: str = "partner_merchant_name") -> DataFrame:
    """Three outputs from one null test on ``primary_id``.

    When the primary party is missing the flag is true and the fallback id
    and name are used; otherwise the primary ones.
    """
    missing = F.col(primary_id).isNull()
    return df.withColumns({
        flag: missing,
        id_out: F.when(missing, F.col(fallback_id)).otherwise(F.col(primary_id)),
        name_out: F.when(missing, F.col(fallback_name)).otherwise(F.col(primary_name)),
    })


def label_unknown(df: DataFrame, countries: DataFrame, key: str = "country_code",
                  name: str = "country_name", out: str = "country",
                  unknown: str = "Unknown country_name") -> DataFrame:
    """Left join to country names with a constant label for misses.

    The dimension is projected to the key and the name first, so no other of
    its columns can collide with the input's (S16). How it is joined is left to
    Spark's size check (a country table is small); a shuffled join of the few
    hot country codes would be split by adaptive skew handling.
    """
    names = countries.select(key, F.col(name).alias("__label_name"))
    return (df.join(names, key, "left")
            .withColumn(out, F.coalesce(F.col("__label_name"), F.lit(unknown)))
            .drop("__label_name"))


def display_projection(df: DataFrame, mapping: Sequence[tuple[str, str]]) -> DataFrame:
    """Order and rename columns for display; names may hold blanks, ``($)``, ``(#)``."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping])
