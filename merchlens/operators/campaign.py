"""Campaign scorecard stages.

Campaign members are the large side here. The plan: select campaigns first
(date filter + semi join on the mart's campaign names), join their members,
attach each member's lead and, for qualified leads only, the time of their
first history row (one row per lead, so no member x history pairs are ever
formed), then reduce once to distinct (campaign, kind, value) rows, from which
members and companies are counted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lit_ts
from .bitmaps import bitmap_counts, dictionary, merged_bitmaps, value_bitmaps
from ..sources.constants import LOST_STAGE, OPEN_STAGES, WON_STAGE


def campaign_selector(campaigns: DataFrame, campaign_names: DataFrame, *,
                      since: str | dt.datetime = "2022-01-01", name_col: str = "ad_campaign_name") -> DataFrame:
    """Campaigns created from ``since`` on whose name occurs in the mart.

    The reference joins to ``DISTINCT name, region, medium`` rows of the mart,
    which repeats a campaign per (region, medium); every measure computed
    afterwards is a distinct count, so a semi join on the name is equal (S8).
    """
    if isinstance(since, str):
        since = dt.datetime.fromisoformat(since)
    names = campaign_names.select(F.col(name_col).alias("name"))
    return (campaigns.filter(F.col("created_date") >= lit_ts(since))
            .join(names, "name", "left_semi"))


def net_new_history(leads: DataFrame, history: DataFrame) -> DataFrame:
    """O22 helper: each lead with the time of its earliest history row.

    The reference left-joins history rows with ``created_at < campaign date``
    inside ON and tests for a miss. A miss happens exactly when the lead has
    no history row before that date, i.e. when ``first_history_at`` is null
    or not earlier — so one row per lead replaces the member x history pairs.
    """
    first = history.groupBy("lead_id").agg(F.min("created_at").alias("first_history_at"))
    return leads.join(first.withColumnRenamed("lead_id", "id"), "id", "left")


def member_rows(campaigns: DataFrame, members: DataFrame, leads: DataFrame, history: DataFrame,
                *, domain_suffix: str = "platform.example", qualified: str = "Qualified") -> DataFrame:
    """O21's tagged values: (created day, campaign id, name, kind, value, nn), one row a member ("member", id) and a qualified
    lead's company ("company", its name); ``nn``: net-new. Values of a campaign may repeat.

    Members whose lead's domain ends in ``domain_suffix`` are excluded;
    members without a lead are kept.
    """
    a = campaigns.select(F.col("id").alias("campaign_id"), "name", F.col("created_date").alias("created_at"))
    chosen = members.select("campaign_id", "lead_id", "lead_or_contact_id").join(a, "campaign_id")
    lead = leads.select(F.col("id").alias("_key"), "status", "company", "domain_name")
    # Only a qualified lead's first history row can matter.
    asked = lead.filter(F.col("status") == qualified).select(F.col("_key").alias("lead_id"))
    first = (history.join(asked, "lead_id", "left_semi").groupBy(F.col("lead_id").alias("_key"))
             .agg(F.min("created_at").alias("first_history_at")))
    # Members without a lead match nothing; keys of their own keep them from
    # meeting in one partition, and members are read once.
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("lead_or_contact_id"), F.lit(4096)).cast("string"))
    rows = (chosen.withColumn("_key", F.coalesce(F.col("lead_id").cast("string"), spread))
            .join(lead.join(first, "_key", "left"), "_key", "left")
            .filter(~F.coalesce(F.col("domain_name").endswith(domain_suffix), F.lit(False))))
    is_qualified = F.col("status") == qualified
    net_new = is_qualified & ~F.coalesce(F.col("first_history_at") < F.col("created_at"), F.lit(False))
    kinds = F.array(F.struct(F.lit("member").alias("kind"), F.col("lead_or_contact_id").alias("value"), F.lit(False).alias("nn")),
                    F.when(is_qualified & F.col("company").isNotNull(),
                           F.struct(F.lit("company").alias("kind"), F.col("company").alias("value"), net_new.alias("nn"))))
    return rows.select(F.to_date("created_at").alias("created_date"), "campaign_id", "name",
                       F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select(*MEMBER_KEYS, "k.*")


MEMBER_KEYS = ["created_date", "campaign_id", "name"]


def campaign_members_mql(campaigns: DataFrame, members: DataFrame, leads: DataFrame, history: DataFrame,
                         *, domain_suffix: str = "platform.example", qualified: str = "Qualified") -> DataFrame:
    """Per (created day, campaign id, name): members, MQL and net-new MQL.

    * members: distinct ``lead_or_contact_id``;
    * MQL: distinct companies of qualified leads;
    * net-new MQL: distinct companies of qualified leads with no history
      row before the campaign was created (S11: a company counts if any of
      its qualified leads qualifies).

    Three COUNT(DISTINCT ...) would be planned as an Expand that triples every
    member row. Instead every row becomes one or two tagged values
    (``member_rows``); (campaign, tag, value) is reduced to one row, which
    spreads a hot campaign, and both counts come from it.
    """
    tagged = member_rows(campaigns, members, leads, history, domain_suffix=domain_suffix, qualified=qualified)
    values = tagged.groupBy(*MEMBER_KEYS, "kind", "value").agg(F.max("nn").alias("nn"))
    company = F.col("kind") == "company"
    return values.groupBy(*MEMBER_KEYS).agg(
        F.count(F.when(~company, F.col("value"))).alias("members"),
        F.count(F.when(company, F.col("value"))).alias("MQL"),
        F.count(F.when(company & F.col("nn"), F.col("value"))).alias("net_new_mql"))


def member_counts_rollup(rows: DataFrame) -> DataFrame:
    """O21's counts at three levels (campaign, day, all), coarser levels merged from the campaigns' bitmaps.

    A member or company of several campaigns counts once a day and once over all. Columns: level, created_date, campaign_id
    (null above their level), members, MQL, net_new_mql.
    """
    tagged = F.concat_ws("\0", "kind", "value")  # members and companies share one dictionary
    marked = rows.withColumn("_tagged", tagged)
    numbered = marked.join(dictionary(marked, "_tagged"), "_tagged")
    measures = F.filter(F.array(F.when(F.col("kind") == "member", "members"), F.when(F.col("kind") == "company", "MQL"),
                                F.when((F.col("kind") == "company") & F.col("nn"), "net_new_mql")), lambda m: m.isNotNull())
    keys = ["created_date", "campaign_id"]
    maps = value_bitmaps(numbered.select(*keys, "value_id", F.explode(measures).alias("measure")), [*keys, "measure"], "value_id", sparse=True)
    day = merged_bitmaps(maps, ["created_date", "measure"])
    whole = merged_bitmaps(day, ["measure"])
    levels = []
    for level, of, held in (("campaign", maps, keys), ("day", day, keys[:1]), ("all", whole, [])):
        counts = bitmap_counts(of, [*held, "measure"], "n")
        pivoted = counts.groupBy(*held).agg(*[F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)).cast("bigint").alias(m)
                                              for m in ("members", "MQL", "net_new_mql")])
        nulls = {"created_date": F.lit(None).cast("date"), "campaign_id": F.lit(None).cast(maps.schema["campaign_id"].dataType)}
        levels.append(pivoted.withColumns({"level": F.lit(level), **{k: v for k, v in nulls.items() if k not in held}}))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def stage_pivot(opportunities: DataFrame, *, campaign_ids: DataFrame | None = None,
                won: str = WON_STAGE, lost: str = LOST_STAGE,
                open_stages: Sequence[str] = tuple(OPEN_STAGES)) -> DataFrame:
    """Per campaign, won / lost / in-progress amounts and opportunity counts.

    First per (campaign, stage): total amount and number of opportunities;
    then six conditional sums per campaign. ``campaign_ids`` optionally
    restricts the opportunities first (semi join on ``campaign_id``).
    """
    opps = opportunities
    if campaign_ids is not None:
        opps = opps.join(campaign_ids.select("campaign_id"), "campaign_id", "left_semi")
    per_stage = (opps.groupBy("campaign_id", "stage_name")
                 .agg(F.sum("amount").alias("total_amount"),
                      F.count(F.lit(1)).alias("number_of_opportunities")))
    stage = F.col("stage_name")
    is_open = stage.isin(list(open_stages))

    def pick(cond, col):
        return F.sum(F.when(cond, F.col(col)).otherwise(F.lit(0)))

    return per_stage.groupBy("campaign_id").agg(
        pick(stage == won, "total_amount").alias("closed_won_amount"),
        pick(stage == lost, "total_amount").alias("closed_lost_amount"),
        pick(is_open, "total_amount").alias("in_progress_amount"),
        pick(stage == won, "number_of_opportunities").alias("closed_won_optys"),
        pick(stage == lost, "number_of_opportunities").alias("closed_lost_optys"),
        pick(is_open, "number_of_opportunities").alias("in_progress_optys"),
    )
