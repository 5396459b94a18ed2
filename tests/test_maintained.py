"""Stored layouts, refreshed days, carried totals, Bloom filters, bitmaps, range joins, salts and
key checks: the mechanism shows on the executed plan or in the files, and results equal the plain form."""

import datetime as dt
import os
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from compare import SF_SMALL, normalise
from merchlens.operators import bitmaps, bloom, checks, cohort, funnel, ranges, skew
from merchlens.operators.enrich import star_enrich
from merchlens.operators.trailing import DAY as DAY_COLUMN
from merchlens.operators.trailing import TrailingTotals
from merchlens.plans import catalog, maintained
from merchlens.plans.mart_store import DAY, MartStore, touched_days
from merchlens.sources import stored
from merchlens.sources.constants import DEFAULT_AS_OF
from merchlens.sources.warehouse import Warehouse


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    kept = {}

    def put(**settings):
        for name, value in settings.items():
            name = name.replace("__", ".")
            kept.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)
    yield put
    for name, value in kept.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def executed(df):
    """The final plan after the frame ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan()


def nodes(plan):
    """All operators of an executed plan, through adaptive stages."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        out.append(p)
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def metric(node, name):
    got = node.metrics().get(name)
    return got.get().value() if got.isDefined() else 0


def equal(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert normalise(a.collect(), a.columns) == normalise(b.collect(), b.columns)


# ------------------------------------------------------------------------ by month
def scans(plan, column):
    return [n for n in nodes(plan) if n.getClass().getSimpleName() == "FileSourceScanExec" and column in n.toString()]


@pytest.fixture(scope="module")
def monthly(spark):
    w = stored.MonthlyFunnel(spark, SF_SMALL).store()
    yield w
    w.drop()


def test_stored_tables_are_whole(spark, monthly):
    plain = Warehouse(spark, SF_SMALL)
    for name, extra in (("opportunity_dim", stored.CLOSED_MONTH), ("attribution_facts", stored.CLOSED_MONTH), ("funnel_rollup_daily", stored.ROLLUP_MONTH)):
        equal(getattr(monthly, name)().drop(extra), getattr(plain, name)())


@pytest.mark.parametrize("build", [catalog.q_kpi_mart, catalog.q_kpi_campaign_names, catalog.q_attributed_value_split])
def test_only_months_from_since_on_are_read(spark, monthly, conf, build):
    """Opportunities and attribution rows, with and without broadcasts; the attribution facts have no date of their own."""
    for threshold in ("10MB", "-1"):
        conf(spark__sql__autoBroadcastJoinThreshold=threshold)
        plan = executed(build(monthly))
        found = scans(plan, stored.CLOSED_MONTH)
        assert {t for n in found for t in ("attribution_facts", "opportunity_dim") if f"/{t}]" in n.toString()} == {"attribution_facts", "opportunity_dim"}
        months = stored.partition_values(spark, f"{monthly.folder}/opportunity_dim", stored.CLOSED_MONTH)
        since = (catalog.VALUE_SINCE if build is catalog.q_attributed_value_split else catalog.MART_SINCE).replace(day=1).isoformat()
        wanted = [m for m in months if m >= since]
        assert 0 < len(wanted) < len(months)
        for n in found:
            assert re.search(r"PartitionFilters: \[[^\]]*closed_month", n.toString()), n.toString()
            assert 0 < metric(n, "numPartitions") <= len(wanted)


def test_attribution_is_pruned_by_what_selects_opportunities(spark, monthly):
    """Dynamic pruning: opportunities of one month by a column that isn't stored by it."""
    opps = monthly.opportunity_dim().filter(F.to_date("opportunity_closed_date") == F.lit(dt.date(2022, 4, 1))).hint("broadcast")
    rows = funnel.value_rows(opps, monthly.attribution_facts(), monthly.touchpoints(), monthly.marketing_channels(), since="2019-02-01")
    plan = executed(rows)
    facts = [n for n in scans(plan, stored.CLOSED_MONTH) if "/attribution_facts]" in n.toString()]
    assert facts and all(metric(n, "numPartitions") == 1 for n in facts)


def test_attribution_without_opportunity_stays(spark, tmp_path):
    w = stored.MonthlyFunnel(spark, SF_SMALL, str(tmp_path / "t"))
    plain = Warehouse(spark, SF_SMALL)
    some = plain.opportunity_dim().filter("is_won")
    w.store(opps=some)
    equal(w.attribution_facts().drop(stored.CLOSED_MONTH), plain.attribution_facts())
    assert w.attribution_facts().filter(F.col(stored.CLOSED_MONTH).isNull()).count() > 0


# ------------------------------------------------------------------- days refreshed
def day_files(folder):
    return {d: {(f, os.stat(os.path.join(folder, d, f)).st_mtime_ns) for f in os.listdir(os.path.join(folder, d)) if f.endswith(".parquet")}
            for d in os.listdir(folder) if d.startswith(f"{DAY}=")}


def test_a_late_row_rewrites_its_day_alone(spark, monthly, tmp_path):
    store = MartStore(spark, str(tmp_path / "mart")).load(maintained.mart_of(monthly))
    equal(store.read(DEFAULT_AS_OF), catalog.q_kpi_mart(Warehouse(spark, SF_SMALL)))
    before = day_files(store.folder)
    day = dt.date(2022, 4, 1)
    late = monthly.funnel_rollup_daily().filter(F.col("date") == F.lit(day)).limit(1).withColumn("total_sessions", F.lit(1000).cast("bigint"))
    late = spark.createDataFrame(late.collect(), late.schema)

    class Later(stored.MonthlyFunnel):
        def funnel_rollup_daily(self, since=None):
            return super().funnel_rollup_daily(since).unionByName(late)

    later = Later(spark, SF_SMALL, monthly.folder)
    later._schemas = monthly._schemas
    days = touched_days(late.select("date"))
    assert days == [day]
    for _ in range(2):  # a refresh can be repeated
        assert store.refresh(maintained.mart_of(later), days) == [day]
        equal(store.rows(), maintained.mart_of(later))
    after = day_files(store.folder)
    assert set(after) == set(before) and [d for d in after if after[d] != before[d]] == [f"{DAY}={day}"]


def test_a_day_without_rows_goes(spark, monthly, tmp_path):
    mart = maintained.mart_of(monthly)
    store = MartStore(spark, str(tmp_path / "mart")).load(mart)
    day = dt.date(2022, 4, 1)
    left = mart.filter(F.to_date("event_date") != F.lit(day))
    assert store.refresh(left, [day]) == [] and store.refresh(left, []) == []
    equal(store.rows(), left)


# ------------------------------------------------------------------- carried totals
def test_carried_totals_equal_the_window(spark):
    rng = random.Random(3)
    start = dt.date(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), start + dt.timedelta(days=rng.randrange(40)), rng.choice([None, Decimal("0.10"), Decimal("-7.25"), Decimal("3.33")]), rng.randrange(-3, 4)) for _ in range(600)]
    facts = spark.createDataFrame(rows, "k int, date date, v decimal(18,2), n int")
    totals = TrailingTotals(spark, ["k"], {"v": "v", "n": "n"}).load(facts)
    at = (start + dt.timedelta(days=4), start + dt.timedelta(days=11))
    totals.build(*at)
    for step in (1, 1, 2, 7, 0, 5):
        after = (at[0] + dt.timedelta(days=step), at[1] + dt.timedelta(days=step))
        totals.advance(at, after)
        totals.advance(at, after)  # a step can be repeated
        at = after
        want = facts.filter((F.col("date") > F.lit(at[0])) & (F.col("date") <= F.lit(at[1]))).groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        equal(totals.totals(*at), want)
    with pytest.raises(ValueError):
        totals.advance(at, (at[0] - dt.timedelta(days=1), at[1]))
    with pytest.raises(TypeError):
        TrailingTotals(spark, ["k"], {"v": "v"}).load(facts.withColumn("v", F.col("v").cast("double")))
    totals.drop()
    assert not os.path.exists(totals.folder)


def test_a_step_reads_one_day_in_and_one_out(spark):
    facts = Warehouse(spark, SF_SMALL).merchant_daily()
    totals = TrailingTotals(spark, ["_merchant_key"], {"annual_gmv": "gmv"}).load(facts)
    held, day = [dt.date.fromisoformat(d) for d in stored.partition_values(spark, f"{totals.folder}/days", DAY_COLUMN)], dt.timedelta(days=1)
    out_day, in_day = held[300], held[700]
    for d in (out_day, in_day):
        found = [n for n in nodes(executed(totals.days(d - day, d))) if n.getClass().getSimpleName() == "FileSourceScanExec"]
        assert [metric(n, "numPartitions") for n in found] == [1]
    totals.build(out_day - day, in_day - day)
    merged = totals._merged([(totals._state(out_day - day, in_day - day), 1), (totals.days(in_day - day, in_day), 1), (totals.days(out_day - day, out_day), -1)])
    read = sum(metric(n, "numPartitions") for n in nodes(executed(merged)) if n.getClass().getSimpleName() == "FileSourceScanExec")
    assert read == 2  # the state isn't partitioned
    totals.drop()


# ---------------------------------------------------------------------- Bloom filters
def shuffled(plan):
    """Rows written by each exchange."""
    return [(n.toString(), metric(n, "shuffleRecordsWritten")) for n in nodes(plan) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]


def test_shuffled_fact_rows_fall_to_the_cohorts_share(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    n = 20_000
    fact = spark.range(n).select((F.col("id") % 5000).alias("k"), F.col("id").alias("v"))
    keys = spark.range(0, 100).select(F.col("id").alias("k"))
    plain, fast = cohort.cohort_semi_join(fact, keys, "k"), bloom.bloom_semi_join(fact, keys, "k")
    equal(plain, fast)
    moved = [max(r for _, r in shuffled(executed(df))) for df in (plain, fast)]
    share = n * 100 // 5000
    assert moved[0] == n and share <= moved[1] <= share + 0.03 * n, moved


def test_bloom_filter_has_no_false_negatives(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    fact = spark.createDataFrame([(v, str(v)) for v in values] + [(None, None)], "k bigint, s string")
    for on in ("k", "s"):
        keys = fact.select(on).limit(1000).union(fact.select(on).where(f"{on} IS NULL"))
        for words in (1, 64, 4096):
            equal(bloom.bloom_semi_join(fact, keys, on, words=words), fact.join(keys, on, "left_semi"))
        assert bloom.bloom_semi_join(fact, keys.limit(0), on).count() == 0
    with pytest.raises(ValueError):
        bloom.bloom_probe(fact, keys, "k", 2 * bloom.MAX_WORDS)
    assert bloom.words_for(10 ** 12) == bloom.MAX_WORDS and bloom.words_for(0) == 64


@pytest.mark.parametrize("name, plain, keys", [("vendor_line_items_bloom", "vendor_line_items", "order_id|product_id"), ("gateway_gmv_monthly_bloom", "gateway_gmv_monthly", "order_id"),
                                               ("cohort_gmv_bloom", None, "shop_id")])
def test_reports_shuffle_fewer_fact_rows(spark, conf, name, plain, keys):
    """Rows exchanged on the filtered keys."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")

    def of_cohort(spark, sf):
        w = Warehouse(spark, sf)
        return cohort.cohort_semi_join(w.shop_daily_gmv(), catalog.q_cohort_semi_join(w).select("shop_id"), "shop_id")

    def of_filter(spark, sf):
        w = Warehouse(spark, sf)
        return bloom.bloom_semi_join(w.shop_daily_gmv(), catalog.q_cohort_semi_join(w).select("shop_id"), "shop_id")

    pair = (catalog.QUERIES[plain], maintained.QUERIES[name]) if plain else (of_cohort, of_filter)
    moved = [sum(r for t, r in shuffled(executed(q(spark, SF_SMALL))) if re.search(rf"hashpartitioning\(({keys})#", t)) for q in pair]
    assert moved[1] < 0.7 * moved[0], moved


# -------------------------------------------------------------------- bucketed tables
def exchanges_on(plan, keys):
    return [t for t, _ in shuffled(plan) if re.search(rf"hashpartitioning\(({keys})#", t)]


@pytest.mark.parametrize("build, tables, keys", [
    (catalog.q_regional_app_gmv_monthly, dict(app_gmv_daily="_shop_key", shops="_shop_key"), "_shop_key"),
    (catalog.q_merchant_tracker, dict(shop_merchant_lookup="shop_id", shops="shop_id", checkout_daily="shop_id", app_gmv_daily="shop_id", shop_daily_gmv="shop_id", migration="shop_id"), "shop_id"),
    (catalog.q_regional_merchant_list, dict(gmv_facts="_shop_key", shops="_shop_key"), "_shop_key"),
    (catalog.q_vendor_line_items, dict(line_items="order_key", gmv_facts="order_id"), "order_id|order_key")])
def test_no_exchange_on_the_bucket_key(spark, conf, build, tables, keys):
    # Q12's products are few and broadcast, as they'd be at any size of the facts.
    limit = "12KB" if "line_items" in tables else "-1"
    conf(spark__sql__autoBroadcastJoinThreshold=limit, spark__sql__adaptive__autoBroadcastJoinThreshold=limit)
    w = stored.BucketedWarehouse(spark, SF_SMALL, tables, buckets=8).store()
    try:
        plain = executed(build(Warehouse(spark, SF_SMALL)))
        df = build(w)
        plan = executed(df)
        facts = [t for t in tables if t not in ("shops", "migration", "shop_merchant_lookup")]
        assert exchanges_on(plain, keys)
        bucketed = [n for n in nodes(plan) if n.getClass().getSimpleName() == "FileSourceScanExec" and "Bucketed: true" in n.toString()]
        assert len(bucketed) >= len(facts), [n.toString() for n in nodes(plan)]
        assert len(exchanges_on(plan, keys)) < len(exchanges_on(plain, keys))
        equal(df, build(Warehouse(spark, SF_SMALL)))
    finally:
        w.drop()


# -------------------------------------------------------------------- column statistics
def test_statistics_show_the_small_filtered_side(spark, conf):
    """Q10's filtered merchants: taken for the whole table without statistics, broadcast with them."""
    conf(spark__sql__autoBroadcastJoinThreshold="2KB", spark__sql__adaptive__enabled="false", spark__sql__cbo__enabled="false", spark__sql__cbo__joinReorder__enabled="false")
    w = stored.AnalyzedWarehouse(spark, SF_SMALL, ["state_facts", "merchants", "partners", "shops", "shop_state_daily"]).store()
    try:
        def referred():
            m = w.merchants().filter((F.col("merchant_country_name") == "Japan") & (F.col("merchant_type") == "Standard")).select("_merchant_key", "merchant_id", "merchant_name")
            return m, w.state_facts().join(m, "_merchant_key")

        def size(df):
            return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

        side, joined = referred()
        with_statistics, text = size(side), joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text
        conf(spark__sql__cbo__enabled="false", spark__sql__cbo__joinReorder__enabled="false")
        side, joined = referred()
        assert size(side) > 4 * with_statistics and "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        conf(spark__sql__cbo__enabled="true", spark__sql__cbo__joinReorder__enabled="true")
        equal(catalog.q_partner_outbound_list(w), catalog.q_partner_outbound_list(Warehouse(spark, SF_SMALL)))
    finally:
        w.drop()


# ---------------------------------------------------------------------------- bitmaps
def test_bitmap_counts_roll_up(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(6), rng.randrange(3), rng.choice([None, *(f"m{rng.randrange(90_000)}" for _ in range(3))])) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "day int, campaign int, member string")
    numbers = bitmaps.dictionary(df, "member")
    ids = [r[0] for r in numbers.select("value_id").collect()]
    assert sorted(ids) == list(range(df.select("member").dropna().distinct().count()))
    fine = bitmaps.value_bitmaps(df.join(numbers, "member"), ["day", "campaign"], "value_id")
    assert fine.agg(F.max(F.length(bitmaps.BITMAP))).first()[0] == 4096
    for groups in (["day", "campaign"], ["day"], ["campaign"], []):
        maps = fine if len(groups) == 2 else bitmaps.merged_bitmaps(fine, groups)
        equal(bitmaps.bitmap_counts(maps, groups, "n"), df.groupBy(*groups).agg(F.countDistinct("member").alias("n")))


# ------------------------------------------------------------------------- range joins
@pytest.fixture(scope="module")
def timed(spark):
    rng = random.Random(2)
    t0 = dt.datetime(2023, 1, 1)

    def rows(n, spread):
        return [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([t0 + dt.timedelta(seconds=rng.randrange(spread))] * 30 + [None]), i % 7) for i in range(n)]

    left = spark.createDataFrame(rows(300, 400_000), "k int, t timestamp_ntz, x int")
    right = spark.createDataFrame(rows(400, 400_000), "k int, s timestamp_ntz, y int")
    return left.union(left.limit(20)), right.union(right.limit(20))


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_banded_join_equals_the_literal_join(timed, how):
    left, right = timed
    hours = dt.timedelta(hours=7)
    l, r = left.alias("l"), right.alias("r")
    literal = l.join(r, (F.col("l.k") == F.col("r.k")) & (F.col("s") < F.col("t")) & (F.col("s") >= F.col("t") - F.expr("INTERVAL 7 HOURS")), how)
    literal = literal.select("l.*", "s", "y") if how == "inner" else literal
    equal(ranges.banded_range_join(left, right, "k", "t", "s", hours, how), literal)


def test_recent_counts_equal_the_literal_count(timed):
    left, right = timed
    want = {}
    for k, t, _ in left.collect():
        want[k, t] = sum(1 for a, s, _ in right.collect() if a == k and a is not None and s is not None and t is not None and t - dt.timedelta(hours=7) <= s < t)
    got = ranges.recent_counts(left, right, "k", "t", "s", dt.timedelta(hours=7), "n").collect()
    assert {(r["k"], r["t"]): r["n"] for r in got if r["k"] is not None and r["t"] is not None} == {k: v for k, v in want.items() if None not in k}


def test_a_hot_key_is_spread_over_its_buckets(spark, conf):
    """One key holds all rows: the tasks of the join share them by time."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__coalescePartitions__enabled="false")
    t0 = dt.datetime(2023, 1, 1)
    times = spark.range(4000).select(F.lit(1).alias("k"), (F.lit(t0) + F.make_dt_interval(mins=F.col("id").cast("int") * 60)).cast("timestamp_ntz").alias("t"))
    pairs = ranges.banded_range_join(times, times.withColumnRenamed("t", "s"), "k", "t", "s", dt.timedelta(days=2))
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


# ------------------------------------------------------------------------- salted joins
@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_the_plain_join(spark, how):
    fact = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(45)] + [(7, "again"), (None, "none")], "k bigint, name string")
    equal(skew.salted_join(fact, dim, "k", how, share=0.1), fact.join(dim, "k", how))
    assert skew.hot_keys(fact, "k", 0.1) == [7]


def test_salted_tasks_are_even(spark, conf):
    """A third of the rows on one key: the largest task stays below three times the median."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__coalescePartitions__enabled="false",
         spark__sql__shuffle__partitions="16")
    fact = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 4000).alias("k"), F.col("id").alias("v"))
    dim = spark.range(4000).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))

    def sizes(df):
        return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())

    plain, salted = sizes(fact.join(dim, "k", "left")), sizes(skew.salted_join(fact, dim, "k", salts=64))
    assert plain[-1] > 3 * plain[len(plain) // 2] and salted[-1] < 3 * salted[len(salted) // 2]


# -------------------------------------------------------------------------- key checks
def test_repeated_keys_are_reported_by_name_in_the_same_job(spark):
    fact = spark.createDataFrame([(1, 10), (2, 10), (2, None), (3, 30)], "a int, b int")
    good, bad = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z"), (9, "z")], "a int, n string"), spark.createDataFrame([(10, "p"), (10, "q"), (30, "r")], "b int, m string")
    seen = checks.KeyChecks()
    out = seen.enrich(fact, {"first": (good, "a", ["n"]), "second": (bad, "b", ["m"])})
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checked", "checked")
    rows = out.collect()
    with_checks = len(jobs.getJobIdsForGroup("checked"))
    spark.sparkContext.setJobGroup("plain", "plain")
    plain = star_enrich(fact, [(good, "a", ["n"]), (bad, "b", ["m"])]).collect()
    assert len(jobs.getJobIdsForGroup("plain")) == with_checks
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(repr, rows)) == sorted(map(repr, plain))
    assert seen.report() == {"first": {"before": 4, "after": 4, "without_key": 0}, "second": {"before": 4, "after": 6, "without_key": 1}}
    with pytest.raises(checks.RepeatedKeyError, match="second: 2 rows more"):
        seen.require_unique()


def test_unique_keys_pass(spark):
    seen = checks.KeyChecks()
    w = Warehouse(spark, SF_SMALL)
    seen.enrich(w.shop_merchant_lookup(), {"shops": (w.shops(), "shop_id", ["shop_name"]), "merchants": (w.merchants(), "_merchant_key", ["merchant_name"])}).collect()
    seen.require_unique()


def test_partitions_are_written_without_a_sample(spark, tmp_path):
    """Each row is computed once: a sample for ranges would compute all of them a second time."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(3000).selectExpr("id", "id % 3 AS part").mapInArrow(count, "id bigint, part bigint")
    stored.write_partitions(df, str(tmp_path / "t"), "part", ["id"])
    assert seen.value == 3000
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 3000 and back.select("part").distinct().count() == 3


def test_sparse_bitmaps_cost_a_word_a_value(spark):
    """Groups that hold few of many values: same counts at all levels, eight bytes a bitmap."""
    ids = spark.range(20_000).select((F.col("id") * 1_000 + F.col("id") % 70).alias("value_id"), (F.col("id") % 9).alias("day"), (F.col("id") % 4_500).alias("campaign"))
    df = ids.union(ids.withColumn("campaign", F.lit(1).cast("bigint"))).union(ids.limit(50)).union(spark.range(64 * 40).select("id", F.lit(3).cast("bigint"), F.lit(7).cast("bigint")))
    fine = bitmaps.value_bitmaps(df, ["day", "campaign"], "value_id", sparse=True)
    assert dict(fine.dtypes)[bitmaps.BITMAP] == "bigint"
    for groups in (["day", "campaign"], ["day"], ["campaign"], []):
        maps = fine if len(groups) == 2 else bitmaps.merged_bitmaps(fine, groups)
        equal(bitmaps.bitmap_counts(maps, groups, "n"), df.groupBy(*groups).agg(F.countDistinct("value_id").alias("n")))


def test_campaigns_bitmaps_are_sparse(spark, monkeypatch):
    kinds = []
    plain = bitmaps.value_bitmaps
    from merchlens.operators import campaign
    monkeypatch.setattr(campaign, "value_bitmaps", lambda *a, **k: kinds.append(dict(plain(*a, **k).dtypes)[bitmaps.BITMAP]) or plain(*a, **k))
    rows = spark.createDataFrame([(dt.date(2022, 1, 1 + i % 2), f"c{i % 3}", "member", f"m{i % 5}", False) for i in range(30)], "created_date date, campaign_id string, kind string, value string, nn boolean")
    out = {(r["level"], str(r["created_date"]), r["campaign_id"]): r["members"] for r in campaign.member_counts_rollup(rows).collect()}
    assert kinds == ["bigint"] and out["all", "None", None] == 5 and len(out) == 9 and set(out.values()) == {5}, (kinds, out)


def test_member_rows_are_computed_once(spark, monkeypatch):
    made = []
    plain = stored.stored
    monkeypatch.setattr(maintained, "stored", lambda df, purpose: made.append(purpose) or plain(df, purpose))
    df = maintained.QUERIES["campaign_members_rollup"](spark, SF_SMALL)
    assert made == ["member-rows"] and "lineitem.parquet" not in " ".join(df.inputFiles())


def test_selected_items_are_computed_once(spark, monkeypatch):
    """The items are stored; what follows reads them from there: line items' products are probed in no later plan."""
    made = []
    plain = stored.stored
    monkeypatch.setattr(maintained, "stored", lambda df, purpose: made.append(purpose) or plain(df, purpose))
    df = maintained.QUERIES["vendor_line_items_bloom"](spark, SF_SMALL)
    assert made == ["line-items"]
    assert "product_id#" not in " ".join(t for t, _ in shuffled(executed(df)))
