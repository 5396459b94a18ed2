"""Properties from the test strategy: row counts kept by dimension joins, and
repeatable results for a fixed reporting date."""

from compare import SF_SMALL, normalise
from merchlens.plans.catalog import BUILDERS, QUERIES
from merchlens.sources.warehouse import Warehouse


def test_star_enrich_keeps_the_fact_row_count(spark):
    w = Warehouse(spark, SF_SMALL)
    assert BUILDERS["star_enrich"](w).count() == w.shop_merchant_lookup().count()


def test_tracker_has_one_row_per_cohort_pair(spark):
    tracker = QUERIES["merchant_tracker"](spark, SF_SMALL)
    cohort = QUERIES["cohort_semi_join"](spark, SF_SMALL)
    assert tracker.count() == cohort.count() == tracker.select("_merchant_key", "shop_id").distinct().count()


def test_dimension_keys_are_unique(spark):
    w = Warehouse(spark, SF_SMALL)
    for df, key in ((w.shops(), "_shop_key"), (w.shops(), "shop_id"), (w.merchants(), "_merchant_key"),
                    (w.partners(), "platform_partner_id"), (w.api_clients(), "_api_client_key"),
                    (w.campaigns(), "id"), (w.leads(), "id")):
        assert df.count() == df.select(key).distinct().count(), key


def test_results_repeat_for_a_fixed_reporting_date(spark):
    for name in ("churn_risk_list", "partner_outbound_list", "merchant_age_band_summary"):
        a = QUERIES[name](spark, SF_SMALL)
        b = QUERIES[name](spark, SF_SMALL)
        assert normalise(a.collect(), a.columns) == normalise(b.collect(), b.columns), name
