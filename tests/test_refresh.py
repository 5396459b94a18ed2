"""The multi-report job gives the same results as the queries run one by one."""

import os

from compare import SF_SMALL, normalise
from merchlens.plans.catalog import QUERIES
from merchlens.plans.refresh import refresh_reports

NAMES = ["regional_app_gmv_monthly", "merchant_tracker", "campaign_scorecard", "partner_outbound_list",
         "vendor_line_items", "kpi_mart"]


def test_refresh_matches_direct_queries(spark):
    written = refresh_reports(spark, SF_SMALL, names=NAMES)
    assert set(written) == set(NAMES)
    base = os.path.dirname(os.path.dirname(written[NAMES[0]]))
    assert os.listdir(base) == ["reports"]  # the shared tables are gone
    for name, path in written.items():
        got = spark.read.parquet(path)
        want = QUERIES[name](spark, SF_SMALL)
        assert sorted(got.columns) == sorted(want.columns), name
        assert normalise(got.collect(), got.columns) == normalise(want.collect(), want.columns), name
