"""bench.py prints one JSON line with the driver's fields (run in its own process,
since it stops its Spark session)."""

import json
import os
import subprocess
import sys

from compare import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_RUNS="1", BENCH_CPUS="2",
               BENCH_QUERIES="churn_risk_list,merchant_age_band_summary")
    done = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                          text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    lines = [line for line in done.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    out = json.loads(lines[0])
    assert out["unit"] == "sec" and out["sf"] == 0.001 and "errors" not in out
    assert set(out["queries"]) == {"churn_risk_list", "merchant_age_band_summary"}
    assert out["value"] == round(sum(out["queries"].values()), 3)
