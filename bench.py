"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from exposure.operators import board as B, feeds as FD, matching as M, notify as N, rollups as R
from exposure.operators.advisories import extract_codes
from exposure.plans.catalog.notifications import active
from exposure.plans.demo import AS_OF, Views
from exposure.plans.exposure_report import department_exposure
from exposure.plans.matching_run import run_matching
from exposure.session import local_session
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def headline(v: Views) -> dict[str, "callable"]:
    at = F.lit("2024-05-05 05:05:05").cast("timestamp")
    return {
        "extract_codes": lambda: extract_codes(v.advisory_text),
        "lookup_cves": lambda: M.lookup_cves(v.codes.drop("lookup_status"), v.cve),
        "match_assets": lambda: M.match_assets(v.codes, v.cve, v.asset),
        "department_exposure": lambda: department_exposure(v.codes, v.cve, v.asset, v.department),
        "run_matching": lambda: run_matching(
            v.advisory, v.codes, v.cve, v.asset, v.match, v.exclusion_rule)["matches"],
        "upsert_cves": lambda: FD.upsert_cves(
            v.cve.drop("affected_versions"), FD.normalize_feed(v.feed_record), at, 1),
        "match_summary": lambda: M.match_summary(v.match, v.asset),
        "asset_progress": lambda: R.asset_progress(v.match),
        "impact": lambda: R.impact(v.match, v.asset),
        "remediation": lambda: R.remediation(v.advisory, v.notification, AS_OF),
        "history_rollup": lambda: R.history_rollup(v.advisory, v.notification, v.codes, v.cve, AS_OF),
        "history_departments": lambda: R.history_departments(v.notification, v.asset, v.department),
        "board_view": lambda: B.board_view(
            v.advisory, v.codes, v.cve, v.match, v.asset, v.department, v.notification, v.comment, AS_OF, q="r1"),
        "plan_notifications": lambda: N.plan_notifications(active(v), v.department, v.advisory, v.notification),
        "message_lines": lambda: N.message_lines(active(v), v.cve),
    }


def run(df: DataFrame) -> None:
    """Work out every row without keeping it."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    v = Views(spark, sf)
    times: dict[str, float] = {}
    t0 = time.time()
    v.codes, v.match  # the stored tables are prepared before the clock of the queries starts
    print(f"prepared stored tables in {time.time() - t0:.1f}s", file=sys.stderr)
    for name, build in headline(v).items():
        t = time.time()
        run(build())
        times[name] = round(time.time() - t, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))


if __name__ == "__main__":
    main()
