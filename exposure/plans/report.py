"""The result report: four tables, keyed by advisory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.operators import rollups as R


def report_tables(
    advisory: DataFrame, notifications: DataFrame, matches: DataFrame, asset: DataFrame, department: DataFrame,
    advisory_cve: DataFrame, cve: DataFrame, as_of: dt.date | str | Column, advisory_id: int | None = None,
) -> dict[str, DataFrame]:
    """``summary, departments, assets, cves`` for one advisory or for all of them."""

    def only(df: DataFrame) -> DataFrame:
        return df if advisory_id is None else df.where(F.col("advisory_id") == advisory_id)

    advisory, notifications = only(advisory), only(notifications)
    return {
        "summary": R.report_summary(advisory, R.remediation(advisory, notifications, as_of)),
        "departments": R.report_departments(R.remediation_rows(notifications, department)),
        "assets": R.report_assets(only(matches), asset, department, cve),
        "cves": R.report_cves(only(advisory_cve), cve),
    }
