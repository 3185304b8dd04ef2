"""Dates, days to deadline, deadline classes and percentages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.constants import FINISHED_STATUSES, IMMINENT_DAYS
from exposure.functions.text import as_col


def as_date(as_of: Column | dt.date | str) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(as_of))


def parse_date_any(text: Column | str) -> Column:
    """First ten characters read as ``Y-m-d``, ``Y.m.d`` or ``Y/m/d``; null otherwise."""
    s = F.left(as_col(text).cast("string"), F.lit(10))
    # the layout is checked first: a failed parse costs far more than a match
    return F.when(s.rlike(r"^\d{4}([-./])\d{1,2}\1\d{1,2}$"), F.try_to_date(F.translate(s, "./", "--"), "yyyy-M-d"))


def parse_date_strict(text: Column | str) -> Column:
    s = F.left(as_col(text).cast("string"), F.lit(10))
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))


def d_day(due: Column | str, as_of: Column | dt.date | str) -> Column:
    return F.date_diff(as_col(due), as_date(as_of))


def _by_days(days: Column) -> Column:
    return (
        F.when(days.isNull(), "NORMAL").when(days < 0, "OVERDUE")
        .when(days <= IMMINENT_DAYS, "IMMINENT").otherwise("NORMAL")
    )


def sla_status(due: Column | str, all_done: Column, as_of: Column | dt.date | str) -> Column:
    """Deadline class where completion comes from the departments' replies."""
    return F.when(all_done, "DONE").otherwise(_by_days(d_day(due, as_of)))


def sla_from_status(status: Column | str, due: Column | str, as_of: Column | dt.date | str) -> Column:
    """Deadline class where completion comes from the advisory's own status."""
    return F.when(as_col(status).isin(*FINISHED_STATUSES), "DONE").otherwise(_by_days(d_day(due, as_of)))


def pct(part: Column, whole: Column) -> Column:
    """Whole percent, half to even; 0 for an empty whole."""
    return F.when(whole > 0, F.bround(part / whole * 100)).otherwise(F.lit(0.0)).cast("int")
