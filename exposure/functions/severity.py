"""Severity classes, ranks and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.constants import ACK_KO, ACTION_KO, SEVERITIES, SEVERITY_KO, SEVERITY_RANK, SLA_KO
from exposure.functions.text import as_col, blank_to_null, lookup, strip


def severity_from_cvss(score: Column | str) -> Column:
    s = as_col(score).cast("double")
    return (
        F.when(s.isNull(), "MEDIUM").when(s >= 9.0, "CRITICAL").when(s >= 7.0, "HIGH")
        .when(s >= 4.0, "MEDIUM").otherwise("LOW")
    )


def severity_from_any(text: Column | str, cvss: Column | str) -> Column:
    """Korean label, then class name, then the score, then MEDIUM."""
    label = strip(as_col(text))
    by_label = lookup(label, {ko: en for en, ko in SEVERITY_KO.items()})
    by_name = F.when(F.upper(label).isin(*SEVERITIES), F.upper(label))
    return F.coalesce(by_label, by_name, severity_from_cvss(as_col(cvss).try_cast("double")))


def severity_rank(severity: Column | str) -> Column:
    return lookup(severity, SEVERITY_RANK, F.lit(0))


def severity_ko(severity: Column | str) -> Column:
    return lookup(severity, SEVERITY_KO)


def ack_ko(ack: Column | str) -> Column:
    return lookup(ack, ACK_KO, as_col(ack))


def sla_ko(sla: Column | str) -> Column:
    return lookup(sla, SLA_KO, as_col(sla))


def action_ko(action: Column | str) -> Column:
    return lookup(action, ACTION_KO, as_col(action))


def max_severity(severity: Column | str) -> Column:
    """Aggregate: the highest ranked severity of a group, null for a group without any."""
    s = as_col(severity)
    return F.max_by(s, F.when(s.isNotNull(), severity_rank(s)))


def score_or_null(score: Column | str) -> Column:
    """A score of 0 or an empty field counts as missing; kept with one decimal."""
    n = score_number(score)
    return F.when(n != 0, n).try_cast("decimal(3,1)")


def score_number(score: Column | str) -> Column:
    """The score as it was given, not rounded."""
    return blank_to_null(strip(as_col(score).cast("string"))).try_cast("double")
