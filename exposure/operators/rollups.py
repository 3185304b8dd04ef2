"""Progress, deadline, dashboard and history roll-ups.

Lists inside a roll-up (the departments of an advisory) are tables of their own, keyed by advisory, so
no advisory's list is ever gathered into one value.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.constants import (
    ACK_STATUSES, AUTO_DEPLOY_OWNER, CLOSED_ACKS, IN_PROGRESS_STATUSES, NO_DEPARTMENT, SLA_STATUSES,
    TRACKED_STATUSES,
)
from exposure.functions.deadlines import d_day, pct, sla_from_status, sla_status
from exposure.functions.severity import ack_ko, max_severity as max_sev, severity_ko, sla_ko
from exposure.operators.matching import active_matches
from exposure.operators.skew import first_per

AsOf = dt.date | str | Column


def ack_counts(ack: str = "ack_status") -> list[Column]:
    return [F.count_if(F.col(ack) == s).alias(s.lower()) for s in ACK_STATUSES]


def with_asset_count(notifications: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Notifications with ``_assets``, their number of assets: rows of the bridge table ``notification_id, asset_id`` if it is given, else
    the length of the list ``asset_ids`` (rows that were planned without lists have none)."""
    if assets is None:
        return notifications.withColumn("_assets", F.coalesce(F.size("asset_ids"), F.lit(0)))
    counts = assets.groupBy("notification_id").agg(F.count("asset_id").cast("int").alias("_assets"))
    return notifications.join(counts, "notification_id", "left").withColumn("_assets", F.coalesce("_assets", F.lit(0)))


# --- per advisory --------------------------------------------------------------------------------
def asset_progress(matches: DataFrame, keys: tuple[str, ...] = ("advisory_id",)) -> DataFrame:
    """Reply state of matched assets per advisory (or finer keys), with the percentage done."""
    return (
        matches.where("status = 'MATCHED'")
        .groupBy(*keys)
        .agg(F.count("*").alias("total"), *ack_counts())
        .withColumn("done_rate", pct(F.col("done"), F.col("total")))
    )


def max_severity(advisory_cve: DataFrame, cve: DataFrame) -> DataFrame:
    """Highest severity among the known codes of each advisory; null when none is known."""
    known = cve.select(F.col("cve_id").alias("cve_id_text"), "severity")
    return (
        advisory_cve.join(known, "cve_id_text", "left")
        .groupBy("advisory_id")
        .agg(max_sev("severity").alias("max_severity"))
        .withColumn("max_severity_ko", severity_ko("max_severity"))
    )


def _reply_state(notifications: DataFrame) -> DataFrame:
    closed = F.col("ack_status").isin(*CLOSED_ACKS)
    return notifications.groupBy("advisory_id").agg(F.count("*").alias("dept_total"), *ack_counts(), F.bool_and(closed).alias("all_done"), *_totals(notifications))


def _totals(notifications: DataFrame) -> list[Column]:
    """Sums of the assets of notifications, where they are counted."""
    if "_assets" not in notifications.columns:
        return []
    return [
        F.sum("_assets").alias("asset_total"),
        F.sum(F.when(F.col("ack_status") == "DONE", F.col("_assets")).otherwise(0)).alias("asset_done"),
    ]


def remediation(advisory: DataFrame, notifications: DataFrame, as_of: AsOf, assets: DataFrame | None = None) -> DataFrame:
    """Per advisory: reply counts, rates, asset totals, days to deadline and deadline class. ``assets`` as in :func:`with_asset_count`."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in
            ("dept_total", "none", "in_progress", "done", "unable", "asset_total", "asset_done")}
    r = advisory.join(_reply_state(with_asset_count(notifications, assets)), "advisory_id", "left").withColumns(zero)
    answered = F.col("dept_total") - F.col("none")
    return r.select(
        "advisory_id", "doc_no", "title", "due_at",
        d_day("due_at", as_of).alias("d_day"),
        sla_status("due_at", F.coalesce("all_done", F.lit(False)), as_of).alias("sla_status"),
        *zero,
        pct(F.col("done"), F.col("dept_total")).alias("done_rate"),
        pct(answered, F.col("dept_total")).alias("responded_rate"),
    )


def remediation_rows(notifications: DataFrame, department: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Reply state of every notification, with department name and label. ``assets`` as in :func:`with_asset_count`."""
    dept = department.select("department_id", F.col("name").alias("department"))
    return with_asset_count(notifications, assets).join(dept, "department_id", "left").select(
        "advisory_id", "notification_id", "department_id", "department", "ack_status",
        ack_ko("ack_status").alias("ack_status_ko"), "ack_note", "ack_by", "ack_updated_at",
        F.col("_assets").alias("asset_count"), "sent_at", "reminded_at", "reminder_count", "channels",
    )


def sla_by_advisory(advisory: DataFrame, notifications: DataFrame, as_of: AsOf) -> DataFrame:
    """Deadline class of each tracked advisory; one without notifications cannot be done."""
    tracked = advisory.where(F.col("status").isin(*TRACKED_STATUSES))
    closed = notifications.groupBy("advisory_id").agg(
        F.bool_and(F.col("ack_status").isin(*CLOSED_ACKS)).alias("all_done")
    )
    return tracked.join(closed, "advisory_id", "left").select(
        "advisory_id",
        sla_status("due_at", F.coalesce("all_done", F.lit(False)), as_of).alias("sla_status"),
    )


def sla_overview(advisory: DataFrame, notifications: DataFrame, as_of: AsOf) -> DataFrame:
    """Number of tracked advisories per deadline class; classes without any are listed with 0."""
    counts = sla_by_advisory(advisory, notifications, as_of).agg(
        *[F.count_if(F.col("sla_status") == s).alias(s) for s in SLA_STATUSES]
    )
    pairs = [F.struct(F.lit(s).alias("sla_status"), F.col(s).alias("advisories")) for s in SLA_STATUSES]
    return counts.select(F.inline(F.array(*pairs)))


def department_progress(notifications: DataFrame, department: DataFrame) -> DataFrame:
    """Share of notifications answered DONE per department."""
    per = notifications.groupBy("department_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("ack_status") == "DONE").alias("done")
    )
    return per.join(department.select("department_id", "name"), "department_id", "left").select(
        "department_id",
        F.coalesce("name", F.col("department_id").cast("string")).alias("dept"),
        pct(F.col("done"), F.col("total")).alias("pct"),
    )


def department_done(
    advisory: DataFrame, matches: DataFrame, asset: DataFrame, notifications: DataFrame
) -> DataFrame:
    """Per (advisory, department): all matched assets DONE, else the latest notification DONE."""
    keys = ["advisory_id", "department_id"]
    by_assets = active_matches(matches, asset).groupBy(*keys).agg(
        F.bool_and(F.col("ack_status") == "DONE").alias("_assets")
    )
    by_reply = latest_ack(notifications).select(*keys, (F.col("ack_status") == "DONE").alias("_reply"))
    return (
        by_assets.join(by_reply, keys, "full_outer")
        .join(advisory.select("advisory_id"), "advisory_id", "left_semi")
        .select(*keys, F.coalesce("_assets", "_reply", F.lit(False)).alias("done"))
    )


def latest_ack(notifications: DataFrame) -> DataFrame:
    """Last notification by id per (advisory, department)."""
    return first_per(notifications, ["advisory_id", "department_id"], F.col("notification_id").desc())


def advisory_done(
    advisory: DataFrame, matches: DataFrame, asset: DataFrame, notifications: DataFrame
) -> DataFrame:
    """All matched assets DONE, else all notifications DONE, else status COMPLETED."""
    by_assets = active_matches(matches, asset).groupBy("advisory_id").agg(
        F.bool_and(F.col("ack_status") == "DONE").alias("_assets")
    )
    by_reply = notifications.groupBy("advisory_id").agg(
        F.bool_and(F.col("ack_status") == "DONE").alias("_reply")
    )
    done = F.coalesce("_assets", "_reply", F.col("status") == "COMPLETED")
    return (
        advisory.join(by_assets, "advisory_id", "left")
        .join(by_reply, "advisory_id", "left")
        .select("advisory_id", done.alias("done"))
    )


# --- impact --------------------------------------------------------------------------------------
def _product(prefix: str = "") -> Column:
    return F.coalesce(F.nullif(F.col(f"{prefix}product_raw"), F.lit("")), F.col(f"{prefix}product_key"))


def _sorted_values(rows: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Sorted distinct values per key. Repeats go in a plain aggregate first, so only short lists are built."""
    distinct = rows.select(*keys, value.alias(out)).where(F.col(out).isNotNull()).distinct()
    return distinct.groupBy(*keys).agg(F.sort_array(F.collect_list(out)).alias(out))


def _empty_list(c: str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>")).alias(c)


def impact_departments(matches: DataFrame, asset: DataFrame, department: DataFrame) -> DataFrame:
    """Per (advisory, department): distinct assets and the sorted owners."""
    keys = ["advisory_id", "department_id"]
    m = active_matches(matches, asset)
    counts = m.select(*keys, "asset_id").distinct().groupBy(*keys).agg(F.count("*").alias("asset_count"))
    owners = _sorted_values(m, keys, F.nullif(F.col("owner_name"), F.lit("")), "owners")
    return (
        counts.join(owners, keys, "left")
        .join(department.select("department_id", F.col("name").alias("department")), "department_id")
        .select(*keys, "department", "asset_count", _empty_list("owners"))
    )


def impact(matches: DataFrame, asset: DataFrame) -> DataFrame:
    """Per advisory: affected departments, products (sorted) and match rows."""
    m = active_matches(matches, asset)
    per = m.groupBy("advisory_id", "department_id").agg(F.count("*").alias("n"))
    counts = per.groupBy("advisory_id").agg(
        F.count("department_id").alias("affected_dept_count"), F.sum("n").alias("affected_asset_count")
    )
    products = _sorted_values(m, ["advisory_id"], F.nullif(_product(), F.lit("")), "affected_products")
    return counts.join(products, "advisory_id", "left").select(
        "advisory_id", "affected_dept_count", _empty_list("affected_products"), "affected_asset_count"
    )


# --- dashboard -----------------------------------------------------------------------------------
def dashboard_stats(
    advisory: DataFrame, advisory_cve: DataFrame, asset: DataFrame, matches: DataFrame,
    notifications: DataFrame, as_of: AsOf,
) -> DataFrame:
    """The five headline numbers, one row each (``key, value``)."""
    from exposure.operators.notify import due_reminders

    def one(df: DataFrame, key: str, value: Column) -> DataFrame:
        return df.agg(value.cast("long").alias("value")).select(F.lit(key).alias("key"), "value")

    target = matches.where("status = 'MATCHED'").agg(F.count_distinct("asset_id").alias("n"))
    all_assets = asset.agg(F.count("*").alias("n")).scalar()
    parts = [
        one(advisory, "in_progress", F.count_if(F.col("status").isin(*IN_PROGRESS_STATUSES))),
        one(
            advisory_cve.where("lookup_status = 'NOT_FOUND'"), "not_found_cve", F.count_distinct("cve_id_text")
        ),
        target.select(
            F.lit("target_assets").alias("key"),
            F.when(F.col("n") > 0, F.col("n")).otherwise(all_assets).cast("long").alias("value"),
        ),
        one(
            sla_by_advisory(advisory, notifications, as_of), "overdue",
            F.count_if(F.col("sla_status") == "OVERDUE"),
        ),
        one(due_reminders(advisory, notifications, as_of), "due_reminders", F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def advisory_brief(
    advisory: DataFrame, advisory_cve: DataFrame, as_of: AsOf, matches: DataFrame | None = None
) -> DataFrame:
    """List entry of an advisory: days to deadline, class from its status, code counts."""
    from exposure.operators.matching import cve_summary

    out = advisory.join(cve_summary(advisory_cve), "advisory_id", "left").select(
        "advisory_id", "doc_no", "title", "source_org", "receive_channel", "received_at", "due_at",
        d_day("due_at", as_of).alias("d_day"),
        sla_from_status("status", "due_at", as_of).alias("sla_status"),
        "status",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("extracted", "found", "not_found")],
        F.col("board_published_at").isNotNull().alias("board_published"), "board_published_at", "created_at",
    )
    if matches is not None:
        n = matches.where("status = 'MATCHED'").groupBy("advisory_id").agg(F.count("*").alias("match_count"))
        out = out.join(n, "advisory_id", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    return out


# --- history -------------------------------------------------------------------------------------
def notification_owners(
    notifications: DataFrame, asset: DataFrame, sentinel: str = AUTO_DEPLOY_OWNER, assets: DataFrame | None = None
) -> DataFrame:
    """Sorted distinct owners of the assets of each notification, without the auto-deploy entry. ``assets`` is the bridge table
    ``notification_id, asset_id``; without it the lists are taken."""
    if assets is None:
        ids = notifications.select("notification_id", F.explode("asset_ids").alias("asset_id"))
    else:
        ids = assets.select("notification_id", "asset_id").join(notifications.select("notification_id"), "notification_id", "left_semi")
    owned = ids.join(asset.select("asset_id", "owner_name"), "asset_id").where(
        F.col("owner_name").isNotNull() & (F.col("owner_name") != sentinel)
    )
    return owned.groupBy("notification_id").agg(F.sort_array(F.collect_set("owner_name")).alias("owners"))


def owners_except(owners: Column | str, sentinel: str = AUTO_DEPLOY_OWNER) -> Column:
    """Distinct owners of a list without nulls, blanks and the auto-deploy entry; order kept."""
    c = F.col(owners) if isinstance(owners, str) else owners
    return F.array_distinct(F.filter(c, lambda x: F.coalesce(x, F.lit("")).isin("", sentinel) == F.lit(False)))


def history_departments(
    notifications: DataFrame, asset: DataFrame, department: DataFrame, sentinel: str = AUTO_DEPLOY_OWNER,
    assets: DataFrame | None = None,
) -> DataFrame:
    """Department rows of the history roll-up: reply state and owners of every notification. ``assets`` as in :func:`with_asset_count`."""
    owners = notification_owners(notifications, asset, sentinel, assets)
    dept = department.select("department_id", F.col("name").alias("department"))
    return (
        with_asset_count(notifications, assets).join(owners, "notification_id", "left")
        .join(dept, "department_id", "left")
        .select(
            "advisory_id", "notification_id", "department_id", "department",
            F.coalesce("owners", F.array().cast("array<string>")).alias("owners"),
            F.nullif(F.array_join("owners", ", "), F.lit("")).alias("owner"),
            "ack_status", ack_ko("ack_status").alias("ack_status_ko"), "ack_note", "ack_by", "ack_updated_at",
            F.col("_assets").alias("asset_count"), "status", "reminder_count", "sent_at",
        )
    )


def history_rollup(
    advisory: DataFrame, notifications: DataFrame, advisory_cve: DataFrame, cve: DataFrame, as_of: AsOf
) -> DataFrame:
    """Per notified advisory: reply distribution, severity, deadline, rates."""
    state = _reply_state(notifications)
    r = advisory.join(state, "advisory_id").join(max_severity(advisory_cve, cve), "advisory_id", "left")
    answered = F.col("dept_total") - F.col("none")
    return r.select(
        "advisory_id", "doc_no", "title", "source_org", "receive_channel", "due_at",
        d_day("due_at", as_of).alias("d_day"),
        sla_status("due_at", F.col("all_done"), as_of).alias("sla_status"),
        "max_severity", "max_severity_ko",
        F.col("board_published_at").isNotNull().alias("board_published"),
        "dept_total", "none", "in_progress", "done", "unable",
        pct(F.col("done"), F.col("dept_total")).alias("done_rate"),
        pct(answered, F.col("dept_total")).alias("responded_rate"),
    )


def history_filter(
    rollup: DataFrame, departments: DataFrame, q: str | None = None, ack_status: str | None = None
) -> DataFrame:
    """Advisories of the roll-up whose text matches ``q`` and that have a department with ``ack_status``."""
    from exposure.functions.text import contains_any

    out = rollup
    if q and q.strip():
        own = rollup.where(contains_any(["title", "doc_no", "source_org"], q)).select("advisory_id")
        by_dept = departments.where(contains_any(["department", "owner"], q)).select("advisory_id")
        out = out.join(own.union(by_dept).distinct(), "advisory_id", "left_semi")
    if ack_status:
        hit = departments.where(F.col("ack_status") == ack_status).select("advisory_id")
        out = out.join(hit, "advisory_id", "left_semi")
    return out


def history_by_department(departments: DataFrame) -> DataFrame:
    """Per department name: advisories in its care and how many are still open."""
    name = F.coalesce(F.nullif(F.col("department"), F.lit("")), F.lit(NO_DEPARTMENT))
    return departments.groupBy(name.alias("department")).agg(
        F.count("*").alias("advisories"),
        F.count_if(~F.col("ack_status").isin(*CLOSED_ACKS)).alias("open"),
    )


# --- report --------------------------------------------------------------------------------------
def report_summary(advisory: DataFrame, remediated: DataFrame) -> DataFrame:
    """Key/value sheet of the result report, one row per entry (``advisory_id, pos, key, value``)."""
    r = remediated.join(
        advisory.select("advisory_id", "source_org", "received_at"), "advisory_id"
    )

    def text(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))

    entries = [
        ("문서번호", text("doc_no")),
        ("제목", text("title")),
        ("발신기관", text("source_org")),
        ("접수일", text("received_at")),
        ("조치기한", text("due_at")),
        ("SLA 상태", sla_ko("sla_status")),
        ("대상 부서", F.format_string("%d개", "dept_total")),
        (
            "조치 완료율",
            F.format_string(
                "%d%%  (완료 %d / 진행중 %d / 불가 %d / 미회신 %d)",
                "done_rate", "done", "in_progress", "unable", "none",
            ),
        ),
        ("대상 자산", F.format_string("%d대 (조치완료 %d대)", "asset_total", "asset_done")),
    ]
    rows = [
        F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), v.alias("value"))
        for i, (k, v) in enumerate(entries, 1)
    ]
    return r.select("advisory_id", F.inline(F.array(*rows)))


def report_departments(rows: DataFrame) -> DataFrame:
    """Department sheet: reply state in display form. Takes :func:`remediation_rows`."""
    return rows.select(
        "advisory_id", "notification_id", "department", "asset_count",
        F.coalesce(F.array_join("channels", " · "), F.lit("")).alias("channels"),
        "ack_status_ko", F.coalesce("ack_by", F.lit("")).alias("ack_by"),
        F.coalesce(F.date_format("ack_updated_at", "yyyy-MM-dd HH:mm"), F.lit("")).alias("ack_at"),
        F.coalesce("ack_note", F.lit("")).alias("ack_note"),
    )


def report_assets(matches: DataFrame, asset: DataFrame, department: DataFrame, cve: DataFrame) -> DataFrame:
    """Asset sheet: every active match with its asset and severity label."""
    m = (
        active_matches(matches, asset)
        .join(department.select("department_id", F.col("name").alias("department")), "department_id", "left")
        .join(cve.select(F.col("cve_id").alias("cve_id_text"), "severity"), "cve_id_text", "left")
    )
    version = F.coalesce(F.nullif(F.col("version_raw"), F.lit("")), F.col("version_norm"))
    return m.select(
        "advisory_id", F.col("cve_id_text").alias("cve"), "asset_no",
        F.coalesce("department", F.lit("")).alias("department"), _product().alias("product"),
        version.alias("version"), F.coalesce("ip", F.lit("")).alias("ip"),
        F.coalesce("owner_name", F.lit("")).alias("owner"),
        F.coalesce(severity_ko("severity"), F.lit("")).alias("severity"),
    )


def report_cves(advisory_cve: DataFrame, cve: DataFrame) -> DataFrame:
    """CVE sheet: known codes with product, severity label and affected versions."""
    from exposure.functions.version import rule_label

    c = cve.withColumnRenamed("cve_id", "cve_id_text")
    return advisory_cve.select("advisory_id", "cve_id_text").join(c, "cve_id_text").select(
        "advisory_id", F.col("cve_id_text").alias("cve"), F.col("product_name").alias("product"),
        severity_ko("severity").alias("severity"), rule_label("version_rule").alias("versions"),
        "description", "source",
    )
