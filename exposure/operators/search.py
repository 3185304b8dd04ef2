"""Filtered, ordered and paged listings, and the flattened rows they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.constants import MAX_AUDIT_PAGE, SYSTEM_LABEL
from exposure.functions.product import product_ver_label
from exposure.functions.severity import ack_ko, action_ko, severity_rank
from exposure.functions.text import ilike_any


def page_of(df: DataFrame, page: int = 1, size: int | None = None) -> DataFrame:
    """One page of an ordered listing; all rows without a size."""
    return df if size is None else df.offset((page - 1) * size).limit(size)


# --- orders --------------------------------------------------------------------------------------
def sort_by(df: DataFrame, *order: Column | str, page: int = 1, size: int | None = None) -> DataFrame:
    return page_of(df.orderBy(*order), page, size)


def sort_cves(df: DataFrame, page: int = 1, size: int | None = None) -> DataFrame:
    """Newest published first, undated last."""
    return sort_by(df, F.col("published_at").desc_nulls_last(), F.col("cve_id").desc(), page=page, size=size)


def sort_notifications(df: DataFrame, page: int = 1, size: int | None = None) -> DataFrame:
    return sort_by(
        df, F.col("sent_at").desc_nulls_last(), F.col("notification_id").desc(), page=page, size=size
    )


def sort_audit(df: DataFrame, page: int = 1, size: int | None = 50) -> DataFrame:
    if size is not None and size > MAX_AUDIT_PAGE:
        raise ValueError(f"a page of the audit trail has at most {MAX_AUDIT_PAGE} rows")
    return sort_by(df, F.col("created_at").desc(), F.col("audit_id").desc(), page=page, size=size)


def sort_history_due(df: DataFrame, page: int = 1, size: int | None = None) -> DataFrame:
    return sort_by(df, F.col("d_day").asc_nulls_last(), "advisory_id", page=page, size=size)


def sort_history(df: DataFrame, by: str = "due", page: int = 1, size: int | None = None) -> DataFrame:
    """``sev``: most severe first; ``prog``: most open departments first; ``due``: soonest first."""
    due = F.col("d_day").asc_nulls_last()
    orders = {
        "sev": [severity_rank("max_severity").desc()],
        "prog": [(F.col("dept_total") - F.col("done")).desc(), due],
        "due": [due],
    }
    return sort_by(df, *orders[by], "advisory_id", page=page, size=size)


def sort_reminders(df: DataFrame, page: int = 1, size: int | None = None) -> DataFrame:
    return sort_by(df, "d_day", "notification_id", page=page, size=size)


def sort_board(df: DataFrame, page: int = 1, size: int | None = None) -> DataFrame:
    return sort_by(df, F.col("board_published_at").desc(), F.col("advisory_id").desc(), page=page, size=size)


def recent_advisories(advisory: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` newest advisories."""
    return sort_by(advisory, F.col("created_at").desc(), F.col("advisory_id").desc(), size=k)


def sort_hits_first(department: DataFrame, q: str, name: str = "name") -> DataFrame:
    """Departments whose name contains the search text first, then by name."""
    hit = F.contains(F.lower(F.col(name)), F.lit(q.strip().lower()))
    return department.withColumn("hit", hit).orderBy(F.col("hit").desc(), name)


def sort_year_feed(df: DataFrame) -> DataFrame:
    """By year and id; a large year lies over several tasks, each with a range of its ids."""
    return df.repartitionByRange("cve_year", "cve_id").sortWithinPartitions("cve_year", "cve_id")


# --- searches ------------------------------------------------------------------------------------
def search_cves(
    cve: DataFrame, q: str | None = None, severity: str | None = None, source: str | None = None
) -> DataFrame:
    out = cve
    if q:
        out = out.where(ilike_any(["cve_id", "product_name", "description"], q))
    if severity:
        out = out.where(F.col("severity") == severity)
    return out.where(F.col("source") == source) if source else out


def search_assets(
    asset: DataFrame, department: DataFrame, department_name: str | None = None,
    product_key: str | None = None, q: str | None = None,
) -> DataFrame:
    """Assets with their department name; an unknown department gives no rows."""
    dept = department.select("department_id", F.col("name").alias("department"))
    if department_name:
        out = asset.join(dept.where(F.col("department") == department_name), "department_id")
    else:
        out = asset.join(dept, "department_id", "left")
    if product_key:
        out = out.where(F.col("product_key") == product_key)
    return out.where(ilike_any(["asset_no", "owner_name", "ip"], q)) if q else out


def list_advisories(
    briefs: DataFrame, status: str | None = None, source_org: str | None = None
) -> DataFrame:
    out = briefs
    if status:
        out = out.where(F.col("status") == status)
    return out.where(F.col("source_org") == source_org) if source_org else out


def search_audit(
    audit: DataFrame, user: DataFrame, advisory: DataFrame,
    entity_type: str | None = None, action: str | None = None,
) -> DataFrame:
    """Audit rows with action label, actor name and, for advisory entries, the advisory's title."""
    out = audit
    if entity_type:
        out = out.where(F.col("entity_type") == entity_type)
    if action:
        out = out.where(F.col("action") == action)
    titles = advisory.select(F.col("advisory_id"), F.col("title").alias("advisory_title"))
    linked = F.when(F.col("entity_type") == "advisory", F.col("entity_id"))
    return (
        out.withColumn("_adv", linked)
        .join(titles, F.col("_adv") == F.col("advisory_id"), "left")
        .join(user.select(F.col("user_id").alias("actor_id"), "display_name"), "actor_id", "left")
        .select(
            "audit_id", "created_at", "action", action_ko("action").alias("action_ko"),
            F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.lit(SYSTEM_LABEL)).alias("actor"),
            "entity_type", "entity_id", "advisory_id", "advisory_title", "detail",
        )
    )


def total(df: DataFrame) -> DataFrame:
    """Row count of a listing, for paging."""
    return df.agg(F.count("*").alias("total"))


def cve_stats(cve: DataFrame) -> DataFrame:
    """Number of CVEs and the time of the last change."""
    return cve.agg(
        F.count("*").alias("total"),
        F.coalesce(F.max("updated_at"), F.max("created_at")).alias("last_updated"),
    )


def feed_history(imports: DataFrame) -> DataFrame:
    """Imports with the time they took effect, newest first."""
    return imports.withColumn("time", F.coalesce("applied_at", "created_at")).orderBy(
        F.col("created_at").desc(), F.col("import_id").desc()
    )


def active_departments(department: DataFrame) -> DataFrame:
    return department.where("is_active").orderBy("name")


# --- flattened rows --------------------------------------------------------------------------------
def cve_view(cve: DataFrame) -> DataFrame:
    return cve.select(
        "cve_id", "product_name", "product_key", "affected_versions", "severity", "cvss_score", "description",
        "published_at", "source",
    )


def asset_view(asset: DataFrame, department: DataFrame) -> DataFrame:
    dept = department.select("department_id", F.col("name").alias("department"))
    return asset.join(dept, "department_id", "left").select(
        "asset_id", "asset_no", "department_id", "department", "product_raw", "product_key", "version_raw",
        "version_norm", "ip", "owner_name", "owner_team", "owner_contact", "status",
    )


def advisory_cve_view(advisory_cve: DataFrame, cve: DataFrame, counts: DataFrame) -> DataFrame:
    """Codes of advisories with the CVE's data and the number of active matches."""
    c = cve.select(
        F.col("cve_id").alias("cve_id_text"), "product_name", "product_key", "affected_versions", "severity",
        "description", "published_at", "source",
    )
    return (
        advisory_cve.join(c, "cve_id_text", "left")
        .join(counts, ["advisory_id", "cve_id_text"], "left")
        .withColumn("match_count", F.coalesce("match_count", F.lit(0)))
        .select(
            "advisory_id", "cve_id_text", "lookup_status", "product_name", "product_key", "affected_versions",
            "severity", "description", "published_at", "source", "match_count", "snippet",
        )
    )


def match_view(matches: DataFrame, asset: DataFrame, cve: DataFrame, department: DataFrame) -> DataFrame:
    """Matches with asset, owner, product and severity for display."""
    a = asset.select(
        "asset_id", "asset_no", "ip", "department_id", "owner_name", "owner_team", "owner_contact",
        F.coalesce(F.nullif(F.col("product_raw"), F.lit("")), F.col("product_key")).alias("product"),
        F.coalesce(F.nullif(F.col("version_raw"), F.lit("")), F.col("version_norm")).alias("version"),
    )
    dept = department.select("department_id", F.col("name").alias("department"))
    sev = cve.select(F.col("cve_id").alias("cve_id_text"), "severity")
    ack = F.coalesce("ack_status", F.lit("NONE"))
    return (
        matches.drop("department_id").join(a, "asset_id")
        .join(dept, "department_id", "left")
        .join(sev, "cve_id_text", "left")
        .select(
            "advisory_id", F.col("cve_id_text").alias("cve"), "asset_id", "asset_no", "ip", "department_id",
            "department", "owner_name", "owner_team", "owner_contact", "product", "version",
            product_ver_label(F.col("product"), F.col("version")).alias("product_ver"), "severity", "status",
            F.coalesce("reason.candidate", F.lit(False)).alias("candidate"),
            F.coalesce("reason.suggested_exclude", F.lit(False)).alias("suggested_exclude"),
            "excluded_reason", ack.alias("ack_status"), ack_ko(ack).alias("ack_status_ko"), "ack_by", "ack_at",
        )
    )


def comment_view(comments: DataFrame, department: DataFrame) -> DataFrame:
    dept = department.select("department_id", F.col("name").alias("_dept"))
    return comments.join(dept, "department_id", "left").select(
        "comment_id", "advisory_id", "author_name", "department_id",
        F.coalesce(F.nullif(F.col("department_name"), F.lit("")), F.col("_dept")).alias("department"), "body",
        "ack_status", ack_ko("ack_status").alias("ack_status_ko"), "is_admin",
        F.col("evidence_name").alias("evidence"), F.col("evidence_path").isNotNull().alias("has_evidence"),
        "created_at",
    )


def notification_log(
    notifications: DataFrame, department: DataFrame, advisory: DataFrame, assets: DataFrame | None = None
) -> DataFrame:
    """Notifications with labels, newest first. ``assets`` as in ``rollups.with_asset_count``."""
    from exposure.operators.rollups import with_asset_count

    dept = department.select("department_id", F.col("name").alias("department"))
    rows = (
        with_asset_count(notifications, assets).join(dept, "department_id", "left")
        .join(advisory.select("advisory_id", "doc_no"), "advisory_id", "left")
        .select(
            "notification_id", "advisory_id", "department_id", "department", "channels", "message",
            F.col("_assets").alias("asset_count"), "status", "ack_status",
            ack_ko("ack_status").alias("ack_status_ko"), "ack_note", "ack_by", "ack_updated_at", "reminded_at",
            "reminder_count", "sent_at", "doc_no",
        )
    )
    return sort_notifications(rows)

