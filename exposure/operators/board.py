"""Internal board: what is published, to whom it matters, and what a reader may see."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions.severity import ack_ko, max_severity as max_sev, severity_ko
from exposure.functions.text import contains_any
from exposure.operators.matching import active_matches
from exposure.operators.rollups import (
    advisory_brief, advisory_done, asset_progress, department_done, impact, latest_ack, max_severity,
)
from exposure.operators.search import sort_board

_ASSET_TEXT = ["asset_no", "owner_name", "department"]
_TITLE_TEXT = ["title", "doc_no", "source_org"]


def published(advisory: DataFrame) -> DataFrame:
    return advisory.where("board_published_at IS NOT NULL")


def board_matches(
    matches: DataFrame, asset: DataFrame, department: DataFrame, department_id: int | None = None
) -> DataFrame:
    """Active matches with asset columns and department name."""
    dept = department.select("department_id", F.col("name").alias("department"))
    return active_matches(matches, asset, department_id).join(dept, "department_id", "left")


def relevant_advisories(notifications: DataFrame, matches: DataFrame, asset: DataFrame) -> DataFrame:
    """(advisory, department) pairs that were notified or have a matched asset."""
    notified = notifications.select("advisory_id", "department_id")
    matched = active_matches(matches, asset).select("advisory_id", "department_id")
    return notified.union(matched).distinct()


def targeted(advisory: DataFrame, notifications: DataFrame, department_id: int) -> DataFrame:
    """Advisories with a notification to a department."""
    return advisory.join(
        notifications.where(F.col("department_id") == department_id), "advisory_id", "left_semi"
    )


def board_text_search(advisory: DataFrame, shown: DataFrame, q: str) -> DataFrame:
    """Advisories whose title, number or source, or any shown asset, contains the text."""
    own = advisory.where(contains_any(_TITLE_TEXT, q)).select("advisory_id")
    by_asset = shown.where(contains_any(_ASSET_TEXT, q)).select("advisory_id")
    return advisory.join(own.union(by_asset).distinct(), "advisory_id", "left_semi")


def exclude_done(
    advisory: DataFrame, matches: DataFrame, asset: DataFrame, notifications: DataFrame,
    department_id: int | None = None,
) -> DataFrame:
    """Drop advisories that are finished, overall or for one department."""
    if department_id is None:
        done = advisory_done(advisory, matches, asset, notifications).where("done")
    else:
        done = department_done(advisory, matches, asset, notifications).where(
            F.col("done") & (F.col("department_id") == department_id)
        )
    return advisory.join(done.select("advisory_id"), "advisory_id", "left_anti")


def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("advisory_id").agg(F.count("*").alias("comment_count"))


def scope_comments(
    comments: DataFrame, department_id: int | None = None, department_name: str | None = None,
    q: str | None = None,
) -> DataFrame:
    """Comments a reader may see: those by admins, and their own department's by id or typed name.

    Without a department the text ``q`` is compared with author and department name.
    """
    if department_id is not None:
        own = (F.col("department_id") == department_id) | (
            F.col("department_id").isNull() & (F.col("department_name") == (department_name or ""))
        )
        return comments.where(F.col("is_admin") | F.coalesce(own, F.lit(False)))
    if q and q.strip():
        return comments.where(F.col("is_admin") | contains_any(["author_name", "department_name"], q))
    return comments


def public_comments(comments: DataFrame) -> DataFrame:
    """Comments with their evidence hidden."""
    return comments.withColumns(
        {c: F.lit(None).cast("string") for c in ("evidence_name", "evidence_path") if c in comments.columns}
    )


def scoped_severity(shown: DataFrame, cve: DataFrame) -> DataFrame:
    """Highest severity per advisory among the shown matches."""
    sev = cve.select(F.col("cve_id").alias("cve_id_text"), "severity")
    return shown.join(sev, "cve_id_text", "left").groupBy("advisory_id").agg(
        max_sev("severity").alias("max_severity")
    ).withColumn("max_severity_ko", severity_ko("max_severity"))


def scope_detail(advisory: DataFrame, shown: DataFrame, q: str | None = None) -> DataFrame:
    """Matches a reader of the detail page sees, with the flag ``scoped``.

    A text that hits the advisory itself shows everything; else only the assets it hits, if it hits any.
    """
    cols = shown.columns
    if not (q and q.strip()):
        return shown.withColumn("scoped", F.lit(False))
    titles = advisory.select("advisory_id", contains_any(_TITLE_TEXT, q).alias("_title"))
    marked = shown.withColumn("_hit", contains_any(_ASSET_TEXT, q))
    hits = marked.groupBy("advisory_id").agg(F.bool_or("_hit").alias("_any"))
    flagged = marked.join(titles, "advisory_id").join(hits, "advisory_id")
    scoped = ~F.col("_title") & F.col("_any")
    return flagged.where(~scoped | F.col("_hit")).select(*cols, scoped.alias("scoped"))


def scope_cves(advisory_cve: DataFrame, cve: DataFrame, scoped_matches: DataFrame) -> DataFrame:
    """Codes of the detail page; a scoped reader sees those of the shown matches only."""
    shown = scoped_matches.groupBy("advisory_id").agg(F.bool_or("scoped").alias("_scoped"))
    kept = scoped_matches.select("advisory_id", "cve_id_text").distinct().withColumn("_kept", F.lit(True))
    c = cve.select(F.col("cve_id").alias("cve_id_text"), "product_name", "severity")
    return (
        advisory_cve.join(shown, "advisory_id", "left")
        .join(kept, ["advisory_id", "cve_id_text"], "left")
        .where(~F.coalesce("_scoped", F.lit(False)) | F.coalesce("_kept", F.lit(False)))
        .join(c, "cve_id_text", "left")
        .select("advisory_id", "cve_id_text", "lookup_status", "product_name", "severity")
    )


def board_view(
    advisory: DataFrame, advisory_cve: DataFrame, cve: DataFrame, matches: DataFrame, asset: DataFrame,
    department: DataFrame, notifications: DataFrame, comments: DataFrame, as_of: dt.date | str | Column,
    q: str | None = None, department_id: int | None = None, department_name: str | None = None,
    hide_done: bool = True,
) -> DataFrame:
    """Board list, newest published first; for a department, limited to what concerns it."""
    listed = published(advisory)
    # everything below is about published advisories only, so the large tables are reduced to them first
    ids = listed.select("advisory_id")
    matches, advisory_cve, notifications, comments = (
        t.join(ids, "advisory_id", "left_semi") for t in (matches, advisory_cve, notifications, comments)
    )
    shown = board_matches(matches, asset, department, department_id)
    if department_id is not None:
        relevant = relevant_advisories(notifications, matches, asset).where(F.col("department_id") == department_id)
        listed = listed.join(relevant, "advisory_id", "left_semi")
    if hide_done:
        listed = exclude_done(listed, matches, asset, notifications, department_id)
    if q and q.strip():
        listed = board_text_search(listed, shown, q)

    severity = max_severity(advisory_cve, cve) if department_id is None else scoped_severity(shown, cve)
    seen = scope_comments(comments, department_id, department_name)
    scoped_rows = matches if department_id is None else shown
    affected = impact(matches, asset if department_id is None else asset.where(F.col("department_id") == department_id))
    counts = ("affected_dept_count", "affected_asset_count", "comment_count")
    out = (
        advisory_brief(listed, advisory_cve, as_of)
        .join(severity, "advisory_id", "left")
        .join(comment_counts(seen), "advisory_id", "left")
        .join(affected, "advisory_id", "left")
        .join(asset_progress(scoped_rows), "advisory_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        .withColumn("affected_products", F.coalesce("affected_products", F.array().cast("array<string>")))
    )
    if department_id is not None:
        ack = latest_ack(notifications).where(F.col("department_id") == department_id).select(
            "advisory_id", F.col("ack_status").alias("dept_ack_status"),
            ack_ko("ack_status").alias("dept_ack_status_ko"),
        )
        out = out.join(ack, "advisory_id", "left")
    return sort_board(out)


def board_detail(
    advisory: DataFrame, advisory_cve: DataFrame, cve: DataFrame, matches: DataFrame, asset: DataFrame,
    department: DataFrame, comments: DataFrame, q: str | None = None,
    department_id: int | None = None, department_name: str | None = None,
) -> dict[str, DataFrame]:
    """Parts of the detail page for all published advisories: ``matches, cves, comments, progress``."""
    open_ids = published(advisory)
    shown = board_matches(matches, asset, department, department_id).join(open_ids, "advisory_id", "left_semi")
    scoped = scope_detail(open_ids, shown, q)
    if department_id is not None:
        scoped = scoped.withColumn("scoped", F.lit(True))
    codes = advisory_cve.join(open_ids, "advisory_id", "left_semi")
    if department_id is not None:
        codes = codes.join(scoped, ["advisory_id", "cve_id_text"], "left_semi")
    visible = comments.join(open_ids, "advisory_id", "left_semi")
    if department_id is None and q and q.strip():
        # only advisories whose matches were narrowed by the text hide comments
        narrowed = scoped.where("scoped").select("advisory_id").distinct()
        visible = visible.join(narrowed, "advisory_id", "left_anti").unionByName(
            scope_comments(visible.join(narrowed, "advisory_id", "left_semi"), q=q)
        )
    else:
        visible = scope_comments(visible, department_id, department_name)
    return {
        "matches": scoped,
        "cves": scope_cves(codes, cve, scoped),
        "comments": public_comments(visible),
        "progress": asset_progress(scoped),
    }
