"""Listings, searches, orders, and the board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.operators import board as B
from exposure.operators import search as S
from exposure.operators.matching import attach_labels, match_count_per_cve
from exposure.operators.rollups import advisory_brief
from exposure.plans.catalog.registry import flat, query
from exposure.plans.catalog.rollups import BRIEF_SQL, DONE_PAIR_SQL, DONE_SQL, HISTORY_SQL, IMPACT_SQL, history
from exposure.plans.catalog.views_sql import ack_ko_sql, pct_sql, rank_sql, sev_ko_sql, top_sql, ts_sql
from exposure.operators.notify import due_reminders
from exposure.plans.demo import AS_OF, Views


# --- orders and pages ------------------------------------------------------------------------------
@query("search_cves", """
    SELECT cve_id, product_name, CAST(published_at AS VARCHAR) AS published_at FROM x_cve
    WHERE (cve_id ILIKE '%w_dget%' OR product_name ILIKE '%w_dget%' OR description ILIKE '%w_dget%') AND severity = 'HIGH' AND source = 'Brand#3'""")
def _(v: Views) -> DataFrame:
    return flat(S.search_cves(v.cve, "w_dget", "HIGH", "Brand#3").select("cve_id", "product_name", "published_at"))


@query("sort_cves_page", "SELECT cve_id FROM x_cve ORDER BY published_at DESC NULLS LAST, cve_id DESC LIMIT 20 OFFSET 40")
def _(v: Views) -> DataFrame:
    return S.sort_cves(v.cve.select("cve_id", "published_at"), page=3, size=20).select("cve_id")


@query("sort_notifications_page", "SELECT notification_id FROM x_note ORDER BY sent_at DESC NULLS LAST, notification_id DESC LIMIT 50")
def _(v: Views) -> DataFrame:
    return S.sort_notifications(v.notification.select("notification_id", "sent_at"), size=50).select("notification_id")


@query("sort_audit_page", "SELECT audit_id FROM x_audit ORDER BY created_at DESC, audit_id DESC LIMIT 200 OFFSET 200")
def _(v: Views) -> DataFrame:
    return S.sort_audit(v.audit, page=2, size=200).select("audit_id")


@query("sort_history_due", f"SELECT advisory_id, d_day FROM {HISTORY_SQL} ORDER BY d_day NULLS LAST, advisory_id LIMIT 30")
def _(v: Views) -> DataFrame:
    return S.sort_history_due(history(v), size=30).select("advisory_id", "d_day")


@query("sort_history_severity", f"""
    SELECT advisory_id, max_severity FROM {HISTORY_SQL} ORDER BY coalesce({rank_sql('max_severity')}, 0) DESC, advisory_id LIMIT 30""")
def _(v: Views) -> DataFrame:
    return S.sort_history(history(v), "sev", size=30).select("advisory_id", "max_severity")


@query("sort_history_progress", f"""
    SELECT advisory_id, dept_total - done AS waiting FROM {HISTORY_SQL} ORDER BY dept_total - done DESC, d_day NULLS LAST, advisory_id LIMIT 30""")
def _(v: Views) -> DataFrame:
    return S.sort_history(history(v), "prog", size=30).select("advisory_id", (F.col("dept_total") - F.col("done")).alias("waiting"))


@query("sort_reminders", f"""
    SELECT n.notification_id, CAST(date_diff('day', DATE '{AS_OF}', a.due_at) AS INTEGER) AS d_day FROM x_note n JOIN x_advisory a USING (advisory_id)
    WHERE n.ack_status IN ('NONE', 'IN_PROGRESS') AND a.status IN ('NOTIFYING', 'MATCHED', 'COMPLETED') AND a.due_at <= DATE '{AS_OF}' + 3
    ORDER BY d_day, notification_id LIMIT 25""")
def _(v: Views) -> DataFrame:
    return S.sort_reminders(due_reminders(v.advisory, v.notification, AS_OF), size=25).select("notification_id", "d_day")


@query("sort_board_page", """
    SELECT advisory_id FROM x_advisory WHERE board_published_at IS NOT NULL ORDER BY board_published_at DESC, advisory_id DESC LIMIT 10 OFFSET 10""")
def _(v: Views) -> DataFrame:
    return S.sort_board(B.published(v.advisory), page=2, size=10).select("advisory_id")


@query("recent_advisories", "SELECT advisory_id FROM x_advisory ORDER BY created_at DESC, advisory_id DESC LIMIT 5")
def _(v: Views) -> DataFrame:
    return S.recent_advisories(v.advisory).select("advisory_id")


@query("sort_hits_first", "SELECT name, contains(lower(name), '_1') AS hit FROM x_department")
def _(v: Views) -> DataFrame:
    return S.sort_hits_first(v.department.select("name"), "_1 ")


@query("sort_assets_page", "SELECT asset_no FROM x_asset ORDER BY asset_no LIMIT 25 OFFSET 25")
def _(v: Views) -> DataFrame:
    return S.sort_by(v.asset.select("asset_no"), "asset_no", page=2, size=25)


@query("sort_year_feed", "SELECT CAST(substr(cve_id, 5, 4) AS INTEGER) AS cve_year, cve_id FROM x_cve")
def _(v: Views) -> DataFrame:
    from exposure.operators.feeds import with_year

    return S.sort_year_feed(with_year(v.cve.select("cve_id"))).select("cve_year", "cve_id")


# --- searches --------------------------------------------------------------------------------------
@query("search_assets", """
    SELECT a.asset_id, d.name AS department FROM x_asset a JOIN x_department d USING (department_id)
    WHERE d.name = 'NATION_4' AND (asset_no ILIKE '%r1%' OR owner_name ILIKE '%r1%' OR ip ILIKE '%r1%')""")
def _(v: Views) -> DataFrame:
    return S.search_assets(v.asset, v.department, "NATION_4", q="r1").select("asset_id", "department")


@query("search_assets_product", "SELECT asset_id, department_id FROM x_asset WHERE product_key = 'acme_widget_17'")
def _(v: Views) -> DataFrame:
    return S.search_assets(v.asset, v.department, product_key="acme_widget_17").select("asset_id", "department_id")


@query("list_advisories", f"SELECT * FROM ({BRIEF_SQL}) WHERE status = 'EXTRACTED' AND source_org = 'F'")
def _(v: Views) -> DataFrame:
    return flat(S.list_advisories(advisory_brief(v.advisory, v.codes, AS_OF), "EXTRACTED", "F"))


@query("listing_total", "SELECT count(*) AS total FROM x_cve WHERE severity = 'LOW'")
def _(v: Views) -> DataFrame:
    return S.total(S.search_cves(v.cve, severity="LOW"))


@query("search_audit", f"""
    SELECT u.audit_id, {ts_sql('u.created_at')} AS created_at, u.action,
        CASE u.action WHEN 'ADVISORY_UPLOAD' THEN '권고문 업로드' WHEN 'ADVISORY_EXTRACT' THEN 'CVE 추출' WHEN 'ADVISORY_MATCH' THEN '자산 매칭'
            WHEN 'MATCH_EXCLUDE' THEN '오탐 제외' WHEN 'NOTIFY_SEND' THEN '권고 발송' ELSE u.action END AS action_ko,
        coalesce(CASE WHEN c.c_custkey % 3 <> 0 THEN c.c_name END, '시스템') AS actor, u.entity_type, u.entity_id, a.advisory_id,
        a.title AS advisory_title, u.detail
    FROM x_audit u LEFT JOIN customer c ON c.c_custkey = u.actor_id
    LEFT JOIN x_advisory a ON a.advisory_id = CASE WHEN u.entity_type = 'advisory' THEN u.entity_id END""")
def _(v: Views) -> DataFrame:
    return flat(S.search_audit(v.audit, v.app_user, v.advisory))


@query("search_audit_filtered", "SELECT audit_id FROM x_audit WHERE entity_type = 'match' AND action = 'MATCH_EXCLUDE'")
def _(v: Views) -> DataFrame:
    return S.search_audit(v.audit, v.app_user, v.advisory, "match", "MATCH_EXCLUDE").select("audit_id")


@query("attach_labels", """
    SELECT c_custkey AS asset_id, CASE WHEN c_nationkey < 20 THEN 'NATION_' || c_nationkey ELSE 'unknown' END AS name FROM customer""")
def _(v: Views) -> DataFrame:
    known = v.department.where("department_id < 20")
    return attach_labels(v.asset, known, "department_id", "name", F.lit("unknown")).select("asset_id", "name")


@query("cve_stats", "SELECT count(*) AS total, '2020-01-01 00:00:00.000000' AS last_updated FROM x_cve")
def _(v: Views) -> DataFrame:
    return flat(S.cve_stats(v.cve))


@query("feed_history", f"""
    SELECT n_nationkey AS import_id, CASE WHEN n_nationkey % 2 = 0 THEN '2024-01-02 00:00:00.000000' ELSE '2024-01-01 00:00:00.000000' END AS time FROM nation""")
def _(v: Views) -> DataFrame:
    imports = v.table("nation").selectExpr(
        "n_nationkey AS import_id", "TIMESTAMP'2024-01-01 00:00:00' AS created_at",
        "CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP'2024-01-02 00:00:00' END AS applied_at",
    )
    return flat(S.feed_history(imports).select("import_id", "time"))


@query("active_departments", "SELECT department_id, name FROM x_department WHERE is_active")
def _(v: Views) -> DataFrame:
    return S.active_departments(v.department).select("department_id", "name")


# --- flattened rows ----------------------------------------------------------------------------------
@query("cve_view", """
    SELECT cve_id, product_name, product_key, affected_versions, severity, cvss_score, description, CAST(published_at AS VARCHAR) AS published_at, source
    FROM x_cve""")
def _(v: Views) -> DataFrame:
    return flat(S.cve_view(v.cve))


@query("asset_view", """
    SELECT asset_id, asset_no, a.department_id, d.name AS department, product_raw, product_key, version_raw, version_norm, ip, owner_name, owner_team,
        owner_contact, status FROM x_asset a LEFT JOIN x_department d USING (department_id)""")
def _(v: Views) -> DataFrame:
    return S.asset_view(v.asset, v.department)


@query("advisory_cve_view", """
    SELECT k.advisory_id, k.cve_id_text, k.lookup_status, c.product_key, c.affected_versions, c.severity, CAST(c.published_at AS VARCHAR) AS published_at,
        coalesce(m.n, 0) AS match_count FROM x_code k LEFT JOIN x_cve c ON c.cve_id = k.cve_id_text
    LEFT JOIN (SELECT advisory_id, cve_id_text, count(*) AS n FROM x_match WHERE status = 'MATCHED' GROUP BY 1, 2) m USING (advisory_id, cve_id_text)""")
def _(v: Views) -> DataFrame:
    codes = v.codes.withColumn("snippet", F.lit(None).cast("string"))
    out = S.advisory_cve_view(codes, v.cve, match_count_per_cve(v.match))
    return flat(out.drop("product_name", "description", "source", "snippet"))


@query("match_view", f"""
    SELECT m.advisory_id, m.cve_id_text AS cve, m.asset_id, a.asset_no, a.ip, a.department_id, d.name AS department, a.owner_name, a.owner_team,
        a.owner_contact, a.product_raw AS product, coalesce(a.version_raw, a.version_norm) AS version,
        rtrim(a.product_raw || ' · ' || coalesce(a.version_raw, a.version_norm), ' ·') AS product_ver, c.severity, m.status, m.candidate,
        m.suggested_exclude, m.excluded_reason, m.ack_status, {ack_ko_sql('m.ack_status')} AS ack_status_ko
    FROM x_match m JOIN x_asset a USING (asset_id) LEFT JOIN x_department d ON d.department_id = a.department_id
    LEFT JOIN x_cve c ON c.cve_id = m.cve_id_text""")
def _(v: Views) -> DataFrame:
    return S.match_view(v.match, v.asset, v.cve, v.department).drop("ack_by", "ack_at")


@query("comment_view", f"""
    SELECT c.comment_id, c.advisory_id, c.author_name, c.department_id, coalesce(c.department_name, d.name) AS department, c.body, c.ack_status,
        {ack_ko_sql('c.ack_status')} AS ack_status_ko, c.is_admin, c.evidence_name AS evidence, c.evidence_name IS NOT NULL AS has_evidence,
        {ts_sql('c.created_at')} AS created_at FROM x_comment c LEFT JOIN x_department d USING (department_id)""")
def _(v: Views) -> DataFrame:
    return flat(S.comment_view(v.comment, v.department))


@query("notification_log", f"""
    SELECT n.notification_id, n.advisory_id, n.department_id, d.name AS department, CAST(len(n.asset_ids) AS INTEGER) AS asset_count, n.status, n.ack_status,
        {ack_ko_sql('n.ack_status')} AS ack_status_ko, n.reminder_count, {ts_sql('n.sent_at')} AS sent_at, a.doc_no
    FROM x_note n LEFT JOIN x_department d USING (department_id) LEFT JOIN x_advisory a USING (advisory_id)""")
def _(v: Views) -> DataFrame:
    out = S.notification_log(v.notification.drop("asset_ids"), v.department, v.advisory, v.notification_asset)
    return flat(out.drop("channels", "message", "ack_note", "ack_by", "ack_updated_at", "reminded_at"))


# --- board -------------------------------------------------------------------------------------------
def _shown(v: Views, department_id: int | None = None) -> DataFrame:
    return B.board_matches(v.match, v.asset, v.department, department_id)


@query("relevant_advisories", """
    SELECT advisory_id, department_id FROM x_note UNION SELECT advisory_id, department_id FROM x_active""")
def _(v: Views) -> DataFrame:
    return B.relevant_advisories(v.notification, v.match, v.asset)


@query("targeted", "SELECT advisory_id FROM x_advisory WHERE advisory_id IN (SELECT advisory_id FROM x_note WHERE department_id = 6)")
def _(v: Views) -> DataFrame:
    return B.targeted(v.advisory, v.notification, 6).select("advisory_id")


@query("published", "SELECT advisory_id FROM x_advisory WHERE board_published_at IS NOT NULL")
def _(v: Views) -> DataFrame:
    return B.published(v.advisory).select("advisory_id")


_HIT = "(contains(lower(asset_no), 'r1') OR contains(lower(owner_name), 'r1') OR contains(lower(department), 'r1'))"


@query("board_text_search", f"""
    SELECT advisory_id FROM x_advisory WHERE contains(lower(title), 'r1') OR contains(lower(doc_no), 'r1')
        OR advisory_id IN (SELECT advisory_id FROM x_active WHERE {_HIT})""")
def _(v: Views) -> DataFrame:
    return B.board_text_search(v.advisory, _shown(v), "R1").select("advisory_id")


@query("exclude_done", f"SELECT advisory_id FROM {DONE_SQL} WHERE NOT done")
def _(v: Views) -> DataFrame:
    return B.exclude_done(v.advisory, v.match, v.asset, v.notification).select("advisory_id")


@query("exclude_done_department", f"""
    SELECT advisory_id FROM x_advisory WHERE advisory_id NOT IN (SELECT advisory_id FROM {DONE_PAIR_SQL} WHERE done AND department_id = 5)""")
def _(v: Views) -> DataFrame:
    return B.exclude_done(v.advisory, v.match, v.asset, v.notification, 5).select("advisory_id")


@query("comment_counts", "SELECT advisory_id, count(*) AS comment_count FROM x_comment GROUP BY 1")
def _(v: Views) -> DataFrame:
    return B.comment_counts(v.comment)


@query("scope_comments_department", """
    SELECT comment_id FROM x_comment WHERE is_admin OR department_id = 8 OR (department_id IS NULL AND department_name = 'NATION_8')""")
def _(v: Views) -> DataFrame:
    return B.scope_comments(v.comment, 8, "NATION_8").select("comment_id")


@query("scope_comments_text", """
    SELECT comment_id, NULL AS evidence FROM x_comment WHERE is_admin OR contains(author_name, 'r12') OR contains(lower(department_name), 'r12')""")
def _(v: Views) -> DataFrame:
    out = B.public_comments(B.scope_comments(v.comment, q="R12"))
    return out.select("comment_id", F.col("evidence_name").alias("evidence"))


_SCOPED = f"""(SELECT m.*, NOT t.title_hit AND h.any_hit AS scoped FROM (SELECT *, {_HIT} AS hit FROM x_active) m
    JOIN (SELECT advisory_id, contains(lower(title), 'r1') OR contains(lower(doc_no), 'r1') OR contains(lower(source_org), 'r1') AS title_hit
        FROM x_advisory WHERE board_published_at IS NOT NULL) t USING (advisory_id)
    JOIN (SELECT advisory_id, bool_or({_HIT}) AS any_hit FROM x_active GROUP BY 1) h USING (advisory_id)
    WHERE hit OR title_hit OR NOT any_hit)"""


@query("scope_detail", f"SELECT advisory_id, cve_id_text, asset_id, scoped FROM {_SCOPED}")
def _(v: Views) -> DataFrame:
    return B.scope_detail(B.published(v.advisory), _shown(v), "r1").select("advisory_id", "cve_id_text", "asset_id", "scoped")


def _detail(v: Views, q: str | None = None, department_id: int | None = None, name: str | None = None) -> dict[str, DataFrame]:
    return B.board_detail(
        v.advisory, v.codes, v.cve, v.match, v.asset, v.department, v.comment, q, department_id, name
    )


@query("board_detail_cves", f"""
    SELECT k.advisory_id, k.cve_id_text, k.lookup_status, c.product_name, c.severity FROM x_code k LEFT JOIN x_cve c ON c.cve_id = k.cve_id_text
    JOIN x_advisory a USING (advisory_id) LEFT JOIN (SELECT advisory_id, bool_or(scoped) AS scoped FROM {_SCOPED} GROUP BY 1) s USING (advisory_id)
    WHERE a.board_published_at IS NOT NULL AND (NOT coalesce(s.scoped, false)
        OR (k.advisory_id, k.cve_id_text) IN (SELECT (advisory_id, cve_id_text) FROM {_SCOPED}))""")
def _(v: Views) -> DataFrame:
    return _detail(v, "r1")["cves"]


@query("board_detail_comments", f"""
    SELECT c.comment_id FROM x_comment c JOIN x_advisory a USING (advisory_id) WHERE a.board_published_at IS NOT NULL AND (
        c.advisory_id NOT IN (SELECT advisory_id FROM {_SCOPED} WHERE scoped)
        OR c.is_admin OR contains(c.author_name, 'r1') OR contains(lower(coalesce(c.department_name, '')), 'r1'))""")
def _(v: Views) -> DataFrame:
    return _detail(v, "r1")["comments"].select("comment_id")


@query("board_detail_department", """
    SELECT m.advisory_id, count(*) AS total, count(*) FILTER (m.ack_status = 'DONE') AS done FROM x_active m JOIN x_advisory a USING (advisory_id)
    WHERE a.board_published_at IS NOT NULL AND m.department_id = 9 GROUP BY 1""")
def _(v: Views) -> DataFrame:
    return _detail(v, None, 9, "NATION_9")["progress"].select("advisory_id", "total", "done")


_PROGRESS = """SELECT advisory_id, count(*) AS total, count(*) FILTER (ack_status = 'DONE') AS done,
    """ + pct_sql("count(*) FILTER (ack_status = 'DONE')", "count(*)") + " AS done_rate FROM x_active"


@query("board_view", f"""
    SELECT b.advisory_id, b.title, b.sla_status, b.found, s.max_severity, {sev_ko_sql('s.max_severity')} AS max_severity_ko,
        coalesce(c.n, 0) AS comment_count, coalesce(i.affected_dept_count, 0) AS affected_dept_count, coalesce(i.affected_products, '') AS affected_products,
        coalesce(i.affected_asset_count, 0) AS affected_asset_count, p.total, p.done, p.done_rate
    FROM ({BRIEF_SQL}) b JOIN {DONE_SQL} f USING (advisory_id) LEFT JOIN x_severity s USING (advisory_id)
    LEFT JOIN (SELECT advisory_id, count(*) AS n FROM x_comment GROUP BY 1) c USING (advisory_id) LEFT JOIN {IMPACT_SQL} i USING (advisory_id)
    LEFT JOIN ({_PROGRESS} GROUP BY 1) p USING (advisory_id)
    WHERE b.board_published AND NOT f.done AND (contains(lower(b.title), 'r1') OR contains(lower(b.doc_no), 'r1')
        OR b.advisory_id IN (SELECT advisory_id FROM x_active WHERE {_HIT}))""")
def _(v: Views) -> DataFrame:
    out = B.board_view(
        v.advisory, v.codes, v.cve, v.match, v.asset, v.department, v.notification, v.comment, AS_OF, q="r1"
    )
    return flat(out.select(
        "advisory_id", "title", "sla_status", "found", "max_severity", "max_severity_ko", "comment_count", "affected_dept_count",
        "affected_products", "affected_asset_count", "total", "done", "done_rate",
    ))


@query("board_view_department", f"""
    SELECT a.advisory_id, s.max_severity, coalesce(c.n, 0) AS comment_count, coalesce(p.total, 0) AS affected_asset_count, p.done, p.done_rate,
        l.ack_status AS dept_ack_status, {ack_ko_sql('l.ack_status')} AS dept_ack_status_ko
    FROM x_advisory a
    LEFT JOIN (SELECT m.advisory_id, {top_sql('c.severity')} AS max_severity FROM x_active m LEFT JOIN x_cve c ON c.cve_id = m.cve_id_text
        WHERE m.department_id = 5 GROUP BY 1) s USING (advisory_id)
    LEFT JOIN (SELECT advisory_id, count(*) AS n FROM x_comment WHERE is_admin OR department_id = 5 OR (department_id IS NULL AND department_name = 'NATION_5')
        GROUP BY 1) c USING (advisory_id)
    LEFT JOIN ({_PROGRESS} WHERE department_id = 5 GROUP BY 1) p USING (advisory_id)
    LEFT JOIN (SELECT * FROM x_latest WHERE department_id = 5) l USING (advisory_id)
    WHERE a.board_published_at IS NOT NULL
        AND advisory_id IN (SELECT advisory_id FROM x_note WHERE department_id = 5 UNION SELECT advisory_id FROM x_active WHERE department_id = 5)
        AND advisory_id NOT IN (SELECT advisory_id FROM {DONE_PAIR_SQL} WHERE done AND department_id = 5)""")
def _(v: Views) -> DataFrame:
    out = B.board_view(
        v.advisory, v.codes, v.cve, v.match, v.asset, v.department, v.notification, v.comment, AS_OF,
        department_id=5, department_name="NATION_5",
    )
    return out.select(
        "advisory_id", "max_severity", "comment_count", "affected_asset_count", "done", "done_rate", "dept_ack_status", "dept_ack_status_ko"
    )
