"""Progress, deadlines, impact, dashboard, history and report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.operators import rollups as R
from exposure.operators.notify import due_reminders
from exposure.plans.catalog.registry import flat, query
from exposure.plans.catalog.views_sql import (
    ack_ko_sql, day_sql, pct_sql, sev_ko_sql, sla_sql, ts_sql,
)
from exposure.plans.demo import AS_OF, Views
from exposure.plans.report import report_tables

_COUNTS = """count(*) AS total, count(*) FILTER (ack_status = 'NONE') AS "none", count(*) FILTER (ack_status = 'IN_PROGRESS') AS in_progress,
    count(*) FILTER (ack_status = 'DONE') AS done, count(*) FILTER (ack_status = 'UNABLE') AS unable,
    """ + pct_sql("count(*) FILTER (ack_status = 'DONE')", "count(*)") + " AS done_rate"


@query("asset_progress", f"SELECT advisory_id, {_COUNTS} FROM x_match WHERE status = 'MATCHED' GROUP BY advisory_id")
def _(v: Views) -> DataFrame:
    return R.asset_progress(v.match)


@query("max_severity", f"""
    SELECT advisory_id, max_severity, {sev_ko_sql('max_severity')} AS max_severity_ko FROM x_severity""")
def _(v: Views) -> DataFrame:
    return R.max_severity(v.codes, v.cve)


_REMEDIATION = f"""
    SELECT a.advisory_id, a.doc_no, a.title, CAST(a.due_at AS VARCHAR) AS due_at, {day_sql('a.due_at')} AS d_day,
        {sla_sql('coalesce(r.all_done, false)', 'a.due_at')} AS sla_status, coalesce(r.dept_total, 0) AS dept_total,
        coalesce(r."none", 0) AS "none", coalesce(r.in_progress, 0) AS in_progress, coalesce(r.done, 0) AS done,
        coalesce(r.unable, 0) AS unable, coalesce(r.asset_total, 0) AS asset_total, coalesce(r.asset_done, 0) AS asset_done,
        {pct_sql('coalesce(r.done, 0)', 'coalesce(r.dept_total, 0)')} AS done_rate,
        {pct_sql('(coalesce(r.dept_total, 0) - coalesce(r."none", 0))', 'coalesce(r.dept_total, 0)')} AS responded_rate
    FROM x_advisory a LEFT JOIN x_reply r USING (advisory_id)"""


@query("remediation", _REMEDIATION)
def _(v: Views) -> DataFrame:
    return flat(R.remediation(v.advisory, v.notification.drop("asset_ids"), AS_OF, v.notification_asset))


@query("remediation_rows", f"""
    SELECT n.advisory_id, n.notification_id, n.department_id, d.name AS department, n.ack_status, {ack_ko_sql('n.ack_status')} AS ack_status_ko,
        CAST(len(n.asset_ids) AS INTEGER) AS asset_count, {ts_sql('n.sent_at')} AS sent_at, n.reminder_count, 'MAIL|WEB_UI' AS channels
    FROM x_note n LEFT JOIN x_department d USING (department_id)""")
def _(v: Views) -> DataFrame:
    return flat(R.remediation_rows(v.notification.drop("asset_ids"), v.department, v.notification_asset).drop("ack_note", "ack_by", "ack_updated_at", "reminded_at"))


_SLA = f"""(SELECT a.advisory_id, {sla_sql('coalesce(r.all_done, false)')} AS sla_status FROM x_advisory a
    LEFT JOIN x_reply r USING (advisory_id) WHERE a.status IN ('NOTIFYING', 'MATCHED', 'COMPLETED'))"""


@query("sla_overview", f"""
    SELECT s AS sla_status, count(a.advisory_id) AS advisories FROM (SELECT unnest(['NORMAL', 'IMMINENT', 'OVERDUE', 'DONE']) AS s)
    LEFT JOIN {_SLA} a ON a.sla_status = s GROUP BY s""")
def _(v: Views) -> DataFrame:
    return R.sla_overview(v.advisory, v.notification, AS_OF)


@query("sla_by_advisory", f"SELECT advisory_id, sla_status FROM {_SLA}")
def _(v: Views) -> DataFrame:
    return R.sla_by_advisory(v.advisory, v.notification, AS_OF)


@query("department_progress", f"""
    SELECT n.department_id, d.name AS dept, {pct_sql("count(*) FILTER (ack_status = 'DONE')", 'count(*)')} AS pct
    FROM x_note n LEFT JOIN x_department d USING (department_id) GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    return R.department_progress(v.notification, v.department)


_DONE_PAIR = """(SELECT coalesce(m.advisory_id, l.advisory_id) AS advisory_id, coalesce(m.department_id, l.department_id) AS department_id,
    coalesce(m.done, l.ack_status = 'DONE') AS done
    FROM (SELECT advisory_id, department_id, bool_and(ack_status = 'DONE') AS done FROM x_active GROUP BY ALL) m
    FULL JOIN x_latest l ON l.advisory_id = m.advisory_id AND l.department_id = m.department_id)"""
_DONE = """(SELECT a.advisory_id, coalesce(m.done, n.done, a.status = 'COMPLETED') AS done FROM x_advisory a
    LEFT JOIN (SELECT advisory_id, bool_and(ack_status = 'DONE') AS done FROM x_active GROUP BY 1) m USING (advisory_id)
    LEFT JOIN (SELECT advisory_id, bool_and(ack_status = 'DONE') AS done FROM x_note GROUP BY 1) n USING (advisory_id))"""


@query("department_done", f"SELECT * FROM {_DONE_PAIR}")
def _(v: Views) -> DataFrame:
    return R.department_done(v.advisory, v.match, v.asset, v.notification)


@query("advisory_done", f"SELECT advisory_id, done FROM {_DONE}")
def _(v: Views) -> DataFrame:
    return R.advisory_done(v.advisory, v.match, v.asset, v.notification)


@query("latest_ack", "SELECT advisory_id, department_id, notification_id, ack_status FROM x_latest")
def _(v: Views) -> DataFrame:
    return R.latest_ack(v.notification).select("advisory_id", "department_id", "notification_id", "ack_status")


@query("impact_departments", """
    SELECT advisory_id, department_id, department, count(DISTINCT asset_id) AS asset_count,
        string_agg(DISTINCT owner_name, '|' ORDER BY owner_name) AS owners FROM x_active GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    return flat(R.impact_departments(v.match, v.asset, v.department))


_IMPACT = """(SELECT advisory_id, count(DISTINCT department_id) AS affected_dept_count,
    string_agg(DISTINCT product_raw, '|' ORDER BY product_raw) AS affected_products, count(*) AS affected_asset_count FROM x_active GROUP BY 1)"""


@query("impact", f"SELECT * FROM {_IMPACT}")
def _(v: Views) -> DataFrame:
    return flat(R.impact(v.match, v.asset))


@query("dashboard_stats", f"""
    SELECT 'in_progress' AS key, count(*) AS value FROM x_advisory WHERE status NOT IN ('COMPLETED', 'ARCHIVED')
    UNION ALL SELECT 'not_found_cve', count(DISTINCT cve_id_text) FROM x_code WHERE lookup_status = 'NOT_FOUND'
    UNION ALL SELECT 'target_assets', count(DISTINCT asset_id) FROM x_match WHERE status = 'MATCHED'
    UNION ALL SELECT 'overdue', count(*) FROM {_SLA} WHERE sla_status = 'OVERDUE'
    UNION ALL SELECT 'due_reminders', count(*) FROM x_note n JOIN x_advisory a USING (advisory_id)
        WHERE n.ack_status IN ('NONE', 'IN_PROGRESS') AND a.status IN ('NOTIFYING', 'MATCHED', 'COMPLETED') AND a.due_at <= DATE '{AS_OF}' + 3""")
def _(v: Views) -> DataFrame:
    return R.dashboard_stats(v.advisory, v.codes, v.asset, v.match, v.notification, AS_OF)


@query("due_reminders", f"""
    SELECT advisory_id, a.doc_no, n.notification_id, n.department_id, n.ack_status, {day_sql('a.due_at')} AS d_day,
        a.due_at < DATE '{AS_OF}' AS overdue, n.reminder_count
    FROM x_note n JOIN x_advisory a USING (advisory_id)
    WHERE n.ack_status IN ('NONE', 'IN_PROGRESS') AND a.status IN ('NOTIFYING', 'MATCHED', 'COMPLETED') AND a.due_at <= DATE '{AS_OF}' + 3""")
def _(v: Views) -> DataFrame:
    return due_reminders(v.advisory, v.notification, AS_OF).drop("last_reminded")


_BRIEF = f"""
    SELECT a.advisory_id, a.doc_no, a.title, a.source_org, a.receive_channel, CAST(a.received_at AS VARCHAR) AS received_at,
        CAST(a.due_at AS VARCHAR) AS due_at, {day_sql('a.due_at')} AS d_day,
        {sla_sql("a.status IN ('COMPLETED', 'ARCHIVED')", 'a.due_at')} AS sla_status, a.status,
        coalesce(c.extracted, 0) AS extracted, coalesce(c.found, 0) AS found, coalesce(c.extracted - c.found, 0) AS not_found,
        a.board_published_at IS NOT NULL AS board_published, {ts_sql('a.board_published_at')} AS board_published_at,
        {ts_sql('a.created_at')} AS created_at
    FROM x_advisory a LEFT JOIN (SELECT advisory_id, count(*) AS extracted, count(*) FILTER (lookup_status = 'FOUND') AS found
        FROM x_code GROUP BY 1) c USING (advisory_id)"""


@query("advisory_brief", f"""
    SELECT b.*, coalesce(m.n, 0) AS match_count FROM ({_BRIEF}) b LEFT JOIN (
        SELECT advisory_id, count(*) AS n FROM x_match WHERE status = 'MATCHED' GROUP BY 1) m USING (advisory_id)""")
def _(v: Views) -> DataFrame:
    return flat(R.advisory_brief(v.advisory, v.codes, AS_OF, v.match))


_HISTORY = f"""(SELECT a.advisory_id, a.doc_no, a.title, a.source_org, a.receive_channel, CAST(a.due_at AS VARCHAR) AS due_at,
        {day_sql('a.due_at')} AS d_day, {sla_sql('r.all_done', 'a.due_at')} AS sla_status, s.max_severity,
        {sev_ko_sql('s.max_severity')} AS max_severity_ko, a.board_published_at IS NOT NULL AS board_published, r.dept_total,
        r."none", r.in_progress, r.done, r.unable, {pct_sql('r.done', 'r.dept_total')} AS done_rate,
        {pct_sql('(r.dept_total - r."none")', 'r.dept_total')} AS responded_rate
    FROM x_advisory a JOIN x_reply r USING (advisory_id) LEFT JOIN x_severity s USING (advisory_id))"""


def history(v: Views) -> DataFrame:
    return R.history_rollup(v.advisory, v.notification, v.codes, v.cve, AS_OF)


def history_rows(v: Views) -> DataFrame:
    return R.history_departments(v.notification.drop("asset_ids"), v.asset, v.department, assets=v.notification_asset)


@query("history_rollup", f"SELECT * FROM {_HISTORY}")
def _(v: Views) -> DataFrame:
    return flat(history(v))


_OWNERS = """(SELECT n.notification_id, list_sort(list(DISTINCT a.owner_name)) AS owners
    FROM (SELECT notification_id, unnest(asset_ids) AS asset_id FROM x_note) n JOIN x_asset a USING (asset_id)
    WHERE a.owner_name <> '자동배포' GROUP BY 1)"""


@query("notification_owners", f"SELECT notification_id, array_to_string(owners, '|') AS owners FROM {_OWNERS}")
def _(v: Views) -> DataFrame:
    return flat(R.notification_owners(v.notification.drop("asset_ids"), v.asset, assets=v.notification_asset))


_DEPT_ROWS = f"""(SELECT n.advisory_id, n.notification_id, n.department_id, d.name AS department,
        coalesce(array_to_string(o.owners, '|'), '') AS owners, array_to_string(o.owners, ', ') AS owner, n.ack_status,
        {ack_ko_sql('n.ack_status')} AS ack_status_ko, CAST(len(n.asset_ids) AS INTEGER) AS asset_count, n.status, n.reminder_count
    FROM x_note n LEFT JOIN {_OWNERS} o USING (notification_id) LEFT JOIN x_department d USING (department_id))"""


@query("history_departments", f"SELECT * FROM {_DEPT_ROWS}")
def _(v: Views) -> DataFrame:
    return flat(history_rows(v).drop("ack_note", "ack_by", "ack_updated_at", "sent_at"))


@query("history_by_department", f"""
    SELECT department, count(*) AS advisories, count(*) FILTER (ack_status NOT IN ('DONE', 'UNABLE')) AS open FROM {_DEPT_ROWS} GROUP BY 1""")
def _(v: Views) -> DataFrame:
    return R.history_by_department(history_rows(v))


@query("history_filter", f"""
    SELECT advisory_id, title FROM {_HISTORY} h WHERE (contains(lower(h.title), '12') OR contains(lower(h.doc_no), '12')
            OR EXISTS (SELECT 1 FROM {_DEPT_ROWS} d WHERE d.advisory_id = h.advisory_id AND (contains(lower(d.department), '12') OR contains(d.owner, '12'))))
        AND EXISTS (SELECT 1 FROM x_note n WHERE n.advisory_id = h.advisory_id AND n.ack_status = 'UNABLE')""")
def _(v: Views) -> DataFrame:
    return R.history_filter(history(v), history_rows(v), " 12 ", "UNABLE").select("advisory_id", "title")


@query("owners_except", """
    SELECT notification_id, array_to_string(list_distinct_sorted, '|') AS owners FROM (
        SELECT notification_id, list_sort(list(DISTINCT o) FILTER (o IS NOT NULL AND o <> '' AND o <> '자동배포')) AS list_distinct_sorted FROM (
            SELECT notification_id, CASE WHEN k % 9 = 0 THEN '자동배포' WHEN k % 7 = 0 THEN '' WHEN k % 5 = 0 THEN NULL ELSE 'owner' || (k % 4) END AS o
            FROM (SELECT notification_id, unnest(asset_ids) AS k FROM x_note)) GROUP BY 1)""")
def _(v: Views) -> DataFrame:
    names = F.transform("asset_ids", lambda k: F.when(k % 9 == 0, "자동배포").when(k % 7 == 0, "").when(
        k % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("owner"), (k % 4).cast("string"))))
    kept = F.sort_array(R.owners_except(names))
    return flat(v.notification.select("notification_id", F.when(F.size(kept) > 0, kept).alias("owners")))


@query("report_summary", f"""
    WITH r AS ({_REMEDIATION})
    SELECT advisory_id, CAST(pos AS INTEGER) AS pos, key, value FROM (
        SELECT r.advisory_id, unnest(range(1, 10)) AS pos,
            unnest(['문서번호', '제목', '발신기관', '접수일', '조치기한', 'SLA 상태', '대상 부서', '조치 완료율', '대상 자산']) AS key,
            unnest([r.doc_no, r.title, a.source_org, CAST(a.received_at AS VARCHAR), coalesce(r.due_at, '-'),
                CASE r.sla_status WHEN 'NORMAL' THEN '정상' WHEN 'IMMINENT' THEN '임박' WHEN 'OVERDUE' THEN '기한초과' ELSE '완료' END,
                r.dept_total || '개',
                r.done_rate || '%  (완료 ' || r.done || ' / 진행중 ' || r.in_progress || ' / 불가 ' || r.unable || ' / 미회신 ' || r."none" || ')',
                r.asset_total || '대 (조치완료 ' || r.asset_done || '대)']) AS value
        FROM r JOIN x_advisory a USING (advisory_id))""")
def _(v: Views) -> DataFrame:
    return R.report_summary(v.advisory, R.remediation(v.advisory, v.notification, AS_OF))


@query("report_departments", f"""
    SELECT n.advisory_id, n.notification_id, d.name AS department, CAST(len(n.asset_ids) AS INTEGER) AS asset_count, 'MAIL · WEB_UI' AS channels,
        {ack_ko_sql('n.ack_status')} AS ack_status_ko, '' AS ack_by, coalesce(strftime(n.ack_updated_at, '%Y-%m-%d %H:%M'), '') AS ack_at, '' AS ack_note
    FROM x_note n LEFT JOIN x_department d USING (department_id)""")
def _(v: Views) -> DataFrame:
    return R.report_departments(R.remediation_rows(v.notification, v.department))


@query("report_assets", f"""
    SELECT m.advisory_id, m.cve_id_text AS cve, m.asset_no, m.department, m.product_raw AS product, coalesce(m.version_raw, m.version_norm) AS version,
        m.ip, m.owner_name AS owner, {sev_ko_sql('c.severity')} AS severity FROM x_active m LEFT JOIN x_cve c ON c.cve_id = m.cve_id_text""")
def _(v: Views) -> DataFrame:
    return R.report_assets(v.match, v.asset, v.department, v.cve)


@query("report_cves", f"""
    SELECT k.advisory_id, c.cve_id AS cve, c.product_name AS product, {sev_ko_sql('c.severity')} AS severity,
        CASE WHEN kind = 'enum' THEN array_to_string(vals, ', ') WHEN op = 'lt' THEN lo || ' 미만' ELSE '전체' END AS versions, c.description, c.source
    FROM x_code k JOIN x_cve c ON c.cve_id = k.cve_id_text""")
def _(v: Views) -> DataFrame:
    return R.report_cves(v.codes, v.cve)


@query("report_tables", f"""
    SELECT 'summary' AS sheet, count(*) * 9 AS n FROM x_advisory UNION ALL SELECT 'departments', count(*) FROM x_note
    UNION ALL SELECT 'assets', count(*) FROM x_active
    UNION ALL SELECT 'cves', count(*) FROM x_code WHERE lookup_status = 'FOUND'""")
def _(v: Views) -> DataFrame:
    tables = report_tables(v.advisory, v.notification, v.match, v.asset, v.department, v.codes, v.cve, AS_OF)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("sheet"), "n") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


HISTORY_SQL, DEPARTMENT_ROWS_SQL, BRIEF_SQL, DONE_SQL, DONE_PAIR_SQL, IMPACT_SQL = _HISTORY, _DEPT_ROWS, _BRIEF, _DONE, _DONE_PAIR, _IMPACT
