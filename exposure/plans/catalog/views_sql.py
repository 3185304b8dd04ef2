"""DuckDB definitions of the derived tables, written independently of the Spark views.

``x_`` views only read the driver's tables. They cover the whole tables, as the Spark views do.
"""

from __future__ import annotations

from exposure.constants import AUTO_DEPLOY_OWNER
from exposure.plans.demo import ADVISORY_STATUS, AS_OF, PRODUCTS, VERSIONS

PRODUCT_KEYS = (
    "windows_11", "windows_10", "windows_server", "microsoft_office", "google_chrome", "hancom_office",
    "adobe_acrobat", "edge", "linux_kernel", "ubuntu", "ibm_aix", "openssl", "apache_httpd", "acme_widget_pro",
)


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def product_sql(key: str) -> str:
    return (
        f"CASE WHEN {key} % 10 = 0 THEN {sql_list(PRODUCTS)}[CAST(({key} // 10) % 14 AS INT) + 1] "
        f"ELSE 'Acme Widget-' || ({key} % 997) END"
    )


def product_key_sql(key: str) -> str:
    return (
        f"CASE WHEN {key} % 10 = 0 THEN {sql_list(PRODUCT_KEYS)}[CAST(({key} // 10) % 14 AS INT) + 1] "
        f"ELSE 'acme_widget_' || ({key} % 997) END"
    )


def code_sql(key: str) -> str:
    return f"'CVE-' || (2000 + {key} % 27) || '-' || lpad(CAST({key} AS VARCHAR), CAST(greatest(5, length(CAST({key} AS VARCHAR))) AS INTEGER), '0')"


def ordinal_sql(v: str) -> str:
    """Numbers of a version, padded to four places; null when there are none."""
    return f"""CASE
        WHEN regexp_matches({v}, '^[0-9]{{2}}[hH][0-9]$')
            THEN list_resize([2000 + CAST(substr({v}, 1, 2) AS BIGINT), CAST(substr({v}, 4, 1) AS BIGINT)], 4, 0)
        WHEN contains(lower({v}), 'dc') AND regexp_matches({v}, '(19|20)[0-9]{{2}}')
            THEN list_resize([CAST(regexp_extract({v}, '(19|20)[0-9]{{2}}') AS BIGINT)], 4, 0)
        WHEN regexp_matches({v}, '[0-9]')
            THEN list_resize(list_transform(regexp_extract_all({v}, '[0-9]+'), lambda d: CAST(d AS BIGINT)), 4, 0)
        END"""


def verdict_sql(v: str, o: str) -> str:
    """0 no match, 1 match, 2 match that needs review."""
    return f"""CASE
        WHEN c.kind = 'any' THEN 1
        WHEN {v} = '' THEN 2
        WHEN c.kind = 'enum' THEN CASE WHEN list_contains(list_transform(c.vals, lambda z: lower(z)), lower({v})) THEN 1 ELSE 0 END
        WHEN c.kind = 'range' THEN CASE
            WHEN {o} IS NULL OR c.lo_ord IS NULL THEN 2 WHEN {o} < c.lo_ord THEN 0
            WHEN c.hi_ord IS NULL THEN 2 WHEN {o} <= c.hi_ord THEN 1 ELSE 0 END
        WHEN c.kind = 'cmp' THEN CASE
            WHEN {o} IS NULL OR c.lo_ord IS NULL THEN 2
            WHEN (c.op = 'lt' AND {o} < c.lo_ord) OR (c.op = 'lte' AND {o} <= c.lo_ord) OR (c.op = 'gt' AND {o} > c.lo_ord)
            THEN 1 ELSE 0 END
        ELSE 2 END"""


def pct_sql(part: str, whole: str) -> str:
    return f"CAST(CASE WHEN {whole} > 0 THEN round_even({part} / {whole} * 100, 0) ELSE 0 END AS INTEGER)"


def ack_ko_sql(c: str) -> str:
    return f"CASE {c} WHEN 'NONE' THEN '미회신' WHEN 'IN_PROGRESS' THEN '진행중' WHEN 'DONE' THEN '조치완료' WHEN 'UNABLE' THEN '조치불가' END"


def sev_ko_sql(c: str) -> str:
    return f"CASE {c} WHEN 'CRITICAL' THEN '긴급' WHEN 'HIGH' THEN '높음' WHEN 'MEDIUM' THEN '중간' WHEN 'LOW' THEN '낮음' END"


def rank_sql(c: str) -> str:
    return f"CASE {c} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END"


def top_sql(c: str) -> str:
    """Highest severity of a group."""
    return f"['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][CAST(max({rank_sql(c)}) AS INT)]"


def sla_sql(done: str, due: str = "due_at") -> str:
    return f"""CASE WHEN {done} THEN 'DONE' WHEN {due} IS NULL THEN 'NORMAL'
        WHEN {due} < DATE '{AS_OF}' THEN 'OVERDUE' WHEN {due} <= DATE '{AS_OF}' + 3 THEN 'IMMINENT' ELSE 'NORMAL' END"""


def day_sql(due: str = "due_at") -> str:
    return f"CAST(date_diff('day', DATE '{AS_OF}', {due}) AS INTEGER)"


def ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


_BOUNDS = sql_list(VERSIONS[:9])
_A, _B = f"{_BOUNDS}[p_size % 9 + 1]", f"{_BOUNDS}[(p_size * 5 + 1) % 9 + 1]"

VIEWS: dict[str, str] = {
    "x_department": """
        SELECT CAST(n_nationkey AS BIGINT) AS department_id, n_name AS name, 'D' || n_nationkey AS code,
            n_nationkey % 12 <> 11 AS is_active FROM nation""",
    "x_asset": f"""
        SELECT c_custkey AS asset_id, c_name AS asset_no, CAST(c_nationkey AS BIGINT) AS department_id,
            {product_sql('c_custkey')} AS product_raw, {product_key_sql('c_custkey')} AS product_key,
            {sql_list(VERSIONS)}[CAST((c_custkey * 7 + 3) % 11 AS INT) + 1] AS version_raw,
            CASE WHEN c_custkey % 5 = 0 THEN '21.001.20155'
                ELSE coalesce({sql_list(VERSIONS)}[CAST((c_custkey * 7 + 3) % 11 AS INT) + 1], '') END AS version_norm,
            '10.0.' || ((c_custkey // 250) % 250) || '.' || (c_custkey % 250) AS ip,
            CASE WHEN c_custkey % 9 = 0 THEN '{AUTO_DEPLOY_OWNER}' ELSE 'owner' || (c_custkey % 40) END AS owner_name,
            c_mktsegment AS owner_team,
            '010-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS owner_contact,
            CASE WHEN c_custkey % 17 = 0 THEN 'RETIRED' WHEN c_custkey % 13 = 0 THEN 'RETIRING' ELSE 'NORMAL' END AS status,
            c_acctbal
        FROM customer""",
    "x_cve": f"""
        SELECT {code_sql('p_partkey')} AS cve_id, {product_sql('p_partkey')} AS product_name,
            {product_key_sql('p_partkey')} AS product_key,
            ['any', 'enum', 'cmp', 'cmp', 'cmp', 'range', 'unknown'][p_size % 7 + 1] AS kind,
            CASE WHEN p_size % 7 = 1 THEN [{_A}, {_B}] END AS vals,
            CASE p_size % 7 WHEN 2 THEN 'lt' WHEN 3 THEN 'lte' WHEN 4 THEN 'gt' END AS op,
            CASE WHEN p_size % 7 IN (2, 3, 4, 5) THEN {_A} END AS lo,
            CASE WHEN p_size % 7 = 5 THEN {_B} END AS hi,
            {ordinal_sql(_A)} AS lo_ord, {ordinal_sql(_B)} AS hi_ord,
            CASE p_size % 7 WHEN 0 THEN '*' WHEN 1 THEN '["' || {_A} || '", "' || {_B} || '"]'
                WHEN 2 THEN '{{"lt":"' || {_A} || '"}}' WHEN 3 THEN '{{"lte":"' || {_A} || '"}}'
                WHEN 4 THEN '{{"gt":"' || {_A} || '"}}' WHEN 5 THEN '{{"range":["' || {_A} || '","' || {_B} || '"]}}'
                ELSE '{{"note":"see vendor"}}' END AS affected_versions,
            CASE WHEN p_partkey % 23 = 0 THEN 'MEDIUM' WHEN p_size >= 45 THEN 'CRITICAL' WHEN p_size >= 35 THEN 'HIGH'
                WHEN p_size >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
            CASE WHEN p_partkey % 23 <> 0 THEN CAST(p_size / 5.0 AS DOUBLE) END AS cvss_score,
            p_name || ' ' || p_type AS description,
            CASE WHEN p_partkey % 19 <> 0 THEN DATE '2000-01-01' + CAST(p_partkey % 9000 AS INTEGER) END AS published_at,
            p_brand AS source
        FROM part""",
    "x_line": f"""
        SELECT advisory_id, l_linenumber, l_suppkey, {code_sql('k')} AS code,
            'CVE' || sep || (2000 + k % 27) || sep
                || lpad(CAST(k AS VARCHAR), CAST(greatest(5, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS spelled
        FROM (SELECT l_orderkey AS advisory_id, l_linenumber, l_suppkey,
            CASE WHEN (l_partkey + l_linenumber) % 10 <> 0 THEN l_partkey ELSE l_partkey + 1000000 END AS k,
            ['-', ' ', '_', '  '][l_linenumber % 4 + 1] AS sep FROM lineitem)""",
    "x_text": """
        SELECT advisory_id, string_agg(spelled, ', ' ORDER BY l_linenumber, code) AS text FROM x_line GROUP BY advisory_id""",
    "x_advisory": f"""
        SELECT o_orderkey AS advisory_id, 'DOC-' || o_custkey AS doc_no, 'Advisory ' || o_orderkey AS title,
            o_orderstatus AS source_org, ['NCST', 'WEBMAIL', 'OFFICIAL_DOC'][CAST(o_orderkey % 3 AS INT) + 1] AS receive_channel,
            CAST(o_orderdate AS DATE) AS received_at,
            CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(14 + o_orderkey % 30 AS INTEGER) END AS due_at,
            {sql_list(ADVISORY_STATUS)}[CAST(o_orderkey % 8 AS INT) + 1] AS status,
            CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP) END AS board_published_at,
            CAST(o_orderdate AS TIMESTAMP) AS created_at
        FROM orders""",
    "x_code": """
        SELECT advisory_id, code AS cve_id_text,
            CASE WHEN code IN (SELECT cve_id FROM x_cve) THEN 'FOUND' ELSE 'NOT_FOUND' END AS lookup_status
        FROM (SELECT DISTINCT advisory_id, code FROM x_line)""",
    "x_gate": """
        SELECT a.advisory_id, coalesce(bool_and(c.lookup_status = 'FOUND'), false) AS can_proceed
        FROM x_advisory a LEFT JOIN x_code c USING (advisory_id) GROUP BY a.advisory_id""",
    "x_pair": f"""
        SELECT * FROM (
            SELECT c.cve_id, a.asset_id, a.department_id, c.product_key, c.affected_versions, a.version_norm, a.version_raw,
                {verdict_sql('a.version_norm', 'a.o_norm')} AS vn,
                {verdict_sql("coalesce(a.version_raw, '')", 'a.o_raw')} AS vr
            FROM x_cve c JOIN (
                SELECT *, {ordinal_sql('version_norm')} AS o_norm, {ordinal_sql('version_raw')} AS o_raw
                FROM x_asset WHERE status <> 'RETIRED') a USING (product_key)
        ) WHERE vn > 0 OR vr > 0""",
    "x_found": """
        SELECT k.advisory_id, k.cve_id_text, p.asset_id, p.department_id, p.product_key, p.version_norm AS asset_version,
            p.version_raw AS asset_version_raw, NOT (p.vn = 1 OR p.vr = 1) AS candidate
        FROM x_code k JOIN x_pair p ON p.cve_id = k.cve_id_text""",
    "x_rule": """
        SELECT asset_id, product_key, 'known ' || asset_id AS reason, c_acctbal < 1000 AS is_active FROM x_asset""",
    "x_match": """
        SELECT f.advisory_id, f.cve_id_text, f.asset_id, f.department_id, f.product_key, f.candidate,
            coalesce(r.is_active, false) AS suggested_exclude,
            CASE WHEN (f.advisory_id + f.asset_id) % 11 = 0 THEN 'EXCLUDED' ELSE 'MATCHED' END AS status,
            CASE WHEN (f.advisory_id + f.asset_id) % 11 = 0 THEN 'not applicable' END AS excluded_reason,
            CASE WHEN (f.advisory_id + f.department_id) % 4 = 0 THEN 'DONE'
                ELSE ['DONE', 'IN_PROGRESS', 'UNABLE', 'NONE', 'NONE'][CAST((f.advisory_id * 3 + f.asset_id) % 5 AS INT) + 1] END AS ack_status
        FROM x_found f LEFT JOIN x_rule r ON r.asset_id = f.asset_id AND r.product_key = f.product_key AND r.is_active""",
    "x_active": """
        SELECT m.advisory_id, m.cve_id_text, m.asset_id, m.candidate, m.suggested_exclude, m.ack_status, a.asset_no,
            a.department_id, a.product_raw, a.product_key, a.version_raw, a.version_norm, a.ip, a.owner_name,
            d.name AS department
        FROM x_match m JOIN x_asset a USING (asset_id) LEFT JOIN x_department d ON d.department_id = a.department_id
        WHERE m.status = 'MATCHED'""",
    "x_note": """
        SELECT l_orderkey * 1000000 + l_suppkey AS notification_id, l_orderkey AS advisory_id, l_suppkey % 25 AS department_id,
            asset_ids, CASE flag WHEN 'A' THEN 'SENT' WHEN 'N' THEN 'FAILED' ELSE 'ACKED' END AS status,
            ['NONE', 'IN_PROGRESS', 'DONE', 'UNABLE', 'DONE', 'DONE', 'NONE'][ln] AS ack_status,
            CASE WHEN ln <> 7 THEN ship END AS sent_at,
            CASE WHEN ['NONE', 'IN_PROGRESS', 'DONE', 'UNABLE', 'DONE', 'DONE', 'NONE'][ln] <> 'NONE' THEN ship END AS ack_updated_at,
            ln % 3 AS reminder_count, sha256(l_orderkey || ':' || l_suppkey) AS idempotency_key
        FROM (SELECT l_orderkey, l_suppkey, list_sort(list(DISTINCT l_partkey)) AS asset_ids, min(l_linenumber) AS ln,
            CAST(max(l_shipdate) AS TIMESTAMP) AS ship, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_suppkey)""",
    "x_reply": f"""
        SELECT advisory_id, count(*) AS dept_total,
            count(*) FILTER (ack_status = 'NONE') AS "none", count(*) FILTER (ack_status = 'IN_PROGRESS') AS in_progress,
            count(*) FILTER (ack_status = 'DONE') AS done, count(*) FILTER (ack_status = 'UNABLE') AS unable,
            bool_and(ack_status IN ('DONE', 'UNABLE')) AS all_done,
            CAST(sum(len(asset_ids)) AS BIGINT) AS asset_total,
            CAST(coalesce(sum(len(asset_ids)) FILTER (ack_status = 'DONE'), 0) AS BIGINT) AS asset_done
        FROM x_note GROUP BY advisory_id""",
    "x_latest": """
        SELECT * FROM x_note QUALIFY row_number() OVER (PARTITION BY advisory_id, department_id ORDER BY notification_id DESC) = 1""",
    "x_severity": f"""
        SELECT k.advisory_id, {top_sql('c.severity')} AS max_severity
        FROM x_code k LEFT JOIN x_cve c ON c.cve_id = k.cve_id_text GROUP BY k.advisory_id""",
    "x_comment": """
        SELECT event_id AS comment_id, user_id * 20 AS advisory_id, 'user' || user_id AS author_name,
            CASE WHEN event_id % 4 <> 0 THEN event_id % 25 END AS department_id,
            CASE WHEN event_id % 4 = 0 THEN 'NATION_' || (event_id % 25) END AS department_name, props AS body,
            CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'error' THEN 'UNABLE' END AS ack_status,
            event_id % 10 = 0 AS is_admin,
            CASE WHEN event_id % 7 = 0 THEN 'file' || event_id || '.png' END AS evidence_name, ts AS created_at
        FROM events""",
    "x_ack": """
        SELECT event_id, ts, user_id * 20 AS advisory_id, event_id % 25 AS department_id,
            CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'error' THEN 'UNABLE' ELSE 'NONE' END AS ack_status
        FROM events""",
    "x_audit": """
        SELECT event_id AS audit_id, ts AS created_at, CASE WHEN event_id % 6 <> 5 THEN user_id END AS actor_id,
            ['ADVISORY_UPLOAD', 'ADVISORY_EXTRACT', 'ADVISORY_MATCH', 'MATCH_EXCLUDE', 'NOTIFY_SEND', 'MATCH_RESTORE']
                [CAST(event_id % 6 AS INT) + 1] AS action,
            CASE WHEN event_id % 6 IN (3, 5) THEN 'match' ELSE 'advisory' END AS entity_type,
            user_id * 20 AS entity_id, props AS detail
        FROM events""",
    "x_record": f"""
        SELECT {code_sql('k')} AS cve_id,
            CASE WHEN o_orderkey % 4 <> 0 THEN {product_sql('k')} END AS product_name,
            CASE WHEN o_orderkey % 4 <> 0 THEN {product_key_sql('k')} END AS product_key,
            CASE o_orderkey % 5 WHEN 1 THEN 'enum' WHEN 2 THEN 'cmp' ELSE 'any' END AS kind,
            CASE o_orderkey % 5 WHEN 1 THEN '22H2|23H2' END AS vals, CASE o_orderkey % 5 WHEN 2 THEN '124' END AS lo,
            CASE left(o_orderpriority, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '5' THEN 'LOW' ELSE
                CASE WHEN s = 0 THEN 'MEDIUM' WHEN s >= 9 THEN 'CRITICAL' WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' ELSE 'LOW' END
            END AS severity,
            CASE WHEN s <> 0 THEN CAST(s AS DOUBLE) END AS cvss_score, 'order ' || o_orderkey AS description,
            CAST(o_orderdate AS DATE) AS published_at,
            CASE WHEN o_orderstatus <> 'P' THEN 'SRC-' || o_orderstatus END AS source,
            CAST(o_orderkey % 5 AS INTEGER) AS file_seq, o_orderkey AS pos
        FROM (SELECT *, o_custkey * 2 AS k, CAST(trunc(o_totalprice) AS BIGINT) % 11 AS s FROM orders)""",
    "x_record_last": """
        SELECT * FROM x_record QUALIFY row_number() OVER (PARTITION BY cve_id ORDER BY file_seq DESC, pos DESC) = 1""",
    "x_grid": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS import_id, 0 AS row_no,
            ['Ledger of ' || n_name, NULL, NULL, NULL, NULL, NULL] AS cells FROM nation
        UNION ALL SELECT CAST(n_nationkey AS BIGINT), 1, ['자산번호', '사용부서', '운영체제', 'IP', '담당자', '비고'] FROM nation
        UNION ALL SELECT CAST(c_nationkey AS BIGINT), CAST(c_custkey + 2 AS INTEGER), [
            CASE WHEN c_custkey % 6 <> 0 THEN c_name END,
            CASE WHEN c_custkey % 7 <> 0 THEN ' NATION_' || (c_nationkey + 5 * (c_nationkey % 2)) END,
            CASE WHEN c_custkey % 11 <> 0 THEN ({product_sql('c_custkey')})
                || CASE WHEN c_custkey % 3 = 0 THEN ' v' || (c_custkey % 9) ELSE '' END END,
            '10.1.' || ((c_custkey // 250) % 250) || '.' || (c_custkey % 250),
            'team' || (c_custkey % 5) || ', owner' || (c_custkey % 40),
            CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END] FROM customer""",
}
