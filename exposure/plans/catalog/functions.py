"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.functions.cve import canonical_cve_id, cve_year
from exposure.functions.deadlines import d_day, parse_date_any, parse_date_strict, pct, sla_from_status, sla_status
from exposure.functions.grid import CellSpec, col_letter, letter_to_idx, resolve_cell
from exposure.functions.messages import idempotency_key, parse_ack, render_reminder, render_template
from exposure.operators.products import KNOWN, with_known
from exposure.functions.product import cpe_product, normalize_product, product_ver_label, split_product_version
from exposure.functions.severity import (
    ack_ko, action_ko, severity_from_any, severity_from_cvss, severity_ko, severity_rank, sla_ko,
)
from exposure.functions.text import contains_any, default_title, file_sha256, formula_safe, ilike_any
from exposure.functions.version import (
    normalize_version, parse_version_rule, rule_from_text, rule_label, split_versions, version_cmp, version_matches,
    version_ordinal, version_sort_key,
)
from exposure.operators.feeds import normalize_feed, normalize_nvd
from exposure.plans.catalog.registry import flat, query
from exposure.plans.catalog.views_sql import (
    ack_ko_sql, code_sql, ordinal_sql, pct_sql, product_key_sql, product_sql, rank_sql, sev_ko_sql, sla_sql, sql_list,
    verdict_sql,
)
from exposure.plans.demo import AS_OF, VERSIONS, Views, pick

_V = f"{sql_list(VERSIONS)}[CAST((c_custkey * 7 + 3) % 11 AS INT) + 1]"
_ORD = "CASE WHEN v LIKE '__H_' THEN [2000 + CAST(left(v, 2) AS BIGINT), CAST(v[4] AS BIGINT)] " \
    "WHEN v LIKE 'DC%' THEN [2021] WHEN regexp_matches(v, '[0-9]') " \
    "THEN list_transform(regexp_extract_all(v, '[0-9]+'), lambda d: CAST(d AS BIGINT)) END"


@query("normalize_version", f"SELECT c_custkey AS asset_id, coalesce({_V}, '') AS version FROM customer")
def _(v: Views) -> DataFrame:
    padded = F.concat(F.lit(" \t"), "version_raw", F.lit(" \n"))
    return v.asset.select("asset_id", normalize_version(padded).alias("version"))


@query("version_ordinal", f"""
    SELECT c_custkey AS asset_id, array_to_string({_ORD}, '|') AS numbers FROM (SELECT c_custkey, {_V} AS v FROM customer)""")
def _(v: Views) -> DataFrame:
    return flat(v.asset.select("asset_id", version_ordinal("version_raw").alias("numbers")))


@query("version_cmp", f"""
    SELECT c_custkey AS asset_id, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END AS cmp
    FROM (SELECT c_custkey, {ordinal_sql(_V)} AS a, {ordinal_sql(sql_list(VERSIONS) + '[CAST(c_custkey % 11 AS INT) + 1]')} AS b
    FROM customer)""")
def _(v: Views) -> DataFrame:
    other = pick(VERSIONS, F.expr("asset_id % 11"))
    return v.asset.select("asset_id", version_cmp("version_raw", other).alias("cmp"))


@query("version_sort_key", f"""
    SELECT first, n FROM (SELECT {ordinal_sql(_V)} AS o, min(c_custkey) AS first, count(*) AS n FROM customer GROUP BY 1)""")
def _(v: Views) -> DataFrame:
    keyed = v.asset.groupBy(version_sort_key("version_raw").alias("k"))
    return keyed.agg(F.min("asset_id").alias("first"), F.count("*").alias("n")).select("first", "n")


@query("parse_version_rule", """
    SELECT cve_id, kind, array_to_string(vals, '|') AS vals, op, lo, hi FROM x_cve""")
def _(v: Views) -> DataFrame:
    r = v.cve.select("cve_id", parse_version_rule("affected_versions").alias("r"))
    return flat(r.select("cve_id", "r.kind", F.col("r.values").alias("vals"), "r.op", "r.lo", "r.hi"))


@query("version_matches", f"""
    SELECT cve_id, code > 0 AS matched, code = 2 AS candidate FROM (
        SELECT c.cve_id, {verdict_sql('c.v', ordinal_sql('c.v'))} AS code
        FROM (SELECT *, coalesce({sql_list(VERSIONS)}[CAST(CAST(right(cve_id, 5) AS BIGINT) % 11 AS INT) + 1], '') AS v FROM x_cve) c)""")
def _(v: Views) -> DataFrame:
    version = pick(VERSIONS, F.expr("CAST(right(cve_id, 5) AS BIGINT) % 11"))
    return v.cve.select("cve_id", version_matches(version, "version_rule").alias("m")).select("cve_id", "m.*")


@query("rule_label", """
    SELECT cve_id, CASE WHEN kind = 'enum' THEN array_to_string(vals, ', ') WHEN op = 'lt' THEN lo || ' 미만' ELSE '전체' END AS label
    FROM x_cve""")
def _(v: Views) -> DataFrame:
    return v.cve.select("cve_id", rule_label("version_rule").alias("label"))


_LIST_TEXT = "o_orderpriority || ' / ' || o_orderstatus || ';; ' || o_custkey || ','"


@query("split_versions", f"""
    SELECT o_orderkey AS id, array_to_string(list_filter(list_transform(
        regexp_split_to_array({_LIST_TEXT}, '[;,/]'), lambda s: trim(s)), lambda s: s <> ''), '|') AS parts, 'enum' AS kind
    FROM orders""")
def _(v: Views) -> DataFrame:
    text = F.expr("concat(o_orderpriority, ' / ', o_orderstatus, ';; ', o_custkey, ',')")
    o = v.table("orders").select(
        F.col("o_orderkey").alias("id"), split_versions(text).alias("parts"), rule_from_text(text)["kind"].alias("kind")
    )
    return flat(o)


@query("normalize_product", f"""
    SELECT c_custkey AS id, {product_key_sql('c_custkey')} AS product_key FROM customer
    UNION ALL SELECT p_partkey + 1000000000, {product_key_sql('p_partkey')} FROM part
    UNION ALL SELECT s_suppkey + 2000000000, lower(replace(s_name, '#', '_')) FROM supplier""")
def _(v: Views) -> DataFrame:
    a = v.asset.select(F.col("asset_id").alias("id"), F.upper("product_raw").alias("raw"))
    p = v.table("part").select("p_partkey").join(
        v.cve.select(F.expr("CAST(right(cve_id, length(cve_id) - 9) AS BIGINT)").alias("p_partkey"), "product_name"), "p_partkey"
    ).select((F.col("p_partkey") + 1000000000).alias("id"), F.concat(F.lit("  "), "product_name").alias("raw"))
    s = v.table("supplier").select((F.col("s_suppkey") + 2000000000).alias("id"), F.concat("s_name", F.lit(" -- ")).alias("raw"))
    return a.unionByName(p).unionByName(s).select("id", normalize_product("raw").alias("product_key"))


def _alias_rows(v: Views) -> DataFrame:
    """Six aliases for each part."""
    each = v.table("part").selectExpr("p_partkey", "p_name", "explode(sequence(0, 5)) AS i")
    return each.selectExpr("concat('p', p_partkey) AS product_key", "concat(' ', upper(p_name), ' ', p_partkey * 6 + i) AS alias")


@query("product_aliases", """
    WITH t AS MATERIALIZED (SELECT o_orderkey AS id, p_name, 'Acme ' || upper(p_name) || ' ' || o_orderkey % 20000 || ' v' || o_orderkey % 9 AS raw,
        CAST(o_orderkey % 20000 AS VARCHAR) AS digits FROM orders JOIN part ON p_partkey = o_custkey),
    a AS MATERIALIZED (SELECT p_partkey, p_name, CAST(p_partkey * 6 + i AS VARCHAR) AS digits FROM part, range(6) r(i)),
    b AS (SELECT id, p_partkey, length(a.digits) AS n
        FROM t JOIN a ON split_part(a.p_name, ' ', -1) = split_part(t.p_name, ' ', -1) AND ends_with(t.p_name, a.p_name) AND starts_with(t.digits, a.digits)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(a.p_name) + length(a.digits) DESC, 'p' || p_partkey) = 1)
    SELECT id, coalesce('p' || b.p_partkey, regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g')) AS product_key,
        CASE WHEN n IS NOT NULL THEN trim(substr(raw, CAST(length('Acme ' || p_name || ' ') + n + 1 AS BIGINT)), ' -/().,') END AS version
    FROM t LEFT JOIN b USING (id)""")
def _(v: Views) -> DataFrame:
    """Keys and versions by an alias table that grows with the parts."""
    named = v.table("orders").join(v.table("part"), F.col("p_partkey") == F.col("o_custkey")).selectExpr(
        "o_orderkey AS id", "concat('Acme ', upper(p_name), ' ', o_orderkey % 20000, ' v', o_orderkey % 9) AS raw")
    found = with_known(named, F.col("raw"), _alias_rows(v))
    version = F.when(F.col(KNOWN).isNotNull(), split_product_version("raw", known=F.col(KNOWN))["version"])
    return found.select("id", normalize_product("raw", known=F.col(KNOWN)).alias("product_key"), version.alias("version"))


_HEAD = sql_list(("Windows 11", "win10", "Microsoft Windows Server", "MS Office", "Google Chrome", "한컴오피스", "Adobe Acrobat",
                  "msedge", "Linux Kernel", "Ubuntu", "IBM AIX", "OpenSSL", "Apache HTTP Server", "Acme Widget-Pro"))
_TAIL = sql_list(("", "Pro", "2022", "", "", "", "DC", "", "", "Linux", "", "", "", ""))


@query("split_product_version", f"""
    SELECT id, CASE WHEN i < 13 THEN {_HEAD}[i + 1] WHEN ver = 'n/a' THEN name || ' n/a' ELSE name END AS product,
        CASE WHEN i < 13 THEN trim({_TAIL}[i + 1] || ' ' || ver) WHEN ver = 'n/a' THEN '' ELSE ver END AS version
    FROM (SELECT c_custkey AS id, {product_sql('c_custkey')} AS name, coalesce({_V}, '') AS ver,
        CASE WHEN c_custkey % 10 = 0 THEN CAST((c_custkey // 10) % 14 AS INT) ELSE 99 END AS i FROM customer)""")
def _(v: Views) -> DataFrame:
    text = F.concat_ws(" ", "product_raw", "version_raw")
    return v.asset.select(F.col("asset_id").alias("id"), split_product_version(text).alias("s")).select("id", "s.*")


@query("product_ver_label", f"""
    SELECT c_custkey AS id, rtrim({product_sql('c_custkey')} || ' · ' || coalesce({_V}, ''), ' ·') AS label FROM customer""")
def _(v: Views) -> DataFrame:
    return v.asset.select(
        F.col("asset_id").alias("id"), product_ver_label(F.col("product_raw"), F.col("version_raw")).alias("label")
    )


@query("cpe_product", """
    SELECT p_partkey AS id, lower(p_type) || ' ' || p_name || ' kit' AS product FROM part""")
def _(v: Views) -> DataFrame:
    cpe = F.expr("concat('cpe:2.3:a:', lower(p_type), ':', replace(p_name, ' ', '_'), '_kit:1.0:*')")
    return v.table("part").select(F.col("p_partkey").alias("id"), cpe_product(cpe).alias("product"))


@query("severity_from_cvss", """
    SELECT p_partkey AS id, CASE WHEN p_partkey % 23 = 0 THEN 'MEDIUM' WHEN p_size >= 45 THEN 'CRITICAL' WHEN p_size >= 35 THEN 'HIGH'
        WHEN p_size >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM part""")
def _(v: Views) -> DataFrame:
    score = F.expr("CASE WHEN p_partkey % 23 <> 0 THEN p_size / 5.0 END")
    return v.table("part").select(F.col("p_partkey").alias("id"), severity_from_cvss(score).alias("severity"))


@query("severity_from_any", "SELECT pos AS id, severity FROM x_record")
def _(v: Views) -> DataFrame:
    r = v.feed_record
    score = F.when(F.col("cvss") != "0", F.col("cvss"))
    return r.select(F.col("pos.row").alias("id"), severity_from_any("severity", score).alias("severity"))


@query("severity_labels", f"""
    SELECT cve_id, {rank_sql('severity')} AS rank, {sev_ko_sql('severity')} AS label FROM x_cve""")
def _(v: Views) -> DataFrame:
    return v.cve.select("cve_id", severity_rank("severity").alias("rank"), severity_ko("severity").alias("label"))


@query("status_labels", f"""
    SELECT audit_id AS id, {ack_ko_sql('ack_status')} AS ack,
        CASE action WHEN 'ADVISORY_UPLOAD' THEN '권고문 업로드' WHEN 'ADVISORY_EXTRACT' THEN 'CVE 추출' WHEN 'ADVISORY_MATCH' THEN '자산 매칭'
            WHEN 'MATCH_EXCLUDE' THEN '오탐 제외' WHEN 'NOTIFY_SEND' THEN '권고 발송' ELSE action END AS action,
        CASE WHEN ack_status = 'DONE' THEN '완료' ELSE '정상' END AS sla
    FROM x_audit JOIN x_ack ON event_id = audit_id""")
def _(v: Views) -> DataFrame:
    both = v.audit.join(v.ack_event.select("event_id", "ack_status"), F.col("event_id") == F.col("audit_id"))
    sla = F.when(F.col("ack_status") == "DONE", "DONE").otherwise("NORMAL")
    return both.select(
        F.col("audit_id").alias("id"), ack_ko("ack_status").alias("ack"), action_ko("action").alias("action"), sla_ko(sla).alias("sla")
    )


@query("parse_date_any", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS any_format,
        CASE WHEN o_orderkey % 5 IN (0, 3) THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS strict FROM orders""")
def _(v: Views) -> DataFrame:
    text = F.expr(
        "date_format(o_orderdate, CASE o_orderkey % 5 WHEN 0 THEN 'yyyy-MM-dd' WHEN 1 THEN 'yyyy.MM.dd' WHEN 2 THEN 'yyyy/MM/dd'"
        " WHEN 3 THEN \"yyyy-MM-dd'T'HH:mm:ss\" ELSE 'dd-MM-yyyy' END)"
    )
    return flat(v.table("orders").select(
        F.col("o_orderkey").alias("id"), parse_date_any(text).alias("any_format"), parse_date_strict(text).alias("strict")
    ))


@query("canonical_cve_id", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, min({code_sql('l_partkey')}) AS code,
        CAST(min(2000 + l_partkey % 27) AS INTEGER) AS year FROM lineitem GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    raw = F.expr("concat('ref: cve', CASE WHEN l_linenumber % 2 = 0 THEN '_' ELSE ' ' END, 2000 + l_partkey % 27, '  ',"
                 " lpad(l_partkey, greatest(5, length(l_partkey)), '0'), ' (x)')")
    code = canonical_cve_id(raw)
    return v.table("lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.count("*").alias("n"), F.min(code).alias("code"), F.min(cve_year(code)).alias("year")
    )


@query("deadline_classes", f"""
    SELECT advisory_id, CAST(date_diff('day', DATE '{AS_OF}', due_at) AS INTEGER) AS d_day,
        {sla_sql("status = 'MATCHED'")} AS by_reply, {sla_sql("status IN ('COMPLETED', 'ARCHIVED')")} AS by_status FROM x_advisory""")
def _(v: Views) -> DataFrame:
    return v.advisory.select(
        "advisory_id", d_day("due_at", AS_OF).alias("d_day"),
        sla_status("due_at", F.col("status") == "MATCHED", AS_OF).alias("by_reply"),
        sla_from_status("status", "due_at", AS_OF).alias("by_status"),
    )


@query("percent_half_even", f"""
    SELECT p_partkey AS id, {pct_sql('(p_size % 9)', '(p_partkey % 17)')} AS pct FROM part""")
def _(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("id"), pct(F.expr("p_size % 9"), F.expr("p_partkey % 17")).alias("pct"))


@query("idempotency_key", """
    SELECT notification_id, sha256(advisory_id || ':' || department_id || ':[' || array_to_string(asset_ids, ', ') || ']') AS key
    FROM x_note""")
def _(v: Views) -> DataFrame:
    shuffled = F.reverse("asset_ids")
    return v.notification.select(
        "notification_id", idempotency_key("advisory_id", "department_id", shuffled).alias("key")
    )


@query("column_letters", """
    SELECT c_custkey AS id, CASE WHEN n < 26 THEN chr(65 + n)
        WHEN n < 702 THEN chr(64 + n // 26) || chr(65 + n % 26)
        ELSE chr(64 + (n - 26) // 676) || chr(65 + ((n - 26) // 26) % 26) || chr(65 + n % 26) END AS letters, n AS back
    FROM (SELECT c_custkey, CAST(c_custkey % 18278 AS INTEGER) AS n FROM customer)""")
def _(v: Views) -> DataFrame:
    letters = col_letter(F.expr("c_custkey % 18278"))
    return v.table("customer").select(
        F.col("c_custkey").alias("id"), letters.alias("letters"), letter_to_idx(F.lower(letters)).alias("back")
    )


@query("resolve_cell", """
    SELECT import_id, row_no, CASE WHEN row_no > 1 THEN split_part(cells[5], ', ', 2) END AS owner, cells[6] AS note,
        trim(cells[2]) AS department FROM x_grid""")
def _(v: Views) -> DataFrame:
    return v.grid.select(
        "import_id", "row_no",
        resolve_cell("cells", CellSpec.of({"col": "E", "sep": ",", "part": 1})).alias("owner"),
        resolve_cell("cells", CellSpec.of("F")).alias("note"), resolve_cell("cells", CellSpec.of("b")).alias("department"),
    )


@query("resolve_cell_product", f"""
    SELECT c_custkey AS id,
        CASE WHEN i IS NULL THEN name ELSE {_HEAD}[i + 1] END AS product,
        CASE WHEN i IS NULL OR i = 13 THEN nullif(trim(tail), '') ELSE nullif(trim({_TAIL}[i + 1] || tail), '') END AS version
    FROM (SELECT c_custkey, {product_sql('c_custkey')} AS name, CASE WHEN c_custkey % 3 = 0 THEN ' v' || (c_custkey % 9) ELSE '' END AS tail,
        CASE WHEN c_custkey % 10 = 0 THEN CAST((c_custkey // 10) % 14 AS INT) END AS i FROM customer WHERE c_custkey % 11 <> 0)
    UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 11 = 0""")
def _(v: Views) -> DataFrame:
    body = v.grid.where("row_no > 1")
    return body.select(
        (F.col("row_no") - 2).cast("bigint").alias("id"),
        resolve_cell("cells", CellSpec.of({"col": "C", "mode": "product"})).alias("product"),
        resolve_cell("cells", CellSpec.of({"col": "C", "mode": "version"})).alias("version"),
    )


_PAYLOAD = """concat('{"', CASE WHEN event_id % 2 = 0 THEN 'department' ELSE 'dept' END, '":"NATION_', event_id % 25, '","status":"',
    element_at(array('완료', 'done', '조치불가', 'in_progress', 'maybe', ''), CAST(event_id % 6 + 1 AS INT)),
    '","ack":"none","note":"n', event_id, '"}')"""


@query("parse_ack", """
    SELECT event_id AS id, CASE WHEN s IS NOT NULL THEN 'NATION_' || (event_id % 25) END AS department, s AS ack_status,
        CASE WHEN s IS NOT NULL THEN 'n' || event_id END AS note
    FROM (SELECT event_id, ['DONE', 'DONE', 'UNABLE', 'IN_PROGRESS', NULL, 'NONE'][CAST(event_id % 6 AS INT) + 1] AS s FROM events)""")
def _(v: Views) -> DataFrame:
    e = v.table("events").select(F.col("event_id").alias("id"), parse_ack(F.expr(_PAYLOAD)).alias("r"))
    return e.select("id", "r.department", "r.ack_status", "r.note")


@query("render_template", """
    SELECT advisory_id, '[' || title || '] ' || doc_no || ' until ' || coalesce(CAST(due_at AS VARCHAR), '') || ' for ' || source_org AS body
    FROM x_advisory""")
def _(v: Views) -> DataFrame:
    body = F.lit("[{제목}] {문서번호} until {기한} for {부서}")
    return v.advisory.select("advisory_id", render_template(body, "title", "doc_no", "due_at", "source_org").alias("body"))


@query("render_reminder", f"""
    SELECT advisory_id, CASE WHEN source_org = 'P' THEN 'custom ' || advisory_id ELSE
        '[조치기한 임박 알림] ' || title || chr(10) || '근거 ' || doc_no || ' · 기한 ' || coalesce(CAST(due_at AS VARCHAR), '')
        || coalesce(' (D' || CASE WHEN d >= 0 THEN '+' ELSE '' END || d || ')', '') || chr(10)
        || '귀 부서 회신이 확인되지 않았습니다. 기한 내 조치 후 회신 바랍니다.' END AS body
    FROM (SELECT *, date_diff('day', DATE '{AS_OF}', due_at) AS d FROM x_advisory)""")
def _(v: Views) -> DataFrame:
    custom = F.expr("CASE source_org WHEN 'P' THEN concat(' custom ', advisory_id) WHEN 'O' THEN '  ' END")
    return v.advisory.select("advisory_id", render_reminder("title", "doc_no", "due_at", AS_OF, custom).alias("body"))


@query("ilike_any", """
    SELECT c_custkey AS id FROM customer WHERE c_name ILIKE '%mer#%12_%' OR c_mktsegment ILIKE '%mer#%12_%'
    UNION ALL SELECT -1 - p_partkey FROM part WHERE p_name ILIKE '%RED%' OR p_type ILIKE '%RED%'""")
def _(v: Views) -> DataFrame:
    c = v.table("customer").where(ilike_any(["c_name", "c_mktsegment"], "mer#%12_")).select(F.col("c_custkey").alias("id"))
    p = v.table("part").where(ilike_any(["p_name", "p_type"], "RED")).select((-1 - F.col("p_partkey")).alias("id"))
    return c.unionByName(p)


@query("contains_any", """
    SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'the of') OR contains(lower(source), 'the of')""")
def _(v: Views) -> DataFrame:
    return v.table("documents").where(contains_any(["text", "source"], " The OF ")).select(F.col("doc_id").alias("id"))


@query("file_sha256", "SELECT doc_id AS id, sha256(text) AS sha FROM documents")
def _(v: Views) -> DataFrame:
    return v.table("documents").select(F.col("doc_id").alias("id"), file_sha256("text").alias("sha"))


@query("default_title", """
    SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id ELSE source || '.v' || doc_id END AS title FROM documents""")
def _(v: Views) -> DataFrame:
    title = F.expr("CASE doc_id % 3 WHEN 0 THEN concat(' T', doc_id, ' ') WHEN 1 THEN '  ' END")
    name = F.expr("concat(source, '.v', doc_id, '.pdf')")
    return v.table("documents").select(F.col("doc_id").alias("id"), default_title(title, name).alias("title"))


@query("formula_safe", """
    SELECT c_custkey AS id, ['''=', '''+', '''-', '''@', ''][CAST(c_custkey % 5 AS INT) + 1] || c_name AS cell FROM customer""")
def _(v: Views) -> DataFrame:
    cell = F.concat(pick(("=", "+", "-", "@", ""), F.expr("c_custkey % 5")), F.col("c_name"))
    return v.table("customer").select(F.col("c_custkey").alias("id"), formula_safe(cell).alias("cell"))


@query("normalize_feed", """
    SELECT pos AS id, cve_id, product_name, product_key, kind, vals, lo, severity, cvss_score, description,
        CAST(published_at AS VARCHAR) AS published_at, source FROM x_record""")
def _(v: Views) -> DataFrame:
    r = normalize_feed(v.feed_record)
    return flat(r.select(
        F.col("pos.row").alias("id"), "cve_id", "product_name", "product_key", "version_rule.kind",
        F.col("version_rule.values").alias("vals"), "version_rule.lo", "severity", "cvss_score", "description", "published_at", "source",
    ))


def nvd_rows(v: Views) -> DataFrame:
    """NVD-shaped records built from the part table."""
    metric = "array(named_struct('cvssData', named_struct('baseScore', {0}, 'baseSeverity', {1}), 'baseSeverity', {2}))"
    none = "CAST(array() AS array<struct<cvssData:struct<baseScore:double,baseSeverity:string>,baseSeverity:string>>)"
    v31 = metric.format("CAST(p_size / 5.0 AS DOUBLE)", "'HIGH'", "CAST(NULL AS STRING)")
    v2 = metric.format("CAST(p_size / 10.0 AS DOUBLE)", "CAST(NULL AS STRING)", "'low'")
    cpe = (
        "named_struct('vulnerable', {0}, 'criteria', concat('cpe:2.3:a:', lower(p_type), ':', replace(p_name, ' ', '_'), {1}),"
        " 'versionStartIncluding', {2}, 'versionEndIncluding', {3}, 'versionEndExcluding', {4})"
    )
    null = "CAST(NULL AS STRING)"
    first = cpe.format("false", "'_off:1'", null, null, "'9'")
    second = cpe.format("p_size % 4 <> 0", "':1'", "'1.0'", "concat('2.', p_size)", null)
    third = cpe.format("true", "'_x:1'", null, null, "CASE WHEN p_size % 3 = 0 THEN concat('5.', p_size) END")
    return v.table("part").select(
        F.expr(
            "named_struct('id', concat('CVE-', 2000 + p_partkey % 27, '-', lpad(p_partkey, greatest(5, length(p_partkey)), '0')),"
            " 'published', concat(DATE'2010-01-01' + CAST(p_size AS INT), 'T10:00:00.000'),"
            " 'descriptions', array(named_struct('lang', 'es', 'value', concat('es ', p_name)),"
            " named_struct('lang', CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'fr' END, 'value', concat('x ', p_name))),"
            f" 'metrics', named_struct('cvssMetricV31', CASE WHEN p_size % 3 = 0 THEN {v31} ELSE {none} END,"
            f" 'cvssMetricV30', {none}, 'cvssMetricV2', CASE WHEN p_size % 3 <> 2 THEN {v2} END),"
            f" 'configurations', array(named_struct('nodes', array(named_struct('cpeMatch', array({first}, {second})))),"
            f" named_struct('nodes', array(named_struct('cpeMatch', array({third}))))))"
        ).alias("cve"),
        F.col("p_partkey"),
    )


@query("normalize_nvd", f"""
    SELECT p_partkey, {code_sql('p_partkey')} AS cve_id,
        lower(p_type) || ' ' || p_name || CASE WHEN p_size % 4 = 0 THEN ' x' ELSE '' END AS product_name,
        CASE WHEN p_size % 3 = 0 THEN 'cmp' WHEN p_size % 4 <> 0 THEN 'range' ELSE 'any' END AS kind,
        CASE WHEN p_size % 3 = 0 THEN '5.' || p_size WHEN p_size % 4 <> 0 THEN '1.0' END AS lo,
        CASE WHEN p_size % 3 <> 0 AND p_size % 4 <> 0 THEN '2.' || p_size END AS hi,
        CASE WHEN p_size % 3 = 0 THEN 'HIGH' WHEN p_size % 3 = 1 THEN 'LOW' ELSE 'MEDIUM' END AS severity,
        CASE WHEN p_size % 3 = 0 THEN p_size / 5.0 WHEN p_size % 3 = 1 THEN round(p_size / 10.0, 1) END AS cvss_score,
        CASE WHEN p_size % 2 = 0 THEN 'x ' ELSE 'es ' END || p_name AS description,
        CAST(DATE '2010-01-01' + p_size AS VARCHAR) AS published_at, 'NVD' AS source,
        CASE WHEN p_size % 4 <> 0 THEN 2 ELSE 1 END AS cpes
    FROM part""")
def _(v: Views) -> DataFrame:
    r = normalize_nvd(nvd_rows(v))
    return flat(r.select(
        "p_partkey", "cve_id", "product_name", "version_rule.kind", "version_rule.lo", "version_rule.hi", "severity", "cvss_score",
        "description", "published_at", "source", F.size("cpe_list").alias("cpes"),
    ))


