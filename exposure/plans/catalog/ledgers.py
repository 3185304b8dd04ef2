"""Asset ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.functions.grid import letter_to_idx
from exposure.operators import ledger as L
from exposure.operators.matching import asset_hits
from exposure.plans.catalog.registry import flat, query
from exposure.plans.catalog.views_sql import VIEWS, product_key_sql, product_sql
from exposure.plans.demo import Views
from exposure.session import store

# One merged range starts at every customer's row, 31 rows deep for the richer ones; the one that starts last wins.
_FILLED = """
    SELECT g.import_id, g.row_no, array_to_string(list_transform(g.cells, lambda c, i: coalesce(CASE
        WHEN g.row_no = 0 THEN g.cells[1] WHEN i = 2 AND g.row_no > 1 THEN f.v ELSE c END, '~')), '|') AS cells
    FROM x_grid g LEFT JOIN (
        SELECT g.import_id, g.row_no, arg_max(struct_pack(v := a.cells[2]), r.r0).v AS v FROM x_grid g
        JOIN (SELECT CAST(c_nationkey AS BIGINT) AS import_id, c_custkey + 2 AS r0, c_custkey + 2 + CASE WHEN c_acctbal > 5000 THEN 30 ELSE 0 END AS r1
            FROM customer) r ON r.import_id = g.import_id AND g.row_no BETWEEN r.r0 AND r.r1
        JOIN x_grid a ON a.import_id = r.import_id AND a.row_no = r.r0 GROUP BY 1, 2) f USING (import_id, row_no)"""


@query("fill_merged", _FILLED)
def _(v: Views) -> DataFrame:
    return flat(L.fill_merged(v.grid, v.merged_range).drop("sheet"))


@query("detect_header_row", "SELECT CAST(n_nationkey AS BIGINT) AS import_id, 1 AS header_row FROM nation")
def _(v: Views) -> DataFrame:
    return L.detect_header_row(v.grid).drop("sheet")


@query("header_scores", """
    SELECT import_id, row_no, CAST(CASE row_no WHEN 0 THEN 1 WHEN 1 THEN 5 * 3 + 6 ELSE
        3 * (CASE WHEN contains(lower(cells[2]), 'dept') THEN 1 ELSE 0 END) + len(list_filter(cells, lambda c: c IS NOT NULL))
        - 2 * len(list_filter(cells, lambda c: c IS NOT NULL AND regexp_full_match(replace(c, '.', ''), '[0-9]+')))
        + 3 * len(list_filter(cells, lambda c: regexp_matches(lower(c), '번호|asset|부서|dept|운영체제|os|제품|sw|product|버전|ver|ip|주소|담당|사용자|owner|이름|팀|소속|전화|contact|phone|tel|소프트웨어|프로그램|아이피|연락처|휴대폰|핸드폰')))
        END AS INTEGER) AS score
    FROM x_grid WHERE row_no < 15""")
def _(v: Views) -> DataFrame:
    return L.header_scores(v.grid).drop("sheet")


def _two_row(v: Views) -> DataFrame:
    """Second header line under the first."""
    extra = v.table("nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS import_id", "'ledger' AS sheet", "2 AS row_no",
        "array('자산번호', '', 'OS', NULL, concat('no ', n_nationkey), ' 비고 ') AS cells",
    )
    body = v.grid.where("row_no > 1").withColumn("row_no", F.col("row_no") + 1)
    return v.grid.where("row_no < 2").unionByName(extra).unionByName(body)


@query("combine_headers", """
    SELECT CAST(n_nationkey AS BIGINT) AS import_id, '자산번호|사용부서|운영체제 / OS|IP|담당자 / no ' || n_nationkey || '|비고' AS headers FROM nation""")
def _(v: Views) -> DataFrame:
    header = L.detect_header_row(v.grid)
    return flat(L.combine_headers(_two_row(v), header, 2).drop("sheet"))


@query("suggest_mapping", """
    SELECT CAST(n_nationkey AS BIGINT) AS import_id, unnest(['asset_no', 'department', 'product_key', 'ip', 'owner_name']) AS field,
        unnest([0, 1, 2, 3, 4]) AS idx FROM nation""")
def _(v: Views) -> DataFrame:
    headers = L.combine_headers(v.grid, L.detect_header_row(v.grid))
    mapping = headers.select("import_id", F.explode(L.suggest_mapping("headers")).alias("field", "letter"))
    return mapping.select("import_id", "field", letter_to_idx("letter").alias("idx"))


@query("preview_columns", """
    SELECT h.import_id, h.col, chr(65 + h.col) AS letter, h.header, coalesce(s.samples, '') AS samples FROM (
        SELECT CAST(n_nationkey AS BIGINT) AS import_id, unnest([0, 1, 2, 3, 4, 5]) AS col,
            unnest(['자산번호', '사용부서', '운영체제', 'IP', '담당자', '비고']) AS header FROM nation) h
    LEFT JOIN (SELECT import_id, col, string_agg(v, '|' ORDER BY row_no) AS samples FROM (
        SELECT import_id, row_no, unnest(range(0, 6)) AS col, unnest(cells) AS v FROM x_grid WHERE row_no BETWEEN 2 AND 6) WHERE v IS NOT NULL GROUP BY 1, 2) s
    USING (import_id, col)""")
def _(v: Views) -> DataFrame:
    return flat(L.preview_columns(v.grid, L.detect_header_row(v.grid)).drop("sheet"))


@query("preview_rows", """
    SELECT import_id, row_no, array_to_string(list_transform(cells, lambda c: coalesce(c, '')), '|') AS cells FROM x_grid WHERE row_no < 12""")
def _(v: Views) -> DataFrame:
    return flat(L.preview_rows(v.grid).drop("sheet"))


MAPPING = {
    "asset_no": "A", "department": "B", "product_key": "C", "ip": "D",
    "owner_team": {"col": "E", "sep": ",", "part": 0}, "owner_name": {"col": "E", "sep": ",", "part": 1},
}


def _body(v: Views) -> DataFrame:
    return L.body_rows(v.grid, L.detect_header_row(v.grid))


_TAIL = "['', 'Pro', '2022', '', '', '', 'DC', '', '', 'Linux', '', '', '', '']"
_MAPPED = f"""(SELECT CAST(c_nationkey AS BIGINT) AS import_id, c_custkey + 2 AS row_no,
        CASE WHEN c_custkey % 6 <> 0 THEN c_name ELSE 'AUTO-' || c_nationkey || '-' || (c_custkey + 3) END AS asset_no,
        CASE WHEN c_custkey % 7 <> 0 THEN 'NATION_' || (c_nationkey + 5 * (c_nationkey % 2)) END AS department,
        CASE WHEN c_custkey % 11 <> 0 THEN ({product_sql('c_custkey')}) || CASE WHEN c_custkey % 3 = 0 THEN ' v' || (c_custkey % 9) ELSE '' END END AS product_raw,
        CASE WHEN c_custkey % 11 <> 0 THEN {product_key_sql('c_custkey')} ELSE '' END AS product_key,
        CASE WHEN c_custkey % 11 <> 0 THEN nullif(trim(CASE WHEN c_custkey % 10 = 0 THEN {_TAIL}[CAST((c_custkey // 10) % 14 AS INT) + 1] ELSE '' END
            || CASE WHEN c_custkey % 3 = 0 THEN ' v' || (c_custkey % 9) ELSE '' END), '') END AS version_raw,
        '10.1.' || ((c_custkey // 250) % 250) || '.' || (c_custkey % 250) AS ip, 'owner' || (c_custkey % 40) AS owner_name,
        'team' || (c_custkey % 5) AS owner_team, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS note
    FROM customer)"""


@query("map_rows", f"""
    SELECT import_id, CAST(row_no AS INTEGER) AS row_no, asset_no, department, product_raw, product_key, version_raw, ip, owner_name, owner_team, note FROM {_MAPPED}""")
def _(v: Views) -> DataFrame:
    m = L.map_rows(_body(v), MAPPING)
    return m.select(
        "import_id", "row_no", "asset_no", "department", "product_raw", "product_key", "version_raw", "ip", "owner_name", "owner_team",
        F.try_element_at("extra", F.lit("F")).alias("note"),
    )


@query("missing_departments", f"""
    SELECT DISTINCT department AS name FROM {_MAPPED} WHERE department IS NOT NULL AND department NOT IN (SELECT name FROM x_department)""")
def _(v: Views) -> DataFrame:
    return L.missing_departments(L.map_rows(_body(v), MAPPING), v.department)


@query("import_warnings", f"""
    SELECT import_id, CAST(row_no + 1 AS INTEGER) AS line, 'MISSING_DEPARTMENT' AS issue, '' AS value FROM {_MAPPED} WHERE department IS NULL
    UNION ALL SELECT import_id, CAST(row_no + 1 AS INTEGER), 'UNKNOWN_DEPARTMENT', department FROM {_MAPPED} WHERE department NOT IN (SELECT name FROM x_department)
    UNION ALL SELECT import_id, CAST(row_no + 1 AS INTEGER), 'MISSING_PRODUCT', '' FROM {_MAPPED} WHERE product_raw IS NULL
    UNION ALL SELECT import_id, CAST(row_no + 1 AS INTEGER), 'MISSING_VERSION', '' FROM {_MAPPED} WHERE version_raw IS NULL""")
def _(v: Views) -> DataFrame:
    rows = L.with_issues(L.map_rows(_body(v), MAPPING), v.department, create_departments=False)
    return L.import_warnings(rows).drop("sheet")


@query("import_stats", f"""
    SELECT import_id, count(*) AS total_rows, count(*) FILTER (department IS NOT NULL AND product_raw IS NOT NULL) AS committed,
        CAST(sum(CAST(department IS NULL AS INT) + CAST(product_raw IS NULL AS INT) + CAST(version_raw IS NULL AS INT)) AS BIGINT) AS warnings,
        count(DISTINCT CASE WHEN department NOT IN (SELECT name FROM x_department) THEN department END) AS created_departments
    FROM {_MAPPED} GROUP BY 1""")
def _(v: Views) -> DataFrame:
    body = _body(v)
    return L.import_stats(body, L.with_issues(L.map_rows(body, MAPPING), v.department), v.department, "reject")


_COMMITTED = f"""
    SELECT coalesce(m.asset_no, a.asset_no) AS asset_no, CASE WHEN m.asset_no IS NULL THEN d.name ELSE m.department END AS department,
        CASE WHEN m.asset_no IS NULL THEN a.product_key ELSE m.product_key END AS product_key,
        CASE WHEN m.asset_no IS NULL THEN a.version_norm ELSE coalesce(m.version_raw, '') END AS version_norm,
        CASE WHEN m.asset_no IS NULL THEN a.owner_name ELSE m.owner_name END AS owner_name,
        CASE WHEN m.asset_no IS NULL THEN a.status ELSE 'NORMAL' END AS status, m.import_id AS import_batch_id
    FROM (SELECT * FROM {_MAPPED} WHERE department IS NOT NULL) m FULL JOIN x_asset a ON a.asset_no = m.asset_no
    LEFT JOIN x_department d ON d.department_id = a.department_id"""


def _stored_assets(v: Views) -> DataFrame:
    dept = v.department.select("department_id", F.col("name").alias("department"))
    return v.asset.join(dept, "department_id", "left").drop("department_id", "asset_id").withColumns(
        {"import_batch_id": F.lit(None).cast("bigint"), "extra": F.lit(None).cast("map<string,string>")}
    )


@query("commit_assets", _COMMITTED)
def _(v: Views) -> DataFrame:
    out = L.commit_assets(_body(v), MAPPING, _stored_assets(v), v.department)["asset"]
    return out.select("asset_no", "department", "product_key", "version_norm", "owner_name", "status", "import_batch_id")


@query("commit_assets_replace", f"""
    SELECT asset_no, department, product_key FROM {_MAPPED} WHERE department IN (SELECT name FROM x_department) AND product_raw IS NOT NULL""")
def _(v: Views) -> DataFrame:
    out = L.commit_assets(_body(v), MAPPING, _stored_assets(v), v.department, "replace", "reject", create_departments=False)
    return out["asset"].select("asset_no", "department", "product_key")


@query("commit_assets_duplicates", """
    SELECT CAST(c_nationkey AS BIGINT) AS import_id, CAST(c_custkey + 3 AS INTEGER) AS line, 'DUPLICATE_ASSET_NO' AS issue, 'N' || c_nationkey AS value
    FROM customer WHERE c_custkey % 7 <> 0
        AND c_custkey NOT IN (SELECT max(c_custkey) FROM customer WHERE c_custkey % 7 <> 0 GROUP BY c_nationkey)""")
def _(v: Views) -> DataFrame:
    # every row of a sheet carries the same asset number
    same = v.grid.withColumn("cells", F.when(F.col("row_no") > 1, F.transform(
        "cells", lambda c, i: F.when(i == 0, F.concat(F.lit("N"), F.col("import_id").cast("string"))).otherwise(c))).otherwise(F.col("cells")))
    body = L.body_rows(same, L.detect_header_row(same))
    out = L.commit_assets(body, MAPPING, _stored_assets(v), v.department)
    return out["warnings"].where("issue = 'DUPLICATE_ASSET_NO'").drop("sheet")


_KEYED = f"""
    arrived AS MATERIALIZED (SELECT * FROM {_MAPPED} WHERE department IS NOT NULL),
    named AS (SELECT department_id, name FROM x_department UNION ALL
        SELECT (SELECT max(department_id) FROM x_department) + row_number() OVER (ORDER BY name), name
        FROM (SELECT DISTINCT department AS name FROM arrived WHERE department NOT IN (SELECT name FROM x_department))),
    joint AS (SELECT coalesce(m.asset_no, a.asset_no) AS asset_no, a.asset_id AS old_id, m.asset_no IS NOT NULL AS fresh,
            coalesce(m.department, d.name) AS name, CASE WHEN m.asset_no IS NULL THEN a.product_key ELSE m.product_key END AS product_key,
            CASE WHEN m.asset_no IS NULL THEN a.version_norm ELSE coalesce(m.version_raw, '') END AS version_norm,
            CASE WHEN m.asset_no IS NULL THEN a.version_raw ELSE m.version_raw END AS version_raw,
            CASE WHEN m.asset_no IS NULL THEN a.status ELSE 'NORMAL' END AS status
        FROM arrived m FULL JOIN x_asset a ON a.asset_no = m.asset_no LEFT JOIN x_department d ON d.department_id = a.department_id),
    keyed AS MATERIALIZED (SELECT j.*, n.department_id, coalesce(old_id,
            (SELECT max(asset_id) FROM x_asset) + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY asset_no)) AS asset_id
        FROM joint j LEFT JOIN named n USING (name))"""


@query("ledger_to_matches", f"""
    WITH {_KEYED}, pair AS ({VIEWS["x_pair"].replace("x_asset", "keyed")}),
    hits AS (SELECT p.asset_id, count(*) AS matches, count(*) FILTER (NOT (p.vn = 1 OR p.vr = 1)) AS candidates
        FROM x_code c JOIN pair p ON p.cve_id = c.cve_id_text GROUP BY 1)
    SELECT k.asset_id, k.asset_no, CAST(k.department_id AS BIGINT) AS department_id, coalesce(h.matches, 0) AS matches,
        coalesce(h.candidates, 0) AS candidates
    FROM keyed k LEFT JOIN hits h USING (asset_id)""")
def _(v: Views) -> DataFrame:
    """From the cells of the ledgers to matches: loaded assets and new departments get ids, then the core join runs on them."""
    named = v.department.select("department_id", F.col("name").alias("department"))
    stored = v.asset.join(named, "department_id", "left").drop("department_id").withColumns(
        {"import_batch_id": F.lit(None).cast("bigint"), "extra": F.lit(None).cast("map<string,string>")}
    )
    out = L.commit_assets(_body(v), MAPPING, stored, v.department)
    asset = store(L.with_keys(out["asset"], out["department"]), "keyed")
    hits = asset_hits(v.codes, v.cve, asset)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("matches", "candidates")}
    return asset.select("asset_id", "asset_no", F.col("department_id").cast("bigint").alias("department_id")).join(hits, "asset_id", "left").withColumns(zero)
