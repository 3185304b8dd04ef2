"""Feed records, upserts, imports, local year feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.operators.feeds import (
    apply_import, combined_total, feed_counts, kev_to_records, last_wins, malformed_ids, merge_modified_feed,
    normalize_feed, split_new_updated, union_feeds, upsert_cves, validate_feed, with_year,
)
from exposure.operators.state import apply_changes, publish, refused_creates
from exposure.plans.catalog.registry import flat, query
from exposure.plans.catalog.views_sql import code_sql, ts_sql
from exposure.plans.demo import Views
from exposure.sources.files import verify_feed_files



def _at() -> Column:
    return F.lit("2024-05-05 05:05:05").cast("timestamp")


def _records(v: Views) -> DataFrame:
    return normalize_feed(v.feed_record)


@query("last_wins", "SELECT cve_id, description, file_seq, pos AS row FROM x_record_last")
def _(v: Views) -> DataFrame:
    return last_wins(_records(v)).select("cve_id", "description", "file_seq", F.col("pos.row").alias("row"))


@query("split_new_updated", """
    SELECT cve_id IN (SELECT cve_id FROM x_cve) AS known, count(*) AS records, count(DISTINCT cve_id) AS ids FROM x_record GROUP BY 1""")
def _(v: Views) -> DataFrame:
    new, updated = split_new_updated(_records(v), v.cve)
    both = new.select("cve_id", F.lit(False).alias("known")).unionByName(updated.select("cve_id", F.lit(True).alias("known")))
    return both.groupBy("known").agg(F.count("*").alias("records"), F.count_distinct("cve_id").alias("ids"))


@query("feed_counts", """
    SELECT count(*) FILTER (cve_id NOT IN (SELECT cve_id FROM x_cve)) AS added,
        count(*) FILTER (cve_id IN (SELECT cve_id FROM x_cve)) AS updated,
        (SELECT source FROM x_record WHERE source IS NOT NULL ORDER BY file_seq, pos LIMIT 1) AS first_source FROM x_record""")
def _(v: Views) -> DataFrame:
    return feed_counts(_records(v), v.cve)


@query("validate_feed", "SELECT count(*) AS records, count(*) > 0 AS accepted FROM x_record")
def _(v: Views) -> DataFrame:
    return validate_feed(_records(v))


_UPSERTED = """
    SELECT coalesce(r.cve_id, c.cve_id) AS cve_id, CASE WHEN r.cve_id IS NULL THEN c.product_key ELSE r.product_key END AS product_key,
        CASE WHEN r.cve_id IS NULL THEN c.kind ELSE r.kind END AS kind,
        CASE WHEN r.cve_id IS NULL THEN c.severity ELSE r.severity END AS severity,
        CASE WHEN r.cve_id IS NULL THEN c.cvss_score ELSE r.cvss_score END AS cvss_score,
        CASE WHEN r.cve_id IS NULL THEN c.description ELSE r.description END AS description,
        CAST(CASE WHEN r.cve_id IS NULL THEN c.published_at ELSE r.published_at END AS VARCHAR) AS published_at,
        CASE WHEN r.cve_id IS NULL THEN c.source ELSE r.source END AS source,
        CASE WHEN r.cve_id IS NOT NULL THEN 42 END AS feed_import_id,
        CASE WHEN c.cve_id IS NULL THEN '2024-05-05 05:05:05.000000' ELSE '2020-01-01 00:00:00.000000' END AS created_at,
        CASE WHEN c.cve_id IS NOT NULL AND r.cve_id IS NOT NULL THEN '2024-05-05 05:05:05.000000' END AS updated_at,
        CASE WHEN c.cve_id IS NULL THEN 'added' WHEN r.cve_id IS NULL THEN 'kept' ELSE 'updated' END AS action
    FROM x_cve c FULL JOIN x_record_last r ON r.cve_id = c.cve_id"""


@query("upsert_cves", _UPSERTED)
def _(v: Views) -> DataFrame:
    out = upsert_cves(v.cve.drop("affected_versions"), _records(v), _at(), 42)
    return flat(out.select(
        "cve_id", "product_key", F.col("version_rule.kind").alias("kind"), "severity", "cvss_score", "description", "published_at",
        "source", "feed_import_id", "created_at", "updated_at", F.col("_action").alias("action"),
    ))


@query("upsert_cves_twice", """
    SELECT CASE WHEN r.cve_id IS NULL THEN 'kept' ELSE 'updated' END AS action, count(*) AS n
    FROM x_cve c FULL JOIN x_record_last r ON r.cve_id = c.cve_id GROUP BY 1""")
def _(v: Views) -> DataFrame:
    once = upsert_cves(v.cve.drop("affected_versions"), _records(v), _at(), 42).drop("_action")
    return upsert_cves(once, _records(v), _at(), 42).groupBy(F.col("_action").alias("action")).agg(F.count("*").alias("n"))


@query("apply_import", """
    SELECT 'added' AS what, count(*) FILTER (cve_id NOT IN (SELECT cve_id FROM x_cve)) AS n FROM x_record_last
    UNION ALL SELECT 'updated', count(*) FILTER (cve_id IN (SELECT cve_id FROM x_cve)) FROM x_record_last
    UNION ALL SELECT 'unlocked', count(*) FROM x_advisory a JOIN (
        SELECT o.advisory_id FROM x_code o GROUP BY 1
        HAVING bool_and(o.lookup_status = 'FOUND' OR o.cve_id_text IN (SELECT cve_id FROM x_record))
            AND bool_or(o.lookup_status = 'NOT_FOUND' AND o.cve_id_text IN (SELECT cve_id FROM x_record))) u USING (advisory_id)
        WHERE a.status = 'NEEDS_CVE_UPDATE'""")
def _(v: Views) -> DataFrame:
    imports = v.department.selectExpr(
        "department_id AS import_id", "CASE WHEN department_id < 5 THEN 'VALIDATED' ELSE 'APPLIED' END AS status",
        "0L AS added_count", "0L AS updated_count", "CAST(NULL AS TIMESTAMP) AS applied_at",
    )
    stored = v.codes
    r = apply_import(imports, 3, v.cve.drop("affected_versions"), _records(v), v.advisory, stored, _at())
    applied = r["imports"].where("import_id = 3")
    waiting = v.advisory.where("status = 'NEEDS_CVE_UPDATE'").select("advisory_id")
    unlocked = r["advisory"].where("unlocked").join(waiting, "advisory_id", "left_semi")
    return (
        applied.select(F.lit("added").alias("what"), F.col("added_count").alias("n"))
        .unionByName(applied.select(F.lit("updated").alias("what"), F.col("updated_count").alias("n")))
        .unionByName(unlocked.agg(F.count("*").alias("n")).select(F.lit("unlocked").alias("what"), "n"))
    )


@query("kev_records", f"""
    SELECT {code_sql('p_partkey')} AS cve_id, p_brand || ' ' || p_name AS product_name, 'HIGH' AS severity, p_type AS description,
        CAST(DATE '2022-01-01' + p_size AS VARCHAR) AS published_at, 'CISA-KEV' AS source FROM part""")
def _(v: Views) -> DataFrame:
    entries = v.table("part").selectExpr(
        "concat('CVE-', 2000 + p_partkey % 27, '-', lpad(p_partkey, greatest(5, length(p_partkey)), '0')) AS cveID",
        "p_brand AS vendorProject", "p_name AS product", "p_type AS vulnerabilityName",
        "CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS shortDescription",
        "CAST(DATE'2022-01-01' + CAST(p_size AS INT) AS STRING) AS dateAdded",
    )
    r = normalize_feed(kev_to_records(entries))
    return flat(r.select("cve_id", "product_name", "severity", "description", "published_at", "source"))


@query("union_feeds", f"""
    SELECT cve_id, description, 'file' AS origin FROM x_record
    UNION ALL SELECT {code_sql('p_partkey')}, p_name, NULL FROM part""")
def _(v: Views) -> DataFrame:
    a = _records(v).select("cve_id", "description", F.lit("file").alias("origin"))
    b = v.cve.join(v.table("part").selectExpr("p_name", "p_partkey AS k"), F.expr("CAST(substring(cve_id, 10) AS BIGINT) = k")).select(
        "cve_id", F.col("p_name").alias("description")
    )
    return union_feeds(a, b)


@query("merge_modified_feed", """
    WITH changed AS (SELECT cve_id, CAST(substr(cve_id, 5, 4) AS INTEGER) AS cve_year, description FROM x_record_last),
        years AS (SELECT DISTINCT cve_year FROM changed)
    SELECT cve_year, count(*) AS entries, count(*) FILTER (fresh) AS changed, min(item) AS first_item FROM (
        SELECT cve_id, cve_year, description AS item, true AS fresh FROM changed
        UNION ALL SELECT cve_id, CAST(substr(cve_id, 5, 4) AS INTEGER), description, false FROM x_cve
        WHERE CAST(substr(cve_id, 5, 4) AS INTEGER) IN (SELECT cve_year FROM years) AND cve_id NOT IN (SELECT cve_id FROM changed))
    GROUP BY cve_year""")
def _(v: Views) -> DataFrame:
    local = with_year(v.cve).select("cve_id", "cve_year", F.col("description").alias("item"))
    modified = _records(v).select("cve_id", F.col("description").alias("item"), "file_seq", "pos")
    now = dt.datetime(2024, 5, 5)
    merged = merge_modified_feed(local, modified, now - dt.timedelta(days=2), now, "a", "b")
    return merged.groupBy("cve_year").agg(
        F.count("*").alias("entries"), F.count_if(F.startswith("item", F.lit("order "))).alias("changed"),
        F.min("item").alias("first_item"),
    )


@query("combined_export_counts", """
    SELECT CAST(substr(cve_id, 5, 4) AS INTEGER) AS cve_year, count(*) AS entries FROM x_cve
    WHERE CAST(substr(cve_id, 5, 4) AS INTEGER) BETWEEN 1999 AND 2020 GROUP BY 1""")
def _(v: Views) -> DataFrame:
    return combined_total(with_year(v.cve), 1999, 2020)


@query("malformed_ids", "SELECT p_partkey AS id FROM part WHERE p_size % 5 = 0")
def _(v: Views) -> DataFrame:
    ids = v.table("part").selectExpr(
        "p_partkey AS id", "CASE WHEN p_size % 5 = 0 THEN concat('CWE-', p_partkey) ELSE concat('CVE-2020-', p_partkey) END AS cve_id"
    )
    return malformed_ids(ids).select("id")


@query("verify_feed_files", """
    SELECT 'feed' || doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'MISSING' WHEN doc_id % 7 = 0 THEN 'NO_META'
            WHEN doc_id % 3 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END AS state,
        doc_id % 5 <> 0 AND doc_id % 4 <> 0 AS verified,
        doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0 AS fetch FROM documents""")
def _(v: Views) -> DataFrame:
    d = v.table("documents").selectExpr("doc_id", "concat('feed', doc_id) AS name", "sha2(text, 256) AS sha")
    files = d.where("doc_id % 5 <> 0").selectExpr("name", "CASE WHEN doc_id % 4 = 0 THEN sha2(sha, 256) ELSE sha END AS sha256")
    meta = d.selectExpr("name", "'sha256' AS key", "upper(sha) AS value")
    old = d.where("doc_id % 7 <> 0").selectExpr("name", "'sha256' AS key", "CASE WHEN doc_id % 3 = 0 THEN 'OLD' ELSE sha END AS value")
    return verify_feed_files(files, meta, old).select("name", "state", "verified", "fetch")


@query("apply_changes", """
    SELECT name, CASE WHEN op IN ('upsert', 'set') THEN 'changed by ' || seq ELSE code END AS code FROM (
        SELECT d.name, d.code, e.op, e.seq FROM x_department d LEFT JOIN (
            SELECT 'NATION_' || (event_id % 40) AS name, event_id AS seq,
                ['create', 'upsert', 'set', 'delete'][CAST(event_id // 40 % 4 AS INT) + 1] AS op FROM events
            QUALIFY row_number() OVER (PARTITION BY event_id % 40 ORDER BY event_id DESC) = 1) e USING (name))
    WHERE coalesce(op, '') <> 'delete'
    UNION ALL SELECT name, 'changed by ' || seq FROM (
        SELECT 'NATION_' || (event_id % 40) AS name, event_id AS seq,
            ['create', 'upsert', 'set', 'delete'][CAST(event_id // 40 % 4 AS INT) + 1] AS op FROM events
        QUALIFY row_number() OVER (PARTITION BY event_id % 40 ORDER BY event_id DESC) = 1)
    WHERE name NOT IN (SELECT name FROM x_department) AND op IN ('create', 'upsert')""")
def _(v: Views) -> DataFrame:
    table = v.department.select("name", "code")
    return apply_changes(table, _changes(v), ["name"])


def _changes(v: Views) -> DataFrame:
    return v.table("events").selectExpr(
        "concat('NATION_', event_id % 40) AS name", "event_id AS seq",
        "element_at(array('create', 'upsert', 'set', 'delete'), CAST((event_id div 40) % 4 + 1 AS INT)) AS op",
        "concat('changed by ', event_id) AS code",
    )


@query("refused_creates", """
    SELECT event_id AS seq FROM events WHERE event_id // 40 % 4 = 0 AND 'NATION_' || (event_id % 40) IN (SELECT name FROM x_department)""")
def _(v: Views) -> DataFrame:
    return refused_creates(v.department, _changes(v), ["name"]).select("seq")


@query("publish_advisories", f"""
    SELECT advisory_id, {ts_sql('p')} AS board_published_at FROM (SELECT advisory_id, CASE WHEN source_org = 'P' THEN NULL
        WHEN source_org = 'F' THEN coalesce(board_published_at, TIMESTAMP '2024-05-05 05:05:05') ELSE board_published_at END AS p FROM x_advisory)""")
def _(v: Views) -> DataFrame:
    flags = v.advisory.where("source_org <> 'O'").select("advisory_id", (F.col("source_org") == "F").alias("publish"))
    return flat(publish(v.advisory, flags, _at()).select("advisory_id", "board_published_at"))


