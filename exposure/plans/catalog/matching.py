"""Lookup, gate, the core join and the state of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.operators.advisories import (
    add_codes, ready_for_matching, reevaluate_status, reextract, remove_codes, unlock_advisories,
)
from exposure.operators.matching import (
    active_matches, active_rules, cascade_delete, cve_summary, flag_suggested, forget_exclusions, gate, lookup_cves,
    match_assets, match_count_per_cve, match_run_stats, match_summary, merge_matches, remember_exclusions,
    resolve_pending, set_match_status, with_reason,
)
from exposure.plans.catalog.registry import query
from exposure.plans.delta_run import run_matching_delta
from exposure.plans.demo import Views
from exposure.plans.exposure_report import department_exposure
from exposure.plans.matching_run import run_matching
from exposure.session import store


@query("lookup_cves", "SELECT advisory_id, cve_id_text, lookup_status FROM x_code")
def _(v: Views) -> DataFrame:
    codes = v.advisory_cve.drop("lookup_status")
    return lookup_cves(codes, v.cve).select("advisory_id", "cve_id_text", "lookup_status")


def _older(v: Views) -> DataFrame:
    """The CVE table before its latest source arrived."""
    return v.cve.where("source <> 'Brand#7'")


_OLD_CODE = """(SELECT advisory_id, cve_id_text, CASE WHEN cve_id_text IN (SELECT cve_id FROM x_cve WHERE source <> 'Brand#7')
    THEN 'FOUND' ELSE 'NOT_FOUND' END AS lookup_status FROM x_code)"""


@query("resolve_pending", f"""
    SELECT advisory_id, cve_id_text FROM {_OLD_CODE} WHERE lookup_status = 'NOT_FOUND' AND cve_id_text IN (SELECT cve_id FROM x_cve)""")
def _(v: Views) -> DataFrame:
    before = lookup_cves(v.codes.drop("lookup_status"), _older(v))
    return resolve_pending(before, v.cve).select("advisory_id", "cve_id_text")


@query("unlock_advisories", f"""
    SELECT a.advisory_id, CASE WHEN u.yes AND a.status = 'NEEDS_CVE_UPDATE' THEN 'EXTRACTED' ELSE a.status END AS status,
        coalesce(u.yes AND a.status = 'NEEDS_CVE_UPDATE', false) AS unlocked
    FROM x_advisory a LEFT JOIN (
        SELECT o.advisory_id, bool_or(o.lookup_status = 'NOT_FOUND' AND n.lookup_status = 'FOUND') AND bool_and(n.lookup_status = 'FOUND') AS yes
        FROM {_OLD_CODE} o JOIN x_code n USING (advisory_id, cve_id_text) GROUP BY o.advisory_id) u USING (advisory_id)""")
def _(v: Views) -> DataFrame:
    before = lookup_cves(v.codes.drop("lookup_status"), _older(v))
    nxt, _codes = unlock_advisories(v.advisory, before, v.cve)
    return nxt.select("advisory_id", "status", "unlocked")


@query("gate", "SELECT advisory_id, can_proceed FROM x_gate")
def _(v: Views) -> DataFrame:
    return gate(v.advisory, v.codes)


@query("ready_for_matching", """
    SELECT advisory_id, CASE WHEN status = 'EXTRACTING' THEN 'EXTRACTING' WHEN NOT can_proceed THEN 'NEEDS_CVE_UPDATE' END AS blocked
    FROM x_advisory JOIN x_gate USING (advisory_id)""")
def _(v: Views) -> DataFrame:
    return ready_for_matching(v.advisory, v.codes).select("advisory_id", "blocked")


@query("cve_summary", """
    SELECT advisory_id, count(*) AS extracted, count(*) FILTER (lookup_status = 'FOUND') AS found,
        count(*) FILTER (lookup_status = 'NOT_FOUND') AS not_found FROM x_code GROUP BY advisory_id""")
def _(v: Views) -> DataFrame:
    return cve_summary(v.codes)


@query("match_assets", """
    SELECT advisory_id, cve_id_text, asset_id, department_id, product_key, asset_version, asset_version_raw, candidate FROM x_found""")
def _(v: Views) -> DataFrame:
    return v.found.select(
        "advisory_id", "cve_id_text", "asset_id", "department_id", "reason.product_key", "reason.asset_version",
        "reason.asset_version_raw", "reason.candidate",
    )


@query("match_assets_by_kind", """
    SELECT c.kind, f.candidate, count(*) AS matches, count(DISTINCT f.asset_id) AS assets
    FROM x_found f JOIN x_cve c ON c.cve_id = f.cve_id_text GROUP BY 1, 2""")
def _(v: Views) -> DataFrame:
    return v.found.groupBy(F.col("reason.version_rule.kind").alias("kind"), F.col("reason.candidate").alias("candidate")).agg(
        F.count("*").alias("matches"), F.count_distinct("asset_id").alias("assets")
    )


@query("department_exposure", """
    SELECT p.department_id, d.name AS department, p.cve_id AS cve_id_text, c.severity, count(*) AS assets,
        count(*) FILTER (NOT (p.vn = 1 OR p.vr = 1)) AS to_review
    FROM x_pair p JOIN x_cve c USING (cve_id) LEFT JOIN x_department d USING (department_id)
    WHERE p.cve_id IN (SELECT cve_id_text FROM x_code) GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    return department_exposure(v.codes, v.cve, v.asset, v.department)


@query("flag_suggested", "SELECT advisory_id, cve_id_text, asset_id, suggested_exclude FROM x_match")
def _(v: Views) -> DataFrame:
    return flag_suggested(v.found, v.exclusion_rule).select(
        "advisory_id", "cve_id_text", "asset_id", "reason.suggested_exclude"
    )


def _stored(v: Views) -> DataFrame:
    """Matches kept from earlier runs: some of today's, and some whose advisory changed since."""
    return v.match.withColumn(
        "advisory_id", F.expr("CASE WHEN asset_id % 2 = 1 OR asset_id % 8 = 0 THEN advisory_id + 100000000 ELSE advisory_id END")
    )


_STORED = """(SELECT * REPLACE (CASE WHEN asset_id % 2 = 1 OR asset_id % 8 = 0 THEN advisory_id + 100000000 ELSE advisory_id END AS advisory_id)
    FROM x_match)"""


@query("merge_matches", f"""
    SELECT coalesce(o.advisory_id, n.advisory_id) AS advisory_id, coalesce(o.cve_id_text, n.cve_id_text) AS cve_id_text,
        coalesce(o.asset_id, n.asset_id) AS asset_id, coalesce(n.candidate, o.candidate) AS candidate,
        coalesce(o.status, 'MATCHED') AS status, coalesce(o.ack_status, 'NONE') AS ack_status, n.asset_id IS NOT NULL AS touched
    FROM {_STORED} o FULL JOIN x_found n
        ON o.advisory_id = n.advisory_id AND o.cve_id_text = n.cve_id_text AND o.asset_id = n.asset_id""")
def _(v: Views) -> DataFrame:
    return merge_matches(with_reason(_stored(v), "candidate"), with_reason(v.found, "candidate")).select(
        "advisory_id", "cve_id_text", "asset_id", "reason.candidate", "status", "ack_status", "touched"
    )


@query("match_run_stats", f"""
    SELECT n.advisory_id, count(*) FILTER (coalesce(o.status, 'MATCHED') = 'MATCHED') AS matched,
        count(DISTINCT CASE WHEN coalesce(o.status, 'MATCHED') = 'MATCHED' THEN n.department_id END) AS departments,
        count(*) FILTER (n.candidate) AS candidates, count(*) FILTER (n.suggested_exclude) AS suggested_exclude
    FROM x_match n LEFT JOIN {_STORED} o ON o.advisory_id = n.advisory_id AND o.cve_id_text = n.cve_id_text AND o.asset_id = n.asset_id
    GROUP BY n.advisory_id""")
def _(v: Views) -> DataFrame:
    told = ("candidate", "suggested_exclude")
    found = with_reason(match_assets(v.codes, v.cve, v.asset, v.exclusion_rule), *told)
    return match_run_stats(merge_matches(with_reason(_stored(v), *told), found), v.asset)


_PASSED = """SELECT f.* FROM x_found f JOIN x_gate g USING (advisory_id) JOIN x_advisory s USING (advisory_id)
    WHERE g.can_proceed AND s.status <> 'EXTRACTING'"""


@query("run_matching_rows", f"""
    SELECT coalesce(o.advisory_id, n.advisory_id) AS advisory_id, coalesce(o.cve_id_text, n.cve_id_text) AS cve_id_text,
        coalesce(o.asset_id, n.asset_id) AS asset_id, coalesce(n.candidate, o.candidate) AS candidate,
        coalesce(o.status, 'MATCHED') AS status, coalesce(o.ack_status, 'NONE') AS ack_status
    FROM {_STORED} o FULL JOIN ({_PASSED}) n
        ON o.advisory_id = n.advisory_id AND o.cve_id_text = n.cve_id_text AND o.asset_id = n.asset_id""")
def _(v: Views) -> DataFrame:
    r = run_matching(v.advisory, v.codes, v.cve, v.asset, _stored(v), v.exclusion_rule)
    return r["matches"].select("advisory_id", "cve_id_text", "asset_id", "reason.candidate", "status", "ack_status")


@query("run_matching_delta", f"""
    WITH passed AS (SELECT advisory_id FROM x_gate JOIN x_advisory s USING (advisory_id) WHERE can_proceed AND s.status <> 'EXTRACTING'),
    now AS (SELECT advisory_id, cve_id_text, asset_id, candidate, suggested_exclude FROM x_match SEMI JOIN passed USING (advisory_id)),
    before AS (SELECT k.advisory_id, k.cve_id_text, a.asset_id, coalesce(r.is_active, false) AS suggested_exclude
        FROM x_code k SEMI JOIN passed USING (advisory_id) JOIN x_cve c ON c.cve_id = k.cve_id_text
        JOIN x_asset a ON a.product_key = c.product_key LEFT JOIN x_rule r ON r.asset_id = a.asset_id AND r.is_active
        WHERE a.asset_id % 10 = 4 AND a.status <> 'RETIRED' AND k.advisory_id % 7 <> 0 AND c.cve_id NOT LIKE '%7'),
    lost AS (SELECT * FROM before ANTI JOIN now USING (advisory_id, cve_id_text, asset_id)),
    seen AS (SELECT *, true AS touched FROM now UNION ALL
        SELECT advisory_id, cve_id_text, asset_id, true, suggested_exclude, false FROM lost)
    SELECT coalesce(o.advisory_id, n.advisory_id) AS advisory_id, coalesce(o.cve_id_text, n.cve_id_text) AS cve_id_text,
        coalesce(o.asset_id, n.asset_id) AS asset_id, coalesce(n.candidate, o.candidate) AS candidate,
        coalesce(n.suggested_exclude, o.suggested_exclude) AS suggested_exclude, coalesce(o.status, 'MATCHED') AS status,
        coalesce(o.ack_status, 'NONE') AS ack_status, coalesce(n.touched, false) AS touched
    FROM {_STORED} o FULL JOIN seen n
        ON o.advisory_id = n.advisory_id AND o.cve_id_text = n.cve_id_text AND o.asset_id = n.asset_id""")
def _(v: Views) -> DataFrame:
    """A run over earlier tables, then one over today's: some advisories, assets and exclusions are new, some assets have
    told their version since, some CVEs have moved to another product."""
    blank = F.col("asset_id") % 10 == 4
    asset = v.asset.where("asset_id % 10 <> 3").withColumns({
        c: F.when(~blank, F.col(c)) for c in ("version_norm", "version_raw")
    })
    cve = v.cve.withColumn("product_key", F.when(F.col("cve_id").endswith("7"), "another").otherwise(F.col("product_key")))
    rules = v.exclusion_rule.withColumn("is_active", F.col("is_active") & (F.col("asset_id") % 4 != 1))
    stored = store(_stored(v), "match")  # both runs read it several times
    first = run_matching_delta(v.advisory, v.codes.where("advisory_id % 7 <> 0"), cve, asset, stored, rules)
    second = run_matching_delta(
        v.advisory, v.codes, v.cve, v.asset, first["matches"], v.exclusion_rule, first["links"], first["assets"]
    )
    return second["matches"].select(
        "advisory_id", "cve_id_text", "asset_id", "reason.candidate", "reason.suggested_exclude", "status", "ack_status", "touched"
    )


@query("run_matching", """
    SELECT a.advisory_id, CASE WHEN g.can_proceed AND a.status IN ('EXTRACTED', 'NEEDS_CVE_UPDATE') THEN 'MATCHED' ELSE a.status END AS status,
        coalesce(m.n, 0) AS matches
    FROM x_advisory a JOIN x_gate g USING (advisory_id) LEFT JOIN (
        SELECT advisory_id, count(*) AS n FROM (SELECT advisory_id, cve_id_text, asset_id FROM ("""+_PASSED+""")
            UNION SELECT advisory_id, cve_id_text, asset_id FROM """+_STORED+""") GROUP BY 1) m USING (advisory_id)
""")
def _(v: Views) -> DataFrame:
    r = run_matching(v.advisory, v.codes, v.cve, v.asset, _stored(v), v.exclusion_rule)
    n = r["matches"].groupBy("advisory_id").agg(F.count("*").alias("matches"))
    return r["advisory"].join(n, "advisory_id", "left").select("advisory_id", "status", F.coalesce("matches", F.lit(0)).alias("matches"))


@query("match_summary", """
    SELECT advisory_id, count(*) AS total, count(*) FILTER (status = 'MATCHED') AS active,
        count(*) FILTER (status = 'EXCLUDED') AS excluded,
        count(DISTINCT CASE WHEN status = 'MATCHED' THEN department_id END) AS departments,
        count(*) FILTER (status = 'MATCHED' AND candidate) AS candidates FROM x_match GROUP BY advisory_id""")
def _(v: Views) -> DataFrame:
    return match_summary(v.match, v.asset)


@query("match_count_per_cve", """
    SELECT advisory_id, cve_id_text, count(*) AS match_count FROM x_match WHERE status = 'MATCHED' GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    return match_count_per_cve(v.match)


@query("active_matches", """
    SELECT advisory_id, cve_id_text, asset_id, asset_no, owner_name, department_id FROM x_active WHERE department_id = 7""")
def _(v: Views) -> DataFrame:
    return active_matches(v.match, v.asset, 7).select(
        "advisory_id", "cve_id_text", "asset_id", "asset_no", "owner_name", "department_id"
    )


def _decisions(v: Views) -> DataFrame:
    """Two decisions of an analyst per match of some assets; the second one counts."""
    base = v.match.where("asset_id % 3 = 0").select("advisory_id", "cve_id_text", "asset_id", "reason.product_key")
    first = base.selectExpr("*", "'EXCLUDED' AS status", "concat('fp ', asset_id) AS reason", "1 AS actor", "1 AS seq")
    second = base.where("asset_id % 6 = 0").selectExpr(
        "*", "'MATCHED' AS status", "CAST(NULL AS STRING) AS reason", "2 AS actor", "2 AS seq"
    )
    return first.unionByName(second)


@query("set_match_status", """
    SELECT advisory_id, cve_id_text, asset_id,
        CASE WHEN asset_id % 6 = 0 THEN 'MATCHED' WHEN asset_id % 3 = 0 THEN 'EXCLUDED' ELSE status END AS status,
        CASE WHEN asset_id % 6 = 0 THEN NULL WHEN asset_id % 3 = 0 THEN 'fp ' || asset_id ELSE excluded_reason END AS excluded_reason
    FROM x_match""")
def _(v: Views) -> DataFrame:
    return set_match_status(v.match, _decisions(v).drop("product_key")).select(
        "advisory_id", "cve_id_text", "asset_id", "status", "excluded_reason"
    )


@query("remember_exclusions", """
    SELECT r.asset_id, r.product_key, CASE WHEN r.asset_id % 3 = 0 AND m.asset_id IS NOT NULL THEN 'fp ' || r.asset_id ELSE r.reason END AS reason,
        CASE WHEN r.asset_id % 6 = 0 AND m.asset_id IS NOT NULL THEN false
             WHEN r.asset_id % 3 = 0 AND m.asset_id IS NOT NULL THEN true ELSE r.is_active END AS is_active
    FROM x_rule r LEFT JOIN (SELECT DISTINCT asset_id, product_key FROM x_found) m USING (asset_id, product_key)""")
def _(v: Views) -> DataFrame:
    d = _decisions(v)
    remembered = remember_exclusions(v.exclusion_rule, d.where("status = 'EXCLUDED'"))
    return forget_exclusions(remembered, d.where("status = 'MATCHED'"))


@query("active_rules", """
    SELECT r.asset_id, a.asset_no, r.product_key, r.reason FROM x_rule r JOIN x_asset a USING (asset_id) WHERE r.is_active""")
def _(v: Views) -> DataFrame:
    return active_rules(v.exclusion_rule, v.asset).select("asset_id", "asset_no", "product_key", "reason")


@query("cascade_delete", """
    SELECT advisory_id, count(*) AS kept FROM x_match m WHERE NOT EXISTS (
        SELECT 1 FROM x_line l WHERE l.advisory_id = m.advisory_id AND l.code = m.cve_id_text AND l.l_linenumber = 3) GROUP BY 1""")
def _(v: Views) -> DataFrame:
    removed = v.line.where("l_linenumber = 3").selectExpr("advisory_id", "code AS cve_id_text")
    return cascade_delete(v.match, removed).groupBy("advisory_id").agg(F.count("*").alias("kept"))


@query("reextract", """
    SELECT a.advisory_id, CASE WHEN a.source_org <> 'P' THEN a.status WHEN c.missing THEN 'NEEDS_CVE_UPDATE' ELSE 'EXTRACTED' END AS status,
        coalesce(c.codes, 0) AS codes, CASE WHEN a.source_org = 'P' THEN 0 ELSE coalesce(m.n, 0) END AS matches
    FROM x_advisory a
    LEFT JOIN (SELECT advisory_id, count(*) AS codes, bool_or(lookup_status = 'NOT_FOUND') AS missing FROM x_code GROUP BY 1) c USING (advisory_id)
    LEFT JOIN (SELECT advisory_id, count(*) AS n FROM x_match GROUP BY 1) m USING (advisory_id)""")
def _(v: Views) -> DataFrame:
    docs = v.advisory_docs.where("source_org = 'P'").select("advisory_id", "text")
    stored = v.codes.select("*", F.lit(None).cast("decimal(3,2)").alias("confidence"), F.lit(None).cast("string").alias("snippet"))
    adv, codes, matches = reextract(v.advisory, stored, v.match, docs, v.cve)
    n_codes = codes.groupBy("advisory_id").agg(F.count("*").alias("codes"))
    n_matches = matches.groupBy("advisory_id").agg(F.count("*").alias("matches"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("codes", "matches")}
    return adv.select("advisory_id", "status").join(n_codes, "advisory_id", "left").join(n_matches, "advisory_id", "left").withColumns(zero)


@query("manual_codes", """
    WITH wanted AS (SELECT DISTINCT o_orderkey AS advisory_id, 'CVE-' || (2000 + o_custkey % 27) || '-'
            || lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(5, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0') AS cve_id_text
        FROM orders WHERE o_orderstatus <> 'F'),
    joint AS (SELECT advisory_id, cve_id_text, 'auto' AS origin FROM x_code UNION ALL
        SELECT advisory_id, cve_id_text, '(수동 추가)' FROM wanted ANTI JOIN x_code USING (advisory_id, cve_id_text)),
    kept AS (SELECT *, CASE WHEN cve_id_text IN (SELECT cve_id FROM x_cve) THEN 'FOUND' ELSE 'NOT_FOUND' END AS lookup_status FROM joint b
        WHERE NOT EXISTS (SELECT 1 FROM x_line l WHERE l.advisory_id = b.advisory_id AND l.code = b.cve_id_text AND l.l_linenumber = 2)),
    g AS (SELECT advisory_id, count(*) AS codes, count(*) FILTER (origin <> 'auto') AS manual, bool_or(lookup_status = 'NOT_FOUND') AS missing
        FROM kept GROUP BY 1)
    SELECT a.advisory_id, coalesce(g.codes, 0) AS codes, coalesce(g.manual, 0) AS manual,
        CASE WHEN g.codes IS NULL THEN 'UPLOADED' WHEN g.missing THEN 'NEEDS_CVE_UPDATE'
             WHEN a.status IN ('NEEDS_CVE_UPDATE', 'UPLOADED', 'EXTRACTING') THEN 'EXTRACTED' ELSE a.status END AS status
    FROM x_advisory a LEFT JOIN g USING (advisory_id)""")
def _(v: Views) -> DataFrame:
    typed = v.table("orders").selectExpr(
        "o_orderkey AS advisory_id", "concat('cve ', 2000 + o_custkey % 27, ' ', lpad(o_custkey, greatest(5, length(o_custkey)), '0')) AS raw",
        "o_orderstatus",
    )
    unusable = typed.where("o_orderstatus = 'F'").withColumn("raw", F.lit("no code"))
    requests = typed.where("o_orderstatus <> 'F'").unionByName(unusable).drop("o_orderstatus")
    stored = v.codes.select("*", F.lit(1).cast("decimal(3,2)").alias("confidence"), F.lit("auto").alias("snippet"))
    added = add_codes(stored, requests, v.cve)
    removed = v.line.where("l_linenumber = 2").selectExpr("advisory_id", "code AS cve_id_text").distinct()
    kept = remove_codes(added, removed)
    adv = reevaluate_status(v.advisory, kept, v.advisory)
    n = kept.groupBy("advisory_id").agg(
        F.count("*").alias("codes"), F.count_if(F.col("snippet") != "auto").alias("manual")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("codes", "manual")}
    return adv.select("advisory_id", "status").join(n, "advisory_id", "left").withColumns(zero)


