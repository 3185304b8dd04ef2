"""From documents and feeds to closed notifications, as an operator would use the library."""

import json

from pyspark.sql import functions as F

from exposure.operators.search import notification_log
from exposure.functions.product import normalize_product
from exposure.operators import acks as A, advisories as D, feeds as FD, matching as M, notify as N, rollups as R
from exposure.plans.matching_run import run_matching
from exposure.schemas import CVE
from exposure.session import store
from exposure.sources.feeds import read_feed
from test_matching import OLD
from test_replies import NOTE

AS_OF = "2024-01-10"


def test_whole_flow(spark, tmp_path):
    at = F.lit("2024-01-09 10:00:00").cast("timestamp")
    dept = spark.createDataFrame([(7, "roads"), (8, "parks")], "department_id bigint, name string")
    asset = spark.createDataFrame(
        [(1, "PC-1", 7, "kim", "Windows 11", "23H2"), (2, "PC-2", 7, "lee", "Windows 11", "21H2"), (3, "PC-3", 8, "park", "Google Chrome", "123.0"),
         (4, "PC-4", 8, "park", "Google Chrome", None)],
        "asset_id bigint, asset_no string, department_id bigint, owner_name string, product_raw string, version_raw string",
    ).withColumns({"product_key": normalize_product("product_raw"), "version_norm": F.coalesce("version_raw", F.lit("")), "status": F.lit("NORMAL"),
                   "ip": F.lit("10.0.0.1")})
    advisory = spark.createDataFrame([(1, "UPLOADED", "T1", "D1", "ORG", "2024-01-12")],
                                     "advisory_id bigint, status string, title string, doc_no string, source_org string, due string").withColumn("due_at", F.to_date("due")).drop("due")
    docs = spark.createDataFrame([(1, "Patch CVE-2024-0001 and cve_2024_0002 now. CVE-2024-0001 is exploited.")], "advisory_id bigint, text string")
    empty_codes = spark.createDataFrame([], "advisory_id bigint, cve_id_text string, confidence decimal(3,2), snippet string, lookup_status string")
    cve = spark.createDataFrame([], CVE)
    matches = spark.createDataFrame([], OLD)
    rules = spark.createDataFrame([], "asset_id bigint, product_key string, reason string, is_active boolean")

    # extraction finds two unknown codes, so the gate stays closed
    # (every step is stored, as between two jobs)
    advisory, codes, matches = (store(t, "t") for t in D.reextract(advisory, empty_codes, matches, docs, cve))
    assert advisory.first().status == "NEEDS_CVE_UPDATE"
    assert [r.can_proceed for r in M.gate(advisory, codes).collect()] == [False]

    # a feed brings both codes; the import unlocks the advisory and cannot be applied twice
    feed = tmp_path / "f.json"
    feed.write_text(json.dumps({"cves": [
        {"cve_id": "CVE-2024-0001", "product": "Windows 11", "affected_versions": ["23H2", "22H2"], "severity": "긴급"},
        {"cve_id": "CVE-2024-0002", "product": "Chrome", "affected_versions": {"lt": "124"}, "cvss": 7.1}]}))
    imports = spark.createDataFrame([(5, "VALIDATED", 0, 0, None)], "import_id bigint, status string, added_count bigint, updated_count bigint, applied_at string").withColumn("applied_at", F.col("applied_at").cast("timestamp"))
    out = FD.apply_import(imports, 5, cve, read_feed(spark, str(feed)), advisory, codes, at)
    out = {k: store(t, k) for k, t in out.items()}
    assert tuple(out["imports"].select("status", "added_count", "updated_count").first()) == ("APPLIED", 2, 0)
    advisory, codes, cve = out["advisory"].drop("unlocked"), out["advisory_cve"], out["cve"]
    assert advisory.first().status == "EXTRACTED"
    try:
        FD.apply_import(out["imports"], 5, cve, read_feed(spark, str(feed)), advisory, codes, at)
        raise AssertionError("applied twice")
    except ValueError as e:
        assert "already applied" in str(e)

    # matching
    run = run_matching(advisory, codes, cve, asset, matches, rules)
    advisory, matches = store(run["advisory"], "a"), store(run["matches"], "m")
    assert advisory.first().status == "MATCHED"
    got = {(r.cve_id_text, r.asset_id): r.reason.candidate for r in matches.collect()}
    assert got == {("CVE-2024-0001", 1): False, ("CVE-2024-0002", 3): False, ("CVE-2024-0002", 4): True}

    # an analyst excludes one match; it is remembered
    change = spark.createDataFrame([(1, "CVE-2024-0002", 4, "EXCLUDED", "not installed", 9, 1)],
                                   "advisory_id bigint, cve_id_text string, asset_id bigint, status string, reason string, actor bigint, seq int")
    matches = store(M.set_match_status(matches, change), "m")
    rules = M.remember_exclusions(rules, change.select("asset_id", F.lit("google_chrome").alias("product_key"), "reason", "seq"))
    again = run_matching(advisory, codes, cve, asset, matches, rules)
    assert {r.asset_id: (r.status, r.reason.suggested_exclude) for r in again["matches"].collect()} == {
        1: ("MATCHED", False), 3: ("MATCHED", False), 4: ("EXCLUDED", True)}
    matches = store(again["matches"], "m")

    # plan, deliver, plan again: nothing is sent twice
    rows = M.active_matches(matches, asset)
    none = spark.createDataFrame([], NOTE)
    plan = store(N.with_text(N.plan_notifications(rows, dept, advisory, none), N.message_lines(rows, cve)), "p")
    assert {r.department_id: r.action for r in plan.collect()} == {7: "send", 8: "send"}
    sending = store(N.planned_rows(plan, 0), "s")
    notes = none.unionByName(sending.select(*[c for c in sending.columns if c in none.columns]), allowMissingColumns=True)
    notes = N.apply_delivery(notes, sending.select("notification_id", F.lit(True).alias("ok")), at)
    notes = store(notes, "n")
    bridge = store(N.notification_assets(sending, rows), "b")
    advisory = store(N.finish_sending(advisory, rows, notes, sending), "a")
    assert advisory.first().status == "COMPLETED"
    assert {r.action for r in N.plan_notifications(rows, dept, advisory, notes).collect()} == {"skip"}
    assert N.due_reminders(advisory, notes, AS_OF).count() == 2

    # replies close it
    ids = {r.department_id: r.notification_id for r in notes.collect()}
    replies = spark.createDataFrame([(ids[7], "DONE", "ok", "kim", 1), (ids[8], "UNABLE", "no patch", "park", 2)], "notification_id bigint, ack_status string, note string, by string, seq int").withColumn("at", at)
    notes = store(A.apply_acks(notes, replies), "n")
    assert "asset_ids" not in plan.columns
    r = R.remediation(advisory, notes, AS_OF, bridge).first()
    assert (r.dept_total, r.done, r.unable, r.done_rate, r.responded_rate, r.sla_status, r.d_day, r.asset_total, r.asset_done) == (2, 1, 1, 50, 100, "DONE", 2, 2, 1)
    assert N.due_reminders(advisory, notes, AS_OF).count() == 0
    lists = bridge.groupBy("notification_id").agg(F.sort_array(F.collect_set("asset_id")).alias("asset_ids"))
    listed = notes.drop("asset_ids").join(lists, "notification_id", "left")
    for by_bridge, by_list in (
        (R.remediation(advisory, notes, AS_OF, bridge), R.remediation(advisory, listed, AS_OF)),
        (R.remediation_rows(notes, dept, bridge), R.remediation_rows(listed, dept)),
        (R.history_departments(notes, asset, dept, assets=bridge), R.history_departments(listed, asset, dept)),
        (notification_log(notes.withColumn("message", F.lit("m")), dept, advisory, bridge), notification_log(listed.withColumn("message", F.lit("m")), dept, advisory)),
    ):
        assert by_bridge.collect() and sorted(by_bridge.collect(), key=str) == sorted(by_list.collect(), key=str)
