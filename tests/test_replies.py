"""Replies, notifications, board rules and roll-ups on small tables."""

import hashlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from exposure.session import store
from exposure.operators.matching import active_matches
from exposure.operators import acks as A, board as B, notify as N, rollups as R
from exposure.operators.state import apply_changes, publish, refused_creates
from exposure.plans.catalog import notifications, registry  # noqa: F401

NOTE = """notification_id bigint, advisory_id bigint, department_id bigint, channels array<string>, asset_ids array<bigint>, status string,
    ack_status string, ack_note string, ack_by string, ack_updated_at timestamp, sent_at timestamp, reminded_at timestamp, reminder_count int,
    idempotency_key string, evidence_name string, evidence_path string"""
MATCH = "advisory_id bigint, cve_id_text string, asset_id bigint, status string, ack_status string, ack_by string, ack_note string, ack_at timestamp"
ASSET = """asset_id bigint, asset_no string, department_id bigint, owner_name string, product_raw string, product_key string, version_raw string,
    version_norm string, status string"""
AT = "2024-01-01 00:00:00"


def notes(spark, *rows):
    """(id, advisory, department, ack[, sent day[, status]])"""
    full = [(r[0], r[1], r[2], ["MAIL"], [1, 2], r[5] if len(r) > 5 else "SENT", r[3], None, None, None,
             r[4] if len(r) > 4 else None, None, 0, f"k{r[0]}", None, None) for r in rows]
    return spark.createDataFrame(full, NOTE.replace("sent_at timestamp", "sent_at string")).withColumn("sent_at", F.col("sent_at").cast("timestamp"))


def assets(spark, *rows):
    return spark.createDataFrame([(i, f"PC-{i}", d, o, "Edge", "edge", "1", "1", "NORMAL") for i, d, o in rows], ASSET)


def matches(spark, *rows):
    return spark.createDataFrame([(a, c, i, s, k, None, None, None) for a, c, i, s, k in rows], MATCH)


def advisories(spark, *rows):
    df = spark.createDataFrame(rows, "advisory_id bigint, status string, due_at string, board_published_at string")
    return df.selectExpr("advisory_id", "status", "CAST(due_at AS DATE) AS due_at", "CAST(board_published_at AS TIMESTAMP) AS board_published_at",
                         "concat('T', advisory_id) AS title", "concat('D', advisory_id) AS doc_no", "'ORG' AS source_org", "'NCST' AS receive_channel",
                         "DATE'2024-01-01' AS received_at", "TIMESTAMP'2024-01-01' AS created_at")


def test_board_reply_goes_to_the_latest_open_notification(spark):
    n = notes(spark, (1, 1, 7, "NONE", "2024-01-01"), (2, 2, 7, "NONE", "2024-02-01"), (3, 3, 7, "DONE", "2024-03-01"), (4, 4, 7, "NONE", None))
    dept = spark.createDataFrame([(7, "roads")], "department_id bigint, name string")
    payloads = spark.createDataFrame([(1, AT, '{"department":"roads","status":"진행중","by":"k"}'), (2, AT, '{"dept":"roads","ack":"done"}'),
                                      (3, AT, '{"department":"roads","status":"?"}'), (4, AT, '{"department":"parks","status":"DONE"}')],
                                     "seq int, at string, payload string").withColumn("at", F.col("at").cast("timestamp"))
    out = {r.notification_id: (r.ack_status, r.ack_by, r.status) for r in
           A.apply_board_acks(A.parse_board_replies(payloads), dept, n).collect()}
    assert out[2] == ("DONE", None, "ACKED")
    assert out[1][0] == "NONE" and out[4][0] == "NONE"


def test_direct_replies(spark):
    n = notes(spark, (1, 1, 7, "NONE"), (2, 1, 8, "NONE"))
    a = spark.createDataFrame([(1, "DONE", "first", "kim", AT, 1), (1, "IN_PROGRESS", None, None, AT, 2)],
                              "notification_id bigint, ack_status string, note string, by string, at string, seq int").withColumn("at", F.col("at").cast("timestamp"))
    out = {r.notification_id: r for r in A.apply_acks(n, a).collect()}
    assert (out[1].ack_status, out[1].ack_note, out[1].ack_by, out[1].status) == ("IN_PROGRESS", "first", "kim", "ACKED")
    assert (out[2].ack_status, out[2].status) == ("NONE", "SENT")


def request(spark, *rows):
    df = spark.createDataFrame(rows, "request_id string, seq int, advisory_id bigint, cve_id_text string, asset_id bigint, department_id bigint, ack_status string")
    return df.select("*", F.lit(" kim ").alias("author"), F.lit("").alias("note"), F.lit(AT).cast("timestamp").alias("at"))


def asset_case(spark):
    a = assets(spark, (1, 7, "x"), (2, 7, "y"), (3, 8, "z"))
    m = matches(spark, (1, "C", 1, "MATCHED", "NONE"), (1, "C", 2, "MATCHED", "NONE"), (1, "C", 3, "MATCHED", "NONE"))
    n = notes(spark, (1, 1, 7, "NONE"), (2, 1, 7, "NONE"), (3, 1, 8, "NONE"))
    return a, m, n


def test_department_closes_with_its_last_asset(spark):
    a, m, n = asset_case(spark)
    m1, n1 = A.apply_asset_acks(m, request(spark, ("r1", 1, 1, "C", 1, 7, "DONE")), a, n)
    assert {r.asset_id: (r.ack_status, r.ack_by) for r in m1.collect()} == {1: ("DONE", "kim"), 2: ("NONE", None), 3: ("NONE", None)}
    assert n1.where("ack_status = 'DONE'").count() == 0
    p = R.asset_progress(m1).first()
    assert (p.total, p.done, p.done_rate) == (3, 1, 33)
    _m2, n2 = A.apply_asset_acks(m1, request(spark, ("r2", 1, 1, "C", 2, 7, "DONE")), a, n1)
    assert {r.notification_id: (r.ack_status, r.status, r.ack_by) for r in n2.collect()} == {
        1: ("NONE", "SENT", None), 2: ("DONE", "ACKED", "kim"), 3: ("NONE", "SENT", None)}


def test_requests_are_all_or_nothing(spark):
    a, m, n = asset_case(spark)
    req = request(spark, ("bad", 1, 1, "C", 1, 7, "DONE"), ("bad", 1, 1, "C", 3, 7, "DONE"), ("gone", 2, 1, "X", 2, 7, "DONE"), ("ok", 3, 1, "C", 3, None, "UNABLE"))
    assert [r.asset_no for r in A.ack_dept_mismatch(req, a).collect()] == ["PC-3"]
    assert [r.request_id for r in A.ack_missing(req, m).collect()] == ["gone"]
    out, _ = A.apply_asset_acks(m, req, a, n)
    assert {r.asset_id: r.ack_status for r in out.collect()} == {1: "NONE", 2: "NONE", 3: "UNABLE"}


def comments(spark, *rows):
    df = spark.createDataFrame(rows, "comment_id bigint, advisory_id bigint, author_name string, department_id bigint, department_name string, ack_status string, is_admin boolean")
    return df.select("*", F.lit(" done it ").alias("body"), F.lit("f.png").alias("evidence_name"), F.lit("/p").alias("evidence_path"), F.lit(AT).cast("timestamp").alias("created_at"))


def test_comments_sync_and_evidence(spark):
    n = notes(spark, (1, 1, 7, "NONE"), (2, 1, 7, "NONE"))
    c = comments(spark, (1, 1, " kim ", 7, "roads", "DONE", False), (2, 1, "lee", None, "roads", "DONE", False), (3, 1, "x", 9, "none", "DONE", False))
    out = {r.notification_id: (r.ack_status, r.ack_note, r.ack_by, r.status) for r in A.sync_comment_acks(c, n).collect()}
    assert out == {1: ("NONE", None, None, "SENT"), 2: ("DONE", "done it", "kim", "ACKED")}
    files = spark.createDataFrame([(1, "a.png", "/a", 1), (1, "b.png", "/b", 2), (2, "c.png", "/c", 3)], "comment_id bigint, name string, path string, seq int")
    cs, ns = A.attach_evidence(files, c, n)
    assert {r.comment_id: r.evidence_name for r in cs.collect()} == {1: "b.png", 2: "c.png", 3: "f.png"}
    assert {r.notification_id: r.evidence_name for r in ns.collect()} == {1: None, 2: "b.png"}


def test_comment_visibility(spark):
    c = comments(spark, (1, 1, "kim", 7, "roads", None, False), (2, 1, "lee", None, "roads", None, False), (3, 1, "adm", 9, "x", None, True), (4, 1, "kim2", 8, "parks", None, False))
    ids = lambda df: sorted(r.comment_id for r in df.collect())
    assert ids(B.scope_comments(c, 7, "roads")) == [1, 2, 3]
    assert ids(B.scope_comments(c, q="KIM")) == [1, 3, 4]
    assert ids(B.scope_comments(c)) == [1, 2, 3, 4]
    assert B.public_comments(c).where("evidence_name IS NOT NULL OR evidence_path IS NOT NULL").count() == 0


def test_board_filters(spark):
    adv = advisories(spark, (1, "NOTIFYING", None, AT), (2, "NOTIFYING", None, AT), (3, "COMPLETED", None, AT), (4, "NOTIFYING", None, None), (5, "NOTIFYING", None, AT))
    a = assets(spark, (1, 7, "x"), (2, 8, "y"))
    m = matches(spark, (1, "C", 1, "MATCHED", "DONE"), (1, "C", 2, "MATCHED", "NONE"), (5, "C", 1, "EXCLUDED", "NONE"))
    n = notes(spark, (1, 2, 7, "NONE"), (2, 2, 7, "DONE"), (3, 2, 8, "NONE"))
    dept = spark.createDataFrame([(7, "roads"), (8, "parks")], "department_id bigint, name string")
    codes = spark.createDataFrame([(1, "C", "FOUND")], "advisory_id bigint, cve_id_text string, lookup_status string")
    cve = spark.createDataFrame([("C", "HIGH")], "cve_id string, severity string")
    c = comments(spark, (1, 1, "kim", 8, "parks", None, False))

    def listed(**kw):
        return [r.advisory_id for r in B.board_view(adv, codes, cve, m, a, dept, n, c, "2024-01-01", **kw).collect()]

    assert sorted(listed()) == [1, 2, 5]                       # 3 is completed, 4 is not published
    assert sorted(listed(hide_done=False)) == [1, 2, 3, 5]
    assert listed(department_id=7, department_name="roads") == []      # all its assets / its latest reply are done
    assert sorted(listed(department_id=7, department_name="roads", hide_done=False)) == [1, 2]
    assert sorted(listed(department_id=8, department_name="parks")) == [1, 2]
    assert listed(q="pc-2") == [1]
    assert sorted(listed(q="t")) == [1, 2, 5]
    view = B.board_view(adv, codes, cve, m, a, dept, n, c, "2024-01-01", department_id=8, department_name="parks").where("advisory_id = 1").first()
    assert (view.max_severity, view.comment_count, view.affected_asset_count, view.affected_products, view.none) == ("HIGH", 1, 1, ["Edge"], 1)


def test_scoped_detail(spark):
    adv = advisories(spark, (1, "NOTIFYING", None, AT))
    a = assets(spark, (1, 7, "kim"), (2, 8, "lee"))
    m = matches(spark, (1, "C1", 1, "MATCHED", "NONE"), (1, "C2", 2, "MATCHED", "DONE"))
    dept = spark.createDataFrame([(7, "roads"), (8, "parks")], "department_id bigint, name string")
    codes = spark.createDataFrame([(1, "C1", "FOUND"), (1, "C2", "FOUND"), (1, "C3", "NOT_FOUND")], "advisory_id bigint, cve_id_text string, lookup_status string")
    cve = spark.createDataFrame([("C1", "HIGH", "p"), ("C2", "LOW", "p")], "cve_id string, severity string, product_name string")
    c = comments(spark, (1, 1, "kim", 7, "roads", None, False), (2, 1, "lee", 8, "parks", None, False), (3, 1, "adm", None, None, None, True))

    def detail(q=None, d=None, name=None):
        out = B.board_detail(adv, codes, cve, m, a, dept, c, q, d, name)
        return (sorted(r.cve_id_text for r in out["cves"].collect()), sorted(r.comment_id for r in out["comments"].collect()),
                sorted(r.asset_id for r in out["matches"].collect()), out["progress"].first().total)

    assert detail() == (["C1", "C2", "C3"], [1, 2, 3], [1, 2], 2)
    assert detail("kim") == (["C1"], [1, 3], [1], 1)
    assert detail("t1") == (["C1", "C2", "C3"], [1, 2, 3], [1, 2], 2)
    assert detail("nobody") == (["C1", "C2", "C3"], [1, 2, 3], [1, 2], 2)
    assert detail(None, 8, "parks") == (["C2"], [2, 3], [2], 1)


def test_notification_plan(spark):
    adv = advisories(spark, (1, "MATCHED", "2024-02-01", None))
    a = assets(spark, (1, 7, "kim"), (2, 7, "자동배포"), (3, 8, None))
    m = matches(spark, (1, "C2", 1, "MATCHED", "NONE"), (1, "C1", 1, "MATCHED", "NONE"), (1, "C1", 2, "MATCHED", "NONE"), (1, "C1", 3, "MATCHED", "NONE"))
    dept = spark.createDataFrame([(7, "roads"), (8, "parks")], "department_id bigint, name string")
    cve = spark.createDataFrame([("C1", "HIGH"), ("C2", "LOW")], "cve_id string, severity string")
    rows = active_matches(m, a)
    lines = N.message_lines(rows, cve)
    none = notes(spark).where("false")
    plan = {r.department_id: r for r in N.with_text(N.plan_notifications(rows, dept, adv, none, listed=True), lines).collect()}
    assert plan[7].idempotency_key == hashlib.sha256(b"1:7:[1, 2]").hexdigest()
    assert (plan[7].asset_ids, plan[7].action, plan[7].channels) == ([1, 2], "send", ["MAIL", "WEB_UI"])
    assert "자산 3대" in plan[7].message and "(담당 kim)" in plan[7].message and "조치기한: 2024-02-01" in plan[7].message
    assert "(담당 시스템)" in plan[8].message
    assert plan[7].message.index("PC-1 (Edge 1) — C1 HIGH") < plan[7].message.index("PC-1 (Edge 1) — C2 LOW")
    sent = spark.createDataFrame([(5, "FAILED", plan[7].idempotency_key), (6, "ACKED", plan[8].idempotency_key)], "notification_id bigint, status string, idempotency_key string")
    again = {r.department_id: (r.action, r.existing_id) for r in N.plan_notifications(rows, dept, adv, sent).collect()}
    assert again == {7: ("retry", 5), 8: ("skip", 6)}
    planned = N.planned_rows(N.with_text(N.plan_notifications(rows, dept, adv, sent, listed=True), lines), 6).collect()
    assert [(r.notification_id, r.department_id, r.asset_ids, r.status) for r in planned] == [(5, 7, [1, 2], "PENDING")]
    fresh = N.planned_rows(N.with_text(N.plan_notifications(rows, dept, adv, none), lines), 6).collect()
    assert len({r.notification_id for r in fresh}) == 2 and min(r.notification_id for r in fresh) > 6


def test_a_large_group_is_one_message_with_one_key(spark):
    """More assets than any earlier limit: still one header row, one key by the same formula, every line."""
    n = 25_000
    adv = advisories(spark, (1, "MATCHED", "2024-02-01", None), (2, "ARCHIVED", None, None), (3, "MATCHED", None, None))
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("advisory_id"), F.lit(7).cast("long").alias("department_id"), F.lit("C1").alias("cve_id_text"),
        F.col("id").alias("asset_id"), F.concat(F.lit("o"), F.col("id") % 3).alias("owner_name"), F.lit("PC").alias("asset_no"),
        F.lit("Edge").alias("product_raw"), F.lit("edge").alias("product_key"), F.lit("1").alias("version_raw"), F.lit("1").alias("version_norm"))
    dept = spark.createDataFrame([(7, "roads")], "department_id bigint, name string")
    cve = spark.createDataFrame([("C1", "HIGH")], "cve_id string, severity string")
    (r,) = N.with_text(N.plan_notifications(rows, dept, adv, notes(spark).where("false"), listed=True), N.message_lines(rows, cve)).collect()
    ids = ", ".join(map(str, range(n)))
    assert r.idempotency_key == hashlib.sha256(f"1:7:[{ids}]".encode()).hexdigest() and len(r.asset_ids) == r.asset_total == n
    assert r.message.count("· PC (Edge 1) — C1 HIGH") == n and "(담당 o0, o1, o2)" in r.message
    sent = notes(spark, (1, 1, 7, "NONE", None, "SENT"))
    groups = rows.select("advisory_id", "department_id").unionByName(spark.createDataFrame([(2, 7), (3, 7)], "advisory_id bigint, department_id bigint"))
    targets = spark.createDataFrame([(1,), (2,)], "advisory_id bigint")
    done = {x.advisory_id: x.status for x in N.finish_sending(adv, groups, sent, targets).collect()}
    assert done == {1: "COMPLETED", 2: "ARCHIVED", 3: "MATCHED"}


def test_keys_and_asset_rows_without_a_list_of_the_group(spark, rows):
    """The same key from ids that pass in batches; the plan and its rows hold no value that grows with the group."""
    n = 3000
    active = spark.range(n).select(
        F.lit(1).cast("long").alias("advisory_id"), F.expr("CASE WHEN id % 10 < 8 THEN 7 WHEN id % 10 = 8 THEN 8 END").cast("long").alias("department_id"),
        F.concat(F.lit("C"), F.col("id") % 2).alias("cve_id_text"), (F.col("id") * 7 % n - 5).alias("asset_id"), F.lit("o").alias("owner_name"))
    groups = {d: sorted((i * 7 % n) - 5 for i in range(n) if (7 if i % 10 < 8 else 8 if i % 10 == 8 else None) == d) for d in (7, 8, None)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.department_id: (r.asset_total, r.idempotency_key) for r in N.message_keys(active.unionByName(active)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {d: (len(ids), hashlib.sha256(f"1:{'' if d is None else f'{d}:'}[{', '.join(map(str, ids))}]".encode()).hexdigest()) for d, ids in groups.items()}
    adv = advisories(spark, (1, "MATCHED", "2024-02-01", None))
    dept = spark.createDataFrame([(7, "roads")], "department_id bigint, name string")
    known = spark.createDataFrame([], "notification_id bigint, status string, idempotency_key string")
    plan = N.plan_notifications(active, dept, adv, known, listed=False)
    assert "asset_ids" not in plan.columns and "message" not in plan.columns
    sent = store(N.planned_rows(plan, 0), "planned")
    assets = N.notification_assets(sent, active)
    own = {r.idempotency_key: r.department_id for r in sent.collect()}
    assert sorted((own[r.idempotency_key] or 0, r.asset_id) for r in assets.collect()) == sorted((d or 0, i) for d, ids in groups.items() for i in ids)


def test_delivery_and_reminders(spark):
    n = notes(spark, (1, 1, 7, "NONE"), (2, 1, 8, "DONE"), (3, 2, 7, "UNABLE"))
    res = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False)], "notification_id bigint, ok boolean")
    at = F.lit(AT).cast("timestamp")
    assert {r.notification_id: r.status for r in N.apply_delivery(n, res, at).collect()} == {1: "SENT", 2: "FAILED", 3: "SENT"}
    assert {r.notification_id: r.reminder_count for r in N.apply_reminders(n, res, at).collect()} == {1: 1, 2: 0, 3: 0}
    adv = advisories(spark, (1, "NOTIFYING", "2024-01-05", None), (2, "NOTIFYING", "2024-01-01", None), (3, "EXTRACTED", "2024-01-01", None))
    due = {r.notification_id: (r.d_day, r.overdue) for r in N.due_reminders(adv, n, "2024-01-03").collect()}
    assert due == {1: (2, False)}
    assert N.due_reminders(adv, n, "2024-01-01").count() == 0
    over = {r.sla_status: r.advisories for r in R.sla_overview(adv, n, "2024-01-03").collect()}
    assert over == {"NORMAL": 0, "IMMINENT": 1, "OVERDUE": 0, "DONE": 1}


def test_all_sent(spark):
    groups = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "advisory_id bigint, department_id bigint")
    n = notes(spark, (1, 1, 7, "NONE"), (2, 1, 8, "NONE", None, "FAILED"), (3, 2, 7, "NONE", None, "ACKED"))
    assert [r.advisory_id for r in N.all_sent(groups, n).collect()] == [2]


def test_change_sets(spark, rows):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "k string, v int, w string")
    ch = spark.createDataFrame([("a", "create", 1, 9, "n"), ("b", "set", 2, None, "n"), ("c", "upsert", 3, 7, "n"), ("c", "delete", 4, None, None),
                                ("d", "create", 5, 5, "n"), ("e", "set", 6, 1, "n")], "k string, op string, seq int, v int, w string")
    assert rows(apply_changes(t, ch, ["k"])) == [("a", 1, "x"), ("b", 2, "n"), ("d", 5, "n")]
    assert [r.k for r in refused_creates(t, ch, ["k"]).collect()] == ["a"]


def test_publishing_keeps_the_first_time(spark):
    adv = advisories(spark, (1, "MATCHED", None, "2023-01-01"), (2, "MATCHED", None, None), (3, "MATCHED", None, "2023-01-01"))
    flags = spark.createDataFrame([(1, True), (2, True), (3, False)], "advisory_id bigint, publish boolean")
    out = {r.advisory_id: str(r.board_published_at)[:10] for r in publish(adv, flags, F.lit(AT).cast("timestamp")).collect()}
    assert out == {1: "2023-01-01", 2: "2024-01-01", 3: "None"}


@pytest.mark.parametrize("status,note,reason", [("UNABLE", " ", "NOTE_REQUIRED"), ("UNABLE", "why", None), ("LATER", "x", "BAD_STATUS"), (None, "x", "BAD_STATUS")])
def test_reply_checks(spark, status, note, reason):
    df = spark.createDataFrame([(status, note)], "ack_status string, note string")
    assert A.validate_ack(df).first().reject_reason == reason

def _told(spark, name):
    """Rows of a registered notification query over a few matches of its own."""
    a = assets(spark, (1, 7, "kim"), (2, 7, "자동배포"), (3, 8, None))
    m = matches(spark, (1, "C2", 1, "MATCHED", "NONE"), (1, "C1", 1, "MATCHED", "NONE"), (1, "C1", 2, "MATCHED", "NONE"), (1, "C1", 3, "MATCHED", "NONE"))
    views = SimpleNamespace(
        match=m, asset=a, advisory=advisories(spark, (1, "MATCHED", "2024-02-01", None)), notification=notes(spark, (1, 1, 8, "NONE", None, "SENT")),
        department=spark.createDataFrame([(7, "roads"), (8, "parks")], "department_id bigint, name string"),
        cve=spark.createDataFrame([("C1", "HIGH"), ("C2", "LOW")], "cve_id string, severity string"))
    return {r.department_id: r for r in registry._QUERIES[name](views).collect()}


def test_preview_query_shows_whole_messages(spark):
    got = _told(spark, "notification_preview")
    assert [line for line in got[7].message.split("\n") if line.startswith("·")] == ["· PC-1 (Edge 1) — C1 HIGH", "· PC-2 (Edge 1) — C1 HIGH", "· PC-1 (Edge 1) — C2 LOW"]
    assert got[8].message.count("·") == 1 and (got[7].sent, got[8].sent) == (False, True)
    assert all(r.message.startswith("[보안조치 요청] ") and r.message.endswith("등록해 주세요.") for r in got.values())


def test_key_query_lists_its_assets(spark):
    got = _told(spark, "asset_keys")
    assert {d: (r.asset_ids, r.asset_total) for d, r in got.items()} == {7: ("1|2", 2), 8: ("3", 1)}
    assert got[7].idempotency_key == hashlib.sha256(b"1:7:[1, 2]").hexdigest()


def test_plan_query_holds_texts_and_assets(spark):
    got = _told(spark, "plan_notifications")
    assert sorted(got) == [8]  # the query leaves department 7 out
    assert (got[8].asset_ids, got[8].asset_total, got[8].action) == ("3", 1, "retry")
    assert got[8].message.startswith("[보안조치 요청] T1") and "\n· PC-3 (Edge 1) — C1 HIGH\n" in got[8].message and got[8].message.endswith("등록해 주세요.")
