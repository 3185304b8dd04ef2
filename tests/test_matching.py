"""The core join and match state, against a nested-loop model."""

import itertools

import pytest
from pyspark.sql import functions as F

from exposure.functions.version import parse_version_rule
from exposure.operators import matching as M
from exposure.operators.skew import hot_keys, sliced_join
from exposure.plans.matching_run import run_matching
from test_versions import model

CVES = [
    ("CVE-2024-0001", "office", '["2021"]'), ("CVE-2024-0002", "office", '{"lt":"2020"}'), ("CVE-2024-0003", "chrome", '{"range":["100","124"]}'),
    ("CVE-2024-0004", "chrome", "*"), ("CVE-2024-0005", "", "*"), ("CVE-2024-0006", "edge", '{"x":1}'), ("CVE-2024-0007", None, "*"),
]
ASSETS = [
    (1, 10, "office", "21.001.20155", "2021", "NORMAL"), (2, 10, "office", "2019", "2019", "RETIRING"), (3, 11, "office", "", None, "NORMAL"),
    (4, 11, "chrome", "122.x", "122.x", "NORMAL"), (5, 11, "chrome", "99", "99", "NORMAL"), (6, 12, "chrome", "n/a", "n/a", "NORMAL"),
    (7, 12, "chrome", "124", "124", "RETIRED"), (8, 12, "", "1", "1", "NORMAL"), (9, 12, "edge", "1", "1", "NORMAL"),
]
CODES = [(a, c, "FOUND") for a in (1, 2) for c, _, _ in CVES] + [(3, "CVE-2024-0001", "FOUND"), (3, "CVE-2030-0001", "NOT_FOUND")]


@pytest.fixture(scope="module")
def tables(spark):
    cve = spark.createDataFrame(CVES, "cve_id string, product_key string, v string").withColumn("version_rule", parse_version_rule("v"))
    asset = spark.createDataFrame(ASSETS, "asset_id bigint, department_id bigint, product_key string, version_norm string, version_raw string, status string")
    codes = spark.createDataFrame(CODES, "advisory_id bigint, cve_id_text string, lookup_status string")
    return cve, asset, codes


def expected():
    out = {}
    for (adv, code, status), (cid, key, rule), (aid, _d, akey, norm, raw, astatus) in itertools.product(CODES, CVES, ASSETS):
        if status != "FOUND" or code != cid or not key or key != akey or astatus == "RETIRED":
            continue
        n, r = model(norm, rule), model(raw, rule)
        if n[0] or r[0]:
            out[adv, code, aid] = not (n == (True, False) or r == (True, False))
    return out


def as_dict(df):
    return {(r.advisory_id, r.cve_id_text, r.asset_id): r.reason.candidate for r in df.collect()}


def test_match_assets(tables):
    cve, asset, codes = tables
    got = as_dict(M.match_assets(codes, cve, asset))
    assert got == expected()
    # normalised text says no with certainty, the original is unknown: still a match to review
    assert got[1, "CVE-2024-0002", 3] is True
    assert (1, "CVE-2024-0001", 1) in got and got[1, "CVE-2024-0001", 1] is False


def test_hot_keys_change_nothing(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("b"))
    small = spark.range(50).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("s"))
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, ["k"], share=0.05)
    assert [(r.k, r._slices) for r in hot.collect()] == [(0, 14)]
    got = sliced_join(big, small, ["k"], F.col("b"), hot)
    want = big.join(small, "k")
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()


def test_hot_key_count_is_bounded(spark):
    counts = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    assert hot_keys(counts, ["k"], share=0.01).count() == 0
    skewed = counts.withColumn("n", F.when(F.col("k") < 30, 1000).otherwise(1))
    assert hot_keys(skewed, ["k"], share=0.01).count() <= 100


def test_gate(spark, tables, rows):
    _cve, _asset, codes = tables
    adv = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "advisory_id bigint")
    assert rows(M.gate(adv, codes)) == [(1, True), (2, True), (3, False), (4, False)]


OLD = "advisory_id bigint, cve_id_text string, asset_id bigint, reason struct<product_key:string,version_rule:struct<kind:string,values:array<string>,op:string,lo:string,hi:string>,asset_version:string,asset_version_raw:string,candidate:boolean,suggested_exclude:boolean>, status string, excluded_reason string, ack_status string, ack_by string, ack_note string, ack_at timestamp"


def test_run_is_idempotent_and_keeps_decisions(spark, tables):
    cve, asset, codes = tables
    adv = spark.createDataFrame([(1, "EXTRACTED"), (2, "NOTIFYING"), (3, "NEEDS_CVE_UPDATE"), (5, "EXTRACTED")], "advisory_id bigint, status string")
    rules = spark.createDataFrame([(4, "chrome", True), (5, "chrome", False)], "asset_id bigint, product_key string, is_active boolean")
    none = spark.createDataFrame([], OLD)
    first = run_matching(adv, codes, cve, asset, none, rules)
    assert {r.advisory_id: r.status for r in first["advisory"].collect()} == {1: "MATCHED", 2: "NOTIFYING", 3: "NEEDS_CVE_UPDATE", 5: "EXTRACTED"}
    assert {r.advisory_id: r.blocked for r in first["blocked"].collect()} == {3: "NEEDS_CVE_UPDATE", 5: "NEEDS_CVE_UPDATE"}
    assert set(as_dict(first["matches"])) == {k for k in expected() if k[0] < 3}
    flagged = {(r.advisory_id, r.asset_id) for r in first["matches"].where("reason.suggested_exclude").collect()}
    assert flagged == {(1, 4), (2, 4)}

    decided = first["matches"].withColumn("status", F.when(F.col("asset_id") == 4, "EXCLUDED").otherwise(F.col("status")))
    decided = decided.withColumn("ack_status", F.when(F.col("asset_id") == 1, "DONE").otherwise(F.col("ack_status")))
    gone = decided.unionByName(decided.limit(1).withColumn("asset_id", F.lit(99).cast("bigint")))
    second = run_matching(adv, codes, cve, asset, gone, rules)
    a, b = second["matches"], gone
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    stats = {r.advisory_id: r for r in second["stats"].collect()}
    base = [k for k in expected() if k[0] == 1]
    assert stats[1].matched == len([k for k in base if k[2] != 4])
    assert stats[1].candidates == sum(expected()[k] for k in base)
    assert stats[1].suggested_exclude == len([k for k in base if k[2] == 4])


def test_exclusion_memory(spark, rows):
    rules = spark.createDataFrame([(1, "a", "old", False)], "asset_id bigint, product_key string, reason string, is_active boolean")
    new = spark.createDataFrame([(1, "a", None, 1), (2, "b", "x", 2), (2, "b", None, 3), (3, "", "no key", 4)], "asset_id bigint, product_key string, reason string, seq int")
    got = M.remember_exclusions(rules, new)
    assert rows(got) == [(1, "a", "old", True), (2, "b", "x", True)]
    assert rows(M.forget_exclusions(got, new.where("asset_id = 2"))) == [(1, "a", "old", True), (2, "b", "x", False)]


def test_slices_on_both_sides_change_nothing(spark):
    left = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(200).select((F.col("id") % 4).alias("k"), F.col("id").alias("b"))
    counts = [t.groupBy("k").agg(F.count("*").alias("n")) for t in (left, right)]
    hot = [hot_keys(c, ["k"], rows=20) for c in counts]
    assert all(h.count() >= 3 for h in hot)
    got = sliced_join(left, right, ["k"], F.col("a"), hot[0], F.col("b"), hot[1])
    want = left.join(right, "k")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_slices_of_a_product_change_no_verdict(spark):
    from exposure.functions.version import parse_version_rule
    from exposure.operators.matching import rule_verdicts

    texts = ['["1.2", "3", ""]', '["22H2"]', '{"lt": "2"}', '{"gte": "1.5"}', '{"range": ["1", "3"]}', "*", '{"x": 1}', None, '{"eq": "3"}']
    rules = spark.createDataFrame([("p", t) for t in texts] + [("q", texts[0])], "product_key string, t string").select("product_key", parse_version_rule("t").alias("version_rule"))
    seen = [(p, a, b) for p in "pq" for a in ("1.2", "3", "", "22h2", "x", None) for b in ("", "2.0", "3.0.0", "22H2", None)]
    profiles = spark.createDataFrame(seen, "product_key string, v_norm string, v_raw string")

    def rows(**options):
        return sorted((r.product_key, str(r.version_rule), str(r.v_norm), str(r.v_raw), r.candidate) for r in rule_verdicts(rules.distinct(), profiles, **options).collect())

    assert rows() == rows(pairs=3) and len(rows()) > 100
    # an empty text needs a review under every list, a named version is sure
    enum = [r for r in rows() if r[0] == "q"]
    assert {(a, b): c for _, _, a, b, c in enum}[("1.2", "2.0")] is False and {(a, b): c for _, _, a, b, c in enum}[("x", "")] is True
    assert ("x", "2.0") not in {(a, b) for _, _, a, b, _ in enum}


def test_delta_run_equals_whole_run(spark, tables, tmp_path, monkeypatch):
    """A chain of states: after each, the delta run leaves what a whole run would leave."""
    from exposure.plans import delta_run as D
    from exposure.sources.sinks import buckets_in, read_buckets, write_buckets

    cve, asset, codes = tables
    adv = spark.createDataFrame([(i, s) for i, s in ((1, "EXTRACTED"), (2, "NOTIFYING"), (3, "NEEDS_CVE_UPDATE"), (5, "EXTRACTED"))], "advisory_id bigint, status string")
    rules = spark.createDataFrame([(4, "chrome", True), (5, "chrome", False)], "asset_id bigint, product_key string, is_active boolean")

    def but(df, column, value, when):
        return df.withColumn(column, F.when(F.expr(when), F.lit(value)).otherwise(F.col(column)))

    known = codes.unionByName(spark.createDataFrame([(5, "CVE-2024-0003", "FOUND")], codes.schema)).where("cve_id_text <> 'CVE-2030-0001'")
    other_rule = cve.withColumn("version_rule", F.when(F.col("cve_id") == "CVE-2024-0003", parse_version_rule(F.lit('["99"]'))).otherwise(F.col("version_rule")))
    states = [
        (codes, cve, asset.where("asset_id <> 3"), rules),
        # a new asset, one that is no longer affected, a CVE of another product
        (codes, but(cve, "product_key", "edge", "cve_id = 'CVE-2024-0001'"),
         but(but(asset, "version_norm", "2025", "asset_id = 1"), "version_raw", "2025", "asset_id = 1"), rules),
        (known, other_rule, but(asset, "status", "RETIRED", "asset_id = 9"), but(rules, "is_active", True, "asset_id = 5")),
        (known.where("advisory_id <> 2"), other_rule, asset, rules),  # an advisory without codes, an asset in use again
    ]
    none = spark.createDataFrame([], OLD)
    whole, delta, marks = none, none, (None, None)
    for codes_now, cve_now, asset_now, rules_now in states:
        want = run_matching(adv, codes_now, cve_now, asset_now, whole, rules_now)
        got = D.run_matching_delta(adv, codes_now, cve_now, asset_now, delta, rules_now, *marks)
        # an analyst decides between the runs
        whole = D.store(but(want["matches"], "status", "EXCLUDED", "asset_id = 4"), "whole")
        delta = D.store(but(got["matches"], "status", "EXCLUDED", "asset_id = 4"), "delta")
        marks = got["links"], got["assets"]
        a, b = delta.drop("touched"), whole
        assert a.count() == b.count() > 0 and a.exceptAll(b.select(*a.columns)).isEmpty()
        for name in ("advisory", "blocked", "stats") if asset_now is asset else ():
            assert sorted(got[name].collect()) == sorted(want[name].select(*got[name].columns).collect()), name

    # nothing changed: nothing is judged and nothing is written
    judged = []
    whole_join = D.match_assets
    monkeypatch.setattr(D, "match_assets", lambda *t: judged.extend(x.count() for x in t) or whole_join(*t))
    again = D.run_matching_delta(adv, codes_now, cve_now, asset_now, delta, rules_now, *marks)
    assert not any(judged) and again["changes"].isEmpty() and again["matches"].exceptAll(delta).isEmpty()
    path = str(tmp_path / "matches")
    write_buckets(delta, path, M.MATCH_KEY)
    assert D.store_changes(spark, path, again["changes"]) == []

    # one changed asset: its pairs alone are judged, its buckets alone are written
    judged.clear()
    moved = but(asset_now, "version_raw", "123", "asset_id = 4")
    one = D.run_matching_delta(adv, codes_now, cve_now, moved, delta, rules_now, *marks)
    assert judged[-1] == 1 and {r.asset_id for r in one["changes"].collect()} == {4}
    files = {str(p) for p in (tmp_path / "matches" / "data").rglob("*.parquet")}
    written = D.store_changes(spark, path, one["changes"])
    new = {p.parent.name for p in (tmp_path / "matches" / "data").rglob("*.parquet") if str(p) not in files}
    assert sorted(written) == sorted(buckets_in(one["changes"], M.MATCH_KEY)) and new == {f"bucket={b}" for b in written}
    left, right = read_buckets(spark, path).select(*one["matches"].columns), one["matches"]
    assert left.count() == right.count() and left.exceptAll(right).isEmpty()

    # links whose matches were deleted are forgotten, so that they are found anew
    removed = spark.createDataFrame([(1, "CVE-2024-0004")], "advisory_id bigint, cve_id_text string")
    cut = M.cascade_delete(delta, removed)
    back = D.run_matching_delta(adv, codes_now, cve_now, asset_now, cut, rules_now, D.forget_links(marks[0], removed), marks[1])
    keys = M.MATCH_KEY
    touched = delta.where("touched").select(*keys)
    assert touched.exceptAll(back["matches"].select(*keys)).isEmpty() and cut.count() < back["matches"].count()
    # tables without rows
    empty = D.run_matching_delta(adv.limit(0), codes.limit(0), cve.limit(0), asset.limit(0), none, rules.limit(0))
    assert empty["matches"].isEmpty() and empty["stats"].isEmpty() and empty["links"].isEmpty()
