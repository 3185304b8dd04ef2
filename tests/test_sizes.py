"""What must not grow faster than tables and results do."""

import random

from pyspark.sql import functions as F

from exposure.functions.version import parse_version_rule
from exposure.operators import matching, products
from exposure.plans import demo, exposure_report


def test_only_pieces_that_may_be_an_alias_leave_their_task(spark, monkeypatch):
    monkeypatch.setattr(products, "BLOCK", 64)  # texts are cut across blocks
    rng = random.Random(4)
    word = lambda least, most: "".join(rng.choice("ab 한é1") for _ in range(rng.randint(least, most)))
    texts, aliases = {word(0, 60) for _ in range(200)}, {word(2, 4) for _ in range(40)} | {"한" * 30}
    texts |= {"a" * 500, "x" + "한" * 40}
    df = spark.createDataFrame([(t,) for t in [*texts, *texts]] + [(None,)], "text string")
    entries = spark.createDataFrame([(a,) for a in aliases], "alias string")
    got = products.alias_pieces(df, entries).groupBy("text", "alias").agg(F.count("*").alias("n")).collect()
    held = {(t, a) for t in texts for a in aliases if a in t}
    found = {(r["text"], r["alias"]) for r in got}
    assert held <= found
    assert len(found) <= len(held) + 20  # every piece of an alias's length before, some 10,000
    assert max(r["n"] for r in got) < 60


def test_no_alias_gives_no_pieces(spark):
    df = spark.createDataFrame([("abc",)], "text string")
    assert products.alias_pieces(df, spark.createDataFrame([], "alias string")).isEmpty()
    assert products.alias_pieces(df.where("false"), df.select(F.col("text").alias("alias"))).isEmpty()


def _tables(spark, codes=30, assets=200):
    """CVEs with repeated ids, assets with repeated ids, missing departments and versions; every code named by two advisories."""
    versions = ("1.0", "2.0", "22H2", None)
    asset = [(i % (assets - 5), i % 4 if i % 9 else None, f"p{i % 3}" if i % 11 else None, versions[i % 4], versions[(i + i // 4) % 4],
              ("NORMAL", "RETIRED", None)[(i % 10 == 0) + (i % 13 == 0)]) for i in range(assets)]
    rules = ('{"lt":"2.0"}', "*", '["1.0"]', None)
    cve = [(f"CVE-2024-{i % (codes - 3):05}", f"p{i % 4}", rules[i % 4], ("HIGH", "LOW")[i % 2]) for i in range(codes)]
    frame = spark.createDataFrame(cve, "cve_id string, product_key string, raw string, severity string")
    rule = F.when(F.col("raw").isNotNull(), parse_version_rule("raw"))
    named = [(a, f"CVE-2024-{i:05}", "FOUND" if i % 7 else "NOT_FOUND") for i in range(codes + 2) for a in (1, 1, 2)]
    return (
        spark.createDataFrame(named, "advisory_id long, cve_id_text string, lookup_status string"),
        frame.select("cve_id", "product_key", rule.alias("version_rule"), "severity"),
        spark.createDataFrame(asset, "asset_id long, department_id long, product_key string, version_norm string, version_raw string, status string"),
        spark.createDataFrame([(0, "a"), (1, "b"), (3, "d")], "department_id long, name string"),
    )


def _counting(monkeypatch):
    """Numbers of the rows that the core join gives from now on."""
    made, plain = [], matching.match_assets

    def counted(*args, **kw):
        out = plain(*args, **kw)
        made.append(out.count())
        return out

    monkeypatch.setattr(matching, "match_assets", counted)
    return made


def test_exposure_makes_no_row_per_code_and_asset(spark, rows, monkeypatch):
    codes, cve, asset, department = _tables(spark)
    once = codes.select("cve_id_text", "lookup_status").distinct().withColumn("advisory_id", F.lit(0))
    pairs = matching.match_assets(once, cve, asset).groupBy("department_id", "cve_id_text").agg(
        F.count("*").alias("assets"), F.count_if("reason.candidate").alias("to_review"))
    want = pairs.join(department.withColumnRenamed("name", "department"), "department_id", "left").join(
        cve.select(F.col("cve_id").alias("cve_id_text"), "severity"), "cve_id_text", "left")
    names = ["department_id", "department", "cve_id_text", "severity", "assets", "to_review"]
    want = rows(want, *names)
    made = _counting(monkeypatch)
    assert rows(exposure_report.department_exposure(codes, cve, asset, department), *names) == want
    assert exposure_report.department_exposure(*_tables(spark, assets=2000)).count()
    assert len(made) == 2 and made[0] < 200 and made[1] < 200  # kinds and rules, however many assets there are


def test_hits_of_assets_make_no_row_per_match(spark, rows, monkeypatch):
    codes, cve, asset, _ = _tables(spark)
    want = matching.match_assets(codes, cve, asset).groupBy("asset_id").agg(
        F.count("*").alias("matches"), F.count_if("reason.candidate").alias("candidates"))
    want = rows(want)
    made = _counting(monkeypatch)
    assert rows(matching.asset_hits(codes, cve, asset), "asset_id", "matches", "candidates") == want
    codes, cve, asset, _ = _tables(spark, codes=300, assets=2000)
    assert matching.asset_hits(codes, cve, asset).count()
    assert len(made) == 2 and made[0] < 200 and made[1] < 200


def test_a_merge_deals_out_the_columns_that_are_asked_for(spark, rows):
    fields = "reason struct<product_key:string,candidate:boolean>"
    key = "advisory_id long, cve_id_text string, asset_id long"
    old = spark.createDataFrame([(1, "a", 1, ("p", True), "EXCLUDED", "DONE", "n"), (1, "a", 2, None, None, None, "m")],
                                f"{key}, {fields}, status string, ack_status string, ack_note string")
    new = spark.createDataFrame([(1, "a", 1, ("q", False)), (2, "b", 3, ("r", True)), (1, "a", 2, None)], f"{key}, {fields}")
    merged = matching.merge_matches(old, new)
    assert rows(merged, "asset_id", "reason.product_key", "status", "ack_status", "ack_note", "touched") == [
        (1, "q", "EXCLUDED", "DONE", "n", True), (2, None, None, None, "m", True), (3, "r", "MATCHED", "NONE", None, True)]
    slim = matching.merge_matches(matching.with_reason(old, "candidate"), matching.with_reason(new, "candidate"))
    assert rows(slim, "asset_id", "reason.candidate") == rows(merged, "asset_id", "reason.candidate")
    dealt = merged.select("asset_id", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert "_ack_note" not in dealt and "_reason" not in dealt  # the whole stored row was one value before


def test_flags_before_the_advisories_are_those_after(spark, rows):
    codes, cve, asset, _ = _tables(spark)
    known = asset.select("asset_id", "product_key", F.lit("x").alias("reason"), (F.col("asset_id") % 3 == 0).alias("is_active"))
    want = matching.flag_suggested(matching.match_assets(codes, cve, asset), known)
    names = ("advisory_id", "cve_id_text", "asset_id", "department_id", "reason.candidate", "reason.suggested_exclude")
    assert rows(matching.match_assets(codes, cve, asset, known), *names) == rows(want, *names)


def test_matches_are_not_written_for_their_readers(spark, monkeypatch):
    written, plain = [], demo.store
    monkeypatch.setattr(demo, "store", lambda df, name: written.append(name) or plain(df, name))
    codes, cve, asset, _ = _tables(spark)
    known = asset.select("asset_id", "product_key", (F.col("asset_id") % 3 == 0).alias("is_active"))
    views = demo.Views(spark, "nowhere")
    views.__dict__.update(codes=codes, cve=cve, asset=asset, exclusion_rule=known)
    assert not views.match.where("status = 'MATCHED'").isEmpty()
    assert "match" not in written


def test_only_columns_of_messages_are_written(spark, monkeypatch):
    from exposure.plans.catalog import notifications

    written, plain = [], notifications.store
    monkeypatch.setattr(notifications, "store", lambda df, name: written.append((name, df.columns)) or plain(df, name))
    match = spark.createDataFrame([(1, "a", 2, ("p",), "MATCHED", "NONE")],
                                  "advisory_id long, cve_id_text string, asset_id long, reason struct<product_key:string>, status string, ack_status string")
    names = ["asset_no", "product_raw", "product_key", "version_raw", "version_norm", "ip", "owner_name", "status"]
    asset = spark.createDataFrame([(2, 3, *["x"] * 8)], f"asset_id long, department_id long, {', '.join(f'{n} string' for n in names)}")
    views = demo.Views(spark, "nowhere")
    views.__dict__.update(match=match, asset=asset)
    assert notifications._active(views).count() == 1 and notifications._active(views, *notifications._LINE).count() == 1
    assert [len(columns) for _, columns in written] == [5, 10]  # every column of match and asset before


def test_replies_write_only_what_they_read(spark):
    from exposure.plans.catalog import replies

    match = spark.createDataFrame([(1, "a", 2, ("p",), "MATCHED", None, "NONE")], "advisory_id long, cve_id_text string, asset_id long, "
                                  "reason struct<product_key:string>, status string, excluded_reason string, ack_status string")
    views = demo.Views(spark, "nowhere")
    views.__dict__.update(match=match)
    kept = replies._matches(views)
    assert kept.columns == ["advisory_id", "cve_id_text", "asset_id", "status", "ack_status"] and kept.count() == 1
