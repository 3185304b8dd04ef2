import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from exposure.operators.feeds import (
    feed_counts, kev_to_records, merge_modified_feed, normalize_feed, upsert_cves, with_year,
)
from exposure.sources import feeds, files, sinks
from exposure.schemas import CVE

AT = "2024-05-05 00:00:00"


def nvd_items(n, start=0):
    tricky = ['brace } ] {"cve":{"id":"x"}} end', 'quote " and \\ back', "한글 설명, [1,2]", "plain"]
    return [
        {"cve": {
            "id": f"CVE-2024-{i:05d}", "published": "2024-01-02T00:00:00.000",
            "descriptions": [{"lang": "es", "value": "es"}, {"lang": "en", "value": tricky[i % 4] + str(i)}],
            "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}]},
            "configurations": [{"nodes": [{"cpeMatch": [
                {"vulnerable": True, "criteria": "cpe:2.3:a:google:chrome:*", "versionEndExcluding": f"{i}.1"}]}]}],
        }} for i in range(start, start + n)]


def write(path, doc, compact=True, packed=False):
    body = json.dumps(doc, ensure_ascii=False, **({"separators": (",", ":")} if compact else {"indent": 1}))
    data = body.encode("utf-8")
    path.write_bytes(gzip.compress(data) if packed else data)
    return str(path)


@pytest.mark.parametrize("split", ["257", "4096", "134217728"])
def test_split_reading_equals_whole_reading(spark, tmp_path, split):
    items = nvd_items(120)
    compact = write(tmp_path / "a.json", {"format": "NVD_CVE", "vulnerabilities": items, "totalResults": 120})
    pretty = write(tmp_path / "b.json", {"vulnerabilities": items}, compact=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        a = feeds.read_nvd_feed(spark, compact)
        in_order = [r.id for r in a.orderBy("file_seq", "pos").select("cve.id").collect()]
        assert in_order == [i["cve"]["id"] for i in items]
        b = feeds.read_nvd_feed(spark, pretty)
        assert a.select("cve").exceptAll(b.select("cve")).isEmpty() and b.select("cve").exceptAll(a.select("cve")).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_mixed_layout_is_refused(spark, tmp_path):
    good = json.dumps(nvd_items(1)[0], separators=(",", ":"))
    path = tmp_path / "m.json"
    path.write_text('{"vulnerabilities":[' + good + ', { "cve" : {"id":"CVE-2024-9999"}}]}')
    with pytest.raises(Exception, match="mixed layout"):
        feeds.read_nvd_feed(spark, str(path), compact=True).collect()
    assert feeds.read_nvd_feed(spark, str(path)).count() == 2


def test_every_format_through_one_reader(spark, tmp_path):
    paths = [
        write(tmp_path / "n.json.gz", {"vulnerabilities": nvd_items(3)}, packed=True),
        write(tmp_path / "i.json", {"source": "X", "cves": [
            {"cve_id": "cve 2026 44120", "product_name": "한컴오피스", "affected_versions": ["2020", "2022"], "severity": "중간",
             "cvss_score": 6.5, "published_at": "2026.06.13"},
            {"cve_id": "CVE-2026-1", "product": "bad id"},
            {"id": "CVE-2026-45088", "product": "Acrobat", "affected_versions": {"lt": "124"}, "cvss": 0.0, "desc": "d"}]}, compact=False),
        write(tmp_path / "bare.json", [{"cve_id": "CVE-2026-11111", "product": "Edge", "versions": "1;2", "severity": "LOW"}]),
    ]
    csv = tmp_path / "c.csv.gz"
    csv.write_bytes(gzip.compress("﻿CVE,제품,영향버전,심각도,extra\nCVE-2026-22222,\"Chrome, new\",\"122; 123\",긴급,x\n".encode("utf-8")))
    plain = tmp_path / "plain.txt"
    plain.write_text('cve_id,os,desc\nCVE-2026-33333,Ubuntu,"two\nlines"\n')
    got = {r.cve_id: r for r in feeds.read_feed(spark, paths + [str(csv), str(plain)]).collect()}
    assert set(got) == {"CVE-2024-00000", "CVE-2024-00001", "CVE-2024-00002", "CVE-2026-44120", "CVE-2026-45088",
                        "CVE-2026-11111", "CVE-2026-22222", "CVE-2026-33333"}
    a = got["CVE-2026-44120"]
    assert (a.product_key, a.version_rule.kind, a.version_rule["values"], a.severity, float(a.cvss_score), str(a.published_at), a.file_seq) == (
        "hancom_office", "enum", ["2020", "2022"], "MEDIUM", 6.5, "2026-06-13", 1)
    b = got["CVE-2026-45088"]
    assert (b.product_key, b.version_rule.op, b.version_rule.lo, b.severity, b.cvss_score) == ("adobe_acrobat", "lt", "124", "MEDIUM", None)
    assert got["CVE-2026-11111"].version_rule["values"] == ["1", "2"]
    c = got["CVE-2026-22222"]
    assert (c.product_key, c.severity, c.version_rule["values"], c.file_seq) == ("google_chrome", "CRITICAL", ["122", "123"], 3)
    assert got["CVE-2026-33333"].description == "two\nlines"
    n = got["CVE-2024-00002"]
    assert (n.product_name, n.product_key, n.version_rule.lo, n.severity, n.description, n.cpe_list, n.source) == (
        "google chrome", "google_chrome", "2.1", "CRITICAL", "한글 설명, [1,2]2", ["cpe:2.3:a:google:chrome:*"], "NVD")


def test_file_order_and_odd_names(spark, tmp_path):
    paths = []
    for i, name in enumerate(["b 한글+1.json", "a%20x.json", "c.json"]):
        paths.append(write(tmp_path / name, {"cves": [{"cve_id": "CVE-2024-0001", "description": f"d{i}"}, {"cve_id": f"CVE-2024-100{i}"}]}))
    for i in (3, 4):
        csv = tmp_path / f"{9 - i}.csv"
        csv.write_text(f"cve,desc\nCVE-2024-0001,d{i}\n" if i == 3 else "desc,CVE\nd4,CVE-2024-0001\n")
        paths.append(str(csv))
    from exposure.operators.feeds import last_wins

    rows = feeds.read_feed(spark, paths)
    assert sorted((r.file_seq, r.description) for r in rows.where("cve_id = 'CVE-2024-0001'").collect()) == [(i, f"d{i}") for i in range(5)]
    assert last_wins(rows).where("cve_id = 'CVE-2024-0001'").first().description == "d4"
    assert feeds.read_feed(spark, paths[:3]).count() == 6


def test_unknown_format(spark, tmp_path):
    bad = write(tmp_path / "x.json", {"foo": 1})
    with pytest.raises(ValueError, match="unsupported"):
        feeds.read_feed(spark, bad)
    good = write(tmp_path / "y.json", {"vulnerabilities": nvd_items(1)})
    assert feeds.read_feed(spark, [bad, good], strict=False).count() == 1
    assert feeds.read_feed(spark, write(tmp_path / "z.json", {"vulnerabilities": []})).count() == 0


def test_kev(spark, tmp_path):
    path = write(tmp_path / "kev.json", {"vulnerabilities": [
        {"cveID": "CVE-2021-44228", "vendorProject": "Apache", "product": "Log4j2", "vulnerabilityName": "n", "shortDescription": "",
         "dateAdded": "2021-12-10"}]})
    r = normalize_feed(kev_to_records(feeds.read_kev_feed(spark, path))).first()
    assert (r.cve_id, r.product_name, r.product_key, r.severity, r.description, str(r.published_at), r.source) == (
        "CVE-2021-44228", "Apache Log4j2", "apache_httpd", "HIGH", "n", "2021-12-10", "CISA-KEV")


def records(spark, lo, hi, severity="LOW", file_seq=0):
    return spark.range(lo, hi).select(
        F.format_string("CVE-2024-%05d", "id").alias("cve_id"), F.lit("Edge").alias("product"), F.lit(severity).alias("severity"),
        F.lit("S").alias("source"), F.lit(file_seq).alias("file_seq"), F.struct(F.lit(0).alias("block"), F.col("id").alias("row")).alias("pos"))


def test_overlapping_feeds(spark):
    at = F.lit(AT).cast("timestamp")
    empty = spark.createDataFrame([], CVE)
    first = normalize_feed(records(spark, 0, 1500))
    assert tuple(feed_counts(first, empty).first()) == (1500, 0, "S")
    cve = upsert_cves(empty, first, at, 1).drop("_action")
    second = normalize_feed(records(spark, 500, 2000, "CRITICAL"))
    assert tuple(feed_counts(second, cve).first())[:2] == (500, 1000)
    marked = upsert_cves(cve, second, F.lit("2024-06-06").cast("timestamp"), 2)
    assert {r[0]: r[1] for r in marked.groupBy("_action").count().collect()} == {"added": 500, "updated": 1000, "kept": 500}
    nxt = marked.drop("_action")
    assert nxt.count() == 2000
    assert nxt.where("updated_at IS NOT NULL").count() == 1000
    assert nxt.where("severity = 'CRITICAL'").count() == 1500
    assert nxt.where("created_at = '2024-05-05'").count() == 1500
    again = upsert_cves(nxt, second, F.lit("2024-06-06").cast("timestamp"), 2)
    assert again.where("_action = 'added'").count() == 0 and again.count() == 2000


def test_last_record_of_a_feed_wins(spark):
    both = normalize_feed(records(spark, 0, 10, "HIGH", 1).unionByName(records(spark, 0, 10, "LOW", 0)))
    cve = upsert_cves(spark.createDataFrame([], CVE), both, F.lit(AT).cast("timestamp"))
    assert {r[0] for r in cve.select("severity").distinct().collect()} == {"HIGH"}


def test_hashes_and_meta(spark, tmp_path):
    body = b'{"x":1}' * 1000
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(body))
    (tmp_path / "b.json").write_bytes(body)
    listed = files.list_files(spark, str(tmp_path))
    got = {r.path.split("/")[-1]: (r.sha256, r.payload_bytes) for r in files.payload_hashes(listed).collect()}
    sha = hashlib.sha256(body).hexdigest().upper()
    assert got == {"a.json.gz": (sha, 7000), "b.json": (sha, 7000)}
    for name, value in (("a", sha), ("b", "00"), ("c", "11")):
        (tmp_path / f"{name}.meta").write_text(f"lastModifiedDate:2024-01-01T00:00:00\nsha256:{value}\n")
    meta = files.read_meta(spark, [str(tmp_path / f"{n}.meta") for n in "abc"])
    assert meta.where("key = 'lastModifiedDate'").first().value == "2024-01-01T00:00:00"
    local = spark.createDataFrame([("a", sha), ("b", sha)], "name string, sha256 string")
    old = meta.where("name <> 'b'")
    state = {r.name: (r.state, r.verified, r.fetch) for r in files.verify_feed_files(local, meta, old).collect()}
    assert state == {"a": ("UNCHANGED", True, False), "b": ("NO_META", False, True), "c": ("MISSING", False, True)}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.current_version(spark, path) == 0
    assert sinks.write_snapshot(spark.range(5), path, ["id"], "a") == 1
    assert sinks.write_snapshot(spark.range(9), path, ["id"], "b") == 2
    assert sinks.write_snapshot(spark.range(99), path, ["id"], "b") == 2
    assert sinks.read_snapshot(spark, path).count() == 9
    assert sinks.read_snapshot(spark, path, 1).count() == 5


def test_partition_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(10).select("id", (2000 + F.col("id") % 2).cast("int").alias("y"))
    sinks.write_parts(first, path, "y", ["id"], "1")
    sinks.write_parts(spark.range(3).select("id", F.lit(2001).alias("y")), path, "y", ["id"], "2")
    sinks.write_parts(spark.range(77).select("id", F.lit(2001).alias("y")), path, "y", ["id"], "2")
    got = {r[0]: r[1] for r in sinks.read_parts(spark, path, "y").groupBy("y").count().collect()}
    assert got == {2000: 5, 2001: 3}


def test_year_and_combined_exports(spark, tmp_path):
    local = with_year(spark.createDataFrame([(f"CVE-{y}-{i:04d}", f"item{i}") for y in (2019, 2021) for i in range(4)], "cve_id string, item string"))
    sinks.export_by_year(local, str(tmp_path / "years"))
    assert spark.read.json(str(tmp_path / "years")).count() == 8
    sinks.export_by_year(local.where("cve_year = 2021 AND cve_id < 'CVE-2021-0002'"), str(tmp_path / "years"))
    assert spark.read.json(str(tmp_path / "years")).count() == 6
    counts = sinks.export_combined(local, str(tmp_path / "all"), 2019, 2020)
    assert [tuple(r) for r in counts.collect()] == [(2019, 4)]
    assert spark.read.text(str(tmp_path / "all")).count() == 4


def test_modified_feed_guards(spark):
    now = dt.datetime(2024, 5, 20)
    local = with_year(spark.createDataFrame([("CVE-2020-0001", "a"), ("CVE-2021-0001", "b")], "cve_id string, item string"))
    mod = spark.createDataFrame([("CVE-2021-0001", "new", 0, (0, 1)), ("CVE-2021-0001", "old", 0, (0, 0)), ("CVE-2021-0002", "c", 0, (0, 2))],
                                "cve_id string, item string, file_seq int, pos struct<block:bigint,row:bigint>")
    with pytest.raises(ValueError, match="full synchronisation"):
        merge_modified_feed(local, mod, now - dt.timedelta(days=8), now)
    assert merge_modified_feed(local, mod, now, now, "h", "h") is None
    got = sorted((r.cve_id, r.item) for r in merge_modified_feed(local, mod, now, now).collect())
    assert got == [("CVE-2021-0001", "new"), ("CVE-2021-0002", "c")]


def test_outbox_audit_and_reports(spark, tmp_path):
    sinks.write_outbox(spark.createDataFrame([("MAIL", "d", "한글")], "channel string, dept string, body string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().body == "한글"
    ev = sinks.audit_events(spark.range(2), "NOTIFY_SEND", "notification", F.col("id"), F.struct(F.col("id").alias("n")), F.lit(AT).cast("timestamp"))
    sinks.append_audit(ev, str(tmp_path / "audit"))
    sinks.append_audit(ev, str(tmp_path / "audit"))
    back = spark.read.parquet(str(tmp_path / "audit"))
    assert back.count() == 4 and back.first().detail.startswith('{"n":')
    sinks.write_csv_report(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "rep"))
    assert spark.read.csv(str(tmp_path / "rep"), header=True).first().a == "'=1+1"


def test_documents(spark, tmp_path):
    from exposure.sources.documents import grid_from_csv, read_advisory_docs, read_advisory_texts

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    d = read_advisory_docs(spark, str(tmp_path / "docs")).first()
    assert (bytes(d.head), d.size_bytes, d.sha256) == (b"%PDF-", 10, hashlib.sha256(b"%PDF-1.7 x").hexdigest())
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "a.txt").write_text("one\ftwo")
    t = read_advisory_texts(spark, str(tmp_path / "txt")).first()
    assert (t.file_name, t.text, t.page_count) == ("a.txt", "one\ftwo", 2)
    (tmp_path / "l.csv").write_text("자산번호,부서\nA-1,\nA-2,x\n")
    g = grid_from_csv(spark, str(tmp_path / "l.csv"), 3).orderBy("row_no").collect()
    assert [(r.row_no, r.cells) for r in g] == [(0, ["자산번호", "부서"]), (1, ["A-1", None]), (2, ["A-2", "x"])]


def test_ledger_rows_of_any_width(spark, tmp_path):
    from exposure.sources.documents import grid_from_csv

    (tmp_path / "l.csv").write_text('Ledger 2024\n\nNo,Dept,OS\n1,"a\nb",Edge\n')
    g = grid_from_csv(spark, str(tmp_path / "l.csv"), 3).orderBy("row_no").collect()
    assert [(r.row_no, r.cells) for r in g] == [(0, ["Ledger 2024"]), (1, []), (2, ["No", "Dept", "OS"]), (3, ["1", "a\nb", "Edge"])]


def test_damaged_feeds_are_refused_whole(spark, tmp_path):
    whole = json.dumps({"vulnerabilities": nvd_items(3)}, separators=(",", ":"))
    internal = json.dumps({"cves": [{"cve_id": f"CVE-2024-000{i}"} for i in range(3)]})
    texts = {
        "cut_nvd": whole[:-30], "cut_internal": internal[:-12], "broken_record": whole.replace('"CVE-2024-00001"', '"CVE-2024-00001', 1),
        "two": internal + internal, "empty": "", "nested_only": json.dumps({"x": {"vulnerabilities": []}}),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(ValueError, match="unsupported"):
            feeds.read_feed(spark, str(tmp_path / f"{name}.json"))
    with pytest.raises(Exception, match="damaged record|mixed layout"):
        feeds.read_nvd_feed(spark, str(tmp_path / "cut_nvd.json"), compact=True).collect()
    with pytest.raises(Exception):
        feeds.read_internal_feed(spark, str(tmp_path / "cut_internal.json")).collect()


def test_the_top_level_key_decides_however_late_it_comes(spark, tmp_path):
    late = write(tmp_path / "late.json", {"pad": "x" * (3 << 20), "vulnerabilities": nvd_items(2)})
    nested = write(tmp_path / "nested.json", {"meta": {"vulnerabilities": [1]}, "cves": [{"cve_id": "CVE-2024-7777", "cvss": 8.96}]})
    kinds = {r.path: (r.kind, r.compact) for r in feeds.sniff_feeds(spark, [late, nested]).collect()}
    assert kinds == {late: ("nvd", True), nested: ("internal", False)}
    got = {r.cve_id: r.severity for r in feeds.read_feed(spark, [late, nested]).collect()}
    assert got == {"CVE-2024-00000": "CRITICAL", "CVE-2024-00001": "CRITICAL", "CVE-2024-7777": "HIGH"}


def test_pieces_do_not_change_the_shape():
    import io

    body = json.dumps({'a " \\ {': ["}", {"x": "]"}], "cves": [{"cve_id": 'q"}{\\', "n": [{}]}, {"d": {}}]}).encode()
    for piece in (1, 2, 7, 64, 1 << 20):
        assert files.json_shape(io.BytesIO(body), piece) == ("internal", False)
        assert files.json_shape(io.BytesIO(body[:-1]), piece) == ("unknown", False)


def test_scores(spark):
    rows = spark.createDataFrame([("CVE-2024-0001", "0"), ("CVE-2024-0002", "8.96"), ("CVE-2024-0003", "100"), ("CVE-2024-0004", "")], "cve_id string, cvss string")

    def classes(**options):
        return [r.severity for r in normalize_feed(rows, **options).orderBy("cve_id").collect()]

    assert classes() == ["MEDIUM", "HIGH", "CRITICAL", "MEDIUM"]
    assert classes(zero_is_missing=False) == ["LOW", "HIGH", "CRITICAL", "MEDIUM"]


def test_malformed_ids_refuse_the_feed(spark):
    now = dt.datetime(2024, 5, 20)
    local = with_year(spark.createDataFrame([("CVE-2020-0001", "a")], "cve_id string, item string"))
    mod = spark.createDataFrame([("CVE-20-1", "x", 0, (0, 1))], "cve_id string, item string, file_seq int, pos struct<block:bigint,row:bigint>")
    with pytest.raises(Exception, match="malformed id"):
        merge_modified_feed(local, mod, now, now).collect()


def test_snapshot_log_hides_no_other_error(spark, tmp_path):
    (tmp_path / "t" / "log").mkdir(parents=True)
    (tmp_path / "t" / "log" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        sinks.current_version(spark, str(tmp_path / "t"))


def test_audit_pages_are_not_cut(spark):
    from exposure.operators.search import sort_audit

    with pytest.raises(ValueError, match="at most 200"):
        sort_audit(spark.range(1), size=500)


def test_records_of_a_document_leave_their_task_one_by_one(spark, tmp_path):
    """A document is no value of its own: records come as rows, are dealt to several tasks, and damage at its end is an error."""
    n = 5000
    doc = {"meta": [{"cve_id": "no"}], "note": "cves", "cves": [None, *[{"cve_id": f"CVE-2024-{i:05d}", "versions": ["}", i]} for i in range(n)]]}
    path = write(tmp_path / "i.json", doc, compact=False)
    assert "posexplode" not in feeds.read_internal_feed(spark, path)._jdf.queryExecution().toString()
    spread = feeds.read_internal_feed(spark, path)
    got = spread.orderBy("pos").collect()
    assert [r.cve_id for r in got] == [f"CVE-2024-{i:05d}" for i in range(n)] and got[7].versions == '["}",7]'
    body = (tmp_path / "i.json").read_text()
    for cut in (body[:-1], body + "x", body.replace('"cves": [', '"cves": [1, '), body.replace('"cves": [', '"other": ['), body.replace("{", "", 1)):
        (tmp_path / "d.json").write_text(cut)
        with pytest.raises(Exception, match="damaged JSON"):
            feeds.read_internal_feed(spark, str(tmp_path / "d.json")).count()


def test_compact_documents_are_checked_in_pieces(spark, tmp_path):
    whole = json.dumps({"a": [{}], "vulnerabilities": nvd_items(300), "totalResults": 300}, separators=(",", ":"))
    cuts = {"good": whole, "end": whole[:-1], "comma": whole.replace('}},{"cve"', '}}{"cve"', 1), "value": whole.replace(":9.8,", ":9.8.1,", 1),
            "loose": whole.replace('},{"cve":', '}, { "cve" :', 1), "head": whole.replace('"a":[{}]', '"a":[{]', 1)}
    paths = {}
    for name, text in cuts.items():
        (tmp_path / f"{name}.json").write_text(text)
        paths[name] = str(tmp_path / f"{name}.json")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [r.file_seq for r in feeds._whole(spark, list(paths.values())).collect()] == [0]
        kinds = {r.path: (r.kind, r.compact) for r in feeds.sniff_feeds(spark, list(paths.values())).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert kinds[paths["good"]] == ("nvd", True) and kinds[paths["loose"]] == ("nvd", False)
    assert kinds[paths["end"]] == kinds[paths["value"]] == ("unknown", False)
    assert feeds.read_feed(spark, [paths["good"], paths["end"], paths["loose"]], strict=False).count() == 600


def test_damaged_catalogues_are_an_error(spark, tmp_path):
    whole = json.dumps({"vulnerabilities": [{"cveID": f"CVE-2021-{i:04d}"} for i in range(3)]})
    for i, text in enumerate((whole[:-1], whole[:-20], json.dumps({"other": []}), whole.replace('"}', '",}', 1))):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(Exception, match="damaged JSON|MALFORMED"):
            feeds.read_kev_feed(spark, str(tmp_path / f"{i}.json")).collect()


@pytest.mark.parametrize("packed", [False, True])
def test_csv_that_ends_inside_a_quote_is_refused(spark, tmp_path, monkeypatch, packed):
    monkeypatch.setattr(files, "_PIECE", 5)
    good = ['cve,desc\nCVE-2024-0001,"a ""b"", c\nd"\n', 'cve,desc\nCVE-2024-0001,5" disk\n', '\ufeff"cve",desc\n"CVE-2024-0001",""', 'cve,desc\nCVE-2024-0001,"x"']
    cut = ['cve,desc\nCVE-2024-0001,"a\nCVE-2024-0002,b\n', '"cve,desc\n', 'cve,desc\nCVE-2024-0001,"x""']
    for i, text in enumerate(good + cut):
        data = text.encode()
        name = f"{i}.csv.gz" if packed else f"{i}.csv"
        (tmp_path / name).write_bytes(gzip.compress(data) if packed else data)
        with files.open_stream(str(tmp_path / name)) as f:
            assert files._kind(name, f)[0] == ("csv" if i < len(good) else "unknown"), text
    path = str(tmp_path / ("4.csv.gz" if packed else "4.csv"))
    with pytest.raises(ValueError, match="damaged CSV"):
        feeds.read_csv_feed(spark, path)
    with pytest.raises(ValueError, match="unsupported"):
        feeds.read_feed(spark, path)
    assert [r.kind for r in feeds.sniff_feeds(spark, path).collect()] == ["unknown"]
