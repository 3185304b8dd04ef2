"""Ledgers with title rows, merged cells, two header lines and split cells."""

import pytest
from pyspark.sql import functions as F

from exposure.operators import ledger as L
from exposure.schemas import ASSET, GRID, MERGED_RANGE

DEPT = "department_id bigint, name string, is_active boolean"


def grid(spark, lines, import_id=1):
    return spark.createDataFrame([(import_id, "S", i, c) for i, c in enumerate(lines)], GRID)


def ranges(spark, *r):
    return spark.createDataFrame([(1, "S", *x) for x in r], MERGED_RANGE)


def departments(spark, *names):
    return spark.createDataFrame([(i, n, True) for i, n in enumerate(names)], DEPT)


def test_title_row_and_vertical_merges(spark):
    g = grid(spark, [
        ["2026 자산 현황", None, None, None, None, None],
        ["자산번호", "사용부서", "OS", "버전", "IP", "담당자"],
        ["PC-1", "도로국", "Windows 11", "23H2", "10.0.0.1", "a"],
        ["PC-2", None, "Windows 11", "23H2", "10.0.0.2", "b"],
        ["PC-3", "총무국", "MS Office", "2021", "10.0.0.3", "c"],
        ["PC-4", None, "MS Office", "2021", "10.0.0.4", "d"],
        ["PC-5", None, "Chrome 122.x", None, "10.0.0.5", "e"],
        [None, "", None, None, None, None],
    ])
    filled = L.fill_merged(g, ranges(spark, (0, 0, 0, 5), (2, 1, 3, 1), (4, 1, 6, 1)))
    header = L.detect_header_row(filled)
    assert header.first().header_row == 1
    headers = L.combine_headers(filled, header)
    mapping = headers.select(L.suggest_mapping("headers")).first()[0]
    assert mapping == {"asset_no": "A", "department": "B", "product_key": "C", "version_norm": "D", "ip": "E", "owner_name": "F"}
    out = L.commit_assets(L.body_rows(filled, header), mapping, spark.createDataFrame([], ASSET), departments(spark, "도로국"))
    assets = {r.asset_no: r for r in out["asset"].collect()}
    assert len(assets) == 5 and out["warnings"].count() == 0
    assert [assets[f"PC-{i}"].department for i in range(1, 6)] == ["도로국", "도로국", "총무국", "총무국", "총무국"]
    assert (assets["PC-5"].product_key, assets["PC-5"].version_norm, assets["PC-5"].product_raw) == ("google_chrome", "122.x", "Chrome 122.x")
    assert {r.name for r in out["department"].collect()} == {"도로국", "총무국"}


def test_merges_across_row_blocks(spark):
    n = L.ROW_BLOCK + 10
    g = spark.range(n).select(F.lit(1).cast("bigint").alias("import_id"), F.lit("S").alias("sheet"), F.col("id").cast("int").alias("row_no"),
                              F.array(F.when(F.col("id") == 5, "top"), F.lit("x")).alias("cells"))
    out = L.fill_merged(g, ranges(spark, (5, 0, n - 2, 0), (999999, 0, 1000000, 0)))
    assert out.where("cells[0] = 'top'").count() == n - 6
    assert out.count() == n and out.where("cells[1] = 'x'").count() == n


def test_two_header_lines(spark):
    g = grid(spark, [
        ["자산번호", "사용부서", "제품", None, "담당자"], [None, None, "OS", "버전", None],
        ["PC-3001", "정보화담당관실", "Windows 11", "23H2", "x"], ["PC-3002", "도로국", "Windows Server", "2022", "y"],
    ])
    filled = L.fill_merged(g, ranges(spark, (0, 2, 0, 3), (0, 0, 1, 0), (0, 1, 1, 1), (0, 4, 1, 4)))
    header = spark.createDataFrame([(1, "S", 0)], "import_id bigint, sheet string, header_row int")
    headers = L.combine_headers(filled, header, 2)
    assert headers.first().headers == ["자산번호", "사용부서", "제품 / OS", "제품 / 버전", "담당자"]
    mapping = headers.select(L.suggest_mapping("headers")).first()[0]
    assert (mapping["product_key"], mapping["version_norm"]) == ("C", "D")
    body = L.body_rows(filled, header, 2)
    assert L.commit_assets(body, mapping, spark.createDataFrame([], ASSET), departments(spark))["asset"].count() == 2


def test_split_cells_and_extra(spark):
    g = grid(spark, [["자산번호", "사용부서", "운영체제", "담당", "메모"], ["PC-7001", "총무국", "Windows 11 22H2", "좋은팀, 홍길동, 010-1234-5678", " m "]])
    mapping = {"asset_no": "A", "department": "B", "product_key": {"col": "C", "mode": "product"},
               "owner_team": {"col": "D", "sep": ",", "part": 0}, "owner_name": {"col": "D", "sep": ",", "part": 1},
               "owner_contact": {"col": "D", "sep": ",", "part": 2}}
    out = L.commit_assets(L.body_rows(g, L.detect_header_row(g)), mapping, spark.createDataFrame([], ASSET), departments(spark))
    a = out["asset"].first()
    assert (a.owner_team, a.owner_name, a.owner_contact, a.product_raw, a.version_raw, a.extra) == (
        "좋은팀", "홍길동", "010-1234-5678", "Windows 11", "22H2", {"E": "m"})


def lines(spark):
    return grid(spark, [
        ["no", "dept", "os"], ["A", "D1", "Edge 1"], ["A", "D1", "Edge 2"], [None, "D1", "Edge"], ["C", None, "Edge 3"],
        ["D", "D9", "Edge 4"], ["E", "D1", None],
    ])


MAP = {"asset_no": "A", "department": "B", "product_key": "C"}


def commit(spark, **kw):
    g = lines(spark)
    old = spark.createDataFrame([("A", "OLD"), ("Z", "OLD")], "asset_no string, product_raw string")
    stored = spark.createDataFrame([], ASSET).unionByName(old, allowMissingColumns=True)
    header = spark.createDataFrame([(1, "S", 0)], "import_id bigint, sheet string, header_row int")
    return L.commit_assets(L.body_rows(g, header), MAP, stored, departments(spark, "D1"), **kw)


def test_policies(spark):
    out = commit(spark)
    got = {r.asset_no: r.product_raw for r in out["asset"].collect()}
    assert got == {"A": "Edge 2", "AUTO-1-4": "Edge", "D": "Edge 4", "E": None, "Z": "OLD"}
    warned = sorted((r.line, r.issue) for r in out["warnings"].collect())
    assert warned == [(2, "DUPLICATE_ASSET_NO"), (4, "MISSING_VERSION"), (5, "MISSING_DEPARTMENT"), (7, "MISSING_PRODUCT"), (7, "MISSING_VERSION")]
    strict = commit(spark, on_warning="reject", create_departments=False, mode="replace")
    assert {r.asset_no for r in strict["asset"].collect()} == {"A", "AUTO-1-4"}
    assert (6, "UNKNOWN_DEPARTMENT", "D9") in {(r.line, r.issue, r.value) for r in strict["warnings"].collect()}


def test_mapping_needs_department_and_product():
    with pytest.raises(ValueError, match="department"):
        L.specs_of({"product_key": "C"})


def test_saved_mapping(spark):
    rows = spark.createDataFrame(
        [("std", {"department": ("B", None, None, None), "product_key": ("C", None, None, "product"), "owner_name": ("D", ",", 1, None)})],
        "name string, mapping map<string, struct<col:string,sep:string,part:int,mode:string>>")
    specs = L.specs_of(L.saved_mapping(rows, "std"))
    assert (specs["department"].index, specs["product_key"].mode, specs["owner_name"].part) == (1, "product", 1)
    with pytest.raises(ValueError, match="no mapping"):
        L.saved_mapping(rows, "other")


def test_loaded_ledgers_have_keys(spark):
    from exposure.session import store

    dept = spark.createDataFrame([(3, "D1")], "department_id bigint, name string")
    stored = spark.createDataFrame([], ASSET).withColumns({"asset_id": F.lit(None).cast("bigint"), "department_id": F.lit(None).cast("bigint")})
    stored = stored.unionByName(spark.createDataFrame([("A", 9, 3)], "asset_no string, asset_id bigint, department_id bigint"), allowMissingColumns=True)
    header = spark.createDataFrame([(1, "S", 0)], "import_id bigint, sheet string, header_row int")
    out = L.commit_assets(L.body_rows(lines(spark), header), MAP, stored, dept)
    department = store(out["department"], "d")
    ids = {r.name: r.department_id for r in department.collect()}
    assert ids["D1"] == 3 and sorted(ids.values()) == list(range(3, 3 + len(ids)))
    got = {r.asset_no: r for r in store(L.with_keys(out["asset"], department), "a").collect()}
    assert got["A"].asset_id == 9 and len({r.asset_id for r in got.values()}) == len(got) and min(r.asset_id for r in got.values()) == 9
    assert {n: got[n].department_id for n in ("A", "D", "E")} == {"A": 3, "D": ids["D9"], "E": 3}
    # new ids follow the asset numbers without gaps, at every evaluation
    new = sorted(n for n in got if n != "A")
    assert [got[n].asset_id for n in new] == list(range(10, 10 + len(new)))
    assert {r.asset_no: r.asset_id for r in L.with_keys(out["asset"], out["department"]).collect()} == {n: r.asset_id for n, r in got.items()}


def test_dense_ids(spark):
    from exposure.operators.ranks import dense_ids

    keys = [(a, b) for a in (None, 1, 2) for b in (None, *"xyz")] + [(3, f"{i:04d}") for i in range(2000)]
    rows = spark.createDataFrame(keys, "a int, b string")
    want = {k: 8 + i for i, k in enumerate(sorted(keys, key=lambda k: tuple((x is not None, x) for x in k)))}
    for cut in (rows, rows.repartition(7, "b"), rows.coalesce(1)):
        got = dense_ids(cut, "id", ["a", "b"], 7)
        assert {(r.a, r.b): r.id for r in got.collect()} == want and got.columns == ["a", "b", "id"]
    assert dense_ids(rows.limit(0), "id", ["a"]).collect() == []
    assert {r.id for r in dense_ids(rows.withColumn("id", F.lit(None)), "id", ["a", "b"]).collect()} == set(range(1, len(keys) + 1))
