import hashlib
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from exposure.operators import products
from exposure.functions import grid, messages, product, severity, text
from exposure.functions.cve import canonical_cve_id, cve_year, extract_cves
from exposure.functions.deadlines import parse_date_any, pct, sla_status
from exposure.operators.advisories import extract_codes

CODE = re.compile(r"CVE[\s\-_]*(\d{4})[\s\-_]+(\d{4,7})", re.I)


def model(t):
    out = {}
    for m in CODE.finditer(t):
        code = f"CVE-{m[1]}-{m[2]}"
        out.setdefault(code, re.sub(r"\s+", " ", t[max(0, m.start() - 50):m.end() + 50]).strip())
    return list(out.items())


_piece = st.one_of(
    st.sampled_from(["CVE-2024-1234", "cve_2024_1234", "CVE 2021  44228", "CVE20190708 12345678", "cve", "CVE-", "-", "_", " ", "\n", "\t"]),
    st.text(alphabet="abc CVE-_0123456789\n한글", max_size=12),
)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(_piece, max_size=25).map("".join), min_size=20, max_size=40))
def test_extraction_equals_a_scan_of_the_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "advisory_id int, text string")
    got = {r.advisory_id: [(c.code, c.snippet) for c in r.c] for r in df.select("advisory_id", extract_cves("text").alias("c")).collect()}
    assert got == {i: model(t) for i, t in enumerate(texts)}
    table = {}
    for r in extract_codes(df).orderBy("advisory_id", "pos").collect():
        table.setdefault(r.advisory_id, []).append((r.cve_id_text, r.snippet))
    assert table == {i: m for i, m in got.items() if m}


def test_long_text_with_many_codes(spark):
    t = ", ".join(f"CVE-2020-{i % 9000 + 1000}" for i in range(30000))
    df = spark.createDataFrame([(1, t)], "advisory_id int, text string")
    assert extract_codes(df).count() == 9000
    assert df.select(F.size(extract_cves("text"))).first()[0] == 9000


def test_canonical_id_and_year(spark):
    df = spark.createDataFrame([("cve_2026_1234",), ("x CVE-1999-0001 y",), ("CWE-79",), (None,)], "s string")
    c = canonical_cve_id("s")
    assert [tuple(r) for r in df.select(c, cve_year(c)).collect()] == [
        ("CVE-2026-1234", 2026), ("CVE-1999-0001", 1999), (None, None), (None, None)]


def test_products(spark):
    cases = {
        "WINDOWS 11": ("windows_11", "WINDOWS 11", ""), "WINDOW 10 H23": ("windows_10", "WINDOW 10", "H23"),
        "UBUNTU 22": ("ubuntu", "UBUNTU", "22"), "Chrome 122.x": ("google_chrome", "Chrome", "122.x"),
        "Microsoft Edge (124)": ("edge", "Microsoft Edge", "124"), "Acme Tool v2 b": ("acme_tool_v2_b", "Acme Tool", "v2 b"),
        "2020 x": ("2020_x", "2020 x", "2020 x"), "plain": ("plain", "plain", ""), "": ("", "", ""),
        "한컴 오피스 2022": ("hancom_office", "한컴 오피스", "2022"), "!!!": ("", "!!!", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    got = {r.p: (r.k, r.s.product, r.s.version) for r in df.select(
        "p", product.normalize_product("p").alias("k"), product.split_product_version("p").alias("s")).collect()}
    assert got.pop(None) == ("", "", "")
    assert got == cases


def test_added_alias(spark):
    table = product.with_alias("acme_suite", " Acme Tool ")
    df = spark.createDataFrame([("My ACME tool 5",)], "p string")
    r = df.select(product.normalize_product("p", table).alias("k"), product.split_product_version("p", table).alias("s")).first()
    assert (r.k, tuple(r.s)) == ("acme_suite", ("My ACME tool", "5"))
    assert product.with_alias("edge", "edge") == product.with_alias("edge", " EDGE ")


def test_alias_rows_are_joined_and_decide_as_a_table_would(spark):
    """Longest alias first; equal lengths by the order of a table that the rows were added to by key and alias."""
    added = [("acme", " Acme Tool "), ("zeta", "acme"), ("beta", "tool"), ("alfa", "tool"), ("edge", "tool"), ("edge", "edge"), ("x", " "), (None, "acme tool 5"), ("acme", "acme tool")]
    table = None
    for key, alias in sorted((k, a) for k, a in added if k and a.strip()):
        table = product.with_alias(key, alias, table)
    texts = ["My ACME tool 5", "Tool 7", "  Acme 1", "MS Edge 12", "win10 tool", "acm", "", None, "Nothing known 3", "x" * 300 + "tool", "한글 2022", "Tool 7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    rows = spark.createDataFrame(added, "product_key string, alias string")
    got = products.with_known(df, F.col("p"), rows).select(
        "i", product.normalize_product("p", known=F.col("_known")).alias("k"), product.split_product_version("p", known=F.col("_known")).alias("s"))
    want = df.select("i", product.normalize_product("p", table).alias("k"), product.split_product_version("p", table).alias("s"))
    assert sorted(got.collect()) == sorted(want.collect())
    none = products.with_known(df, F.col("p"), rows.where("false"), builtin=False)
    assert none.where("_known IS NOT NULL").count() == 0 and none.count() == len(texts)


def test_severity(spark):
    df = spark.createDataFrame([("높음", "1"), ("critical", None), ("?", "9.0"), (None, "7"), ("", "x"), (None, None)], "t string, s string")
    assert [r[0] for r in df.select(severity.severity_from_any("t", "s")).collect()] == [
        "HIGH", "CRITICAL", "CRITICAL", "HIGH", "MEDIUM", "MEDIUM"]


def test_dates_percent_and_deadline(spark):
    df = spark.createDataFrame([("2024-01-05T10",), ("2024.1.5",), ("2024/01/05",), ("24-01-05",), ("2024-13-01",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(parse_date_any("d")).collect()] == ["2024-01-05"] * 3 + ["None"] * 3
    n = spark.createDataFrame([(1, 8), (3, 8), (1, 3), (0, 0)], "a int, b int")
    assert [r[0] for r in n.select(pct(F.col("a"), F.col("b"))).collect()] == [12, 38, 33, 0]
    due = spark.createDataFrame([("2024-01-09",), ("2024-01-13",), ("2024-01-14",), (None,)], "d string").select(F.to_date("d").alias("d"))
    assert [r[0] for r in due.select(sla_status("d", F.lit(False), "2024-01-10")).collect()] == ["OVERDUE", "IMMINENT", "NORMAL", "NORMAL"]


def test_letters_and_cells(spark):
    df = spark.range(18278).select(grid.letter_to_idx(grid.col_letter("id")).alias("i"), "id", grid.col_letter("id").alias("l"))
    assert df.where("i <> id").count() == 0
    assert {r.id: r.l for r in df.where("id in (0, 25, 26, 701, 702, 18277)").collect()} == {
        0: "A", 25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 18277: "ZZZ"}
    cells = spark.createDataFrame([(["good team, Kim, 010", "Windows 11 22H2", " ", None],)], "cells array<string>")

    def cell(spec):
        return cells.select(grid.resolve_cell("cells", grid.CellSpec.of(spec))).first()[0]

    assert cell({"col": "A", "sep": ",", "part": 1}) == "Kim"
    assert cell({"col": "A", "sep": ",", "part": 9}) is None
    assert cell({"col": "B", "mode": "version"}) == "22H2"
    assert cell({"col": "B", "mode": "product"}) == "Windows 11"
    assert (cell("C"), cell("D"), cell("Z"), cell("")) == (None, None, None, None)


def test_keys_and_messages(spark):
    one = spark.range(1)
    key = one.select(messages.idempotency_key(F.lit(5), F.lit(7), F.array(F.lit(3), F.lit(1)))).first()[0]
    assert key == hashlib.sha256(b"5:7:[1, 3]").hexdigest()
    body = one.select(messages.render_template(F.lit("{제목}/{문서번호}/{기한}/{부서}"), F.lit("T"), F.lit("D"), F.lit(None).cast("date"), F.lit("P"))).first()[0]
    assert body == "T/D//P"
    bad = one.select(messages.parse_ack(F.lit('{"department":"","status":"DONE"}'))).first()[0]
    assert bad is None


def test_search_wildcards_and_literals(spark):
    df = spark.createDataFrame([("100%",), ("100x",), (None,), ("a_b",)], "c string")
    assert df.where(text.ilike_any(["c"], "0%")).count() == 2
    assert df.where(text.contains_any(["c"], "0%")).count() == 1
    assert df.where(text.ilike_any(["c"], "a_b")).count() == 1
    assert df.where(text.ilike_any(["c"], "a\\b")).count() == 0
