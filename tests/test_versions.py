"""Version rules against a slow model written from the decision table."""

import itertools
import json
import re

from pyspark.sql import functions as F

from exposure.functions.version import (
    parse_version_rule, rule_from_text, rule_label, version_cmp, version_matches, version_ordinal, version_sort_key,
)

VERSIONS = [
    "23H2", "22h2 ", " 2021", "2019", "122.x", "124", "124.0.0", "DC 2021", "DC2019", "10.0.19045", "1.0", "1", "0", "n/a", "", None,
    "9" * 50 + ".1", "1" + "0" * 49, "1.10", "1.9", "v2", "１２",
]
RULES = [
    None, "*", "", "[]", '["*"]', '["23H2","22H2"]', '[" 122.X "]', '{"lt":"124"}', '{"lte":"124"}', '{"gt":"2019"}',
    '{"gte":"1.0.0"}', '{"eq":"1"}', '{"lt":"n/a"}', '{"range":["DC2019","DC2023"]}', '{"range":["1","n/a"]}',
    '{"range":["n/a","5"]}', '{"range":["1"],"gt":"3"}', '{"foo":"1"}', "{}", "17", '{"gte":"1","lt":"2"}', '{"lt":null}',
    '{"range":["1.9","1.10"]}', '{"lt":"' + "9" * 50 + '.2"}',
]


def numbers(v):
    s = (v or "").strip().translate(str.maketrans("０１２３４５６７８９", "0123456789"))
    if re.fullmatch(r"\d\d\s*[hH]\s*\d", s):
        return [2000 + int(s[:2]), int(s[-1])]
    year = re.search(r"(19|20)\d\d", s)
    if "dc" in s.lower() and year:
        return [int(year.group())]
    return [int(x) for x in re.findall(r"\d+", s)] or None


def compare(a, b):
    a, b = numbers(a), numbers(b)
    if a is None or b is None:
        return None
    width = max(len(a), len(b))
    a, b = a + [0] * (width - len(a)), b + [0] * (width - len(b))
    return (a > b) - (a < b)


def model(version, text):
    av = (version or "").strip()
    rule = "*" if text in (None, "", "*") else json.loads(text)
    if rule in ("*", [], ["*"]):
        return True, False
    if not av:
        return True, True
    if isinstance(rule, list):
        return av.lower() in [x.strip().lower() for x in rule], False
    if not isinstance(rule, dict):
        return True, True
    bounds = rule.get("range")
    if isinstance(bounds, list) and len(bounds) == 2:
        low = compare(av, bounds[0])
        if low is None:
            return True, True
        if low < 0:
            return False, False
        high = compare(av, bounds[1])
        return (True, True) if high is None else (high <= 0, False)
    for op, test in (("lt", (-1,)), ("lte", (-1, 0)), ("gt", (1,)), ("gte", (0, 1)), ("eq", (0,))):
        if op in rule:
            c = compare(av, rule[op])
            return (True, True) if c is None else (c in test, False)
    return True, True


def test_rules_follow_the_decision_table(spark):
    pairs = list(itertools.product(VERSIONS, RULES))
    df = spark.createDataFrame(pairs, "v string, rule string").withColumn("r", parse_version_rule("rule"))
    got = {(x.v, x.rule): (x.m.matched, x.m.candidate) for x in df.select("v", "rule", version_matches("v", "r").alias("m")).collect()}
    wrong = [(p, got[p], model(*p)) for p in pairs if got[p] != model(*p)]
    assert wrong == []


def test_sort_key_orders_like_padded_numbers(spark):
    pairs = list(itertools.product(VERSIONS, VERSIONS))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", version_cmp("a", "b").alias("c"))
    wrong = [(r.a, r.b, r.c) for r in df.collect() if r.c != compare(r.a, r.b)]
    assert wrong == []


def test_ordinals(spark):
    df = spark.createDataFrame([("23H2",), ("DC 2021",), ("10.0.19045",), ("n/a",)], "v string")
    got = [None if r[0] is None else [int(x) for x in r[0]] for r in df.select(version_ordinal("v")).collect()]
    assert got == [[2023, 2], [2021], [10, 0, 19045], None]
    assert df.where("v = 'n/a'").select(version_sort_key("v")).first()[0] is None


def test_rule_from_text_and_label(spark):
    df = spark.createDataFrame([("22H2; 23H2/1",), (" ",), ("*",), (None,)], "t string")
    got = [(r.kind, r["values"]) for r in df.select(rule_from_text("t").alias("r")).select("r.*").collect()]
    assert got == [("enum", ["22H2", "23H2", "1"]), ("any", None), ("any", None), ("any", None)]
    rules = spark.createDataFrame([('["a","b"]',), ('{"lt":"9"}',), ('{"gt":"9"}',)], "t string")
    labels = [r[0] for r in rules.select(rule_label(parse_version_rule("t"))).collect()]
    assert labels == ["a, b", "9 미만", "전체"]


def test_unknown_shapes_need_review(spark):
    df = spark.createDataFrame([("[1",), ("abc",), ("true",)], "t string")
    got = df.select(version_matches(F.lit("1"), parse_version_rule("t")).alias("m")).select("m.*").collect()
    assert all(r.matched and r.candidate for r in got)
