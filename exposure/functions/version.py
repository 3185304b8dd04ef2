"""Version strings and affected-version rules.

A version is compared through its *sort key*: the numbers in it, each written as a six-digit length
followed by its digits, joined by dots, with trailing zero numbers removed. Two keys compare as plain
strings exactly as the padded number tuples would, for numbers of any size, so comparisons stay
ordinary string predicates that Spark can hash, sort and push down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.functions.text import as_col, ascii_digits, let, strip

RULE_TYPE = "struct<kind:string,values:array<string>,op:string,lo:string,hi:string>"
RULE_OPERATORS = ("lt", "lte", "gt", "gte", "eq")
_ZERO = "000000"


def normalize_version(v: Column | str) -> Column:
    """Null becomes the empty string; surrounding white space goes."""
    return F.coalesce(strip(as_col(v).cast("string")), F.lit(""))


def _numbers(v: Column | str) -> Column:
    """Digit runs that make up a version; an empty array when there are none."""
    s = ascii_digits(normalize_version(v))
    half_year = r"(?i)^(\d{2})\s*h\s*(\d)$"
    year = F.regexp_extract(s, r"(19|20)\d{2}", 0)
    return (
        F.when(
            s.rlike(half_year),
            F.array(
                F.concat(F.lit("20"), F.regexp_extract(s, half_year, 1)),
                F.regexp_extract(s, half_year, 2),
            ),
        )
        .when(F.contains(F.lower(s), F.lit("dc")) & (year != ""), F.array(year))
        .otherwise(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)))
    )


def version_ordinal(v: Column | str) -> Column:
    """Numbers of a version as ``ARRAY<DECIMAL(38,0)>``; null when it holds no number."""
    nums = _numbers(v)
    return F.when(F.size(nums) > 0, F.transform(nums, lambda x: x.try_cast("decimal(38,0)")))


def version_sort_key(v: Column | str) -> Column:
    """Comparable key of a version; null when it holds no number."""

    def encode(x: Column) -> Column:
        digits = F.ltrim(x, F.lit("0"))
        return F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)

    joined = F.concat(F.lit("."), F.array_join(F.transform(_numbers(v), encode), "."))
    # "." alone means: no number at all
    return F.when(joined != ".", F.regexp_replace(joined, rf"(\.{_ZERO})+$", ""))


def version_cmp(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1; null when either side cannot be compared."""
    ka, kb = version_sort_key(a), version_sort_key(b)
    return F.when(ka < kb, -1).when(ka > kb, 1).when(ka == kb, 0)


def any_rule() -> Column:
    return rule_struct(F.lit("any"))


def rule_struct(
    kind: Column,
    values: Column | None = None,
    op: Column | None = None,
    lo: Column | None = None,
    hi: Column | None = None,
) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        kind.alias("kind"),
        (values if values is not None else F.lit(None).cast("array<string>")).alias("values"),
        (op if op is not None else null).alias("op"),
        (lo if lo is not None else null).alias("lo"),
        (hi if hi is not None else null).alias("hi"),
    )


def split_versions(s: Column | str) -> Column:
    """Cut a text at ``;`` ``,`` ``/``, trim, drop blanks. An empty list stands for any version."""
    parts = F.split(F.coalesce(as_col(s), F.lit("")), "[;,/]", -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def rule_from_values(values: Column) -> Column:
    """List of versions as a rule; an empty list, or one that holds only ``*``, means any version."""
    named = F.filter(values, lambda x: F.coalesce(x, F.lit("")) != "*")
    return F.when(F.coalesce(F.size(named), F.lit(0)) == 0, any_rule()).otherwise(
        rule_struct(F.lit("enum"), values=values)
    )


def rule_from_text(text: Column | str) -> Column:
    """Free text such as ``"22H2; 23H2"`` as a rule."""
    return rule_from_values(split_versions(text))


def parse_version_rule(raw: Column | str) -> Column:
    """JSON text of a rule to the canonical struct.

    Accepted: a list of versions, ``{"range":[lo,hi]}``, an object with one of lt/lte/gt/gte/eq, ``"*"``,
    empty or null. Anything else has the kind ``unknown``.
    """
    fields = ", ".join(f"{op} string" for op in RULE_OPERATORS)
    unknown = rule_struct(F.lit("unknown"))

    def from_list(items: Column) -> Column:
        return F.when(items.isNull(), unknown).otherwise(rule_from_values(items))

    def from_object(s: Column) -> Column:
        obj, bounds = s["obj"], s["obj"]["range"]
        op = F.coalesce(*[F.when(F.array_contains(s["keys"], k), F.lit(k)) for k in RULE_OPERATORS])

        def compare(o: Column) -> Column:
            value = F.coalesce(*[F.when(o == k, obj[k]) for k in RULE_OPERATORS])
            return F.when(o.isNull(), unknown).otherwise(rule_struct(F.lit("cmp"), op=o, lo=value))

        in_range = rule_struct(F.lit("range"), lo=F.get(bounds, F.lit(0)), hi=F.get(bounds, F.lit(1)))
        return F.when(F.size(bounds) == 2, in_range).otherwise(let(op, compare))

    def parse(text: Column) -> Column:
        bare = F.when(text.rlike(r'^".*"$'), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
        parsed = F.struct(
            F.from_json(text, f"range array<string>, {fields}").alias("obj"), F.json_object_keys(text).alias("keys")
        )
        return (
            F.when(text.isNull() | bare.isin("", "*"), any_rule())
            .when(F.startswith(text, F.lit("[")), let(F.from_json(text, "array<string>"), from_list))
            .when(F.startswith(text, F.lit("{")), let(parsed, from_object))
            .otherwise(unknown)
        )

    return let(strip(as_col(raw)), parse)


def rule_with_keys(rule: Column) -> Column:
    """Rule prepared for matching: lower-case values and sort keys of its bounds."""
    return F.struct(
        rule["kind"].alias("kind"),
        F.transform(rule["values"], lambda x: F.lower(normalize_version(x))).alias("values"),
        rule["op"].alias("op"),
        version_sort_key(rule["lo"]).alias("lo"),
        version_sort_key(rule["hi"]).alias("hi"),
    )


# Outcome of a decision.
NO, SURE, REVIEW = 0, 1, 2


def decide(version: Column, key: Column, rule: Column) -> Column:
    """Decision table over a normalised version, its sort key and a prepared rule: NO, SURE or REVIEW.

    A comparison that cannot be decided counts as a match that a person has to review.
    """
    kind, lo, hi, op = rule["kind"], rule["lo"], rule["hi"], rule["op"]
    compared = (
        F.when(op == "lt", key < lo).when(op == "lte", key <= lo)
        .when(op == "gt", key > lo).when(op == "gte", key >= lo).when(op == "eq", key == lo)
    )

    def sure_if(condition: Column) -> Column:
        return F.when(condition, SURE).otherwise(NO)

    return (
        F.when(kind.isNull() | (kind == "any"), SURE)
        .when((version == "") | (kind == "unknown"), REVIEW)
        .when(kind == "enum", sure_if(F.array_contains(rule["values"], F.lower(version))))
        .when(key.isNull() | lo.isNull(), REVIEW)
        .when(kind == "cmp", sure_if(compared))
        .when(key < lo, NO)
        .when(hi.isNull(), REVIEW)
        .otherwise(sure_if(key <= hi))
    )


def version_matches(version: Column | str, rule: Column | str) -> Column:
    """Does a version fall under a rule? ``STRUCT<matched BOOLEAN, candidate BOOLEAN>``."""
    v = normalize_version(version)
    code = let(
        F.struct(v.alias("v"), version_sort_key(v).alias("k"), rule_with_keys(as_col(rule)).alias("r")),
        lambda s: decide(s["v"], s["k"], s["r"]),
    )
    return let(code, lambda c: F.struct((c != NO).alias("matched"), (c == REVIEW).alias("candidate")))


def rule_label(rule: Column | str) -> Column:
    """Short text of a rule for reports: list of versions, ``<v> 미만``, else ``전체``."""
    r = as_col(rule)
    return (
        F.when(r["kind"] == "enum", F.array_join(r["values"], ", "))
        .when((r["kind"] == "cmp") & (r["op"] == "lt"), F.concat(F.coalesce(r["lo"], F.lit("")), F.lit(" 미만")))
        .otherwise(F.lit("전체"))
    )
