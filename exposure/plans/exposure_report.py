"""Which departments are exposed to which codes, and with how many assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.operators.matching import KIND, RULE, match_kinds
from exposure.operators.skew import hot_keys, sliced_join
from exposure.session import store


def department_exposure(
    advisory_cve: DataFrame, cve: DataFrame, asset: DataFrame, department: DataFrame
) -> DataFrame:
    """Per (department, code): affected assets, how many need review, and the severity.

    Assets are counted by kind and department, and departments by the rules of a code; a code comes to its departments last, in the
    join that makes the result, so no row per (code, asset) is made.
    """
    codes = advisory_cve.where("lookup_status = 'FOUND'").select("cve_id_text").distinct()
    named = cve.where("product_key <> '' AND version_rule IS NOT NULL").select(F.col("cve_id").alias("cve_id_text"), F.struct(*RULE).alias("rule"))
    # a code has one rule, or one for each of its rows
    ruled = named.join(codes, "cve_id_text", "left_semi").groupBy("cve_id_text").agg(F.sort_array(F.collect_list("rule")).alias("rules"))
    ruled = store(ruled, "ruled")
    sets = store(ruled.groupBy("rules").agg(F.count("*").alias("n")), "rule-sets")

    owned = asset.groupBy(F.struct(*KIND).alias("kind"), "department_id").agg(F.count("*").alias("n"))
    each = sets.select("rules", F.explode("rules").alias("rule"))
    hit = match_kinds(each.select("rule.*").distinct(), asset.select(*KIND).distinct())
    per_rule = hit.join(owned, "kind").groupBy("rule", "department_id").agg(
        F.sum("n").alias("assets"), F.sum(F.when(F.col("candidate"), F.col("n")).otherwise(0)).alias("to_review")
    )
    per_set = each.join(per_rule, "rule").groupBy("rules", "department_id").agg(
        F.sum("assets").alias("assets"), F.sum("to_review").alias("to_review")
    )
    per = per_set.join(department.select("department_id", F.col("name").alias("department")), "department_id", "left")
    severity = cve.select(F.col("cve_id").alias("cve_id_text"), "severity")
    rows = severity.join(ruled, "cve_id_text")
    return sliced_join(rows, store(per, "exposure"), ["rules"], F.col("cve_id_text"), hot_keys(sets, ["rules"])).select(
        "department_id", "department", "cve_id_text", "severity", "assets", "to_review"
    )
