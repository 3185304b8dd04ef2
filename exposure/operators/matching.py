"""Codes against the CVE table, CVEs against assets, and the state of the resulting matches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions.version import NO, SURE, decide, normalize_version, rule_with_keys, version_sort_key
from exposure.operators.skew import first_per, hot_keys, sliced_join
from exposure.operators.state import overlay, upsert
from exposure.session import store

MATCH_KEY = ["advisory_id", "cve_id_text", "asset_id"]
# What decides whether a code affects an asset: of its CVE, and of the asset.
RULE = ["product_key", "version_rule"]
KIND = ["product_key", "version_norm", "version_raw", "status"]
# Pairs of rule and version that one slice of a product judges; products with more are cut.
PAIRS_PER_SLICE = 2_000_000


# --- codes and gate ------------------------------------------------------------------------------
def lookup_cves(codes: DataFrame, cve: DataFrame) -> DataFrame:
    """Mark each code FOUND or NOT_FOUND."""
    known = cve.select(F.col("cve_id").alias("cve_id_text"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known"), "FOUND").otherwise("NOT_FOUND")
    return codes.join(known, "cve_id_text", "left").select(*codes.columns, status.alias("lookup_status"))


def resolve_pending(advisory_cve: DataFrame, cve: DataFrame) -> DataFrame:
    """Codes that were not found before and exist now."""
    pending = advisory_cve.where("lookup_status = 'NOT_FOUND'")
    return pending.join(cve.select(F.col("cve_id").alias("cve_id_text")), "cve_id_text", "left_semi").select(
        *advisory_cve.columns
    )


def cve_summary(advisory_cve: DataFrame) -> DataFrame:
    """Per advisory: extracted, found and missing codes."""
    return advisory_cve.groupBy("advisory_id").agg(
        F.count("*").alias("extracted"),
        F.count_if(F.col("lookup_status") == "FOUND").alias("found"),
        F.count_if(F.col("lookup_status") != "FOUND").alias("not_found"),
    )


def gate(advisory: DataFrame, advisory_cve: DataFrame) -> DataFrame:
    """Per advisory: may it proceed? It needs at least one code and all of them found."""
    open_gate = advisory_cve.groupBy("advisory_id").agg(
        F.bool_and(F.col("lookup_status") == "FOUND").alias("can_proceed")
    )
    return advisory.select("advisory_id").join(open_gate, "advisory_id", "left").select(
        "advisory_id", F.coalesce("can_proceed", F.lit(False)).alias("can_proceed")
    )


# --- core join -----------------------------------------------------------------------------------
def rule_verdicts(rules: DataFrame, profiles: DataFrame, pairs: int = PAIRS_PER_SLICE) -> DataFrame:
    """Judge distinct rules against distinct asset versions of the same product; only pairs that match come out.

    Both sides hold distinct values only, so the rule logic runs once per (rule, version) rather than once per (CVE, asset).
    A list of versions can only match a version it names, or one without text: those rules meet their versions by an equi-join on
    product and version text. The other kinds match whole ranges, so most of their pairs are results; a product's versions
    are cut into slices by the number of its pairs.
    """
    # the rule is prepared below the explode, once per rule
    prepared = rules.select("product_key", "version_rule", rule_with_keys(F.col("version_rule")).alias("r"))
    versions = profiles.select(
        "product_key", "v_norm", "v_raw",
        version_sort_key("v_norm").alias("k_norm"), version_sort_key("v_raw").alias("k_raw"),
    )
    named = F.coalesce(F.col("r.kind") == "enum", F.lit(False))

    texts = F.array_compact(F.array_distinct(F.concat(F.coalesce("r.values", F.array().cast("array<string>")), F.array(F.lit("")))))
    listed = prepared.where(named).withColumn("_text", F.explode(texts))
    own = F.array_compact(F.array_distinct(F.array(F.lower("v_norm"), F.lower("v_raw"))))
    by_text = versions.withColumn("_text", F.explode(own))
    # a rule and a version may meet by both texts of the version
    met = listed.join(by_text, ["product_key", "_text"]).drop("_text").dropDuplicates(
        ["product_key", "version_rule", "v_norm", "v_raw"]
    )

    ranges = prepared.where(~named)
    rule_n = ranges.groupBy("product_key").agg(F.count("*").alias("_rules"))
    version_n = versions.groupBy("product_key").agg(F.count("*").alias("_versions"))
    cut = rule_n.join(version_n, "product_key").select(
        "product_key", F.ceil(F.col("_rules") * F.col("_versions") / pairs).cast("int").alias("_slices")
    ).where("_slices > 1")
    n = F.coalesce("_slices", F.lit(1))
    rule_side = ranges.join(cut, "product_key", "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), n - 1)))
    version_side = versions.join(cut, "product_key", "left").withColumn(
        "_slice", F.pmod(F.xxhash64("v_norm", "v_raw"), n).cast("int")
    )
    ranged = rule_side.drop("_slices").join(version_side.drop("_slices"), ["product_key", "_slice"]).drop("_slice")

    by_norm = decide(F.col("v_norm"), F.col("k_norm"), F.col("r"))
    by_raw = decide(F.col("v_raw"), F.col("k_raw"), F.col("r"))
    # either text may match, and the match is sure if either is sure
    verdict = F.when((by_norm == SURE) | (by_raw == SURE), SURE).otherwise(F.greatest(by_norm, by_raw))
    return (
        met.unionByName(ranged)
        .withColumn("verdict", verdict)
        .where(F.col("verdict") != NO)
        .select("product_key", "version_rule", "v_norm", "v_raw", (F.col("verdict") != SURE).alias("candidate"))
    )


def match_assets(advisory_cve: DataFrame, cve: DataFrame, asset: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Found codes to the assets they affect: ``advisory_id, cve_id_text, asset_id, department_id, reason``.

    With ``known``, exclusion rules, the result is that of :func:`flag_suggested` on it; assets are then flagged once per code, before
    they are expanded to advisories.

    1. mentions per code and assets per distinct (product, version) are counted first;
    2. rules are judged on those distinct values (:func:`rule_verdicts`);
    3. the verdicts are expanded to assets, then to advisories. Both steps are plain equi-joins that emit
       result rows only; keys that hold a large share of the rows, or very many, are cut into slices, using the counts
       of step 1: profiles by their assets, CVEs by their mentions and by the assets they affect.
    """
    codes = advisory_cve.where("lookup_status = 'FOUND'").select("advisory_id", "cve_id_text")
    mentions = codes.groupBy("cve_id_text").agg(F.count("*").alias("n"))
    named = (
        cve.where("product_key <> ''")
        .select(F.col("cve_id").alias("cve_id_text"), "product_key", "version_rule")
        .join(mentions.select("cve_id_text"), "cve_id_text")
    )
    live = asset.where("status <> 'RETIRED' AND product_key <> ''").select(
        "asset_id", "department_id", "product_key", "version_norm", "version_raw",
        normalize_version("version_norm").alias("v_norm"), normalize_version("version_raw").alias("v_raw"),
    )
    profile = ["product_key", "v_norm", "v_raw"]
    profiles = live.groupBy(*profile).agg(F.count("*").alias("n"))
    rules = named.select("product_key", "version_rule").distinct()

    # counted and then joined: written once, as the verdicts are the dear part
    affected = store(named.join(rule_verdicts(rules, profiles), ["product_key", "version_rule"]), "affected")
    exposed = sliced_join(live, affected, profile, F.col("asset_id"), hot_keys(profiles, profile)).select(
        "cve_id_text", "asset_id", "department_id",
        F.struct(
            "product_key", "version_rule",
            F.col("version_norm").alias("asset_version"), F.col("version_raw").alias("asset_version_raw"),
            "candidate", F.lit(False).alias("suggested_exclude"),
        ).alias("reason"),
    )
    if known is not None:
        exposed = flag_suggested(exposed, known)
    hot_codes = hot_keys(mentions, ["cve_id_text"])
    reach = affected.join(profiles, profile).groupBy("cve_id_text").agg(F.sum("n").alias("n"))
    hot_reach = hot_keys(reach, ["cve_id_text"], share=1.0)
    if hot_reach.isEmpty():  # a choice of plan only: no CVE reaches more assets than a slice holds
        hot_reach = None
    return sliced_join(
        codes, exposed, ["cve_id_text"], F.col("advisory_id"), hot_codes, F.col("asset_id"), hot_reach
    ).select(
        *MATCH_KEY, "department_id", "reason"
    )


def match_kinds(rules: DataFrame, kinds: DataFrame) -> DataFrame:
    """:func:`match_assets` over distinct rules and distinct kinds of assets, for results that do not name single pairs:
    ``rule, kind, candidate``, the first two being structs of :data:`RULE` and :data:`KIND`.

    Codes with the same rule affect the same assets, and assets of the same kind are affected by the same codes, so the pairs do not
    grow with the CVEs nor with the assets; whoever calls expands them by both numbers.
    """
    cve = rules.select(F.struct(*RULE).alias("cve_id"), *RULE)
    codes = cve.select(F.lit(0).alias("advisory_id"), F.col("cve_id").alias("cve_id_text"), F.lit("FOUND").alias("lookup_status"))
    asset = kinds.select(F.struct(*KIND).alias("asset_id"), F.lit(None).cast("bigint").alias("department_id"), *KIND)
    return match_assets(codes, cve, asset).select(
        F.col("cve_id_text").alias("rule"), F.col("asset_id").alias("kind"), "reason.candidate"
    )


def asset_hits(advisory_cve: DataFrame, cve: DataFrame, asset: DataFrame) -> DataFrame:
    """Per affected asset: rows of :func:`match_assets`, and candidates among them; no row per match is made."""
    mentions = advisory_cve.where("lookup_status = 'FOUND'").groupBy("cve_id_text").agg(F.count("*").alias("n"))
    named = cve.where("product_key <> '' AND version_rule IS NOT NULL").select(F.col("cve_id").alias("cve_id_text"), *RULE)
    weights = store(named.join(mentions, "cve_id_text").groupBy(*RULE).agg(F.sum("n").alias("n")), "rules")
    kinds = store(asset.groupBy(*KIND).agg(F.count("*").alias("n")), "kinds")
    per_kind = (
        match_kinds(weights.select(*RULE), kinds)
        .join(weights.select(F.struct(*RULE).alias("rule"), "n"), "rule")
        .groupBy("kind").agg(F.sum("n").alias("_matches"), F.sum(F.when(F.col("candidate"), F.col("n")).otherwise(0)).alias("_candidates"))
    )
    hot = hot_keys(kinds.select(F.struct(*KIND).alias("kind"), "n"), ["kind"])
    own = asset.select("asset_id", F.struct(*KIND).alias("kind"))
    return sliced_join(own, store(per_kind, "hits"), ["kind"], F.col("asset_id"), hot).groupBy("asset_id").agg(
        F.sum("_matches").alias("matches"), F.sum("_candidates").alias("candidates")
    )


def flag_suggested(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Set ``reason.suggested_exclude`` where the same asset and product were excluded before."""
    known = rules.where("is_active").select(
        "asset_id", F.col("product_key").alias("_pk"), F.lit(True).alias("_known")
    )
    m = matches.withColumn("_pk", F.col("reason.product_key")).join(known, ["asset_id", "_pk"], "left")
    flagged = F.col("reason").withField("suggested_exclude", F.coalesce("_known", F.lit(False)))
    return m.withColumn("reason", flagged).select(*matches.columns)


def merge_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Result of a run into the stored matches: reasons refreshed, status and replies kept, nothing removed.

    The extra column ``touched`` marks the rows this run produced.
    """
    keys = MATCH_KEY
    # columns side by side, not as one value, so that only those that are asked for are dealt out
    o = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in old.columns if c not in keys], F.lit(True).alias("_stored"))
    n = new.select(*keys, F.col("reason").alias("_new_reason"), F.lit(True).alias("_touched"))

    def column(c: str) -> Column:
        if c in keys:
            return F.col(c)
        kept = F.col(f"_{c}")
        if c == "reason":
            return F.coalesce("_new_reason", kept).alias(c)
        if c in ("status", "ack_status"):
            first = "MATCHED" if c == "status" else "NONE"
            return F.when(F.col("_stored").isNull(), F.lit(first)).otherwise(kept).alias(c)
        return kept.alias(c)

    return o.join(n, keys, "full_outer").select(
        *[column(c) for c in old.columns], F.coalesce("_touched", F.lit(False)).alias("touched")
    )


def with_reason(matches: DataFrame, *fields: str) -> DataFrame:
    """Matches whose reason holds some fields only, for results that read no others."""
    reason = F.struct(*[F.col(f"reason.{f}").alias(f) for f in fields])
    return matches.withColumn("reason", F.when(F.col("reason").isNotNull(), reason))


# --- counts --------------------------------------------------------------------------------------
def match_run_stats(merged: DataFrame, asset: DataFrame) -> DataFrame:
    """Per advisory, over the rows of one run: active, departments, candidates (also excluded), suggested."""
    rows = merged.where("touched").join(asset.select("asset_id", "department_id"), "asset_id")
    per = rows.groupBy("advisory_id", "department_id").agg(
        F.count_if(F.col("status") == "MATCHED").alias("matched"),
        F.count_if(F.col("reason.candidate")).alias("candidates"),
        F.count_if(F.col("reason.suggested_exclude")).alias("suggested_exclude"),
    )
    return per.groupBy("advisory_id").agg(
        F.sum("matched").alias("matched"),
        F.count_if((F.col("matched") > 0) & F.col("department_id").isNotNull()).alias("departments"),
        F.sum("candidates").alias("candidates"),
        F.sum("suggested_exclude").alias("suggested_exclude"),
    )


def match_summary(matches: DataFrame, asset: DataFrame) -> DataFrame:
    """Per advisory: total, active, excluded, departments and candidates among the active ones.

    Counted per (advisory, department) first, so that departments need no distinct aggregate.
    """
    active = F.col("status") == "MATCHED"
    per = (
        matches.join(asset.select("asset_id", "department_id"), "asset_id")
        .groupBy("advisory_id", "department_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(active).alias("active"),
            F.count_if(active & F.col("reason.candidate")).alias("candidates"),
        )
    )
    return per.groupBy("advisory_id").agg(
        F.sum("total").alias("total"),
        F.sum("active").alias("active"),
        F.sum(F.col("total") - F.col("active")).alias("excluded"),
        F.count_if((F.col("active") > 0) & F.col("department_id").isNotNull()).alias("departments"),
        F.sum("candidates").alias("candidates"),
    )


def match_count_per_cve(matches: DataFrame) -> DataFrame:
    return (
        matches.where("status = 'MATCHED'")
        .groupBy("advisory_id", "cve_id_text")
        .agg(F.count("*").alias("match_count"))
    )


def active_matches(matches: DataFrame, asset: DataFrame, department_id: int | None = None) -> DataFrame:
    """Matches that are not excluded and whose asset exists, with the asset's columns."""
    live = asset if department_id is None else asset.where(F.col("department_id") == department_id)
    cols = [c for c in live.columns if c == "asset_id" or c not in (*matches.columns, "status")]
    return matches.where("status = 'MATCHED'").join(
        live.select(*cols, F.col("status").alias("asset_status")), "asset_id"
    )


# --- analyst decisions ----------------------------------------------------------------------------
def set_match_status(matches: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """Exclude or restore matches; the last change per match wins.

    ``changes``: match key, ``status`` and ``reason`` of the analyst, ``actor``, ``seq``.
    """
    last = first_per(changes, MATCH_KEY, F.col(order).desc()).select(
        *MATCH_KEY, "status", F.col("reason").alias("why"), "actor"
    )
    excluded = F.col("new_status") == "EXCLUDED"
    updates = {"status": F.col("new_status"), "excluded_reason": F.when(excluded, F.col("new_why"))}
    if "excluded_by" in matches.columns:
        updates["excluded_by"] = F.when(excluded, F.col("new_actor"))
    return overlay(matches, last, MATCH_KEY, updates)


def remember_exclusions(rules: DataFrame, excluded: DataFrame, order: str = "seq") -> DataFrame:
    """Upsert active rules for excluded (asset, product) pairs; an empty new reason keeps the old one.

    The reason that counts is the last one given that is not empty.
    """
    usable = excluded.where("coalesce(product_key, '') <> ''")
    said = F.nullif(F.col("reason"), F.lit(""))
    new = usable.groupBy("asset_id", "product_key").agg(
        F.max_by(said, F.when(said.isNotNull(), F.col(order))).alias("reason"),
        F.lit(True).alias("is_active"),
    )
    return upsert(
        rules, new, ["asset_id", "product_key"],
        on_update={"reason": F.coalesce(F.col("_new.reason"), F.col("_old.reason"))},
    ).drop("_action")


def forget_exclusions(rules: DataFrame, restored: DataFrame) -> DataFrame:
    """Deactivate the rules of restored (asset, product) pairs."""
    pairs = restored.select("asset_id", "product_key").distinct()
    return overlay(rules, pairs, ["asset_id", "product_key"], {"is_active": F.lit(False)})


def active_rules(rules: DataFrame, asset: DataFrame) -> DataFrame:
    return rules.where("is_active").join(asset.select("asset_id", "asset_no"), "asset_id", "left")


def cascade_delete(matches: DataFrame, removed_codes: DataFrame) -> DataFrame:
    """Drop the matches of removed (advisory, code) links."""
    return matches.join(removed_codes.select("advisory_id", "cve_id_text"), ["advisory_id", "cve_id_text"], "left_anti")


def attach_labels(df: DataFrame, dim: DataFrame, on: str, label: str, default: Column | None = None) -> DataFrame:
    """Add a display label from a dimension; ``default`` when the key is unknown."""
    out = df.join(dim.select(on, label), on, "left")
    return out if default is None else out.withColumn(label, F.coalesce(F.col(label), default))


def stamp(at: dt.datetime | str | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(str(at)).cast("timestamp")
