"""Feed records: normalisation, counts, upsert into the CVE table, exports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.constants import MAX_STALE_DAYS
from exposure.functions.cve import canonical_cve_id, cve_year
from exposure.functions.deadlines import parse_date_any
from exposure.functions.nvd import cpe_version_rule, nvd_cpe_matches, nvd_cvss, nvd_description
from exposure.functions.product import cpe_product, normalize_product
from exposure.functions.severity import score_number, severity_from_any
from exposure.functions.text import as_col, blank_to_null, strip
from exposure.functions.version import any_rule, parse_version_rule, rule_from_text
from exposure.operators.advisories import unlock_advisories
from exposure.operators.products import KNOWN, with_known
from exposure.operators.skew import first_per
from exposure.operators.state import overlay, upsert
from exposure.schemas import CVE_RECORD_COLUMNS, RECORD_FIELDS

Aliases = Mapping[str, Sequence[str]] | DataFrame
PLACE = ("file_seq", "pos")


# --- normalisation -------------------------------------------------------------------------------
def _product_key(raw: DataFrame, name: Column, aliases: Aliases | None) -> tuple[DataFrame, Column]:
    if not isinstance(aliases, DataFrame):
        return raw, normalize_product(name, aliases)
    return with_known(raw, name, aliases), normalize_product(name, known=F.col(KNOWN))


def normalize_feed(raw: DataFrame, aliases: Aliases | None = None, zero_is_missing: bool = True) -> DataFrame:
    """Raw text records to CVE records; rows without a usable id are dropped.

    Other columns of ``raw`` (such as the place in the input) are kept. The class comes from the score as given, before it is
    rounded. A score of 0 is missing in JSON, where it is a number; in CSV, where it is text, it is kept (``zero_is_missing``).
    ``aliases`` is a small table, or a frame (product_key, alias) of any size that is joined and added to the built-in one.
    """
    have = set(raw.columns)

    def field(*names: str) -> Column:
        return F.coalesce(*[blank_to_null(c) for c in names if c in have], F.lit(None).cast("string"))

    def present(*names: str) -> Column:
        return F.coalesce(*[as_col(c) for c in names if c in have], F.lit(None).cast("string"))

    cve_id = canonical_cve_id(F.replace(field("cve_id", "id"), F.lit(" "), F.lit("-")))
    name = field("product_name", "product", "matchKey")
    versions = present("affected_versions", "versions")
    rule = F.when(versions.isNull(), any_rule()).when(
        strip(versions).rlike(r"^[\[{]"), parse_version_rule(versions)
    ).otherwise(rule_from_text(versions))
    cpe = field("cpe_list", "cpe")
    score = field("cvss_score", "cvss")
    given = score_number(score)
    exact = F.when(given != 0, given) if zero_is_missing else given
    number = exact.try_cast("decimal(3,1)")
    rest = [c for c in raw.columns if c not in RECORD_FIELDS]
    raw, key = _product_key(raw, name, aliases)
    return (
        raw.select(
            cve_id.alias("cve_id"),
            name.alias("product_name"),
            F.coalesce(field("product_key"), F.when(name.isNotNull(), key)).alias("product_key"),
            rule.alias("version_rule"),
            F.when(F.startswith(cpe, F.lit("[")), F.from_json(cpe, "array<string>"))
            .when(cpe.isNotNull(), F.array(cpe)).alias("cpe_list"),
            severity_from_any(field("severity"), exact).alias("severity"),
            number.alias("cvss_score"),
            field("description", "desc").alias("description"),
            parse_date_any(field("published_at", "published")).alias("published_at"),
            field("source").alias("source"),
            *rest,
        )
        .where("cve_id IS NOT NULL")
    )


def normalize_nvd(raw: DataFrame, aliases: Aliases | None = None) -> DataFrame:
    """NVD rows (``cve`` struct) to CVE records: first product, last usable version rule."""
    matches = nvd_cpe_matches("cve")
    rest = [c for c in raw.columns if c != "cve"]
    m = raw.select("*", matches.alias("_m"), nvd_cvss("cve").alias("_cvss"))
    rules = F.filter(F.transform("_m", cpe_version_rule), lambda r: r.isNotNull())
    names = F.filter(F.transform("_m", lambda x: cpe_product(x["criteria"])), lambda p: p.isNotNull())
    criteria = F.filter(F.transform("_m", lambda x: x["criteria"]), lambda c: F.coalesce(c, F.lit("")) != "")
    name = blank_to_null(F.get(names, F.lit(0)))
    score = F.when(F.col("_cvss.score") != 0, F.col("_cvss.score"))
    m, key = _product_key(m, name, aliases)
    return m.select(
        canonical_cve_id("cve.id").alias("cve_id"),
        name.alias("product_name"),
        F.when(name.isNotNull(), key).alias("product_key"),
        F.coalesce(F.try_element_at(rules, F.lit(-1)), any_rule()).alias("version_rule"),
        F.when(F.size(criteria) > 0, criteria).alias("cpe_list"),
        severity_from_any(F.col("_cvss.severity"), score).alias("severity"),
        score.try_cast("decimal(3,1)").alias("cvss_score"),
        blank_to_null(nvd_description("cve")).alias("description"),
        parse_date_any("cve.published").alias("published_at"),
        F.lit("NVD").alias("source"),
        *rest,
    ).where("cve_id IS NOT NULL")


def kev_to_records(entries: DataFrame) -> DataFrame:
    """Known-exploited catalogue entries to raw records; the catalogue has no score, so severity is HIGH."""
    both = F.concat(F.coalesce("vendorProject", F.lit("")), F.lit(" "), F.coalesce("product", F.lit("")))
    rest = [c for c in PLACE if c in entries.columns]
    return entries.select(
        F.col("cveID").alias("cve_id"), strip(both).alias("product_name"), F.lit("HIGH").alias("severity"),
        F.coalesce(blank_to_null("shortDescription"), F.col("vulnerabilityName")).alias("description"),
        F.col("dateAdded").alias("published"), F.lit("CISA-KEV").alias("source"), *rest,
    )


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Records of several files, years or formats together."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


# --- counts --------------------------------------------------------------------------------------
def last_wins(records: DataFrame, keys: Sequence[str] = ("cve_id",), place: Sequence[str] = PLACE) -> DataFrame:
    """One row per key: the one that comes last in the input."""
    return first_per(records, list(keys), *[F.col(c).desc() for c in place])


def split_new_updated(records: DataFrame, cve: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of unknown ids, and records of ids that exist."""
    ids = cve.select("cve_id")
    return records.join(ids, "cve_id", "left_anti"), records.join(ids, "cve_id", "left_semi")


def feed_counts(records: DataFrame, cve: DataFrame, place: Sequence[str] = PLACE) -> DataFrame:
    """Validation counts of an import: every record counts; plus the first source named in the input."""
    known = cve.select("cve_id", F.lit(True).alias("_known"))
    source = F.col("source")
    at = F.when(source.isNotNull(), F.struct(*place))
    return records.join(known, "cve_id", "left").agg(
        F.count_if(F.col("_known").isNull()).alias("added"),
        F.count_if(F.col("_known").isNotNull()).alias("updated"),
        F.min_by(source, at).alias("first_source"),
    )


def validate_feed(records: DataFrame) -> DataFrame:
    """One row: number of usable records and whether the feed is accepted (at least one)."""
    return records.agg(F.count("*").alias("records")).withColumn("accepted", F.col("records") > 0)


# --- upsert --------------------------------------------------------------------------------------
def upsert_cves(
    cve: DataFrame, records: DataFrame, at: Column, import_id: int | None = None, place: Sequence[str] = PLACE
) -> DataFrame:
    """Next CVE table with ``_action`` (added, updated, kept). Applying the same records again changes
    nothing but ``updated_at``.

    All data columns of a known id are overwritten, also with nulls; ``created_at`` stays.
    """
    changes = last_wins(records, place=place).select(
        *[c for c in CVE_RECORD_COLUMNS if c in records.columns],
        F.lit(import_id).cast("bigint").alias("feed_import_id"),
    )
    return upsert(
        cve, changes, ["cve_id"],
        on_update={"updated_at": at}, on_insert={"created_at": at, "updated_at": F.lit(None).cast("timestamp")},
    )


def apply_import(
    imports: DataFrame, import_id: int, cve: DataFrame, records: DataFrame, advisory: DataFrame,
    advisory_cve: DataFrame, at: Column,
) -> dict[str, DataFrame]:
    """Apply one validated import: next ``cve, advisory, advisory_cve, imports``. Refused when already applied.

    The import's own row is the only thing looked at on the driver.
    """
    state = imports.where(F.col("import_id") == import_id).select("status").first()
    if state is None:
        raise ValueError(f"unknown import {import_id}")
    if state["status"] == "APPLIED":
        raise ValueError(f"import {import_id} is already applied")
    marked = upsert_cves(cve, records, at, import_id)
    counts = marked.agg(
        F.count_if(F.col("_action") == "added").alias("added_count"),
        F.count_if(F.col("_action") == "updated").alias("updated_count"),
    ).select(F.lit(import_id).cast("bigint").alias("import_id"), "*")
    next_cve = marked.drop("_action")
    next_advisory, next_codes = unlock_advisories(advisory, advisory_cve, next_cve)
    next_imports = overlay(
        imports, counts, ["import_id"],
        {
            "status": F.lit("APPLIED"), "applied_at": at,
            "added_count": F.col("new_added_count"), "updated_count": F.col("new_updated_count"),
        },
    )
    return {"cve": next_cve, "advisory": next_advisory, "advisory_cve": next_codes, "imports": next_imports}


# --- local year feeds ------------------------------------------------------------------------------
def with_year(items: DataFrame, id_col: str = "cve_id") -> DataFrame:
    return items.withColumn("cve_year", cve_year(id_col))


def malformed_ids(items: DataFrame, id_col: str = "cve_id") -> DataFrame:
    """Rows whose id has no year; a feed with any of them is not merged."""
    return with_year(items, id_col).where("cve_year IS NULL")


def check_fresh(last_sync: dt.datetime, as_of: dt.datetime, max_stale_days: int = MAX_STALE_DAYS) -> None:
    """Changes can only be merged into a copy that was synchronised recently."""
    days = (as_of - last_sync).total_seconds() / 86400
    if days > max_stale_days:
        raise ValueError(f"local copy is {days:.1f} days old; a full synchronisation is needed")


def merge_modified_feed(
    local: DataFrame, modified: DataFrame, last_sync: dt.datetime, as_of: dt.datetime,
    last_sha256: str | None = None, sha256: str | None = None, max_stale_days: int = MAX_STALE_DAYS,
) -> DataFrame | None:
    """Rows of every year that the changes touch, with the changes merged in; null when nothing changed. A malformed id
    refuses the whole feed.

    ``local``: ``cve_id, cve_year, item``; ``modified``: ``cve_id, item`` and its place. Only the touched
    years come out, ready for a dynamic partition overwrite.
    """
    check_fresh(last_sync, as_of, max_stale_days)
    if sha256 is not None and sha256 == last_sha256:
        return None
    refused = F.raise_error(F.concat(F.lit("malformed id in the modified feed: "), F.coalesce("cve_id", F.lit("null")))).cast("int")
    marked = last_wins(with_year(modified)).withColumn("cve_year", F.coalesce("cve_year", refused))
    changes = marked.select("cve_id", "cve_year", "item")
    years = changes.select("cve_year").distinct()
    kept = local.join(years, "cve_year", "left_semi").join(changes, ["cve_year", "cve_id"], "left_anti")
    return kept.select("cve_id", "cve_year", "item").unionByName(changes)


def feed_digest(modified: DataFrame) -> str:
    """Digest of a feed's entries as they count (the last of each id), whatever their order and files: number, sum and
    exclusive or of two 64-bit hashes, so one aggregate and one row."""
    entries = last_wins(modified).select(F.xxhash64("cve_id", "item").alias("a"), F.xxhash64(F.lit(1), "item", "cve_id").alias("b"))
    n, total, mixed = entries.agg(F.count("*"), F.sum(F.col("a").cast("decimal(20,0)")), F.bit_xor("b")).first()
    return f"{n}:{total or 0}:{mixed or 0}"


def combined_total(local: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Entries per year of a combined export; years without any are absent."""
    return (
        local.where(F.col("cve_year").between(start_year, end_year))
        .groupBy("cve_year").agg(F.count("*").alias("entries"))
    )
