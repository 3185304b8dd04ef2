"""Advisory documents: intake checks, code extraction, manual corrections, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.constants import MANUAL_SNIPPET, MAX_UPLOAD_BYTES, RECEIVE_CHANNELS
from exposure.functions.cve import canonical_cve_id, cve_mentions
from exposure.functions.text import is_blank
from exposure.operators.matching import cascade_delete, gate, lookup_cves
from exposure.operators.skew import first_per


def validate_advisories(docs: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add ``reject_reason`` (null for a document that passes).

    Needs ``size_bytes, head`` (first bytes), ``source_org, receive_channel``.
    """
    reason = (
        F.when(F.col("size_bytes") > max_bytes, "TOO_LARGE")
        .when(~F.coalesce(F.startswith(F.col("head"), F.lit(b"%PDF")), F.lit(False)), "NOT_A_PDF")
        .when(is_blank("source_org"), "SOURCE_ORG_REQUIRED")
        .when(~F.coalesce(F.col("receive_channel").isin(*RECEIVE_CHANNELS), F.lit(False)), "BAD_CHANNEL")
    )
    return docs.withColumn("reject_reason", reason)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("reject_reason IS NULL").drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where("reject_reason IS NOT NULL")


def dup_documents(new: DataFrame, existing: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """New documents with the id of the earliest document of the same content (``duplicate_of``).

    Earlier means already stored, else a smaller id in the same batch. Rows with ``force`` go through.
    Needs ``sha256`` on both sides.
    """
    stored = existing.groupBy("sha256").agg(F.min(id_col).alias("_stored"))
    in_batch = new.groupBy("sha256").agg(F.min(id_col).alias("_first"))
    dup = F.coalesce(F.col("_stored"), F.when(F.col("_first") != F.col(id_col), F.col("_first")))
    out = new.join(stored, "sha256", "left").join(in_batch, "sha256", "left")
    return out.select(*new.columns, dup.alias("duplicate_of"))


def new_documents(checked: DataFrame) -> DataFrame:
    """Documents to take in: no duplicate, or forced."""
    force = F.coalesce(F.col("force"), F.lit(False)) if "force" in checked.columns else F.lit(False)
    return checked.where(F.col("duplicate_of").isNull() | force).drop("duplicate_of")


def extract_codes(docs: DataFrame, id_col: str = "advisory_id") -> DataFrame:
    """Distinct codes per document, one row each, first occurrence kept.

    Hits are exploded before repeats are removed, so a long document never becomes one large value.
    """
    hits = docs.select(id_col, F.explode(cve_mentions("text")).alias("m")).select(id_col, "m.*")
    return first_seen(hits, id_col)


def first_seen(hits: DataFrame, id_col: str = "advisory_id") -> DataFrame:
    """First occurrence of each code in a document."""
    kept = first_per(hits, [id_col, "code"], F.col("pos"))
    return kept.select(id_col, F.col("code").alias("cve_id_text"), "confidence", "snippet", "pos")


def reextract(
    advisory: DataFrame, advisory_cve: DataFrame, matches: DataFrame, docs: DataFrame, cve: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extract again for the advisories in ``docs``: all their codes and matches are replaced.

    Returns the next advisory, advisory_cve and match tables.
    """
    todo = docs.select("advisory_id").distinct()
    fresh = lookup_cves(extract_codes(docs).drop("pos"), cve)
    kept = advisory_cve.join(todo, "advisory_id", "left_anti")
    next_cve = kept.unionByName(fresh.select(*advisory_cve.columns))
    dropped = advisory_cve.join(todo, "advisory_id", "left_semi")
    missing = fresh.groupBy("advisory_id").agg(F.bool_or(F.col("lookup_status") == "NOT_FOUND").alias("_missing"))
    status = F.when(F.coalesce("_missing", F.lit(False)), "NEEDS_CVE_UPDATE").otherwise("EXTRACTED")
    next_advisory = (
        advisory.join(todo.withColumn("_todo", F.lit(True)), "advisory_id", "left")
        .join(missing, "advisory_id", "left")
        .withColumn("status", F.when(F.col("_todo"), status).otherwise(F.col("status")))
        .select(*advisory.columns)
    )
    return next_advisory, next_cve, cascade_delete(matches, dropped)


def manual_codes(requests: DataFrame) -> DataFrame:
    """Typed codes in canonical form; ``cve_id_text`` is null for unusable input."""
    return requests.withColumn("cve_id_text", canonical_cve_id("raw"))


def add_codes(advisory_cve: DataFrame, requests: DataFrame, cve: DataFrame) -> DataFrame:
    """Add typed codes; unusable and already present ones are refused."""
    wanted = (
        manual_codes(requests).where("cve_id_text IS NOT NULL")
        .select("advisory_id", "cve_id_text").distinct()
        .join(advisory_cve, ["advisory_id", "cve_id_text"], "left_anti")
    )
    rows = lookup_cves(wanted, cve).withColumns(
        {"confidence": F.lit(None).cast("decimal(3,2)"), "snippet": F.lit(MANUAL_SNIPPET)}
    )
    return advisory_cve.unionByName(rows.select(*advisory_cve.columns))


def remove_codes(advisory_cve: DataFrame, removed: DataFrame) -> DataFrame:
    return advisory_cve.join(removed, ["advisory_id", "cve_id_text"], "left_anti")


def reevaluate_status(advisory: DataFrame, advisory_cve: DataFrame, touched: DataFrame) -> DataFrame:
    """Status of the touched advisories after their codes changed."""
    codes = advisory_cve.groupBy("advisory_id").agg(
        F.bool_or(F.col("lookup_status") == "NOT_FOUND").alias("_missing")
    )
    reopened = F.col("status").isin("NEEDS_CVE_UPDATE", "UPLOADED", "EXTRACTING")
    status = (
        F.when(F.col("_missing").isNull(), "UPLOADED")
        .when(F.col("_missing"), "NEEDS_CVE_UPDATE")
        .when(reopened, "EXTRACTED")
        .otherwise(F.col("status"))
    )
    mark = touched.select("advisory_id").distinct().withColumn("_touched", F.lit(True))
    return (
        advisory.join(mark, "advisory_id", "left")
        .join(codes, "advisory_id", "left")
        .withColumn("status", F.when(F.col("_touched"), status).otherwise(F.col("status")))
        .select(*advisory.columns)
    )


def unlock_advisories(
    advisory: DataFrame, advisory_cve: DataFrame, cve: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Look up missing codes again; waiting advisories with every code found become EXTRACTED.

    Returns the next advisory (with ``unlocked`` BOOLEAN) and advisory_cve tables.
    """
    cols = [c for c in advisory_cve.columns if c != "lookup_status"]
    before = advisory_cve.select(*cols, F.col("lookup_status").alias("_before"))
    looked = lookup_cves(before, cve)
    now = F.when(F.col("_before") == "FOUND", "FOUND").otherwise(F.col("lookup_status"))
    resolved = (F.col("_before") == "NOT_FOUND") & (F.col("lookup_status") == "FOUND")
    marked = looked.withColumns({"lookup_status": now, "_resolved": resolved})
    state = marked.groupBy("advisory_id").agg(
        F.bool_or("_resolved").alias("_touched"),
        F.bool_and(F.col("lookup_status") == "FOUND").alias("_all"),
    )
    unlocked = F.coalesce(
        (F.col("status") == "NEEDS_CVE_UPDATE") & F.col("_touched") & F.col("_all"), F.lit(False)
    )
    next_advisory = (
        advisory.join(state, "advisory_id", "left")
        .withColumn("unlocked", unlocked)
        .withColumn("status", F.when(F.col("unlocked"), "EXTRACTED").otherwise(F.col("status")))
        .select(*advisory.columns, "unlocked")
    )
    return next_advisory, marked.select(*advisory_cve.columns)


def ready_for_matching(advisory: DataFrame, advisory_cve: DataFrame) -> DataFrame:
    """Advisories that may be matched, or the reason why not (``blocked``)."""
    g = gate(advisory, advisory_cve)
    blocked = (
        F.when(F.col("status") == "EXTRACTING", "EXTRACTING")
        .when(~F.col("can_proceed"), "NEEDS_CVE_UPDATE")
    )
    return advisory.join(g, "advisory_id").select("advisory_id", "status", blocked.alias("blocked"))
