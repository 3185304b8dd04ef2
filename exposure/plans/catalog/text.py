"""Code extraction from whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.functions.cve import extract_cves
from exposure.operators.advisories import (
    accepted, dup_documents, extract_codes, new_documents, rejected, validate_advisories,
)
from exposure.plans.catalog.registry import flat, query
from exposure.plans.demo import Views

_PATTERN = r"(?i)CVE[\s\-_]*(\d{4})[\s\-_]+(\d{4,7})"
_SPACE = r"[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def hits_sql(source: str, key: str) -> str:
    """First hit per (text, code) with its context, from running offsets."""
    return f"""
    WITH p AS (SELECT {key}, t, regexp_extract_all(t, '{_PATTERN}') AS hits, regexp_split_to_array(t, '{_PATTERN}') AS gaps
        FROM ({source})),
    u AS (SELECT {key}, t, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM p),
    o AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY {key} ORDER BY i) AS e,
        'CVE-' || regexp_extract(hit, '{_PATTERN}', 1) || '-' || regexp_extract(hit, '{_PATTERN}', 2) AS code FROM u),
    f AS (SELECT *, greatest(e - length(hit) - 50, 0) AS s FROM o
        QUALIFY row_number() OVER (PARTITION BY {key}, code ORDER BY i) = 1)
    SELECT {key}, code AS cve_id_text, i AS pos,
        trim(regexp_replace(substr(t, CAST(s + 1 AS BIGINT), CAST(e + 50 - s AS BIGINT)), '{_SPACE}', ' ', 'g')) AS snippet FROM f"""


# Codes put into the running prose of every document, several times and in several spellings.
MARKED_SQL = """SELECT doc_id, replace(replace(text, '. ', ' CVE_2024_' || (1000 + doc_id % 9000) || '. '),
    ', ', ' (cve 2019  ' || (20000 + doc_id) || '), CVE-2020-1472 ') AS t FROM documents"""


def marked(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id",
        F.expr(
            "replace(replace(text, '. ', concat(' CVE_2024_', 1000 + doc_id % 9000, '. ')),"
            " ', ', concat(' (cve 2019  ', 20000 + doc_id, '), CVE-2020-1472 '))"
        ).alias("text"),
    )


@query("extract_codes_documents", hits_sql(MARKED_SQL, "doc_id"))
def _(v: Views) -> DataFrame:
    return extract_codes(marked(v.table("documents")), "doc_id").select("doc_id", "cve_id_text", F.col("pos").cast("bigint").alias("pos"), "snippet")


@query("extract_cves_documents", f"""
    SELECT doc_id, string_agg(cve_id_text, '|' ORDER BY pos) AS codes FROM ({hits_sql(MARKED_SQL, 'doc_id')}) GROUP BY doc_id""")
def _(v: Views) -> DataFrame:
    codes = extract_cves("text")
    out = marked(v.table("documents")).select("doc_id", F.transform(codes, lambda c: c["code"]).alias("codes")).where(F.size("codes") > 0)
    return flat(out)


@query("extract_codes_advisories", hits_sql("SELECT advisory_id, text AS t FROM x_text", "advisory_id"))
def _(v: Views) -> DataFrame:
    return extract_codes(v.advisory_text).select(
        "advisory_id", "cve_id_text", F.col("pos").cast("bigint").alias("pos"), "snippet"
    )


@query("extract_conversations", hits_sql("""
    SELECT conv_id * 100 + turn AS id, replace(text, ' ', ' cve-2023-' || (1000 + conv_id * 100 + turn) || ' ') AS t FROM conversations""", "id"))
def _(v: Views) -> DataFrame:
    t = v.table("conversations").selectExpr(
        "conv_id * 100 + turn AS id", "replace(text, ' ', concat(' cve-2023-', 1000 + conv_id * 100 + turn, ' ')) AS text"
    )
    return extract_codes(t, "id").select("id", "cve_id_text", F.col("pos").cast("bigint").alias("pos"), "snippet")


def _uploads(v: Views) -> DataFrame:
    return v.table("documents").selectExpr(
        "doc_id", "sha2(text, 256) AS sha256", "doc_id % 50 = 0 AS force", "n_chars * 2000 AS size_bytes",
        "CASE WHEN doc_id % 6 = 0 THEN encode('PK34', 'utf-8') ELSE encode('%PDF-', 'utf-8') END AS head",
        "CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE source END AS source_org",
        "element_at(array('NCST', 'WEBMAIL', 'OFFICIAL_DOC', 'FAX'), CAST(doc_id % 4 + 1 AS INT)) AS receive_channel", "lang",
    )


@query("validate_advisories", """
    SELECT doc_id, CASE WHEN n_chars * 2000 > 31457280 THEN 'TOO_LARGE' WHEN doc_id % 6 = 0 THEN 'NOT_A_PDF'
        WHEN doc_id % 7 = 0 THEN 'SOURCE_ORG_REQUIRED' WHEN doc_id % 4 = 3 THEN 'BAD_CHANNEL' END AS reject_reason FROM documents""")
def _(v: Views) -> DataFrame:
    checked = validate_advisories(_uploads(v))
    return accepted(checked).select("doc_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejected(checked).select("doc_id", "reject_reason")
    )


@query("duplicate_documents", """
    SELECT d.doc_id, coalesce(s.first, CASE WHEN b.first <> d.doc_id THEN b.first END) AS duplicate_of
    FROM documents d LEFT JOIN (SELECT md5(text) AS h, min(doc_id) AS first FROM documents WHERE lang = 'en' GROUP BY 1) s ON s.h = md5(d.text)
    LEFT JOIN (SELECT md5(text) AS h, min(doc_id) AS first FROM documents WHERE lang <> 'en' GROUP BY 1) b ON b.h = md5(d.text)
    WHERE d.lang <> 'en'""")
def _(v: Views) -> DataFrame:
    u = _uploads(v)
    return dup_documents(u.where("lang <> 'en'"), u.where("lang = 'en'")).select("doc_id", "duplicate_of")


@query("new_documents", """
    SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)
    WHERE rn = 1 OR doc_id % 50 = 0""")
def _(v: Views) -> DataFrame:
    u = _uploads(v)
    return new_documents(dup_documents(u, u.where(F.lit(False)))).select("doc_id")
