"""CVE identifiers: extraction from text, canonical form, year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.constants import CVE_PATTERN, SNIPPET_CONTEXT
from exposure.functions.text import as_col, ascii_digits, let, strip

# A code is at least 12 characters long, so the 50 characters of context on one side can touch at
# most 5 neighbouring codes and the text between them: 10 pieces are always enough.
_NEIGHBOURS = 10
_MARK = "\u0001"
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def canonical_cve_id(raw: Column | str) -> Column:
    """First code found in a raw field as ``CVE-<year>-<serial>``; null when there is none."""
    text = ascii_digits(raw)
    year = F.regexp_extract(text, CVE_PATTERN, 1)
    return F.when(
        year != "", F.concat(F.lit("CVE-"), year, F.lit("-"), F.regexp_extract(text, CVE_PATTERN, 2))
    )


def cve_year(cve_id: Column | str) -> Column:
    """Year part of a well-formed id; null for a malformed one (callers quarantine those rows)."""
    return F.regexp_extract(as_col(cve_id), r"^(?i)CVE-(\d{4})-", 1).try_cast("int")


def cve_mentions(text: Column | str) -> Column:
    """Every code in a text, in order: ``ARRAY<STRUCT<pos,code,snippet,confidence>>``.

    The text is cut at each hit, so odd pieces are codes and even pieces the text between them.
    The context of a hit is read from its neighbouring pieces, which keeps the work linear in the
    length of the text however many codes it holds.
    """
    clean = F.translate(ascii_digits(F.coalesce(as_col(text), F.lit(""))), _MARK, " ")
    pieces = F.split(F.regexp_replace(clean, CVE_PATTERN, _MARK + "$0" + _MARK), _MARK, -1)

    def mentions(parts: Column) -> Column:
        def one(k: Column) -> Column:
            at = k * 2  # 1-based position of the k-th code among the pieces
            first = F.greatest(at - _NEIGHBOURS, F.lit(1))
            hit = F.get(parts, at - 1)
            before = F.right(F.array_join(F.slice(parts, first, at - first), ""), F.lit(SNIPPET_CONTEXT))
            after = F.left(
                F.array_join(F.slice(parts, at + 1, F.lit(_NEIGHBOURS)), ""), F.lit(SNIPPET_CONTEXT)
            )
            snippet = strip(F.regexp_replace(F.concat(before, hit, after), _SPACES, " "))
            return F.struct(
                k.cast("int").alias("pos"),
                canonical_cve_id(hit).alias("code"),
                snippet.alias("snippet"),
                F.lit(1.0).cast("decimal(3,2)").alias("confidence"),
            )

        hits = F.floor(F.size(parts) / 2).cast("int")
        return F.when(hits > 0, F.transform(F.sequence(F.lit(1), F.greatest(hits, F.lit(1))), one)).otherwise(
            F.array().cast("array<struct<pos:int,code:string,snippet:string,confidence:decimal(3,2)>>")
        )

    return let(pieces, mentions)


def extract_cves(text: Column | str) -> Column:
    """Codes of a text without repeats, first occurrence kept, order preserved.

    Repeats are found by sorting on (code, position), so long lists stay cheap.
    """

    def first_only(sorted_hits: Column) -> Column:
        return F.filter(
            sorted_hits,
            lambda x, i: (i == 0) | (F.get(sorted_hits, i - 1)["code"] != x["code"]),
        )

    by_code = F.array_sort(
        F.transform(
            cve_mentions(text),
            lambda m: F.struct(
                m["code"].alias("code"), m["pos"].alias("pos"),
                m["snippet"].alias("snippet"), m["confidence"].alias("confidence"),
            ),
        )
    )
    kept = let(by_code, first_only)
    in_order = F.array_sort(
        F.transform(
            kept,
            lambda m: F.struct(
                m["pos"].alias("pos"), m["code"].alias("code"),
                m["snippet"].alias("snippet"), m["confidence"].alias("confidence"),
            ),
        )
    )
    return F.transform(
        in_order,
        lambda m: F.struct(
            m["code"].alias("code"), m["snippet"].alias("snippet"), m["confidence"].alias("confidence")
        ),
    )
