"""Product names: canonical key, product/version split, labels."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.constants import PRODUCT_ALIASES
from exposure.functions.text import as_col, let, strip

Aliases = Mapping[str, Sequence[str]]


def ordered_aliases(aliases: Aliases | None = None) -> list[tuple[str, str]]:
    """(alias, key) pairs, longest alias first; equal lengths keep the order of the table."""
    table = PRODUCT_ALIASES if aliases is None else aliases
    pairs = [(a, key) for key, names in table.items() for a in names]
    return sorted(pairs, key=lambda p: -len(p[0]))


def with_alias(product_key: str, alias: str, aliases: Aliases | None = None) -> dict[str, list[str]]:
    """Alias table with one more entry."""
    table = {k: list(v) for k, v in (PRODUCT_ALIASES if aliases is None else aliases).items()}
    names = table.setdefault(product_key, [])
    alias = alias.strip().lower()
    if alias not in names:
        names.append(alias)
    return table


def _alias_table(aliases: Aliases | None) -> Column:
    """Literal ``ARRAY<STRUCT<alias,key>>`` in matching order; read from JSON, which folds to a constant."""
    rows = [{"alias": a, "key": key} for a, key in ordered_aliases(aliases)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<alias:string,key:string>>")


def _known(text: Column, table: Column) -> Column:
    """First entry of the table that is contained in a lower-case text; null when none is."""
    return F.get(F.filter(table, lambda x: F.contains(text, x["alias"])), F.lit(0))


def normalize_product(raw: Column | str, aliases: Aliases | None = None, known: Column | None = None) -> Column:
    """Raw product text to product key: longest alias contained in it, else a slug.

    ``known`` is the entry (alias, key) of the text where it was looked up already, see ``operators.products``.
    """
    table = _alias_table(aliases) if known is None else None
    return let(
        F.lower(strip(F.coalesce(as_col(raw), F.lit("")))),
        lambda t: F.coalesce(
            (_known(t, table) if known is None else known)["key"], F.btrim(F.regexp_replace(t, r"[^a-z0-9가-힣]+", "_"), F.lit("_"))
        ),
    )


def split_product_version(raw: Column | str, aliases: Aliases | None = None, known: Column | None = None) -> Column:
    """One cell holding both to ``STRUCT<product,version>``.

    Cut after the longest known alias; without one, before the first token that looks like a version. ``known`` as in
    :func:`normalize_product`.
    """
    table = _alias_table(aliases) if known is None else None

    def cut(text: Column, alias: Column) -> Column:
        end = F.position(alias, F.lower(text)) + F.length(alias) - 1
        product = strip(F.substring(text, F.lit(1), end))
        version = F.btrim(F.substring(text, end + 1, F.length(text)), F.lit(" -/().,"))
        return _pair(product, version)

    def by_token(text: Column) -> Column:
        def at_token(tokens: Column) -> Column:
            looks = F.transform(tokens, lambda t: t.rlike(r"(?i)^(\d|v\d|dc\b|\d{2}h\d)"))
            return let(F.array_position(looks, F.lit(True)).cast("int"), lambda at: parts(tokens, at))

        def parts(tokens: Column, at: Column) -> Column:
            head = F.array_join(F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0))), " ")
            tail = F.array_join(F.slice(tokens, F.greatest(at, F.lit(1)), F.size(tokens)), " ")
            return F.when(at == 0, _pair(text, F.lit(""))).otherwise(
                _pair(F.when(head == "", text).otherwise(head), tail)
            )

        return let(F.split(F.regexp_replace(text, r"(?U)\s+", " "), " "), at_token)

    def split(text: Column) -> Column:
        return let(
            (_known(F.lower(text), table) if known is None else known)["alias"],
            lambda alias: F.when(text == "", _pair(F.lit(""), F.lit("")))
            .when(alias.isNotNull(), cut(text, alias))
            .otherwise(by_token(text)),
        )

    return let(strip(F.coalesce(as_col(raw), F.lit(""))), split)


def _pair(product: Column, version: Column) -> Column:
    return F.struct(product.alias("product"), version.alias("version"))


def product_ver_label(product: Column, version: Column) -> Column:
    """``product · version`` without dangling separators."""
    joined = F.concat(F.coalesce(product, F.lit("None")), F.lit(" · "), F.coalesce(version, F.lit("")))
    return F.btrim(joined, F.lit(" ·"))


def cpe_product(criteria: Column | str) -> Column:
    """``vendor product`` from a CPE 2.3 string, underscores as blanks; null when it is too short."""
    parts = F.split(as_col(criteria), ":", -1)
    both = F.concat(F.get(parts, F.lit(3)), F.lit(" "), F.get(parts, F.lit(4)))
    return F.when(F.size(parts) >= 5, strip(F.translate(both, "_", " ")))
