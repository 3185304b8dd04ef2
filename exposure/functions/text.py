"""Small text helpers shared by all column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.constants import WHITESPACE


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space (any Unicode space, not only blanks)."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def ascii_digits(c: Column | str) -> Column:
    """Full-width digits become ASCII ones; the length of the text stays the same."""
    return F.translate(as_col(c), "０１２３４５６７８９", "0123456789")


def lookup(c: Column | str, table: Mapping[str, object], default: Column | None = None) -> Column:
    """Value of ``c`` in a small literal table; ``default`` (or null) when it is not there."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*entries), as_col(c))
    return found if default is None else F.coalesce(found, default)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def ilike_any(cols: Iterable[Column | str], q: str) -> Column:
    """Case-insensitive substring over several columns; ``%`` and ``_`` in ``q`` are wildcards."""
    pattern = "%" + q.replace("\\", "\\\\") + "%"
    return any_of(F.coalesce(as_col(c).ilike(pattern), F.lit(False)) for c in cols)


def contains_any(cols: Iterable[Column | str], q: str) -> Column:
    """Case-insensitive literal substring over several columns."""
    needle = F.lit(q.strip().lower())
    return any_of(F.coalesce(F.contains(F.lower(as_col(c)), needle), F.lit(False)) for c in cols)


def default_title(title: Column | str, file_name: Column | str) -> Column:
    """Title, else the file name without its last extension."""
    stem = F.regexp_replace(F.coalesce(blank_to_null(as_col(file_name)), F.lit("보안권고문")), r"\.[^.]*$", "")
    return F.coalesce(blank_to_null(strip(title)), stem)


def doc_no_or_null(doc_no: Column | str) -> Column:
    return blank_to_null(strip(doc_no))


def file_sha256(content: Column | str) -> Column:
    return F.sha2(as_col(content), 256)


def formula_safe(c: Column | str) -> Column:
    """Prefix cells that a spreadsheet would run as a formula."""
    c = as_col(c)
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
