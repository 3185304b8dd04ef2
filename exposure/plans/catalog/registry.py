"""Registration of queries over the driver's tables together with the SQL that gives the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.plans.catalog.views_sql import VIEWS
from exposure.plans.demo import Views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the ``x_`` views of :mod:`views_sql`."""

    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = _with_views(sql)
        return fn

    return register


def _with_views(sql: str) -> str:
    """Put the views that a statement uses, directly or through others, in front of it."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        for name in re.findall(r"\bx_\w+", todo.pop()):
            if name not in needed and name in VIEWS:
                needed.add(name)
                todo.append(VIEWS[name])
    # materialised: several of them are used more than once and are dear
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in VIEWS if n in needed]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


_PLANS: dict[tuple[str, str], Views] = {}


def _views(spark: SparkSession, sf_dir: str) -> Views:
    """The derived tables of a directory; their plans (not their rows) are kept for the session's other queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANS or _PLANS[key].spark is not spark:
        _PLANS[key] = Views(spark, sf_dir)
    return _PLANS[key]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(_views(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flat(df: DataFrame) -> DataFrame:
    """Plain columns for comparison: dates and times as text, decimals as doubles, string lists joined."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "date":
            c = c.cast("string")
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind.startswith("array<"):
            c = F.array_join(c.cast("array<string>"), "|", "~")
        cols.append(c.alias(name))
    return df.select(*cols)
