"""Keyed change sets: current table and changes in, next table out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.operators.skew import first_per


def overlay(
    table: DataFrame, changes: DataFrame, keys: Sequence[str], updates: Mapping[str, Column]
) -> DataFrame:
    """Update matching rows of ``table``; one row per key in ``changes``.

    ``updates`` gives the new value of a column. It may use the table's columns by name and the changes'
    columns with the prefix ``new_``. Rows without a change stay as they are.
    """
    keys = list(keys)
    incoming = changes.select(
        *keys, F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"new_{c}") for c in changes.columns if c not in keys],
    )
    joined = table.join(incoming, keys, "left")
    cols = [
        F.when(F.col("_hit"), updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
        for c in table.columns
    ]
    return joined.select(*cols)


def upsert(
    table: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    on_update: Mapping[str, Column] | None = None,
    on_insert: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Insert new keys, overwrite the data columns of known ones; one row per key in ``changes``.

    Columns missing from ``changes`` keep their value on update and are null on insert, unless
    ``on_update`` / ``on_insert`` say otherwise. The extra column ``_action`` tells what happened.
    """
    keys = list(keys)
    on_update, on_insert = on_update or {}, on_insert or {}
    types = dict(table.dtypes)
    old = table.select(*keys, F.struct(*table.columns).alias("_old"))
    new = changes.select(*keys, F.struct(*changes.columns).alias("_new"))
    joined = old.join(new, keys, "full_outer")
    added = F.col("_old").isNull()
    updated = F.col("_old").isNotNull() & F.col("_new").isNotNull()

    def column(c: str) -> Column:
        if c in keys:
            return F.col(c)
        kept = F.col("_old")[c]
        incoming = F.col("_new")[c].cast(types[c]) if c in changes.columns else None
        inserted = on_insert.get(c, incoming if incoming is not None else F.lit(None).cast(types[c]))
        overwritten = on_update.get(c, incoming if incoming is not None else kept)
        return F.when(added, inserted).when(updated, overwritten).otherwise(kept).alias(c)

    action = F.when(added, "added").when(updated, "updated").otherwise("kept")
    return joined.select(*[column(c) for c in table.columns], action.alias("_action"))


def apply_changes(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Generic change set: ``op`` is create, upsert, set or delete; the last change of a key wins.

    ``create`` is refused on an existing key and ``set`` is ignored on a missing one. Null fields of a
    ``set`` leave the stored value alone.
    """
    keys = list(keys)
    data = [c for c in changes.columns if c not in (*keys, "op", order)]
    last = first_per(changes, keys, F.col(order).desc())
    old = table.select(*keys, F.struct(*table.columns).alias("_old"))
    new = last.select(*keys, "op", F.struct(*[F.col(c) for c in data]).alias("_new"))
    joined = old.join(new, keys, "full_outer")
    exists = F.col("_old").isNotNull()
    op = F.coalesce(F.col("op"), F.lit("keep"))
    joined = joined.where(~(op == "delete") & ~(~exists & (op == "set")))

    def column(c: str) -> Column:
        if c in keys:
            return F.col(c)
        kept = F.col("_old")[c]
        if c not in data:
            return kept.alias(c)
        incoming = F.col("_new")[c]
        return (
            F.when((op == "keep") | (exists & (op == "create")), kept)
            .when(op == "set", F.coalesce(incoming, kept))
            .otherwise(incoming)
            .alias(c)
        )

    return joined.select(*[column(c) for c in table.columns])


def refused_creates(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``create`` changes whose key already exists."""
    return changes.where(F.col("op") == "create").join(table, list(keys), "left_semi")


def publish(advisory: DataFrame, flags: DataFrame, at: Column) -> DataFrame:
    """Publish or take down advisories; the first publication time is kept until it is taken down.

    ``flags``: advisory_id, publish BOOLEAN (one row per advisory).
    """
    return overlay(
        advisory, flags, ["advisory_id"],
        {
            "board_published_at": F.when(
                F.col("new_publish"), F.coalesce(F.col("board_published_at"), at)
            )
        },
    )
