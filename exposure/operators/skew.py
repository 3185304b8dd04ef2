"""Joins and picks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows or more than ROWS_PER_SLICE rows. The share never falls below
# MIN_SHARE, so there are at most 1 / MIN_SHARE hot keys, some megabytes.
HOT_SHARE = 1 / 1000
MIN_SHARE = 1 / 100_000
ROWS_PER_SLICE = 5_000_000


def hot_keys(
    counts: DataFrame, keys: Sequence[str], n: str = "n", share: float = HOT_SHARE, rows: int = ROWS_PER_SLICE
) -> DataFrame:
    """Hot keys of a table of per-key counts, with the number of slices each should be cut into.

    At most ``1 / min(share, MIN_SHARE)`` keys can exceed the share of the total that is taken, whatever the size of the data,
    so the result always fits a broadcast. The slices only spread work; no result depends on them.
    """
    total = counts.select(F.sum(n).alias("total")).scalar()
    taken = F.greatest(F.least(F.lit(share), F.lit(float(rows)) / total), F.lit(min(share, MIN_SHARE)))
    slice_rows = F.greatest(total * taken, F.lit(1.0))
    return counts.where(F.col(n) > slice_rows).select(
        *keys, F.ceil(F.col(n) / slice_rows).cast("int").alias("_slices")
    )


def sliced_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], slice_on: Column, hot: DataFrame,
    other_on: Column | None = None, other_hot: DataFrame | None = None,
) -> DataFrame:
    """Inner equi-join where rows of hot keys on the big side are spread over slices.

    ``slice_on`` identifies a row of the big side; the rows of the other side are repeated once per slice
    of a hot key only. Where the other side has hot keys too (``other_hot``, with ``other_on`` to identify its rows), it is
    cut as well, and each pair of slices meets in one place. The result equals the plain join.
    """
    keys = list(keys)

    def prepare(df: DataFrame, own: Column | None, mine: DataFrame | None, theirs: DataFrame | None, names: tuple[str, str]):
        def slices(of: DataFrame | None, df: DataFrame) -> tuple[DataFrame, Column]:
            if of is None:
                return df, F.lit(1)
            return df.join(F.broadcast(of), keys, "left"), F.coalesce(F.col("_slices"), F.lit(1))

        df, n = slices(mine, df)
        df = df.withColumn(names[0], F.pmod(F.xxhash64(own), n).cast("int") if mine is not None else F.lit(0)).drop("_slices")
        df, n = slices(theirs, df)
        return df.withColumn(names[1], F.explode(F.sequence(F.lit(0), n - 1)) if theirs is not None else F.lit(0)).drop("_slices")

    left = prepare(big, slice_on, hot, other_hot, ("_slice", "_other"))
    right = prepare(small, other_on, other_hot, hot, ("_other", "_slice"))
    return left.join(right, [*keys, "_slice", "_other"]).drop("_slice", "_other")


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order.

    Spark limits each map task to one row per key before the shuffle, so a hot key costs no more than
    any other.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
