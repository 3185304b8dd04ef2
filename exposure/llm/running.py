"""Positions and running sums inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from exposure.session import store

# A shuffle file of few bytes a row still has to keep many tasks busy; rows that tie on every order column are dealt at random.
_SEED = 11


def _sums(batches: Iterator[pa.RecordBatch], group: str, weight: str) -> Iterator[pa.RecordBatch]:
    """Adds the weights of the rows before, within the group and this task; rows of a group are adjacent."""
    part = TaskContext.get().partitionId()
    last, carry, first = None, 0, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        groups = batch.column(group).dictionary_encode()
        ids = groups.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        weights = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(weights) - weights
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        runs = np.diff(np.r_[starts, n])
        base = before[starts]
        if not first and batch.column(group)[0].as_py() == last:
            base[0] -= carry
        before = before - np.repeat(base, runs)
        last, carry, first = batch.column(group)[n - 1].as_py(), int(before[-1] + weights[-1]), False
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(before)],
            [*batch.schema.names, "_part", "_before"],
        )


def running(df: DataFrame, group: str, order: list[Column], weight: str, out: str, name: str, settle: bool = False) -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` over the rows of the same group that come earlier in ``order``.

    Rows are range-sorted by group and order, so a group of any size lies over many tasks. Each task adds up its own rows;
    the sums of whole tasks, one row per task and group, give what earlier tasks hold. Only the first group of a task can
    have begun in an earlier one, so the table that is broadcast has at most one row per task.

    A range sort reads its input twice, first to sample the ranges; ``settle`` writes rows that are dear to work out and small
    to keep to the shared folder before.

    Weights are whole numbers and not null; a null group is a group like any other; rows that tie take an arbitrary order.
    ``df`` must not have columns named ``_part``, ``_before``, ``_offset`` or ``_group``.
    """
    kinds = StructType([*df.schema.fields, StructField("_part", IntegerType()), StructField("_before", LongType())])
    keys = [F.col(group).asc_nulls_last(), *order, F.rand(_SEED)]
    if settle:
        df = store(df, f"{name}-rows")
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys[:-1])
    rows = store(dealt.mapInArrow(lambda batches: _sums(batches, group, weight), kinds), name)
    sums = rows.groupBy("_part", F.col(group).alias("_group")).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("_offset", F.sum("_sum").over(earlier))
        .where("_offset > 0")
        .select(F.col("_part").alias("_at"), "_group", "_offset")
    )
    joined = rows.join(
        F.broadcast(offsets), (F.col("_part") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")), "left"
    )
    return joined.withColumn(out, F.col("_before") + F.coalesce("_offset", F.lit(0))).drop(
        "_part", "_before", "_at", "_group", "_offset"
    )
