"""Mixing sources to target weights: hash-random order, distributed prefix sums and exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm.running import running
from exposure.session import store

WEIGHTS = (5, 2, 1)
MOST = 3
WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source (source, source_size -> also weight, target).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    ``most`` times its source's size; the excess is shared by weight among the others until none is above. The number of
    sources is not limited: each round is one aggregate, and the driver holds three sums.
    """
    one = sizes.select("source", "source_size", F.lit(0).alias("_all"), F.lit(1).cast("long").alias("_one"))
    ranked = running(one, "_all", [F.col("source").asc_nulls_last()], "_one", "_rank", "sources")
    turn = F.pmod(F.col("_rank"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long")
    rows = store(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    cap = F.col("source_size") * most
    total, open_weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    fixed, level, above = 0, F.lit(0.0), -1
    while open_weight:
        level = F.lit(float(total - fixed)) / F.lit(float(open_weight)) * F.col("weight")
        full = cap <= level
        fixed, open_weight, n = rows.agg(
            F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count_if(full)
        ).first()
        if n == above:
            break
        above = n
    return rows.withColumn("target", F.least(level, cap.cast("double")))


def mix(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: str = "mix",
    settle: bool = True,
) -> DataFrame:
    """How many words of each document (doc_id, text, source) the mix takes, repeats counted.

    Columns: row (a struct of the ``keep`` columns), source, size, source_size, target (its source's), taken. Within a source the documents stand in the
    order of a hash of their id. A source is taken whole as often as its target allows; the rest goes to the documents
    whose words begin before the cut, and the document on the cut gives only its words up to it. So a source's taken words
    are its target, rounded, and no document gives more than ``most`` times its size.

    ``settle`` writes the counted rows once before they are sorted; rows that carry whole texts are better read twice.

    Null text: size 0, taken 0. A null source is a source of its own. Null or repeated ids are ordered by text checksum;
    rows equal in all are interchangeable. Other columns may have any name: rows travel as one struct. No rows: no rows.
    """
    rows = docs.select(
        F.struct(*keep).alias("row"),
        F.col("source").alias("source"),
        words(F.col("text")).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("_key"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("_tie"),
    )
    placed = running(rows, "source", [F.col("_key"), F.col("_tie")], "size", "before", "mix", settle).drop("_key", "_tie")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, most).withColumnRenamed("source", "_source")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("_epochs") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before")))
    return (
        placed.join(goals, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_epochs", epochs.cast("long"))
        .select(
            "row", "source", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken")
        )
    )


def repeated(mixed: DataFrame, text: Column, size: Column, taken: Column) -> DataFrame:
    """The mixed rows themselves: one row per whole copy, and one with the leading words for what is left.

    Adds ``_text``. Documents of which nothing is taken are left out; copies per document are at most the ``most`` of
    :func:`mix`, so a row never grows into an unbounded list.
    """
    whole = F.floor(taken / size).cast("int")
    left = (taken - whole * size).cast("int")
    copies = F.concat(
        F.array_repeat(F.lit(None).cast("int"), whole), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<int>"))
    )
    lead = r"^[\x20\x09-\x0D]*"
    rows = mixed.where(taken > 0).withColumn("_left", F.explode(copies))
    cut = F.array_join(F.slice(F.split(F.regexp_replace(text, lead, ""), r"[\x20\x09-\x0D]+"), 1, F.col("_left")), " ")
    return rows.withColumn("_text", F.when(F.col("_left").isNull(), text).otherwise(cut)).drop("_left")
