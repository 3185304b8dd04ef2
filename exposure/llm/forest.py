"""Approximate nearest neighbours by a forest of sorted hash strings."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.session import store

TREES = 64
BITS = 32
# Candidates at which the common ascent stops: this share of a shard's vectors, and never fewer than LEAST.
SHARE = 0.4
LEAST = 1024
# Vectors of one shard and queries of one block; with 64 components a task holds some 30 MB.
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
_AT_ONCE = 256


def usable(vec: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


class Forest:
    """Trees over the rows of ``vectors``: per tree a sorted array of hash strings, here numbers of ``bits`` bits.

    A bit says on which side of the median of these vectors a projection falls; the directions of a tree are orthogonal as
    far as the dimension allows. The prefix of length x of a string is a range of the sorted array.
    """

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        draw = np.random.default_rng(seed)
        self.planes, self.medians, self.order, self.strings = [], [], [], []
        for _ in range(trees):
            plane = self._directions(draw, vectors.shape[1], bits)
            sides = vectors @ plane
            median = np.median(sides, axis=0)
            strings = self._pack(sides > median)
            order = np.argsort(strings, kind="stable")
            self.planes.append(plane)
            self.medians.append(median)
            self.order.append(order)
            self.strings.append(strings[order])

    @staticmethod
    def _directions(draw: np.random.Generator, dim: int, bits: int) -> np.ndarray:
        found = []
        while sum(x.shape[1] for x in found) < bits:
            found.append(np.linalg.qr(draw.standard_normal((dim, dim)))[0])
        return np.concatenate(found, axis=1)[:, :bits]

    def _pack(self, sides: np.ndarray) -> np.ndarray:
        return (sides * (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).sum(axis=1)

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows that share the longest prefixes with it, in any tree.

        The descent is a binary search in every sorted array. The ascent shortens the prefix in all trees at once until
        they hold ``least`` different rows.
        """
        low = np.empty((self.bits + 1, len(queries), self.trees), np.int32)
        high = low.copy()
        for t in range(self.trees):
            own = self._pack(queries @ self.planes[t] > self.medians[t])
            for x in range(self.bits + 1):
                rest = self.bits - x
                first = (own >> rest) << rest
                low[x, :, t] = np.searchsorted(self.strings[t], first)
                high[x, :, t] = np.searchsorted(self.strings[t], first + ((1 << rest) - 1), "right")
        held = (high - low).sum(axis=2)
        for q in range(len(queries)):
            seen = np.zeros(len(self.vectors), bool)
            for x in range(self.bits, -1, -1):
                if held[x, q] < least and x:
                    continue
                for t in range(self.trees):
                    seen[self.order[t][low[x, q, t] : high[x, q, t]]] = True
                if np.count_nonzero(seen) >= least:
                    break
            yield np.flatnonzero(seen)


def _search(k: int, trees: int, bits: int, share: float, least: int, seed: int):
    """Best ``k`` rows of one shard for each query vector of one block, by exact distance."""

    def search(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"query": [], "vec_id": [], "score": []}
        lengths, asked = points.embedding.str.len(), queries.embedding.str.len()
        for dim in sorted(set(lengths) & set(asked)):
            rows, wanted = points[lengths == dim], queries[asked == dim]
            vectors = np.stack(rows.embedding.to_numpy()).astype(np.float64)
            index = Forest(vectors, trees, bits, seed)
            enough = min(len(vectors), max(least, ceil(share * len(vectors))))
            ids = rows.ids.to_numpy()
            for i in range(0, len(wanted), _AT_ONCE):
                block = wanted.embedding.iloc[i : i + _AT_ONCE]
                own = np.stack(block.to_numpy()).astype(np.float64)
                for vec, query, near in zip(block, own, index.candidates(own, enough), strict=True):
                    gap = vectors[near] - query
                    far = np.sqrt((gap * gap).sum(axis=1))
                    n = min(k, len(far))
                    best = np.flatnonzero(far <= np.partition(far, n - 1)[n - 1])
                    pairs = sorted((float(far[b]), int(x)) for b in best for x in ids[near[b]])[:k]
                    found["query"] += [vec] * len(pairs)
                    found["vec_id"] += [x for _, x in pairs]
                    found["score"] += [d for d, _ in pairs]
        return pd.DataFrame({c: pd.Series(v, dtype=t) for (c, v), t in zip(found.items(), ("object", "int64", "float64"), strict=True)})

    return search


def neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    trees: int = TREES,
    bits: int = BITS,
    share: float = SHARE,
    least: int = LEAST,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    seed: int = 5,
) -> DataFrame:
    """The ``k`` nearest found for each query by Euclidean distance: query_id, rank, vec_id, score.

    Both tables have vec_id and embedding, of the same type. Equal vectors are one entry of the index with their ``k + 1`` smallest ids, more
    of which can never be among the nearest; equal query vectors are searched once. So a vector that a third of the rows
    share costs one entry. Distinct vectors are dealt by hash over shards of about ``shard_rows``, query vectors over blocks
    of about ``query_rows``; each pair of shard and block is one task of bounded memory, and only its ``k`` best per query
    leave it. With fewer vectors than ``least`` per shard the search is exact.

    Ties go to the smaller vec_id. A query never finds its own vec_id. Rows with a null vec_id and vectors that are null,
    empty, zero or hold null or non-finite components take no part; rows that repeat id and vector count once. Vectors are
    compared with those of their own length. Other columns are left out. No rows: no rows.
    """

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
        return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()

    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    held = clean(vectors).withColumn("_rn", F.row_number().over(by_id)).where(F.col("_rn") <= k + 1)
    entries = store(held.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = store(clean(queries), "queries")
    vecs = asked.select("embedding").distinct()
    shards = max(1, ceil(entries.count() / shard_rows))
    blocks = max(1, ceil(vecs.count() / query_rows))
    key = F.xxhash64("embedding")
    points = entries.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    wanted = vecs.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    kind = entries.schema["embedding"].dataType.simpleString()
    found = (
        points.groupBy("shard", "block")
        .cogroup(wanted.groupBy("shard", "block"))
        .applyInPandas(
            _search(k + 1, trees, bits, share, least, seed), f"query {kind}, vec_id long, score double"
        )
    )
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    merged = found.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k + 1).drop("_rn")
    merged = merged.withColumnRenamed("vec_id", "_found")
    rows = asked.join(merged, asked["embedding"] == merged["query"]).where("vec_id <> _found")
    rank = Window.partitionBy("vec_id", "embedding").orderBy("score", "_found")
    return (
        rows.withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select(F.col("vec_id").alias("query_id"), "rank", F.col("_found").alias("vec_id"), "score")
    )
