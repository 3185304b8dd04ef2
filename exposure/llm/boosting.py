"""Gradient-boosted trees for two classes, grown from histograms that tasks sum up over all rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.session import store

BINS = 32
# Slopes and curvatures are summed as whole multiples of this part, so that sums are exact whatever the order of the rows
# (up to 2**33 rows): every run grows the same trees.
PART = 2.0**-20
# The margins of the rows are written anew after so many trees; between, tasks add the trees since then.
ANEW = 10


def edges(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bin edges of a feature from its different values, ascending, and how often each occurs: between any two values, or the
    quantiles of all rows if these are too many."""
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < BINS:
        return middle
    ends = np.cumsum(counts)
    at = np.linspace(0, 1, BINS + 1)[1:-1] * (ends[-1] - 1)
    low = np.floor(at).astype(np.int64)
    below, above = (values[np.searchsorted(ends, np.minimum(i, ends[-1] - 1), "right")] for i in (low, low + 1))
    return np.unique(below + (above - below) * (at - low))


def bins(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


@dataclass
class Boosted:
    """Sum of trees over binned features; ``cuts`` holds the bin edges of each feature."""

    cuts: list[np.ndarray]
    base: float
    trees: list[list[tuple[int, int, int, int, float]]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(x):
            binned = bins(self.cuts, x)
            for tree in self.trees:
                total += _walk(tree, binned)
        return total


def _place(tree: list[tuple[int, int, int, int, float]], binned: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to."""
    at = np.zeros(len(binned), np.int64)
    kind = np.array([n[0] for n in tree])
    edge = np.array([n[1] for n in tree])
    left, right = np.array([n[2] for n in tree]), np.array([n[3] for n in tree])
    rows = np.arange(len(binned))
    while (inner := kind[at] >= 0).any():
        here = at[inner]
        goes = binned[rows[inner], kind[here]] <= edge[here]
        at[inner] = np.where(goes, left[here], right[here])
    return at


def _walk(tree: list[tuple[int, int, int, int, float]], binned: np.ndarray) -> np.ndarray:
    return np.array([n[4] for n in tree])[_place(tree, binned)]


def _rows(batch: pa.RecordBatch, trees: list) -> tuple[np.ndarray, np.ndarray]:
    """Bins and margins of the rows of a batch, the margins with these trees added."""
    binned = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    margin = batch.column("margin").to_numpy(zero_copy_only=False).copy()
    for tree in trees:
        margin += _walk(tree, binned)
    return binned, margin


def with_margins(rows: DataFrame, trees: list) -> DataFrame:
    """The rows (with bins and margin, among others), the trees added to their margins."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(_rows(batch, trees)[1]))

    return rows.mapInArrow(added, rows.schema)


def _histograms(rows: DataFrame, trees: list, tree: list, open_at: list[int], features: int) -> np.ndarray:
    """Sums of slope and curvature over all rows by open leaf of ``tree``, feature and bin; one small array comes from each task."""
    shape = (2, len(open_at), features, BINS)
    slot = np.full(len(tree), -1)
    slot[open_at] = np.arange(len(open_at))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(open_at) * features * BINS))
        for batch in batches:
            if not batch.num_rows:
                continue
            binned, margin = _rows(batch, trees)
            n, right = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "right"))
            p = 1 / (1 + np.exp(-margin))
            at = slot[_place(tree, binned)]
            own = np.flatnonzero(at >= 0)
            cells = ((at[own, None] * features + np.arange(features)) * BINS + binned[own]).ravel()
            for side, part in enumerate((n * p - right, n * p * (1 - p))):
                total[side] += np.bincount(cells, np.repeat(np.rint(part[own] / PART), features), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = np.zeros(shape)
    for r in rows.mapInArrow(sums, "sums binary").collect():
        total += np.frombuffer(r["sums"]).reshape(shape)
    return total * PART


def train(rows: DataFrame, cuts: list[np.ndarray], mean: float, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss with histogram splits, over all rows.

    ``rows`` (bins: one byte a feature, n: how many rows are alike, right: how many of them are of class 1) stay where they are:
    each level of a tree is one pass, and only its histograms, whose size the rows do not change, come to the driver.
    ``mean`` is the share of class 1.
    """
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    model = Boosted(cuts, float(np.log(mean / (1 - mean))))
    rows, since = rows.select("bins", "n", "right", F.lit(model.base).alias("margin")), 0

    def leaf(g: float, h: float) -> tuple[int, int, int, int, float]:
        return (-1, 0, 0, 0, float(-rate * g / (h + ridge)))

    for done in range(trees):
        if done - since == ANEW:
            rows, since = store(with_margins(rows, model.trees[since:]), "margins"), done
        tree = [leaf(0.0, 0.0)]
        open_at = [0]
        for _ in range(depth):
            slopes, curves = _histograms(rows, model.trees[since:], tree, open_at, len(cuts))
            split = []
            for place, own_g, own_h in zip(open_at, slopes, curves, strict=True):
                g, h = own_g[0].sum(), own_h[0].sum()
                tree[place] = leaf(g, h)
                gl, hl = own_g.cumsum(axis=1)[:, :-1], own_h.cumsum(axis=1)[:, :-1]
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                f, k = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, k] > 1e-6:
                    left = len(tree)
                    tree += [leaf(gl[f, k], hl[f, k]), leaf(g - gl[f, k], h - hl[f, k])]
                    tree[place] = (int(f), int(k), left, left + 1, 0.0)
                    split += [left, left + 1]
            open_at = split
            if not open_at:
                break
        model.trees.append(tree)
    return model
