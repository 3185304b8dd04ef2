"""Periodic runs of words: Lyndon arrays by Baier's grouping under both word orders, Lyndon roots extended through LCE.

A run is a stretch with smallest period q that no neighbouring word extends. Under one of the two orders of the alphabet (any
order and its reverse) the longest Lyndon word at some place of the run has length q. So the longest Lyndon words of all places, under
both orders, extended to both sides as long as words q apart are equal, give every run. The longest Lyndon words are what the
first phase of Baier's suffix sorter works out when it groups suffixes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 6
LEAST_POWER = 4
# Words of a stretch that could lie in a run of the least length and power recur in grams of this size (see ``live``).
_GRAM = 5
# Times a part of a document is narrowed.
_LOOKS = 8
_RUNS = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"
_FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string()),
    ]
)


def lyndon(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place; ``ranks`` are 0 to k - 1, all of them in use.

    Baier's first phase: suffixes are grouped by their first word, groups are taken from the highest down. The group's context (what
    its suffixes begin with) is final when its turn comes. Each of its suffixes points to the nearest place before it
    whose group is lower; a place that is pointed at l times has its context prolonged by l contexts of the group, and moves to
    a new group just above its old one. Places whose groups are done are taken out of a linked list, so what a suffix points at
    is its neighbour there. A place moves once for each group that points at it: the work is linear.
    """
    n, k = len(ranks), max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(k)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    of, width, below = list(ranks), [1] * k, list(range(-1, k - 1))
    above = [*range(1, k), -1]
    left, right = list(range(-1, n)), [*range(1, n + 1), n, n]
    found = [0] * n
    group = k - 1
    while group >= 0:
        w, pointed, last, count = width[group], {}, -1, 0
        for i in members[group]:
            if of[i] != group:
                continue
            found[i] = w
            p, r = left[i], right[i]
            left[r] = p
            right[p] = r
            if p == last:
                count += 1
            else:
                if last >= 0:
                    pointed.setdefault(count, []).append(last)
                last, count = p, 1
        if last >= 0:
            pointed.setdefault(count, []).append(last)
        for times in sorted(pointed, reverse=True):
            moved: dict[int, int] = {}
            for p in pointed[times]:
                old = of[p]
                new = moved.get(old)
                if new is None:
                    new = moved[old] = len(width)
                    width.append(width[old] + times * w)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                    members.append([])
                of[p] = new
                members[new].append(p)
        members[group] = []
        group = below[group]
    return found


class Common:
    """Longest common extensions of pairs of places, by names of stretches of 1, 2, 4, ... words; equal names, equal words."""

    def __init__(self, ids: np.ndarray):
        self.names = [ids.astype(np.int64)]
        while True:
            size = 1 << len(self.names)
            last = self.names[-1]
            if size > len(ids):
                return
            pairs = last[: len(ids) - size + 1] * (len(ids) + 1) + last[size // 2 : len(ids) - size // 2 + 1]
            different, named = np.unique(pairs, return_inverse=True)
            if len(different) == len(pairs):
                return
            self.names.append(named.astype(np.int64))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and from b (a < b) on."""
        found, n = np.zeros(len(a), np.int64), len(self.names[0])
        for level in reversed(range(len(self.names))):
            names, size = self.names[level], 1 << level
            # a step of each size can be taken once but for the largest one, which may repeat
            while True:
                fits = b + found + size <= n
                at_a, at_b = np.where(fits, a + found, 0), np.where(fits, b + found, 0)
                same = fits & (names[at_a] == names[at_b])
                found[same] += size
                if level < len(self.names) - 1 or not same.any():
                    break
        return found

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before a and before b (a < b)."""
        found = np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.names))):
            names, size = self.names[level], 1 << level
            while True:
                fits = a - found - size >= 0
                at_a, at_b = np.where(fits, a - found - size, 0), np.where(fits, b - found - size, 0)
                same = fits & (names[at_a] == names[at_b])
                found[same] += size
                if level < len(self.names) - 1 or not same.any():
                    break
        return found


def runs_of(ids: np.ndarray) -> np.ndarray:
    """All runs (start, length, period) of length >= 2 * period, by start, then period; ``ids`` are numbers of words."""
    n = len(ids)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    _, ranks = np.unique(ids, return_inverse=True)
    ranks = ranks.astype(np.int64)
    up, down = ranks.tolist(), (ranks.max() - ranks).tolist()
    roots = np.concatenate([np.array(lyndon(up), np.int64), np.array(lyndon(down), np.int64)])
    at = np.concatenate([np.arange(n)] * 2)
    inside = at + roots < n + 1
    at, roots = at[inside], roots[inside]
    common = Common(ranks)
    after = common.forward(at, at + roots)
    before = common.backward(at, at + roots)
    found = np.stack([at - before, before + roots + after, roots], axis=1)
    found = np.unique(found[found[:, 1] >= 2 * found[:, 2]], axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """Names of the stretches of ``size`` words, exact."""
    names = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    first = names
    for k in range(1, size):
        pairs = names[: len(ids) - k] * (len(ids) + 1) + first[k:]
        names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    return names


def live(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, stop) outside which no word lies in a run of at least six words and four periods.

    Such a run of period q has L >= max(6, 4q) words, so L - 4 >= max(2, q) stretches of five words begin in it, and each of them occurs
    again q words further or earlier within the run. (q = 1: at least two equal ones; q > 1: 4q - 4 >= 2q.) A place where a stretch
    of five begins that does not recur parts the document: runs do not go over it. Parts are looked at again on their own, a few
    times at most: a part that would shrink further is handed on as it is.
    """
    todo, done = [(0, len(ids), 0)], []
    while todo:
        start, stop, depth = todo.pop()
        if stop - start < LEAST_LENGTH:
            continue
        names = _grams(ids[start:stop], _GRAM)
        again = np.bincount(names)[names] > 1
        if again.all() or depth == _LOOKS:
            done.append((start, stop))
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, again, False].astype(np.int8))).reshape(-1, 2)
        todo += [(start + a, start + b + _GRAM - 1, depth + 1) for a, b in edges.tolist()]
    return sorted(done)


def find(ids: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER, narrow: bool = True) -> np.ndarray:
    """Runs (start, length, period) of at least ``least_length`` words and ``least_power`` periods, by start, then period.

    Lyndon roots are looked for where such runs can lie at all (:func:`live`) if the bounds are those or higher.
    """
    narrow = narrow and least_length >= LEAST_LENGTH and least_power >= LEAST_POWER
    found = [np.zeros((0, 3), np.int64)]
    for start, stop in live(ids) if narrow else [(0, len(ids))]:
        part = runs_of(ids[start:stop])
        part = part[part[:, 1] >= np.maximum(least_length, least_power * part[:, 2])]
        found.append(part + np.array([start, 0, 0]))
    out = np.concatenate(found)
    # stretches may overlap by less than a run's least length, so no run lies in two of them
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER,
    prepare: Callable[[list[bytes], int | None], list[bytes]] | None = None,
) -> DataFrame:
    """Every document with its runs of words: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are what stands between blanks (20, 09-0D). ``collapsed`` is the text without the words that lie in a run after its first
    period, joined by one blank. ``prepare`` may change the words of a document (words, doc_id) before they are looked at. A null text
    counts as empty; without words there are no runs and ``collapsed`` is empty. Repeated rows stay, each with the same result. Other
    columns are left out. No rows: no rows. A text is worked on by itself, in memory in proportion to its words.
    """

    @F.arrow_udf(_RUNS)
    def find_all(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for i, t in zip(ids, texts.cast(pa.binary()), strict=True):
            words = (t.as_py() or b"").split()
            if prepare:
                words = prepare(words, i.as_py())
            runs = find(numbered(words), least_length, least_power)
            if len(runs):
                stay = kept(len(words), runs)
                words, n = [words[j] for j in np.flatnonzero(stay).tolist()], len(words)
            else:
                n = len(words)
            found = [{"start": s, "length": length, "period": p} for s, length, p in runs.tolist()]
            out.append({"n_words": n, "runs": found, "collapsed": b" ".join(words).decode()})
        return pa.array(out, _FOUND)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.withColumn("_found", find_all("doc_id", "text")).select("doc_id", "_found.*")
