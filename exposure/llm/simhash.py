"""Near-duplicates by SimHash: fingerprints that share pigeonhole blocks are joined and verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from exposure.llm.components import components
from exposure.session import store

SEED = 42
SHINGLE = 4
RADIUS = 4
# Fingerprints of one bucket that a task compares at once (8 bytes each); larger buckets are cut by a finer scheme.
BUCKET = 16_384
# Shingles whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set if over half of the shingle hashes have it set; no words give 0.

    ``bytes.lower`` and ``bytes.split`` touch just A-Z and just the bytes 20 and 09-0D.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        spans = zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist(), strict=True)
        hashes = np.array([hashed(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed 64-bit numbers; null counts as empty text."""
    found = [fingerprint(t) for t in texts.cast(pa.binary()).fill_null(b"").to_pylist()]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of ``blocks - radius`` of the blocks; two fingerprints that differ in ``radius`` bits agree on one of them."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def scheme(n: int, radius: int = RADIUS) -> int:
    """Number of blocks with the least expected work for ``n`` evenly spread fingerprints: rows dealt plus pairs compared.

    Any number finds all links; this only keeps the buckets small as the corpus grows.
    """

    def work(blocks: int) -> float:
        kept = 64 * (blocks - radius) // blocks
        return comb(blocks, radius) * (20.0 * n + n * n / 2 / 2**kept)

    return min(range(radius + 2, radius + 13), key=work)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that span the components of one bucket, one link fewer than nodes: a search that visits each node once."""
    if len(prints) == 2:
        return [(0, 1)] if int(np.bitwise_count(prints[0] ^ prints[1])) <= radius else []
    links, rest = [], np.arange(len(prints))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= radius
            found = rest[near].tolist()
            links += [(at, x) for x in found]
            todo += found
            rest = rest[~near]
    return links


def _link(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of one task; rows are sorted by bucket, and a bucket has at most ``BUCKET`` of them."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_mask", "_key", "fp")])
        rows = np.concatenate([*held, rows], axis=1)
        change = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
        last = int(change[-1]) if len(change) else 0
        yield _found(rows[:, :last], change, radius)
        held = [rows[:, last:]]
    if held:
        change = np.array([held[0].shape[1]])
        yield _found(held[0], change, radius)


def _found(rows: np.ndarray, change: np.ndarray, radius: int) -> pa.RecordBatch:
    prints = np.ascontiguousarray(rows[2]).view(np.uint64)
    starts = np.r_[0, change[:-1]] if len(change) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, change[-1]]) if len(change) else starts
    two = starts[sizes == 2]
    close = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
    a, b = [prints[close]], [prints[close + 1]]
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        bucket = prints[start : start + size]
        links = np.array(forest(bucket, radius), np.int64).reshape(-1, 2)
        a.append(bucket[links[:, 0]])
        b.append(bucket[links[:, 1]])
    columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def _balls(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Exact links for what no block scheme could cut: all fingerprints within half the radius of a point are links of each
    other, and any two within the radius have such a point between them. Minima are taken before the shuffle."""
    bits = [1 << i for i in range(64)]
    flips = [_signed(sum(c)) for k in range(radius // 2 + 1) for c in combinations(bits, k)]
    near = prints.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("_at"))
    least = near.groupBy("_at").agg(F.min("fp").alias("b"), F.count("*").alias("_n")).where("_n > 1")
    return near.join(least, "_at").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, steps: tuple[int, ...] = (4, 8)) -> DataFrame:
    """Links (a, b) that connect just those distinct fingerprints (fp) which a chain of Hamming steps of ``radius`` connects.

    A bucket is keyed by a mask and the masked fingerprint. Bucket sizes are counted first, with partial sums, and only
    buckets of two to ``bucket`` are brought together; each gives a spanning forest, never all its pairs. The members of
    larger buckets go through a scheme of more blocks, and at last through :func:`_balls`, so that nothing is left out.
    """
    found, todo = [], prints
    base = scheme(prints.count(), radius)
    for blocks in (base, *[base + s for s in steps]):
        kept = masks(blocks, radius)
        keyed = todo.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in kept])).alias("_mask", "_key"))
        counts = store(keyed.groupBy("_mask", "_key").agg(F.count("*").alias("_n")).where("_n > 1"), "buckets")
        shared = keyed.join(counts, ["_mask", "_key"])
        dealt = shared.where(F.col("_n") <= bucket).select(F.col("_mask").cast("long"), "_key", "fp")
        dealt = dealt.repartition("_mask", "_key").sortWithinPartitions("_mask", "_key")
        found.append(store(dealt.mapInArrow(lambda batches: _link(batches, radius), "a long, b long"), "pairs"))
        if counts.where(F.col("_n") > bucket).isEmpty():
            todo = None
            break
        todo = store(shared.where(F.col("_n") > bucket).select("fp").distinct(), "dense")
    if todo is not None:
        found.append(store(_balls(todo, radius), "pairs"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_groups(rows: DataFrame, **options) -> DataFrame:
    """(doc_id, fp) -> (fp, root, component_id): the component's smallest fingerprint and smallest doc_id."""
    classes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("_least")), "classes")
    roots = components(links(classes.select("fp"), **options)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Every document (doc_id, text) with its fingerprint (16 hex digits) and component_id.

    Null text counts as empty; empty texts have fingerprint zero and are linked like any other. Repeated rows stay, each
    with the class of its text. A null doc_id is never the smallest; a component of such rows only has a null id. Other
    columns are left out. No rows: no rows. Texts are read once, in place; then only fingerprints move.
    """
    rows = store(docs.select(F.col("doc_id"), simhash(F.col("text")).alias("fp")), "fingerprints")
    return rows.join(near_groups(rows, **options), "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each near-duplicate group, all its columns as they are: the one with the smallest doc_id (null last),
    among equal ids the smallest text checksum, among equal rows any."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), simhash(F.col("text")).alias("fp"))
    rows = store(rows.withColumn("_tie", F.crc32(F.coalesce("row.text", F.lit("")))), "fingerprinted")
    grouped = rows.join(near_groups(rows.select("doc_id", "fp"), **options), "fp").drop("doc_id")
    order = Window.partitionBy("root").orderBy(F.col("row.doc_id").asc_nulls_last(), "_tie", "fp")
    return grouped.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("row.*")
