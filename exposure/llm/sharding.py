"""Sharding by jump consistent hashing: no ring table, and appended shards draw only the rows that move into them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm.running import running

# Fixed values of the published algorithm (a 64-bit linear congruential step and 2^31).
STEP = 2862933555777941757
SPAN = float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; the work per key grows with the logarithm of the number of shards."""
    state = keys.astype(np.uint64)
    at = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(STEP) + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((at[live] + 1) * (SPAN / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def stable_key(key: Column) -> Column:
    """60 bits of the MD5 of the key's text, the same in every engine and release; a null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """Shard from 0 to ``shards - 1``, decided by the key and the number of shards alone."""
    if shards < 1:
        raise ValueError("there must be at least one shard")

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return jump(stable_key(key))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, more: int = 1) -> DataFrame:
    """Every row with its shard, its place in the shard and its shard after ``more`` shards are appended.

    Columns: ``key``, size (UTF-8 bytes plus 1), text_crc32 (unsigned, UTF-8), law ('key'), shard, slot (gapless from 0 in
    key order), grown_shard. A row's grown shard is its old one or one of the new ones.

    Null text: size 1, checksum of no bytes. Null key: sharded as the empty text. Repeated rows and ties each get a slot of
    their own. No rows: no rows. Other columns are left out, so their names cannot clash. Texts are read in place; only
    numbers are shuffled, and a shard of any size is numbered by many tasks.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + more).alias("grown_shard"),
        F.lit(1).cast("long").alias("_one"),
    )
    order = [F.col(key).asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    return running(rows, "shard", order, "_one", "slot", "shards").drop("_one")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = 16, files: int = 1) -> None:
    """Write the rows as one folder per shard; a shard is split by key hash over ``files`` tasks so that it is never one task."""
    shard = shard_of(F.col(key), shards)
    slice_of = F.pmod(F.xxhash64(*docs.columns), F.lit(files))
    (
        docs.withColumn("_shard", shard)
        .repartition(shards * files, "_shard", slice_of)
        .write.partitionBy("_shard")
        .parquet(path)
    )
