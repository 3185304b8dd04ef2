"""Product names against alias tables of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.constants import PRODUCT_ALIASES
from exposure.functions.text import strip
from exposure.session import store

KNOWN = "_known"
# Marks of the aliases' hashes: words of 64 bits, 16 bits an alias, 64 MB at most. A piece is kept if all its marks are set.
MAX_WORDS = 1 << 23
PROBES = 4
# Bytes of texts that are cut at a time.
BLOCK = 1 << 19
# Bytes of one batch of pieces, with their texts.
BATCH = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_TURNS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def alias_entries(alias_rows: DataFrame, builtin: bool = True) -> DataFrame:
    """``alias, product_key`` and the place of each entry: built-in ones in their order, then rows by key and alias.

    Aliases are compared trimmed and in lower case; blank ones are left out. A row that extends a built-in key stands behind that key's
    own names. An entry that occurs more than once counts once.
    """
    own = alias_rows.select(F.lower(strip("alias")).alias("alias"), "product_key").where("alias <> '' AND product_key IS NOT NULL").distinct()
    fixed = [(a, k, i, j) for i, (k, names) in enumerate(PRODUCT_ALIASES.items()) for j, a in enumerate(names)] if builtin else []
    table = alias_rows.sparkSession.createDataFrame(fixed, "alias string, product_key string, _key int, _name int")
    keys = table.select("product_key", "_key").distinct()
    late = F.lit(1 << 30)
    more = own.join(table.select("alias", "product_key"), ["alias", "product_key"], "left_anti").join(keys, "product_key", "left")
    more = more.select("alias", "product_key", F.coalesce("_key", late).alias("_key"), late.alias("_name"))
    return table.unionByName(more)


def _sums(data: np.ndarray) -> np.ndarray:
    """``H`` with ``H[i]`` the sum of ``data[j] * BASE ** -j`` below ``i``, modulo 2 ** 64: a stretch has the same sum anywhere but for a factor."""
    back = np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64)
    back[:1] = 1
    return np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(back))]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _bits(hashes: np.ndarray, probe: int, words: int) -> np.ndarray:
    """Place of a hash's mark; ``words`` is a power of two."""
    turned = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_TURNS[probe])
    return (turned >> np.uint64(65 - (words * 64).bit_length())).astype(np.int64)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of some texts, and where each begins; the last entry is the end."""
    texts = texts.cast(pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return body[starts[0] : starts[-1]], starts - starts[0]


def _alias_marks(aliases: DataFrame, words: int) -> np.ndarray:
    """Marks of all aliases: each has ``PROBES`` bits of ``words`` words set."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts = _buffers(batch.column(0))
            sums, powers = _sums(data), _powers(int(starts[-1]) + 1)
            hashes = (sums[starts[1:]] - sums[starts[:-1]]) * powers[starts[:-1]]
            places = np.unique(np.concatenate([_bits(hashes, p, words) for p in range(PROBES)]))
            bits = np.uint64(1) << (places & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array(bits.view(np.int64))], ["word", "bit"])

    rows = aliases.select("alias").mapInArrow(marks, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = rows.toArrow()
    out = np.zeros(words, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _pieces(data: np.ndarray, starts: np.ndarray, lengths: Sequence[int], marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Stretches of the given lengths in bytes, within one text and on whole letters, whose marks are all set, equal ones of a text
    once a block: text, place, length."""
    total, longest = len(data), max(lengths)
    for at in range(0, total, BLOCK):
        until = min(at + BLOCK, total)
        block = data[at : min(until + longest + 1, total)]
        sums, powers = _sums(block), _powers(until - at)
        text = np.searchsorted(starts, np.arange(at, until), "right") - 1
        left = starts[text + 1] - np.arange(at, until)
        inner = np.r_[(block & 0xC0) == 0x80, False]  # bytes inside a letter
        left[inner[: until - at]] = 0
        for n in lengths:
            place = np.flatnonzero(left >= n)
            place = place[(left[place] == n) | ~inner[place + n]]
            hashes = (sums[place + n] - sums[place]) * powers[place]
            for probe in range(PROBES):
                bit = _bits(hashes, probe, len(marks))
                kept = (marks[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) != 0
                place, hashes = place[kept], hashes[kept]
            if len(place):
                order = np.lexsort((hashes, text[place]))
                own, hashes = text[place][order], hashes[order]
                first = np.r_[True, (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])]
                yield own[first], place[order][first] + at, n


def alias_pieces(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``text, alias``: pieces of the texts that may be an alias. Every alias a text holds is among them, and few others.

    Pieces are told from aliases by marks of their hashes, a table of bounded size that every task gets; only the few that pass leave
    their task. The texts of a batch count once each.
    """
    told = aliases.agg(F.count("*"), F.collect_set(F.octet_length("alias"))).first()  # one row; as many lengths as aliases have
    lengths = sorted(told[1])
    if not lengths:
        return texts.select("text", F.col("text").alias("alias")).where("false")
    words = min(MAX_WORDS, max(1 << 10, 1 << (int(told[0]) // 4).bit_length()))
    shared = texts.sparkSession.sparkContext.broadcast(_alias_marks(aliases, words))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            own = batch.column(0).drop_null().unique()
            if not len(own):
                continue
            data, starts = _buffers(own)
            for text, place, n in _pieces(data, starts, lengths, marks):
                filled = np.cumsum(starts[text + 1] - starts[text] + 9 * n) // BATCH
                for some in np.split(np.arange(len(place)), np.flatnonzero(np.diff(filled)) + 1):
                    body = data[place[some][:, None] + np.arange(n)].reshape(-1)
                    offsets = np.arange(0, len(some) * n + 1, n, dtype=np.int64)
                    found = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(offsets), pa.py_buffer(body)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(text[some])), found], ["text", "alias"])

    return texts.select("text").mapInArrow(cut, "text string, alias string")


def longest_aliases(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """``text`` to the longest alias it holds: ``text, known`` (alias, key); texts without any are left out.

    Pieces of the texts (:func:`alias_pieces`) meet the aliases by equality, so no text is held against the whole table. Aliases of
    the same length are decided by their place, as in a table that is searched in order.
    """
    cut = alias_pieces(texts, entries)
    rank = F.struct(-F.char_length("alias"), "_key", "product_key", "_name", "alias")
    return cut.join(entries, "alias").groupBy("text").agg(F.min_by(F.struct("alias", F.col("product_key").alias("key")), rank).alias("known"))


def with_known(df: DataFrame, raw: Column, alias_rows: DataFrame, builtin: bool = True) -> DataFrame:
    """``df`` with the column ``_known``: the longest alias contained in the trimmed lower-case text, and its key; null without one.

    For ``normalize_product`` and ``split_product_version``, which take it instead of a table that is part of the plan.
    """
    text = F.lower(strip(F.coalesce(raw, F.lit(""))))
    # both are written once: the entries are read three times, and Spark sees the size of what was found before it deals out the rows
    entries = store(alias_entries(alias_rows, builtin), "aliases")
    found = store(longest_aliases(df.select(text.alias("text")), entries), "known-aliases")
    rows = df.withColumn("_text", text)
    return rows.join(found.select(F.col("text").alias("_text"), F.col("known").alias(KNOWN)), "_text", "left").drop("_text")
