"""Packing token sequences by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.running import running

CAPACITY = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# Words whose ids a Python worker remembers; when half of them were met lately, the others go (some 200 bytes a word).
REMEMBERED = 400_000
# Bytes of text that a task works on at a time, longer texts in stretches up to white space.
AT_ONCE = 1 << 20
# Words that the tokenizer encodes at a time when they go one by one: what it returns takes far more room than the ids.
ENCODED = 1000
# Kinds of bytes; the last is the greatest.
_SPACE, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_WORDS: dict[tuple[str, int], "_Words"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Words:
    """Ids of words as little-endian 32-bit numbers.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words in order. Words are
    cut at ASCII white space only; whatever else the tokenizer takes for white space stays inside a word and is left to it.
    It does not merge across the ends of a run of letters or of signs either, nor across a digit's, so a plain word is cut
    there too and its A-Z made small, as the tokenizer does. A word stays whole if it has an apostrophe (``'s`` is one unit),
    a character outside ASCII or the sign that a special token begins with.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        # words met lately, and those of the time before
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.encode = found.encode_batch_fast
        # ids that end a run of letters
        vocabulary = found.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kinds = np.full(256, _SIGN, np.uint8)
        for kind, these in ((_SPACE, b" \t\n\v\f\r"), (_DIGIT, b"0123456789"), (_WHOLE, b"'")):
            self.kinds[list(these)] = kind
        self.kinds[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
        self.kinds[128:] = _WHOLE
        for token in found.get_added_tokens_decoder().values():
            self.kinds[token.content.encode()[0]] = _WHOLE

    def cut(self, raw: np.ndarray, text_ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words and parts of words of some bytes that end in white space, and how many come before each end of a text."""
        kinds = self.kinds[raw]
        solid = kinds != _SPACE
        edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
        if not len(edges):
            return pa.array([], pa.large_string()), np.zeros(len(text_ends), np.int64)
        begin, sizes = edges[::2], edges[1::2] - edges[::2]
        stops = np.cumsum(sizes)
        first = stops - sizes
        raw, kinds = raw[solid], kinds[solid]
        del solid, edges
        at = kinds == _DIGIT
        at[1:] |= kinds[1:] != kinds[:-1]
        big = (raw - np.uint8(65)) < 26
        whole = np.maximum.reduceat(kinds, first) == _WHOLE
        if whole.any():
            apart = np.repeat(~whole, sizes)
            at &= apart
            big &= apart
        at[first] = True
        starts = np.flatnonzero(at)
        data = raw | (big.view(np.uint8) << 5)
        places = pa.py_buffer(np.append(starts, len(data)))
        words = pa.LargeStringArray.from_buffers(len(starts), places, pa.py_buffer(data))
        return words, np.searchsorted(starts, np.r_[0, stops][np.searchsorted(begin, text_ends)])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, one text after the other, and where each text ends. Long texts are worked on in stretches."""
        ended = pc.binary_join_element_wise(texts, pa.scalar("\n", texts.type), pa.scalar("", texts.type))
        text_ends = np.cumsum(pc.binary_length(ended).to_numpy(zero_copy_only=False), dtype=np.int64)
        raw = np.frombuffer(ended.buffers()[2], np.uint8, int(text_ends[-1]))
        ids, ends, begin, n = [], [], 0, 0
        while begin < len(raw):
            stop, look = len(raw), 1 << 12
            if stop - begin > 2 * AT_ONCE:
                at = begin + AT_ONCE
                while not len(found := np.flatnonzero(self.kinds[raw[at : at + look]] == _SPACE)):
                    at, look = at + look, look * 2
                stop = at + int(found[0]) + 1
            here = text_ends[np.searchsorted(text_ends, begin, "right") : np.searchsorted(text_ends, stop, "right")]
            some, some_ends = self.stretch(raw[begin:stop], here - begin)
            ids.append(some)
            ends.append(some_ends + n)
            begin, n = stop, n + len(some)
        return np.concatenate(ids), np.concatenate(ends)

    def stretch(self, raw: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some bytes that end in white space, and where texts end in them. Each different word is looked up once."""
        cut, of_text = self.cut(raw, text_ends)
        coded = cut.dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        parts = list(map(self.known.get, words))
        new = [w for w, p in zip(words, parts, strict=True) if p is None]
        if new:
            found = map(self.learn(new).__getitem__, new)
            parts = [next(found) if p is None else p for p in parts]
        sizes = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        first = np.cumsum(sizes) - sizes
        counts = sizes[at]
        ends = np.cumsum(counts)
        n = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if n + int(sizes.sum()) < 1 << 31 else np.int64
        places = np.repeat((first[at] - (ends - counts)).astype(kind), counts)
        places += np.arange(n, dtype=kind)
        return np.frombuffer(b"".join(parts), "<u4")[places], np.r_[0, ends][of_text]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words not met lately, by word, with those of other words. The letters of many words are encoded at once;
        other words go one by one. Outside ASCII, letters and a full stop or comma have the ids of both, as the tokenizer cuts
        there if its normal form of the letters has letters only.

        Only letters and the other words are remembered, not what is put together from them."""
        known, older, joined, letters, odd = self.known, self.older, {}, [], []
        for word in new:
            if (found := older.get(word)) is not None:
                known[word] = found
            elif word.isascii():
                (letters if word.isalpha() else odd).append(word)
            elif word[-1] in ".," and normalize("NFC", word[:-1]).lower().isalpha():
                joined[word] = (word[:-1], word[-1])
            else:
                (letters if word.isalpha() else odd).append(word)
        if joined:
            more = {part for both in joined.values() for part in both}.difference(known, letters, odd)
            for part in more:
                if (found := older.get(part)) is not None:
                    known[part] = found
                else:
                    (letters if part.isalpha() else odd).append(part)
        for i in range(0, len(letters), 128):
            some = letters[i : i + 128]
            coded = np.array(self.encode([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[coded]) + 1
            if len(ends) == len(some):
                data, cuts = coded.tobytes(), [0, *(ends * 4).tolist()]
                known.update(zip(some, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:
                odd += some
        for i in range(0, len(odd), ENCODED):
            some = odd[i : i + ENCODED]
            for word, coded in zip(some, self.encode(some, add_special_tokens=False), strict=True):
                known[word] = np.array(coded.ids, "<u4").tobytes()
        if not joined:
            return known
        made = {word: known[core] + known[end] for word, (core, end) in joined.items()}
        return made | {word: known[word] for word in new if word not in joined}


def tokenize(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text and the end id; null counts as empty. Some megabytes of text are worked on at a time."""
    key = (path, os.getpid())
    if key not in _WORDS:
        _WORDS[key] = _Words(path)
    texts = texts.fill_null("")
    block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // AT_ONCE
    starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(starts, starts[1:], strict=False):
        ids, ends = _WORDS[key].ids(texts[a:b])
        ids, begin = np.insert(ids, ends, np.uint32(END_ID)), 0
        for end in (ends + np.arange(1, len(ends) + 1)).tolist():
            yield ids[begin:end]
            begin = end


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) cut into pieces of at most ``capacity`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, and ``ids`` if asked for. Null text counts as empty: one piece
    that holds the end id. Texts are read in place and whole; only numbers leave the task unless ids are asked for.
    """
    path = path or tokenizer_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for row, coded in enumerate(tokenize(batch.column("text"), path)):
                for s in range(0, len(coded), capacity):
                    part = coded[s : s + capacity]
                    rows.append(row)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(coded))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            found = [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
            found += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            found += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(found, names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths whose sum is at most ``room`` and closest to it: subset sums as bits of one number, then back.

    Longer lengths come first, each in doubling bundles; the search ends as soon as the room can be filled.
    """
    limit, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(bundle, left)
            steps.append((length, take, reach))
            reach |= (reach << take * length) & limit
            left, bundle = left - take, bundle * 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, each, sequence, offset): pieces of a length ranked first..last lie ``each`` to a sequence
    from ``sequence`` on, the first of them at ``offset``.

    A window is opened by the longest piece left and filled by :func:`fullest`; the same filling is repeated as long as the
    counts allow, so the plan's size depends on the capacity and not on the number of pieces.
    """
    left, used, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * times - 1, n, sequence, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, start, length, ..) with sequence_id and offset: sequences of at most ``capacity`` ids, little padded.

    Only the histogram of lengths, at most ``capacity`` rows, comes to the driver; the plan made from it is bounded the same
    way and is broadcast. Pieces of one length are ranked by distributed sums, however many they are, and each finds its
    place by its rank. Repeated rows each get a place. No rows: no rows.
    """
    spark = cut.sparkSession
    rows = cut.withColumn("_one", F.lit(1).cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("start"), F.col("ids_crc32")]
    ranked = running(rows, "length", order, "_one", "_rank", "pieces", settle=True).drop("_one")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    kinds = "_length long, _first long, _last long, _each long, _sequence long, _offset long"
    windows = F.broadcast(spark.createDataFrame(plan(counts, capacity), kinds))
    here = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    place = F.col("_rank") - F.col("_first")
    sequence = F.col("_sequence") + F.floor(place / F.col("_each")).cast("long")
    offset = F.col("_offset") + F.pmod(place, F.col("_each")) * F.col("length")
    return (
        ranked.join(windows, here)
        .withColumn("sequence_id", sequence)
        .withColumn("offset", offset)
        .drop("_rank", "_length", "_first", "_last", "_each", "_sequence", "_offset")
    )


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Packed pieces with ids -> sequence_id, tokens, ids: padded to ``capacity`` except where the length is a power of two.

    A sequence is at most ``capacity`` ids, so its group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), parts.alias("_parts"))
    ids = F.flatten(F.transform("_parts", lambda p: p["ids"]))
    padding = F.when(F.bit_count("tokens") == 1, 0).otherwise(F.lit(capacity) - F.col("tokens")).cast("int")
    return rows.select("sequence_id", "tokens", F.concat(ids, F.array_repeat(F.lit(pad_id), padding)).alias("ids"))
