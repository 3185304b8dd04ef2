"""Fill-in-the-middle by piece tables: a document is a list of descriptors over two buffers that never change.

The *text* buffer holds the document's UTF-8 bytes, the *marks* buffer holds the sentinels. A descriptor names a buffer, a start
and a length in bytes. Cutting a document splits descriptors, an arrangement permutes them and puts descriptors of sentinels
between, the inverse permutation restores the document, and digests read the bytes that descriptors name one after the other.
No text is copied before somebody asks for the arranged one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = PREFIX + SUFFIX + MIDDLE
TEXT, MARK = 0, 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20
SEED = 1
# Sentinel and part (0 prefix, 1 middle, 2 suffix) in the order in which a form writes them.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
# Bytes that are looked at together when tokens are counted.
_CHUNK = 1 << 20
# Kind of a byte: 0 goes on with a character, 1 is a letter A-Z or a-z, 2 begins any other character.
_KIND = np.full(256, 2, np.uint8)
_KIND[0x80:0xC0] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_ARRANGED = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,pieces:array<struct<buffer:int,start:long,length:long>>>"

Piece = tuple[int, int, int]


def _starts(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Where the tokens ``[A-Za-z]+|[^A-Za-z]`` begin, chunk by chunk: (offset of the chunk, flags)."""
    before = 2
    for at in range(0, len(data), _CHUNK):
        kind = _KIND[data[at : at + _CHUNK]]
        previous = np.r_[np.uint8(before), kind[:-1]]
        yield at, (kind == 2) | ((kind == 1) & (previous != 1))
        before = int(kind[-1])


def n_tokens(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero(flags)) for _, flags in _starts(data))


def offset(data: np.ndarray, tokens: int) -> int:
    """Bytes that the first ``tokens`` tokens take."""
    seen = 0
    for at, flags in _starts(data):
        here = int(np.count_nonzero(flags))
        if seen + here > tokens:
            return at + int(np.flatnonzero(flags)[tokens - seen])
        seen += here
    return len(data)


def chars(data: np.ndarray) -> int:
    """Code points of a stretch of UTF-8."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def cut(pieces: Iterable[Piece], at: int) -> list[Piece]:
    """The same bytes with a boundary after the first ``at`` of them: at most one descriptor is split."""
    out = []
    for buffer, start, length in pieces:
        if 0 < at < length:
            out += [(buffer, start, at), (buffer, start + at, length - at)]
        else:
            out.append((buffer, start, length))
        at -= length
    return out


def take(pieces: Iterable[Piece], start: int, stop: int) -> list[Piece]:
    """Descriptors of the bytes from start to stop."""
    out, at = [], 0
    for piece in cut(cut(pieces, start), stop):
        if start <= at and at + piece[2] <= stop and piece[2]:
            out.append(piece)
        at += piece[2]
    return out


def arrange(pieces: list[Piece], first: int, second: int, total: int, form: str) -> list[Piece]:
    """Parts of a document in the order of a form, each after its sentinel."""
    if form == "plain":
        return pieces
    parts = [take(pieces, 0, first), take(pieces, first, second), take(pieces, second, total)]
    out: list[Piece] = []
    for mark, part in FORMS[form]:
        out += [(MARK, MARKS.index(mark), len(mark)), *parts[part]]
    return out


def parts_of(output: bytes, form: str) -> list[Piece]:
    """Descriptors, over an arranged text, of the document it came from: its parts in the inverse permutation.

    The document held no sentinel and a sentinel cannot overlap another, so each is found at its first place.
    """
    if form == "plain":
        return [(TEXT, 0, len(output))]
    order = FORMS[form]
    at = [output.index(mark) for mark, _ in order]
    found: list[Piece] = [(TEXT, 0, 0)] * len(order)
    for (mark, part), start, stop in zip(order, at, [*at[1:], len(output)], strict=True):
        found[part] = (TEXT, start + len(mark), stop - start - len(mark))
    return found


def stream(pieces: Iterable[Piece], text: bytes) -> Iterator[memoryview]:
    """The bytes that descriptors name, in order, without putting them together."""
    buffers = (memoryview(text), memoryview(MARKS))
    for buffer, start, length in pieces:
        yield buffers[buffer][start : start + length]


def digest(pieces: Iterable[Piece], text: bytes) -> str:
    found = hashlib.sha256()
    for part in stream(pieces, text):
        found.update(part)
    return found.hexdigest()


def describe(text: bytes, draws: str, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> dict:
    """Piece table of one document. ``draws`` is a hex digest; its first four groups of 8 digits choose the two cuts,
    whether the document is rearranged, and how."""
    data = np.frombuffer(text, np.uint8)
    n = n_tokens(data)
    h1, h2, h3, h4 = (int(draws[i : i + 8], 16) for i in range(0, 32, 8))
    whole = [(TEXT, 0, len(text))]
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain_percent:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "pieces": _named(whole)}
    first, second = (offset(data, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    pieces = arrange(whole, first, second, len(text), form)
    return {"n": n, "form": form, "prefix_chars": chars(data[:first]), "middle_chars": chars(data[first:second]), "pieces": _named(pieces)}


def _named(pieces: list[Piece]) -> list[dict]:
    return [{"buffer": b, "start": s, "length": length} for b, s, length in pieces]


def _plain(pieces: list[dict]) -> list[Piece]:
    return [(p["buffer"], p["start"], p["length"]) for p in pieces]


def piece_tables(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED,
    plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, with_output: bool = False,
) -> DataFrame:
    """Every document with its piece table: doc_id, text, n, form, prefix_chars, middle_chars, pieces.

    ``with_output`` adds the arranged text (``output``) and its SHA-256 in hex digits (``output_sha256``), read through the descriptors.

    The document is cut into n tokens (a run of A-Z and a-z, or any other character). The cuts and the form follow from the
    SHA-256 of ``seed:doc_id``, so reruns agree and repeated rows get the same table; a null doc_id counts as an empty one. A null
    text counts as empty. Empty texts, texts that hold a sentinel and ``plain_percent`` of the others stay plain (prefix_chars and
    middle_chars null). Texts of any length are read in place, a stretch at a time. Other columns of ``docs`` are left out.
    No rows: no rows.
    """
    wanted = _ARRANGED[:-1] + ",output:string,output_sha256:string>" if with_output else _ARRANGED

    @F.arrow_udf(wanted)
    def describe_all(texts: pa.Array, draws: pa.Array) -> pa.Array:
        found, outputs, digests = [], [], []
        for t, d in zip(texts.cast(pa.binary()), draws, strict=True):
            raw = t.as_py()
            told = describe(raw, d.as_py(), plain_percent, spm_percent)
            found.append(told)
            if with_output:
                pieces = _plain(told["pieces"])
                outputs.append(b"".join(stream(pieces, raw)))
                digests.append(digest(pieces, raw))
        tables = pa.array(found, _TABLE)
        if not with_output:
            return tables
        columns = [*tables.flatten(), pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())]
        return pa.StructArray.from_arrays(columns, [*_TABLE.names, "output", "output_sha256"])

    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), draws.alias("_draws"))
    told = rows.withColumn("_table", describe_all("text", "_draws"))
    return told.select("doc_id", "text", "_table.*")


_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
_TABLE = pa.struct(
    [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("pieces", _PIECES)]
)


@F.arrow_udf(StringType())
def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The document's own text from an arranged one and the name of its form."""
    out = []
    for o, f in zip(output.cast(pa.binary()), form, strict=True):
        text = o.as_py()
        out.append(b"".join(stream(parts_of(text, f.as_py()), text)))
    return pa.array(out, pa.binary()).cast(pa.string())


@F.arrow_udf(StringType())
def restored_sha256(output: pa.Array, form: pa.Array) -> pa.Array:
    """SHA-256 (hex) of the restored text, read through the descriptors over the arranged one."""
    out = []
    for o, f in zip(output.cast(pa.binary()), form, strict=True):
        text = o.as_py()
        out.append(digest(parts_of(text, f.as_py()), text))
    return pa.array(out, pa.string())


def transform(docs: DataFrame, **options) -> DataFrame:
    """``piece_tables`` with the arranged text as ``output`` and its digest as ``output_sha256``; rows as there."""
    return piece_tables(docs, with_output=True, **options)


def restore(outputs: DataFrame, text: str = "restored") -> DataFrame:
    """Rows with ``output`` and ``form``, and the exact text they came from. A null output or form gives null."""
    exact = F.when(F.col("output").isNotNull() & F.col("form").isNotNull(), restored(F.coalesce("output", F.lit("")), F.coalesce("form", F.lit("plain"))))
    return outputs.withColumn(text, exact)
