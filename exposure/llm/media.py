"""Interleaved documents: HTML becomes an ordered sequence of texts and media, whose payloads are joined by digest."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from exposure.session import store

FIELDS = ("kind", "text", "caption", "ref", "digest")
SEQUENCE = ArrayType(StructType([StructField("position", IntegerType()), *[StructField(f, StringType()) for f in FIELDS]]))
MEDIA_TAGS = {"img", "video", "audio", "source", "embed"}
# Elements that end a run of text, and elements whose text is not shown.
BLOCKS = {
    "p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th",
    "blockquote", "pre", "figure", "figcaption", "header", "footer", "nav", "main", "aside", "body", "br", "hr", "title",
}
HIDDEN = {"script", "style", "template", "noscript"}
_DIGEST = re.compile(r"^media:([0-9a-f]{64})$")
_SPACE = re.compile(r"\s+")


class _Sequence(HTMLParser):
    """Texts and media in document order; the caption of a figure goes to the figure's media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.hidden, self.figures, self.caption = [], [], 0, [], None

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if not text:
            return
        if self.caption is not None:
            self.caption.append(text)
        else:
            self.items.append({"kind": "text", "text": text, "caption": None, "ref": None, "digest": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append((len(self.items), []))
        elif tag == "figcaption" and self.figures:
            self.caption = self.figures[-1][1]
        elif tag in MEDIA_TAGS:
            given = dict(attrs)
            ref = given.get("src")
            if ref:
                self.flush()
                found = _DIGEST.match(ref)
                self.items.append(
                    {"kind": tag, "text": None, "caption": given.get("alt"), "ref": ref, "digest": found and found[1]}
                )

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.caption = None
        elif tag == "figure" and self.figures:
            self.caption = None
            first, words = self.figures.pop()
            for item in self.items[first:] if words else ():
                if item["ref"] is not None:
                    item["caption"] = " ".join(words)

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def parse_html(html: str | None) -> list[dict]:
    """Ordered items of a page: position, kind ('text' or the tag), text, caption, ref, digest."""
    reader = _Sequence()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    while reader.figures:
        reader.handle_endtag("figure")
    return [{"position": i} | item for i, item in enumerate(reader.items)]


@F.arrow_udf(SEQUENCE)
def html_sequence(pages: pa.Array) -> pa.Array:
    fields = [("position", pa.int32()), *[(f, pa.string()) for f in FIELDS]]
    return pa.array([parse_html(p) for p in pages.to_pylist()], pa.list_(pa.struct(fields)))


def interleave(pages: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages (key, html) as sequences: key, sequence; each item has position, kind, text, caption, ref, digest and ``media``.

    ``media`` (digest and any other columns) is what the references are resolved with: payloads, or what was worked out from
    them where they are stored. A digest counts once, however often it was stored, so the join keeps one row per reference;
    a digest that very many pages refer to is a skewed but many-to-one join, which Spark splits. Positions and captions stay
    with their items; an unknown or missing digest leaves ``media`` null.

    Null or empty html: an empty sequence. Repeated pages and null keys stay rows of their own. Columns of ``media`` may have
    any name, they become fields of one struct; other columns of ``pages`` are left out. No rows: no rows.
    """
    parsed = pages.select(F.col(key).alias(key), html_sequence(F.col("html")).alias("_items"))
    parsed = parsed.withColumn("_page", F.monotonically_increasing_id())
    items = parsed.select(key, "_page", F.explode_outer("_items").alias("_item"))
    known = media.where("digest IS NOT NULL").dropDuplicates(["digest"])
    known = known.select(F.col("digest").alias("_digest"), F.struct("*").alias("_media"))
    # items without a digest find nothing; a key of their own keeps them from meeting in one task
    own = F.concat_ws(":", F.lit("none"), "_page", "_item.position")
    found = items.join(known, F.coalesce("_item.digest", own) == F.col("_digest"), "left")
    item = F.struct(*[F.col(f"_item.{f}").alias(f) for f in ("position", *FIELDS)], F.col("_media").alias("media"))
    placed = F.collect_list(F.when(F.col("_item").isNotNull(), F.struct(F.col("_item.position").alias("at"), item.alias("item"))))
    rows = found.groupBy("_page", F.col(key)).agg(placed.alias("_placed"))
    # positions are unique within a page, so only they are compared
    ordered = F.array_sort("_placed", lambda a, b: a["at"] - b["at"])
    return rows.select(key, F.transform(ordered, lambda p: p["item"]).alias("sequence"))


# ---- payloads as images: 8-bit grey samples, WIDTH to a row, in PNG files ----

WIDTH = 64
_SIGN = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """Bytes as an 8-bit grey image, filled up with zeros to whole rows, at least one; their number is kept in a text chunk."""
    rows = max(1, -(-len(data) // WIDTH))
    samples = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with its filter type, none
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    samples[:, 1:] = flat.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    size = b"bytes\0" + str(len(data)).encode()
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"tEXt", size) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows x WIDTH) and the number of bytes that were stored; raises if the file is damaged."""
    if png[:8] != _SIGN:
        raise ValueError("not a PNG file")
    at, packed, n = 8, [], None
    while at < len(png):
        (size,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(data)
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            n = int(data[6:])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, WIDTH + 1)
    if n is None or rows[:, 0].any():
        raise ValueError("not written by this module")
    return rows[:, 1:], n


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation and a 64-bit average hash of the image scaled to 8 by 8, as one text."""
    rows = len(samples)
    across = samples.reshape(rows, 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    edges = np.arange(9) * rows // 8
    sums = np.r_[np.zeros((1, 8), np.int64), across.cumsum(axis=0)]
    low, high = edges[:-1], np.maximum(edges[1:], np.minimum(edges[:-1] + 1, rows))
    boxes = (sums[high] - sums[low]) / ((high - low)[:, None] * (WIDTH // 8))
    bits = "".join("1" if x else "0" for x in (boxes > boxes.mean()).ravel())
    return f"{WIDTH}x{rows} mean {samples.mean():.4f} std {samples.std():.4f} ahash {int(bits, 2):016x}"


def store_payloads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as images in the shared folder: key, digest (SHA-256 of the file), media. Null text counts as empty."""
    kind = docs.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(1).cast(pa.binary()).fill_null(b"")
            # a bounded number of rows at a time, as payload and image are held together
            for i in range(0, batch.num_rows, 256):
                files = [to_png(p.as_py()) for p in payloads[i : i + 256]]
                digests = [hashlib.sha256(f).hexdigest() for f in files]
                columns = [batch.column(0)[i : i + 256], pa.array(digests), pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [key, "digest", "media"])

    rows = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    return store(rows.mapInArrow(write, f"{key} {kind}, digest string, media binary"), "media")


def payload_features(stored: DataFrame) -> DataFrame:
    """What the stored files hold, worked out where they are read, so that no payload is shuffled.

    Columns: digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = (
        "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                png = file.as_py()
                samples, n = from_png(png)
                payload = samples.tobytes()
                rows.append(
                    (
                        digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
                        len(png), hashlib.sha256(png).hexdigest(), feature(samples),
                    )
                )
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return stored.select("digest", "media").mapInArrow(read, schema)


def payload_page(key: Column, digest: Column) -> Column:
    """A page that shows a document's payload as a captioned figure between two lines of text."""
    name = F.concat(F.lit("document "), F.coalesce(key.cast("string"), F.lit("without id")))
    parts = ["<article><p>Payload of ", name, '</p><figure><img src="media:', digest, '"><figcaption>', name, "</figcaption></figure><p>End.</p></article>"]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
