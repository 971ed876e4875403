"""Interleaved sequences of text and media, with payloads resolved by digest.

HTML events yield each page's ordered items: text, or a reference to a medium by the SHA-256 of its payload, with its caption.
A store holds each payload once, as a greyscale PNG of 8-bit samples 24 wide (lossless; equal payloads have equal files), and
is joined to the references by digest; text items are not moved for that. Both come together again as one array of structs per
page, in page order, so positions and captions stay aligned with the media. Copies meet in the store before they are moved: a
digest is encoded and shuffled once for each task that has it.

Payloads are UTF-8 texts padded with bytes 255, which UTF-8 never holds, to a positive multiple of 576. Null or empty texts
are one block of padding. Repeated rows have sequences of their own that refer to one stored payload; rows that share an id
but not the page are pages of their own. A reference whose digest is not in the store keeps its place with a null medium; a page
without items (null, empty) has no sequence. Very long texts are one medium each. Ties don't occur, as positions differ. Empty
tables give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import by_chunks, doc_texts, map_arrow, text_or_empty

BLOCK, WIDTH, PAD = 576, 24, b"\xff"
PNG_HEAD = b"\x89PNG\r\n\x1a\n"

ITEMS = pa.schema([("page_id", pa.int64()), ("page_key", pa.int64()), ("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
STORE = pa.schema([("digest", pa.string()), ("media", pa.binary())])
FEATURES = pa.schema(
    [("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
     ("media_sha256", pa.string()), ("feature", pa.string())]
)
PAGES = pa.schema([("doc_id", pa.int64()), ("html", pa.string())])


def padded(text: bytes) -> bytes:
    return text + PAD * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def to_png(payload: bytes) -> bytes:
    """Rows of 24 samples, filter 0."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, data, height = 8, [], 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            height = struct.unpack_from(">II", body)[1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and a 64-bit average hash over an 8 x 8 grid, as hexadecimal digits."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    grid = np.add.reduceat(x.reshape(len(x), 8, 3).sum(axis=2, dtype=np.int64), np.arange(8) * len(x) // 8, axis=0)
    sizes = np.diff(np.append(np.arange(8) * len(x) // 8, len(x)))[:, None] * 3
    bits = grid / sizes > x.mean()
    return f"{int(round(x.mean() * 256)):04x}{int(round(x.std() * 256)):04x}{np.packbits(bits).tobytes().hex()}"


class _Items(HTMLParser):
    """Ordered items of a page; a figure's caption goes to its media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.items.append(["text", text, None, None])
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "div", "figure", "br", "li", "h1", "h2", "h3", "h4", "article", "section"):
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            a = dict(attrs)
            src = a.get("src") or ""
            if src.startswith("sha256:"):
                self.flush()
                self.items.append(["media", None, src[7:], a.get("alt")])

    def handle_endtag(self, tag: str) -> None:
        if tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            for item in self.items[self.figure :]:
                if item[0] == "media":
                    item[3] = words
            self.caption = None
        elif tag in ("p", "div", "figure", "li", "h1", "h2", "h3", "h4", "article", "section"):
            self.flush()

    def handle_data(self, data: str) -> None:
        (self.text if self.caption is None else self.caption).append(data)


def items_of(html: str) -> list[list]:
    p = _Items()
    p.feed(html)
    p.close()
    p.flush()
    return p.items


def items(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(page_id, page_key, position, kind, text, digest, caption) in page order; page_key tells pages that share an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_chunks(batches, "html"):
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, k, n, *item) for i, k, t in zip(ids, keys, texts, strict=True) for n, item in enumerate(items_of(t.decode("utf-8", "replace")))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(ITEMS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, ITEMS, strict=True)], schema=ITEMS)

    own = pages.select(F.col(page_id).cast("long").alias("page_id"), text_or_empty("html").alias("html"))
    return map_arrow(own.select("page_id", F.xxhash64("page_id", "html").alias("page_key"), "html"), run, ITEMS)


def document_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, html): each document as a page whose text stands as a medium, referred to by digest, between two paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_chunks(batches):
            pages = []
            for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                whole = padded(t)
                figure = f'<figure><img src="sha256:{sha256(whole).hexdigest()}"><figcaption>{len(t)} bytes &amp; padding</figcaption></figure>'
                pages.append(f"<article><h1>Document {i}</h1>{figure}<p>{len(whole)} bytes</p></article>")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string())], schema=PAGES)

    return map_arrow(doc_texts(docs), run, PAGES)


def media_store(docs: DataFrame) -> DataFrame:
    """(digest, media): each distinct payload once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_chunks(batches):
            own = {sha256(p).hexdigest(): p for p in map(padded, texts)}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([to_png(p) for p in own.values()], pa.binary())], schema=STORE)

    return map_arrow(doc_texts(docs), run, STORE).dropDuplicates(["digest"])


def media_features(store: DataFrame) -> DataFrame:
    """What the stored bytes say, read back: one row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = from_png(media)
                rows.append((digest, len(payload.rstrip(PAD)), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha256(media).hexdigest(), feature(payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, FEATURES, strict=True)], schema=FEATURES)

    return map_arrow(store.select("digest", "media"), run, FEATURES)


def interleaved(page_items: DataFrame, store: DataFrame, *columns: str) -> DataFrame:
    """(page_id, page_key, items): each page's items in page order, as an array of structs (position, kind, text, digest, caption,
    and the given columns of the store, null for text and for media that the store lacks). Pages that repeat have a row each."""
    own = store.select(F.col("digest").alias("_d"), *(F.col(c).alias(f"_{c}") for c in columns))
    media = page_items.filter("kind = 'media'").join(own, F.col("digest") == F.col("_d"), "left")
    text = page_items.filter("kind <> 'media'")
    for c in columns:
        text = text.withColumn(f"_{c}", F.lit(None).cast(store.schema[c].dataType))
    item = F.struct("position", "kind", "text", "digest", "caption", *(F.col(f"_{c}").alias(c) for c in columns))
    both = media.drop("_d").unionByName(text)
    # copies of a page have equal items: they are gathered once and counted
    pages = both.groupBy("page_id", "page_key").agg(F.sort_array(F.collect_set(item)).alias("items"), F.count("*").alias("n"))
    return pages.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / F.size("items")).cast("int")))).select("page_id", "page_key", "items")


def document_media(docs: DataFrame) -> DataFrame:
    """One row per document: the medium of its page's sequence, with position, caption and the number of the page's items."""
    names = FEATURES.names[1:]
    pages = interleaved(items(document_pages(docs), "doc_id"), media_features(media_store(docs)), *names)
    found = pages.select(F.col("page_id").alias("doc_id"), F.size("items").alias("n_items"), F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("m"))
    return found.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in (*names, "position", "caption")), "n_items")
