"""Interleaved documents: ordered text and media references, payloads resolved by digest.

A page's HTML becomes a sequence of items: stretches of visible text and media
references (``img``, ``source``, ``video``, ``audio``), numbered in document
order, each reference with its caption.  Payloads live once per digest in a
media table; sequences refer to them by digest, and a join on the digest
resolves them.  What the join carries is chosen by the caller: the payload, or
columns computed from it beforehand, one row for each distinct digest, so that
an image used by a third of all pages is read and described once.

Payloads that are not images yet are stored as 8-bit grey images of width 64
(binary PGM), padded with zero bytes to whole rows: lossless, and readable by
any image library.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm import kernels as K
from curatrix.llm import skew, workers
from curatrix.session import materialize, ship_package

WIDTH = 64
#: Digests that a task remembers having stored (some 60 MB); beyond it, copies may be stored again.
SEEN = 500_000
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string,n_bytes:long>>"
_MEDIA = {"img", "source", "video", "audio"}
_SILENT = {"script", "style", "template", "noscript"}
_BLOCK = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "table", "ul", "ol", "blockquote", "pre", "td", "th", "body", "header", "footer", "nav", "hr"}
_SHA = re.compile(r"[0-9a-f]{64}\Z")


def reference_digest(src: str) -> str | None:
    """The digest a reference names (``sha256:<hex>``), or that of its address; None without one."""
    if not src:
        return None
    if src.startswith("sha256:") and _SHA.match(src[7:]):
        return src[7:]
    return hashlib.sha256(src.encode("utf-8", "surrogatepass")).hexdigest()


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._silent = 0
        self._figure: list[int] = []
        self._caption: list[str] | None = None

    def _flush(self) -> None:
        text = re.sub(r"[ \t\r\n\f]+", " ", "".join(self._text)).strip()
        self._text = []
        if text:
            self._add("text", text=text)

    def _add(self, kind: str, text: str | None = None, digest: str | None = None, caption: str | None = None, n_bytes: int | None = None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "digest": digest, "caption": caption, "n_bytes": n_bytes})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self._silent += 1
        if self._silent:
            return
        if tag in _BLOCK:
            self._flush()
        if tag == "figure":
            self._figure.append(len(self.items))
        elif tag == "figcaption":
            self._flush()
            self._caption = []
        elif tag in _MEDIA:
            a = dict(attrs)
            digest = reference_digest((a.get("src") or "").strip())
            if digest:
                self._flush()
                size = a.get("data-bytes") or ""
                self._add("media", digest=digest, caption=(a.get("alt") or "").strip() or None, n_bytes=int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self._silent:
            self._silent -= 1
        elif tag == "figcaption" and self._caption is not None:
            caption = re.sub(r"[ \t\r\n\f]+", " ", "".join(self._caption)).strip()
            self._caption = None
            if self._figure and caption:
                for item in self.items[self._figure[-1] :]:
                    if item["kind"] == "media":
                        item["caption"] = caption
            elif caption:
                self._add("text", text=caption)
        elif tag == "figure" and self._figure:
            self._flush()
            self._figure.pop()
        elif tag in _BLOCK:
            self._flush()

    def handle_data(self, data: str) -> None:
        if not self._silent:
            (self._text if self._caption is None else self._caption).append(data)


def parse_page(html: str | None) -> list[dict]:
    """Ordered items of a page; a figure's caption goes with every reference in it, else ``alt`` does.

    Null or empty pages have none.  Tags that are never closed are closed by the end.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader._caption is not None:
        reader.handle_endtag("figcaption")
    reader._flush()
    return reader.items


def parse_pages(pages: DataFrame, html: str = "html", keep: str = "page_id") -> DataFrame:
    """``keep, items``: the sequence of each row of ``pages``.

    Null and empty pages give empty sequences, repeated rows one each, an empty
    table none.  Columns but ``keep`` and ``html`` are ignored.
    """
    ship_package(pages.sparkSession)
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in K.pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([parse_page(h) for h in texts], kind)], [keep, "items"])

    rows = pages.select(keep, F.col(html).cast("string").alias("_html"))
    return rows.mapInArrow(workers.task("media", run, _nothing), f"`{keep}` {rows.schema[0].dataType.simpleString()}, items {ITEMS}")


def resolve(sequences: DataFrame, media: DataFrame, columns: list[str], keep: str = "page_id") -> DataFrame:
    """Every media reference with ``columns`` of its digest's row in ``media``: a left equi-join.

    ``media`` may repeat a digest (equal bytes, equal columns); it is reduced to
    one row a digest first.  References to unknown digests get nulls; sequences
    without references give no rows.  The result has ``keep, position, digest,
    caption, n_bytes`` and ``columns``.  The references are written once, so that
    a digest that very many pages share is known and is not joined in one task.
    """
    refs = sequences.select(keep, F.explode("items").alias("_i")).where("_i.kind = 'media'").select(keep, "_i.position", "_i.digest", "_i.caption", "_i.n_bytes")
    one = media.groupBy("digest").agg(*[F.first(c).alias(c) for c in columns])
    return skew.join_one(materialize(refs, "references"), one, "digest").select(keep, "position", "digest", "caption", "n_bytes", *columns)


def to_image(data: bytes) -> bytes:
    """``data`` with zero bytes to a positive multiple of 64, as a PGM image."""
    size = max(1, -(-len(data) // WIDTH)) * WIDTH
    return b"P5\n%d %d\n255\n" % (WIDTH, size // WIDTH) + data.ljust(size, b"\0")


def samples(image: bytes) -> np.ndarray:
    """The rows of samples of a PGM image that ``to_image`` made."""
    head = re.match(rb"P5\n(\d+) (\d+)\n255\n", image)
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(image, np.uint8, width * height, head.end()).reshape(height, width)


def image_feature(pixels: np.ndarray) -> str:
    """Height, mean, deviation, share of zeros and a 64-bit column hash (columns above the mean)."""
    counts = np.bincount(pixels.ravel(), minlength=256)
    n = pixels.size
    total = int(counts @ np.arange(256))
    square = int(counts @ (np.arange(256, dtype=np.int64) ** 2))
    columns = pixels.sum(0, dtype=np.int64)
    bits = int("".join("1" if int(c) * WIDTH > total else "0" for c in columns), 2)
    return f"h={len(pixels)};mean={total / n:.4f};var={(square - total * total / n) / n:.4f};zeros={int(counts[0])};columns={bits:016x}"


def _nothing() -> None:
    """Tasks keep no tables."""


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map (doc_id, text) to pages with one reference, and the images not yet emitted by the task."""
    seen: set[bytes] = set()
    for batch in batches:
        ids = batch.column(0)
        for at, texts in K.pieces(batch.column(1)):
            pages, digests, images = [], [], []
            docs = ids.slice(at, len(texts))
            for doc, text in zip(docs.to_pylist(), texts, strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                image = to_image(data)
                h = hashlib.sha256(image)
                pages.append(f'<article><figure><img src="sha256:{h.hexdigest()}" data-bytes="{len(data)}"><figcaption>{escape(f"document {doc}")}</figcaption></figure></article>')
                digests.append(h.hexdigest())
                images.append(None if h.digest() in seen else image)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(h.digest())
            yield pa.RecordBatch.from_arrays([docs, pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(images, pa.binary())], ["doc_id", "html", "digest", "image"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map (digest, image) to what the stored bytes say."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for at, images in K.pieces(batch.column(1)):
            rows = []
            for digest, image in zip(batch.column(0).slice(at, len(images)).to_pylist(), images, strict=True):
                pixels = samples(image)
                payload = pixels.tobytes()
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), image_feature(pixels)))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)


#: How the media table is written: small row groups and pages, since its rows are large; bytes of images are no dictionary.
LAYOUT = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.size": str(256 << 10), "parquet.enable.dictionary#image": "false", "parquet.enable.dictionary#html": "false", "parquet.enable.dictionary#digest": "false"}


def store_documents(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as pages and images; returns the table ``doc_id, html, digest, image``.

    ``image`` is null where the same task has stored the same bytes already.
    Null texts count as empty and take one row of zero samples.  Equal texts have
    equal digests, whichever row comes first; repeated rows, and rows without an
    id, get a page each.  An empty table gives an empty one.  Other columns are
    ignored, whatever their names.  Texts are taken a bounded number of bytes at
    a time, so a task's memory follows its longest text.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(workers.task("media", _store, _nothing), "doc_id long, html string, digest string, image binary"), "media", LAYOUT)


def describe_media(media: DataFrame) -> DataFrame:
    """Sizes, digests and a feature string for each stored image of ``media(digest, image)``; rows without an image are left out."""
    ship_package(media.sparkSession)
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.where("image is not null").select("digest", "image").mapInArrow(workers.task("media", _describe, _nothing), schema)
