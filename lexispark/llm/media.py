"""Media columns: interleaved sequences of text and media, with payloads in a content-addressed store.

Pages are parsed into ordered structs, each a text or a media reference with its caption; references
name payloads by digest. Payloads are stored once each, as 8-bit grey images in a plain
portable format, and a join by digest resolves references; positions and captions stay with them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, map_batches

#: Samples in an image's row; payloads are padded with bytes 0 to a positive multiple of it.
WIDTH = 64
SCHEME = "media:sha256/"
ELEMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_BREAKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "table", "tr", "td", "th", "nav", "header", "footer", "blockquote", "pre", "figure", "body", "html"}
_SILENT = {"script", "style", "template"}
#: What a head may hold; anything else ends it, even where its end tag is left out.
_IN_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "head", "html"}


class _Figure:
    """An open figure: its media so far, and its caption once it is read."""

    def __init__(self):
        self.media: list[dict] = []
        self.caption: str | None = None

    def add(self, element: dict) -> None:
        self.media.append(element)
        if self.caption is not None:
            element["caption"] = self.caption

    def say(self, caption: str) -> None:
        self.caption = caption
        for e in self.media:
            e["caption"] = caption


class _Sequence(HTMLParser):
    """Ordered elements of a page.

    A caption belongs to the media of its own figure, before and behind it, and not to those of figures inside or around that one; outside figures it is text.
    A caption ends with its tag, or else with its figure or at a tag that begins a block.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.silent: list[str] = []
        self.head: str | None = None
        self.figures: list[_Figure] = []

    def flush(self) -> None:
        text = "".join(self.text).strip()
        self.text = []
        if text:
            self.elements.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        if self.caption is not None:
            said, self.caption = "".join(self.caption).strip(), None
            self.figures[-1].say(said)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if self.head is not None:
            if tag not in _IN_HEAD:
                self.head = None
            elif tag not in ("head", "html"):
                self.head = tag
        if tag == "head":
            self.head = tag
        elif tag == "figcaption":
            self.flush()
            self.end_caption()
            self.caption = [] if self.figures else None
        elif tag in ("img", "audio", "video", "source"):
            a = dict(attrs)
            if (src := a.get("src") or "").startswith(SCHEME):
                self.flush()
                self.elements.append({"kind": "media", "text": None, "digest": src.removeprefix(SCHEME), "caption": a.get("alt")})
                if self.figures:
                    self.figures[-1].add(self.elements[-1])
        elif tag in _BREAKS:
            if tag not in ("p", "br"):
                self.end_caption()
            self.flush()
        if tag == "figure":
            self.figures.append(_Figure())

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            return
        if tag == "head":
            self.head = None
        elif self.head == tag:
            self.head = "head"
        elif tag == "figcaption":
            self.flush()
            self.end_caption()
        elif tag in _BREAKS:
            if tag not in ("p", "br"):
                self.end_caption()
            self.flush()
        if tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.head is not None:
            if self.head != "head" or not data.strip():
                return
            self.head = None  # text ends a head
        (self.text if self.caption is None else self.caption).append(data)

    @classmethod
    def of(cls, html: str | None) -> list[dict]:
        p = cls()
        p.feed(html or "")
        p.close()
        p.end_caption()
        p.flush()
        return [{"position": i, **e} for i, e in enumerate(p.elements)]


def parse_sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, elements): each page's texts and media references in order; null or empty html: no elements. Ids may repeat or be null, pages may be of any length, and an empty table gives an empty result."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([_Sequence.of(h) for h in b.column("html").to_pylist()], kind)], names=["id", "elements"])

    return map_batches(pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{html_col}`").alias("html")), parse, f"id long, elements {ELEMENTS}")


def image_bytes(payload: bytes) -> bytes:
    """The payload, padded, as a binary grey map of WIDTH columns."""
    padded = payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, len(padded) // WIDTH) + padded


def image_samples(media: bytes) -> bytes:
    """The samples of an image that image_bytes() made."""
    magic, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit grey map")
    return samples


def feature_of(samples: bytes) -> str:
    """An average hash of the image, 16 hex digits (a column's mean against the mean of all), and its mean and deviation."""
    a = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    columns = a.sum(axis=0, dtype=np.int64)
    bits = np.packbits(columns * WIDTH > columns.sum()).tobytes().hex()
    squares = int((np.bincount(a.ravel(), minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    mean = int(columns.sum()) / a.size
    return f"{bits}:{mean:.3f}:{max(0.0, squares / a.size - mean * mean) ** 0.5:.3f}"


def store_payloads(payloads: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes (digest, n_bytes, media) of (digest, text) to the shared folder, a row for each digest; null text counts as empty.

    Copies meet before they are stored, combined in each task first, so a payload that very many rows have is sent once a task, as a Zstandard frame. Texts may be of any length; an empty table gives an empty store.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([packer.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())], names=["digest", "packed"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            digests, sizes, images = [], [], []
            for i, (digest, packed) in enumerate(zip(b.column("digest").to_pylist(), b.column("packed").to_pylist(), strict=True), 1):
                data = unpacker.decompress(packed)
                digests.append(digest)
                sizes.append(len(data))
                images.append(image_bytes(data))
                # A frame may be far smaller than its text, so what goes out is bounded by its own size.
                if i == b.num_rows or sum(sizes) >= BATCH_BYTES or len(sizes) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["digest", "n_bytes", "media"])
                    digests, sizes, images = [], [], []

    packed = map_batches(payloads.select("digest", "text"), pack, "digest string, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))
    return scratch.table(map_batches(packed, store, "digest string, n_bytes long, media binary"), "payloads", keep=True)


def described(store: DataFrame) -> DataFrame:
    """(digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row for each digest, from the stored bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                rows = []
                for media in b.column("media"):
                    media = media.as_buffer().to_pybytes()
                    s = image_samples(media)
                    rows.append((len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(s)))
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n_bytes"), *columns], names=["digest", "n_bytes", *FEATURES])

    return map_batches(store, read, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def resolve(sequences: DataFrame, payloads: DataFrame, columns: list[str]) -> DataFrame:
    """(id, position, caption, digest, columns): each media reference of (id, elements) with its payload's columns, null where the store lacks it.

    payloads has one row for each digest. Either may be empty, ids may repeat or be null. A digest that very many pages refer to is a
    skewed key of the references' side only, which Spark splits.
    """
    refs = sequences.select("id", F.explode("elements").alias("e")).where(F.col("e.kind") == "media").select("id", "e.position", "e.caption", "e.digest")
    return refs.join(payloads.select("digest", *columns), "digest", "left").select("id", "position", "caption", "digest", *columns)
