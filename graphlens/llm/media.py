"""Media columns: interleaved sequences of text and media, with payloads in a store by digest.

A page's HTML is parsed into one ordered sequence of structs, each either a text or a media reference
with its digest and caption (the figcaption of its figure, else its alt text). Scripts, styles, templates and what
stands in the head or in noscript are left out, media too; a head ends where something else begins. Payloads live in a separate table of (digest, media): 8-bit grey samples, 64
in a row, behind a PGM header, as Parquet. References meet the store in a join on the digest. What
is asked of a payload (a feature, a digest) can be computed where it is stored, before that join, so that
payloads need not travel; ``resolve`` also joins the payloads themselves.

Defined results: a null text is an empty payload of 64 zero bytes; null html gives an empty sequence; a
reference without a payload keeps its place with nulls; equal payloads share a digest and are
resolved once; extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of

ROW = 64
SCHEME = "media:sha256/"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_HIDDEN = {"script", "style", "head", "title", "noscript", "template"}
#: What a head may hold; anything else ends it, with or without its end tag.
_OF_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
_BREAKS = set("address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Sequence(HTMLParser):
    """Texts and media in order. A figure's ``figcaption`` is the caption of its media, their ``alt`` where there is none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden: list[str] = []
        #: Of each open figure: where its items begin, its captions and where they stood.
        self.figures: list[tuple[int, list[tuple[int, str]]]] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        text, self.caption = " ".join("".join(self.caption or ()).split()), None
        if text and self.figures:
            self.figures[-1][1].append((len(self.items), text))

    def end_figure(self) -> None:
        self.flush()
        self.end_caption()
        first, captions = self.figures.pop()
        media = [x for x in self.items[first:] if x["kind"] == "media" and not x.get("captioned")]
        for x in media if captions else ():
            x |= {"caption": " ".join(text for _, text in captions), "captioned": True}
        if not media:
            for at, text in reversed(captions):
                self.items.insert(at, {"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag == "body" or self.hidden == ["head"] and tag not in _OF_HEAD:
            self.hidden.clear()
        if tag in _HIDDEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in _BREAKS:
            self.flush()
        if tag == "figure":
            self.figures.append((len(self.items), []))
        elif tag == "figcaption" and self.figures:
            self.end_caption()
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            at = dict(attrs)
            src = at.get("src")
            if src is not None or tag == "img":
                self.flush()
                self.items.append({"kind": "media", "text": None, "digest": src[len(SCHEME) :] if src and src.startswith(SCHEME) else src, "caption": at.get("alt")})

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        elif not self.hidden and tag in _BREAKS:
            self.flush()
            if tag == "figcaption":
                self.end_caption()
            elif tag == "figure" and self.figures:
                self.end_figure()

    def handle_data(self, data):
        if self.hidden == ["head"] and data.strip():
            self.hidden.clear()
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)

    def finished(self) -> list[dict]:
        self.flush()
        while self.figures:
            self.end_figure()
        return [{k: x[k] for k in ("kind", "text", "digest", "caption")} | {"position": i} for i, x in enumerate(self.items)]


def parse_html(html: str | None) -> list[dict]:
    """The page's texts and media references in order."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    return parser.finished()


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, sequence: the interleaved items of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
        for b in rows_of(batches, 512):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse_html(h.as_py()) for h in b.column(1)], pa.list_(item))], names=[key, "sequence"])

    return pages.select(key, "html").mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, sequence {SEQUENCE}")


def store_payload(data: bytes) -> bytes:
    """Bytes, a multiple of 64, as an 8-bit grey image."""
    return b"P5\n%d %d\n255\n" % (ROW, len(data) // ROW) + data


def read_payload(media: bytes) -> bytes:
    kind, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    assert kind == b"P5" and most == b"255" and len(samples) == width * height, "not an image of this store"
    return samples


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % ROW if raw else ROW), len(raw)


def page_of(text: str | None, digest: str, n_bytes: int) -> str:
    """A page that holds the text in two halves with its media between them."""
    text = text or ""
    half = text.find(" ", len(text) // 2) + 1 or len(text)
    halves = [f"<p>{escape(x)}</p>" if x else "" for x in (text[:half], text[half:])]
    return f'<html><head><title>{n_bytes}</title><body>{halves[0]}<figure><img src="{SCHEME}{digest}"><figcaption>text of {n_bytes} bytes</figcaption></figure>{halves[1]}'


def media_of_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store (digest, n_bytes, media) and pages (doc_id, n_bytes, html) that refer to it, one media per document.

    A task stores a payload once for each batch, so a popular one is not written for every copy. Pages are made
    where they are parsed and are never written.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 256):
            seen = {hashlib.sha256(data).hexdigest(): (n, store_payload(data)) for t in set(b.column("text").to_pylist()) for data, n in [padded(t)]}
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([m for _, m in seen.values()], pa.binary())], names=["digest", "media"])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 256):
            made = [(page_of(t, hashlib.sha256(data).hexdigest(), n), n) for t in b.column("text").to_pylist() for data, n in [padded(t)]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([h for h, _ in made], pa.string())], names=["doc_id", "n_bytes", "html"])

    store = materialize(texts.select("text").mapInArrow(put, "digest string, media binary"), "media-store")
    return store, texts.mapInArrow(pages, "doc_id long, n_bytes long, html string")


def describe(samples: bytes) -> str:
    """A feature of an image: its height and, for each quarter of the rows, the mean sample."""
    grey = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    quarters = [f"{int(part.sum(dtype=np.int64)) // max(1, part.size)}" for part in np.array_split(grey, 4)]
    return f"gray8:{ROW}x{len(grey)}:" + ",".join(quarters)


def features(store: DataFrame) -> DataFrame:
    """digest and what is read back from each stored payload, one row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 256):
            out = []
            for d, m in zip(b.column("digest"), b.column("media")):
                media = m.as_py()
                samples = read_payload(media)
                out.append((d.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    ddl = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.select("digest", "media").mapInArrow(run, ddl).distinct()


def resolve(items: DataFrame, store: DataFrame) -> DataFrame:
    """Items (key columns, ``item`` struct) with the store's columns beside each reference, in place.

    Only references enter the join. A payload with many references is a skewed key with one row on the store's
    side; adaptive execution splits the other side.
    """
    return items.withColumn("digest", F.col("item.digest")).join(store, "digest", "left")


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and of the
    page's sequence: items, position of the media, caption.
    """
    store, pages = media_of_documents(docs)
    parsed = sequences(pages.withColumn("page", F.struct("doc_id", "n_bytes")), "page")
    items = parsed.select("page", F.size("sequence").alias("items"), F.explode(F.filter("sequence", lambda x: x["kind"] == "media")).alias("item"))
    slim = items.withColumn("item", F.struct("item.digest", "item.position", "item.caption"))
    found = resolve(slim, features(store))
    return found.select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "items", "item.position", "item.caption")
