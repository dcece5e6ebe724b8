"""Interleaved document sequences with media columns (operator 7).

A document is HTML whose media are referred to by digest. Parsing gives one ordered array of
structs - text, or a media reference with its caption - in document order; a join on the
digest resolves the references, and each item keeps its position and caption. Payloads are
stored losslessly as 8-bit grey images, 64 samples a line, in a container that is read back,
checksums included, before features are computed from its samples.

What is joined are the features of each distinct payload, so a payload that very many
documents share is one row on one side and the join may be split on the other.

Null text is an empty payload (64 zero bytes after padding). Null or broken HTML gives the
items found up to there; a reference to no known payload keeps its place with null features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import Batches, as_bytes, checkpointed, emit, small_batches

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def store_image(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey PNG of 64 columns; the payload's length is a positive multiple of 64."""
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_image(stored: bytes) -> bytes:
    """The samples of a stored image; its checksums must hold."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a stored image")
    at, body, height = 8, [], 0
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("a checksum does not hold")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", data)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not an image of this store")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Lines, mean, spread and a histogram of the samples in 8 equal ranges."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    total = int(counts @ np.arange(256))
    squares = int(counts @ np.arange(256) ** 2)
    n = len(x)
    spread = squares * n - total * total  # n^2 times the variance, exact
    return f"h={n // WIDTH};mean={total / n:.6f};var={spread / n / n:.6f};hist={','.join(map(str, counts.reshape(8, 32).sum(axis=1)))}"


class _Sequence(HTMLParser):
    """Text and media references in document order; a caption belongs to the last reference of its figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("img", "audio", "video"):
            self.flush()
            a = dict(attrs)
            self.items.append({"kind": "media", "text": None, "ref": (a.get("src") or "").removeprefix("media:"), "caption": a.get("alt") or None})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("p", "div", "figure", "h1", "h2", "h3", "li", "article", "br"):
            self.flush()

    def handle_endtag(self, tag):  # noqa: ANN001
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            media = next((x for x in reversed(self.items) if x["kind"] == "media"), None)
            if text and media:
                media["caption"] = text
            self.caption = None
        elif tag in ("p", "div", "figure", "h1", "h2", "h3", "li", "article"):
            self.flush()

    def handle_data(self, data):  # noqa: ANN001
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError):
        pass  # what was read of a broken page stays
    parser.flush()
    return [{"pos": k, **x} for k, x in enumerate(parser.items)]


ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
ITEMS_DDL = "array<struct<pos int, kind string, text string, ref string, caption string>>"


def parse_sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, items): the ordered text and media references of each page."""
    small_batches(pages.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("items", pa.list_(ITEM))])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield emit(schema, [batch.column(0), [sequence_of(x.as_py()) for x in batch.column(1)]])

    return pages.select(F.col(key).cast("bigint").alias(key), html).mapInArrow(run, f"`{key}` bigint, items {ITEMS_DDL}")


def resolve(sequences: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """(key, pos, caption, ref, *) for every reference, with the payload's columns or nulls."""
    refs = sequences.select(key, F.explode("items").alias("i")).where("i.kind = 'media'").select(key, "i.pos", "i.caption", "i.ref")
    return refs.join(media, refs.ref == media.digest, "left").drop("digest")


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("html", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("feature", pa.string())])


def ingest(docs: DataFrame) -> DataFrame:
    """Stores each text as an image, reads it back, and writes the page that refers to it."""
    small_batches(docs.sparkSession)
    stored_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("html", pa.string()), ("digest", pa.string()), ("media", pa.binary())])

    def store(batches: Batches) -> Batches:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py()
                media = store_image(padded(raw))
                digest = hashlib.sha256(media).hexdigest()
                html = f'<article><p>document {doc_id}</p><figure><img src="media:{digest}"><figcaption>{escape(str(len(raw)))} bytes</figcaption></figure></article>'
                for c, v in zip(rows, (len(raw), html, digest, media)):
                    c.append(v)
            yield emit(stored_schema, [batch.column(0), *rows])

    def read(batches: Batches) -> Batches:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for media in batch.column(4):
                stored = media.as_py()
                payload = read_image(stored)
                for c, v in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), feature_of(payload))):
                    c.append(v)
            yield emit(STORED, [*(batch.column(k) for k in range(4)), *rows])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("text"))
    kept = texts.mapInArrow(store, "doc_id bigint, n_bytes bigint, html string, digest string, media binary")
    return kept.mapInArrow(read, "doc_id bigint, n_bytes bigint, html string, digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, feature string")


def media_features(docs: DataFrame) -> DataFrame:
    """One row per document: its payload's digests and features, by way of its parsed page and a digest join."""
    stored = checkpointed(ingest(docs))
    features = checkpointed(stored.select("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature").dropDuplicates(["digest"]))
    sequences = parse_sequences(stored, "doc_id", "html")
    found = resolve(sequences, "doc_id", features)
    return found.select("doc_id", F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("bigint").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("ref").alias("media_sha256"), "feature", "pos")
