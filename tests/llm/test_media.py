from __future__ import annotations

import hashlib
import zlib

import pytest

from evidara.llm import media as M


def test_every_text_is_read_back(docs):
    texts = ["hello", None, "", "é" * 32, "x" * 64, "x" * 65, "y" * 300_000, "hello", "\x00"]
    got = {r.doc_id: r for r in M.media_features(docs(texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts, 1):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        stored = M.store_image(want)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[1].feature == got[8].feature and got[1].media_sha256 == got[8].media_sha256
    assert got[2].asDict() | {"doc_id": 0} == got[3].asDict() | {"doc_id": 0}
    assert len({r.feature for r in got.values()}) > 4


def test_broken_store_is_refused():
    stored = bytearray(M.store_image(M.padded(b"abc")))
    stored[45] ^= 1
    with pytest.raises(ValueError):
        M.read_image(bytes(stored))
    with pytest.raises(ValueError):
        M.read_image(b"GIF89a")


def test_sequences_keep_order_and_captions():
    html = '<p>One &amp; two</p><figure><img src="media:aa" alt="old"><figcaption>A <b>cap</b></figcaption></figure>tail<script>x()</script><img src="media:bb"><p>end'
    items = [(x["pos"], x["kind"], x["text"], x["ref"], x["caption"]) for x in M.sequence_of(html)]
    assert items == [(0, "text", "One & two", None, None), (1, "media", None, "aa", "A cap"), (2, "text", "tail", None, None), (3, "media", None, "bb", None), (4, "text", "end", None, None)]
    assert M.sequence_of(None) == [] and M.sequence_of("<p <<") is not None


def test_unknown_reference_keeps_its_place(spark):
    pages = spark.createDataFrame([(1, '<img src="media:a"><img src="media:b"><img src="media:a">'), (2, None)], "page_id bigint, html string")
    media = spark.createDataFrame([("a", 7)], "digest string, size int")
    got = sorted((r.page_id, r.pos, r.ref, r.size) for r in M.resolve(M.parse_sequences(pages, "page_id", "html"), "page_id", media).collect())
    assert got == [(1, 0, "a", 7), (1, 1, "b", None), (1, 2, "a", 7)]


def test_empty_table_and_extra_columns(docs):
    assert M.media_features(docs([]).where("doc_id < 0")).collect() == []
    assert M.media_features(docs(["a", "b"]).selectExpr("*", "1 as digest", "2 as html", "3 as pos")).count() == 2
