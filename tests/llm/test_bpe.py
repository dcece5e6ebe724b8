from __future__ import annotations

import hashlib
import random
import struct

from tokenizers import Tokenizer

from evidara.llm import bpe as B

ODD = [
    None, "", " ", "İstanbul ΑΣ ΣΑΣ’s It's DON'T 123 ½ ǅ", "<|startoftext|>hi<|endoftext|> <|ENDOFTEXT|> <|end", "漢字 🙂👍🏽 e\u0301 é x\u2003y\u0085z \x1c a\x00b ٣٤ ﬁ A\u030a",
    "aaaa" * 300 + "xyz" * 150, "𝒜𝒷 ẞ ß", "a" * 120_000, "!!! ... ,,," * 50, "qzxj" * 40,
]


def library():
    t = Tokenizer.from_file(B.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_equals_the_library(docs):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzéèßöñ '.,-0123ABC\n\t"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))) for _ in range(150)]
    t = library()
    want = []
    for k, x in enumerate(texts, 1):
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = sorted(tuple(r) for r in B.encode_documents(docs(texts)).collect())
    assert got == want


def test_no_token_crosses_a_cut():
    b = B.encoder(B.default_vocabulary())
    for word in ("zqxjkv", "hello", "übergrößenträger", "qqqjjj"):
        raw = word.encode()
        cuts = b.cuts(raw)
        whole, at, split = b.fragment(raw, True), 0, b""
        for end in [*cuts, len(raw)]:
            split += b.fragment(raw[at:end], end == len(raw))
            at = end
        assert whole == split
    assert any(b.cuts(w.encode()) for w in ("zqxjkv", "qqqjjj"))


def test_caches_do_not_change_results(monkeypatch):
    monkeypatch.setattr(B, "CACHE_ENTRIES", 3)
    b = B.ForcedBoundaryBpe(B.default_vocabulary())
    text = "the cat sat on the mat and the cat ran " * 3
    assert list(struct.unpack(f"<{len(b.encode(text)) // 4}I", b.encode(text))) == library().encode(text, add_special_tokens=False).ids


def test_empty_table_ids_and_extra_columns(docs):
    assert B.encode_documents(docs([]).where("doc_id < 0")).collect() == []
    r = B.encode_documents(docs(["a b"]).selectExpr("*", "1 as n_tokens", "2 as ids"), with_ids=True).first()
    assert r.n_tokens == len(r.ids) == 2
