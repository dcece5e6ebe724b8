from __future__ import annotations

import struct

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidara.llm import bpe, common, media, packing, simhash, substring_dedup, token_counts

LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())
ANY = st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=200)
#: Characters of every plane, private and unassigned ones as likely as letters.
PLANES = st.text(alphabet=st.one_of(st.integers(0, 0x10FFFF).filter(lambda c: not 0xD800 <= c < 0xE000).map(chr), st.sampled_from("ab 1!'é漢")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(ANY)
def test_bpe_equals_the_library_on_any_text(text):
    packed = bpe.encoder(bpe.default_vocabulary()).encode(text)
    assert [i for (i,) in struct.iter_unpack("<I", packed)] == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(PLANES)
@example("\U00033000a")
@example("a\U00033000")
@example("!\U00033000")
@example("\U0003fc3fb")
def test_bpe_equals_the_library_on_all_planes(text):
    test_bpe_equals_the_library_on_any_text.hypothesis.inner_test(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=500))
def test_images_are_lossless(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload and payload.startswith(raw) and media.read_image(media.store_image(payload)) == payload


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=8))
def test_words_are_those_of_bytes_split(texts):
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, end, doc = common.words_of(data, offsets)
    got = [[] for _ in texts]
    for a, b, d in zip(start, end, doc):
        got[d].append(data[a:b].tobytes())
    assert got == [t.split() for t in texts]
    h = common.range_hashes(data, start, end)
    by: dict[bytes, set[int]] = {}
    for a, b, x in zip(start, end, h.tolist()):
        by.setdefault(data[a:b].tobytes(), set()).add(x)
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_packing_fits_and_keeps_all(sizes):
    rows = packing.best_fit(sizes, 64)
    assert sorted(k for r in rows for k in r) == list(range(len(sizes))) and all(sum(sizes[k] for k in r) <= 64 for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 60)), min_size=1, max_size=30))
def test_merged_spans_cover_the_same_bytes(spans):
    s = np.array([(a, a + n) for a, n in spans])
    m = substring_dedup.merged(s).tolist()
    cover = lambda xs: {k for a, b in xs for k in range(a, b)}
    assert cover(m) == cover(s.tolist()) and all(b < c for (_, b), (c, _) in zip(m, m[1:]))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_simhash_ignores_spacing_and_ascii_case(raw):
    words = raw.split()
    assert simhash.simhash(raw) == simhash.simhash(b" \n".join(words).upper())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefghij ", max_size=80))
def test_token_counts_add_up(text):
    words, tokens, unknown = token_counts.automaton(token_counts.default_vocabulary()).tally(text)
    assert words == len(text.split()) and unknown == 0 and tokens >= words
