from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from evidara.llm import packing as P


def plain_best_fit(sizes, capacity):
    rooms, rows = [], []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fit = [r for r in rooms if r >= sizes[k]]
        if not fit:
            rooms.append(capacity)
            fit = [capacity]
        room = min(fit)
        rooms.remove(room)
        rooms.append(room - sizes[k])
    return sorted(rooms)


def test_tree_packs_as_plain_best_fit_does():
    rng = random.Random(6)
    for capacity in (1, 7, 8, 100):
        for _ in range(40):
            sizes = [rng.randrange(0, capacity + 1) for _ in range(rng.randrange(0, 60))]
            rows = P.best_fit(sizes, capacity)
            assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
            assert sorted(capacity - sum(sizes[k] for k in r) for r in rows) == plain_best_fit(sizes, capacity)


def test_round_trip(docs, tmp_path):
    texts = ["hello world " * k for k in (0, 1, 3, 40, 900)] + [None, "<|endoftext|> é🙂", "x" * 30_000, "same", "same"]
    encode, decode, pad = P.tokenizer(P.default_vocabulary())
    rows = P.write_packed(docs(texts), str(tmp_path / "packed"), capacity=64).collect()
    assert P.matrix(rows, 64).shape == (len(rows), 64)
    pieces = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and (ids[r.n_tokens :] == pad).all()
        assert r.position_resets == r.cu_seqlens[:-1]
        assert P.position_ids(r.cu_seqlens).tolist() == [k for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for k in range(b - a)]
        for d, at, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces[d].append((at, ids[a:b].tolist()))
    assert len(pieces) == len(texts)
    for k, t in enumerate(texts, 1):
        whole = [i for _, p in sorted(pieces[k]) for i in p]
        assert whole == encode(t or "") and decode(whole).decode() == (t or "")


def test_empty_table_and_extra_columns(docs):
    assert P.pack_documents(docs([]).where("doc_id < 0")).collect() == []
    assert P.pack_documents(docs(["a"]).selectExpr("*", "1 as block", "2 as ids")).count() == 1
