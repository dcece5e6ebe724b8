from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evidara.llm import ranked_search as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=R.K):
    """Every document scored for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if gone else doc, -s) for rank, (s, gone, doc) in enumerate(sorted(rows)[:k], 1)]
    return out


def key(rows):
    return sorted(tuple((x is None, x or 0) for x in r) for r in rows)


def run(spark, docs, items, k=R.K):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    return [tuple(r) for r in R.rank_documents(d, spark.createDataFrame(items, ITEMS), k).select("item_id", "rank", "doc_id", "score").collect()]


@pytest.mark.parametrize("shard", [1, 40, 800_000])
def test_equals_scoring_every_document(spark, monkeypatch, shard):
    monkeypatch.setattr(R, "SHARD_POSTINGS", shard)
    rng = random.Random(shard)
    words = ["the", "of", "Ünïcode", "ab9", "x", "rare", "語", *(f"w{k}" for k in range(30))]
    some = lambda n: " ".join(rng.choice(words[:7] if rng.random() < 0.6 else words) for _ in range(n))
    docs = [(k, some(rng.randrange(0, 40))) for k in range(150)] + [(7, "the of x"), (None, "rare rare the"), (None, "rare rare the"), (900, None), (901, ""), (902, "!?"), (903, "rare rare the"), (904, "RARE-rare the")]
    items = [(1, some(12)), (2, "the of"), (3, None), (4, ""), (5, "nowhere"), (6, "rare, the; Ünïcode"), (6, "语 w1"), (None, "x ab9"), (1, "w2")]
    want = plain(docs, items, 5)
    assert key(run(spark, docs, items, 5)) == key(want) and len({r[0] for r in want}) > 3


def test_edges(spark):
    docs = [(k, "same text") for k in range(70)]
    found = run(spark, docs, [(1, "same text other"), (1, "same text other")])
    assert key(found) == key(plain(docs, [(1, "same text other")]))
    other = docs + [(100 + k, "filler words here") for k in range(200)]
    assert key(run(spark, other, [(1, "same"), (2, "same")])) == key(plain(other, [(1, "same"), (2, "same")]))  # 50 of 70 equal scores, by id
    assert run(spark, [], [(1, "a")]) == [] and run(spark, docs, []) == []
    clash = spark.createDataFrame(docs + [(999, "only one")], "doc_id bigint, text string").selectExpr("*", "1 as score", "'x' as term", "2 as rank")
    assert R.rank_documents(clash, spark.createDataFrame([(1, "one", 3)], ITEMS + ", doc_id int")).count() == 1


@pytest.mark.parametrize("limit", [5, 100, 10_000_000])
def test_long_texts_come_in_pieces(limit):
    texts = ["alpha beta gamma " * 300, "", "alpha", "x" * 500 + " beta", "!", "beta-alpha " * 40]
    words = [b"alpha", b"beta", b"x" * 500, b"nowhere"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([t.encode() for t in texts], pa.binary())], names=["doc_id", "text"])
    got = R.count_asked(batch, R.Vocabulary(words), limit).to_pylist()
    want = [(k, Counter(terms(t))) for k, t in enumerate(texts) if terms(t)]
    assert [(r["doc_id"], r["n"], dict(zip((words[x].decode() for x in r["term"]), r["tf"]))) for r in got] == [(k, sum(c.values()), {w.decode(): c[w.decode()] for w in words if w.decode() in c}) for k, c in want]


def test_tree_bounds_hold_at_every_node():
    rng = np.random.default_rng(3)
    doc, impact = rng.integers(0, 13, 60), np.sort(rng.integers(0, 50, 60))[::-1]
    tree = R.Tree(doc, impact, 13)
    level, low, high, held = np.zeros(1, np.int64), np.array([[0]]), np.array([[60]]), [set(range(13))]
    while level[0] < tree.levels:
        low, high = tree.children(level, low, high)
        level = np.tile(level + 1, 2)
        bit = tree.levels - level[0]
        held = [{d for d in h if d >> bit & 1 == 0} for h in held] + [{d for d in h if d >> bit & 1} for h in held]
        for h, lo, hi, bound in zip(held, low[:, 0], high[:, 0], tree.bounds(level, low, high)):
            own = [x for d, x in zip(doc, impact) if d in h]
            assert hi - lo == len(own)
            if own and level[0] < tree.levels:
                assert bound == max(0, *own)


@pytest.mark.parametrize("nodes", [1, 4, 64])
def test_best_first_finds_the_best(nodes):
    rng = np.random.default_rng(nodes)
    for n_docs in (1, 2, 37, 64):
        lists = [(d := np.flatnonzero(rng.random(n_docs) < 0.5), rng.integers(0, 100, len(d))) for _ in range(4)]
        order = [np.argsort(-x, kind="stable") for _, x in lists]
        tree = R.Tree(np.concatenate([d[o] for (d, _), o in zip(lists, order)]), np.concatenate([x[o] for (_, x), o in zip(lists, order)]), n_docs)
        ends = np.cumsum([0, *(len(d) for d, _ in lists)])
        total = np.zeros(n_docs, np.int64)
        for d, x in lists:
            total[d] += x
        want = sorted((-s, d) for d, s in enumerate(total.tolist()) if s > 0)[:5]
        held = ends[:-1] < ends[1:]
        docs, scores = tree.best(ends[:-1][held], ends[1:][held], 5, 1, nodes)
        assert sorted(zip((-scores).tolist(), docs.tolist()))[:5] == want
