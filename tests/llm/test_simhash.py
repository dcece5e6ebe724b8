from __future__ import annotations

import random
from collections import defaultdict

import xxhash

from evidara.llm import simhash as S


def brute_print(text):
    w = [x for x in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if x]
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in w]
    if not w:
        return 0
    sh = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """prints: id -> fingerprint"""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_equals_brute_force(docs):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(60)) for _ in range(30)]
    texts = []
    for t in base:
        w = t.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "zz"
            texts.append(" \n".join(v) if rng.random() < 0.5 else " ".join(v).upper())
    texts += base + base[:3] + [None, "", " \t ", "One", "one", "one TWO", "one two three", "é x y", "w " * 20_000]
    df = docs(texts)
    want_fp = {k: brute_print(t) for k, t in enumerate(texts, 1)}
    want = brute_components(want_fp)
    for small, fine in ((16, 24), (1, 24), (1, 1)):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(df, small=small, small_fine=fine).collect()}
        assert got == {k: (f"{want_fp[k]:016x}", want[k]) for k in want}


def test_crowded_fingerprints_lose_no_link(spark):
    """A dense cloud: components by the bounded postings equal those of all links, for every size of posting."""
    rng = random.Random(1)
    centre, fps = rng.getrandbits(64), set()
    for _ in range(260):
        x = centre
        for _ in range(rng.randrange(0, 7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    want = brute_components({x: x for x in fps})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    parts = lambda m: {frozenset(v) for v in groups(m).values()}

    def groups(m):
        out = defaultdict(set)
        for k, v in m.items():
            out[v].add(k)
        return out

    for small, fine in ((16, 24), (2, 2), (1, 1)):
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.links(nodes, small, fine).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in edges)
        root = {x: x for x in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        assert parts({x: find(x) for x in fps}) == parts(want)


def test_empty_and_extra_columns(docs):
    assert S.simhash_components(docs([]).where("doc_id < 0")).collect() == []
    df = docs(["a b c d"] * 3).selectExpr("*", "1 as fp", "2 as root", "3 as component_id")
    assert [r.component_id for r in S.simhash_components(df).collect()] == [1, 1, 1]


def test_components_of_few_edges_take_few_tasks(spark, monkeypatch):
    from evidara.llm import common as C
    from evidara.llm import components

    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 430)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in p for p in pairs if p[0] != p[1])}
    held = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame(pairs, "a long, b long").repartition(20)
        for most in (components.EDGES, 90):
            written = []

            def kept(df, write=C.checkpointed, written=written):
                out = write(df)
                written.append(out.rdd.getNumPartitions())
                return out

            monkeypatch.setattr(components, "EDGES", most)
            monkeypatch.setattr(components, "checkpointed", kept)
            rows = components.connected_components(edges, "a", "b").collect()
            assert {r.node: r.root for r in rows} == want and len(rows) == len(want)
            assert len(written) > 2 and max(written[1:]) == (1 if most > 90 else 3)  # by their number, not over all 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
