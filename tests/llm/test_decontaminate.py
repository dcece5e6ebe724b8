from __future__ import annotations

import random

import numpy as np

from evidara.llm import decontaminate as D


def word(rng):
    return "".join(rng.choice(["an", "ter", "ol", "mi", "ra", "ke", "sun", "po"]) for _ in range(rng.randrange(1, 5)))


def made(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "is"]) if rng.random() < 0.4 else word(rng) for _ in range(n))


def tables(spark, docs, docs_texts, items):
    return docs(docs_texts), spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id bigint, text string")


def test_planted_items_are_found_and_clean_documents_left(spark, docs):
    rng = random.Random(8)
    items = [made(rng, rng.randrange(14, 45)) + "." for _ in range(12)] + ["too short", None, ""]
    texts = [made(rng, rng.randrange(0, 400)) for _ in range(80)] + [None, "", "x", "the " * 30_000]
    planted = {}
    for k in range(12):
        w = items[k].rstrip(".").split()
        copies = [items[k], items[k].upper().replace(" ", " \n"), ", ".join(w)]
        loose = list(w)
        loose[len(w) // 3] = "replaced"
        loose.insert(len(w) // 2, "added")
        copies.append(" ".join(loose))
        for c in copies:
            texts.append(made(rng, rng.randrange(0, 300)) + " " + c + " " + made(rng, rng.randrange(0, 300)))
            planted[len(texts)] = k
    df, bench = tables(spark, docs, texts, items)
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(df, bench).collect()}
    assert set(got) == {(d, k) for d, k in planted.items()}
    assert all(r.similarity >= D.LOOSE and r.cosine >= D.COSINE for r in got.values())
    kept = D.without_contaminated(df.selectExpr("*", "1 as item_id", "'z' as passages"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(1, len(texts) + 1)) - set(planted))
    assert kept.columns[-2:] == ["item_id", "passages"]


def test_common_subsequence_equals_the_table_method():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 90)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 120)).astype(np.uint64)
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(row[-1], last[k + 1]))
        assert D.common_subsequence(a, D._masks(a), b) == row[-1]


def test_basis_spans_the_leading_singular_vectors(spark):
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(60, 5)) @ np.diag([9, 7, 5, 3, 2]) @ rng.normal(size=(5, 20))
    rows = [(k % D.GROUPS, np.arange(20, dtype=np.int32).tobytes(), r.astype(np.float32).tobytes()) for k, r in enumerate(dense)]
    v = D.latent_basis(spark.createDataFrame([(a, bytearray(b), bytearray(c)) for a, b, c in rows], "group int, cols binary, weights binary"), 20)
    assert np.allclose(dense @ v @ v.T, dense, atol=1e-3)


def test_without_documents_or_items(spark, docs):
    df, bench = tables(spark, docs, ["some text of no interest to anyone here"], ["an item that is long enough to count as one"])
    assert D.contaminated(df.where("doc_id < 0"), bench).collect() == []
    assert D.contaminated(df, bench.where("item_id < 0")).collect() == []
    assert D.without_contaminated(df, bench.where("item_id < 0")).count() == 1
    assert {r.doc_id for r in D.contaminated(docs(["x " * 50 + "an item that is long enough to count as one"] * 2), bench).collect()} == {1, 2}


def test_items_of_words_in_no_sampled_passage_are_found(spark, docs, monkeypatch):
    """The share of sampled passages is next to nothing, as it is on very large tables."""
    rng = random.Random(12)
    rare = [" ".join(f"q{k}x{rng.randrange(10**6)}" for _ in range(20)) for k in range(8)]
    texts = [made(rng, 200) for _ in range(60)] + [made(rng, 50) + " " + t + " " + made(rng, 50) for t in rare]
    texts += [made(rng, 31) + " " + " ".join("other" if k == 7 else w for k, w in enumerate(t.split())) + " " + made(rng, 40) for t in rare]
    df, bench = tables(spark, docs, texts, [*rare, *(made(rng, 25) for _ in range(10))])
    want = {(61 + k, k) for k in range(8)} | {(69 + k, k) for k in range(8)}
    for sample in (1, 0):
        monkeypatch.setattr(D, "SAMPLE", sample)
        assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == want


def exhaustive(texts, items):
    """All (doc_id, item) by comparing every passage's surroundings with every item, without a candidate search."""
    sequences = [D.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in items]
    width = max(D.SHORTEST, min(D.LONGEST, min(map(len, sequences))))
    it = D.Items(width, list(range(len(items))), sequences, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool))
    matcher, found = D.Matcher(it), set()
    for d, t in enumerate(texts, 1):
        h, doc = D.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        start, end, _ = D.windows(doc, 1, width, max(1, width // 3))
        for k, item in enumerate(sequences):
            if any(matcher.verify(k, h[max(0, a - len(item)) : b + len(item)]) for a, b in zip(start, end)):
                found.add((d, k))
    return found


def paraphrased(rng, item, kept, added):
    """An item with a share of its words left, its close whole, and words as they stand elsewhere put in between."""
    w = item.split()
    close = len(w) - max(D.LEAST_WORDS, len(w) // 4)
    out = []
    for k, x in enumerate(w):
        if k >= close or rng.random() < kept:
            while rng.random() < added / (1 + added):
                out.append(word(rng))
            out.append(x)
    return " ".join(out)


def test_paraphrases_against_exhaustive_subsequences(spark, docs):
    """Nothing but what the exhaustive comparison finds, and nearly all of the planted pairs among that.

    The others are chance subsequences of very common words, which share no passage.
    """
    rng = random.Random(21)
    items = [made(rng, rng.randrange(15, 45)) for _ in range(40)]
    texts, planted, mixed = [], set(), set()
    for k, t in enumerate(items):
        for kept in (0.6, 0.75, 0.9):
            for added in (0.0, 0.25, 0.5, 1.0):
                texts.append(made(rng, 40) + " " + paraphrased(rng, t, kept, added) + " " + made(rng, 40))
                planted.add((len(texts), k))
                if added == 1:
                    mixed.add((len(texts), k))
    texts += [made(rng, 200) for _ in range(150)]
    df, bench = tables(spark, docs, texts, items)
    want, got = exhaustive(texts, items), {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()}
    assert got <= want and len(want & planted) > 450
    for some in (planted, mixed):
        assert len(got & some) >= 0.9 * len(want & some)
    kept = {r.doc_id for r in D.without_contaminated(df, bench).collect()}
    assert kept == set(range(1, len(texts) + 1)) - {d for d, _ in got}


def test_blocks_of_the_benchmark_find_what_one_block_finds(spark, docs, monkeypatch):
    rng = random.Random(4)
    items = [made(rng, 20) for _ in range(9)]
    df, bench = tables(spark, docs, [made(rng, 30) + " " + t + " " + made(rng, 30) for t in items] + [made(rng, 60)], items)
    whole = {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()}
    monkeypatch.setattr(D, "ITEMS", 2)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == whole == {(k + 1, k) for k in range(9)}
    assert [r.doc_id for r in D.without_contaminated(df, bench).collect()] == [10]


def test_common_words_are_never_too_few():
    rng = np.random.default_rng(7)
    sequences = [rng.integers(0, 30, rng.integers(5, 25)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(20)]
    it = D.read_items([(k, " ".join(f"w{x % 31}" for x in s.tolist()).encode()) for k, s in enumerate(sequences)], np.ones(D.TERMS), 8)
    pairs = D._Pairs(it, it.sequences)
    text = rng.integers(0, len(it.vocabulary), 200)
    at, a = np.where(rng.random(200) < 0.2, -1, text), rng.integers(0, 150, 50)
    k = rng.integers(0, len(it.ids), 50)
    got = pairs.common_words(k, a, a + 40, at, block=7)
    for g, item, lo in zip(got, k, a):
        own = it.lookup(it.sequences[item]).tolist()
        held = at[lo : lo + 40].tolist()
        assert g >= sum(min(own.count(x), held.count(x)) for x in set(own))


def test_blocks_of_a_benchmark_are_taken_one_after_the_other(spark, docs, monkeypatch):
    rng = random.Random(12)
    items = [(k, " ".join(f"b{rng.randrange(300)}" for _ in range(20))) for k in range(40)]
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) + " " + (t if k % 2 else "") for k, t in items]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted((r.doc_id, r.item_id) for r in D.contaminated(docs(texts), bench).collect())
    monkeypatch.setattr(D, "ITEMS", 8)
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(docs(texts), bench).collect()) == whole == [(k + 1, k) for k in range(1, 40, 2)]
    left = D.without_contaminated(docs(texts), bench)
    assert left._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one block in a task
    assert sorted(r.doc_id for r in left.collect()) == list(range(1, 41, 2))


def test_basis_is_fitted_on_every_passage(spark, docs, monkeypatch):
    """A table of far more passages than are multiplied at once, in which a few documents alone join two groups of words."""
    rng = random.Random(30)
    items = [" ".join(f"{g}{rng.randrange(12)}" for _ in range(20)) for g in "abcd" for _ in range(3)]
    texts = [" ".join(f"{rng.choice('abcd')}{rng.randrange(12)}" if rng.random() < 0.5 else word(rng) for _ in range(rng.randrange(0, 900))) for _ in range(60)]
    df, bench = tables(spark, docs, texts, items)
    monkeypatch.setattr(D, "RANK", 4)
    monkeypatch.setattr(D, "SAMPLE", 7)
    it = next(D.prepare(df, bench))
    rows = []
    for t in [*texts, *items]:
        data = np.frombuffer(t.encode(), np.uint8)
        h, doc = D.words(data, np.array([0, len(data)]))
        at, idf = it.lookup(h), it.idf[D._column(h)]
        for a, b, _ in zip(*D.windows(doc, 1, it.width, it.width)):
            row = np.zeros(len(it.vocabulary))
            np.add.at(row, at[a:b][at[a:b] >= 0], idf[a:b][at[a:b] >= 0])
            rows.append(row / np.sqrt((idf[a:b] ** 2).sum()))
    a = np.array(rows)
    assert len(a) > 100 * D.SAMPLE
    test = np.random.default_rng(D.SEED).standard_normal((a.shape[1], D.RANK + D.OVERSAMPLE))
    q, _ = np.linalg.qr(a.T @ (a @ test))
    values, vectors = np.linalg.eigh(q.T @ (a.T @ (a @ q)))
    want = q @ vectors[:, np.argsort(-values)[: D.RANK]]
    assert np.allclose(it.basis @ it.basis.T, want @ want.T, atol=1e-4)
