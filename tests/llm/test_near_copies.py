from __future__ import annotations

import random

import corpus_pipeline as C
from evidara.llm import near_copies as N


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = {k: shingles(t) for k, t in enumerate(texts, 1)}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            union = len(sets[a] | sets[b])
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def edited(rng, text, edits):
    w = text.split()
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"edit{rng.randrange(1000)}"
    return " ".join(w)


def test_planted_edits_leave_the_corpus(spark, docs):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(200)) for _ in range(12)]
    texts += [edited(rng, t, 1) for t in texts[:6]] + [edited(rng, t, 4) for t in texts[6:]]
    left = C.drop_near_copies(spark, docs(texts), "")
    assert {r.doc_id for r in left.collect()} == set(range(1, 13))


def test_equals_brute_force(docs):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(25))
    base = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([4, 5, 6, 30, 64, 150]))) for _ in range(20)]
    texts = base + [edited(rng, t, rng.choice([0, 1, 2, 4])) for t in base for _ in range(2)]
    texts += [edited(rng, base[-1] + " " + passage + " x" * 40, k % 7) for k in range(40)] + [passage + f" {k} {k} {k}" for k in range(30)] + [f"{k} {k} {passage}" for k in range(20)]
    texts += [base[0].upper().replace(" ", " \n"), None, "", " \t", "One", "one", "é x y", "w " * 3000]
    want = brute_components(texts)
    df = docs(texts)
    for small in (16, 2):
        assert {r.doc_id: r.component_id for r in N.near_copies(df, small=small).collect()} == want
    for sent in (N.SENT_ROWS, 0):
        assert sorted(r.doc_id for r in N.without_near_copies(df, most_sent=sent).collect()) == sorted(set(want.values()))


def test_repeated_rows_and_rows_without_an_id(docs):
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, a), (None, a), (2, b), (None, c), (None, c), (3, b + " end"), (4, None), (4, ""), (None, None), (5, d), (5, c + " end")]
    df = docs(rows).selectExpr("*", "7 as own", "8 as own_hash", "9 as node", "text as least")
    for sent in (N.SENT_ROWS, 0):
        got = N.without_near_copies(df, most_sent=sent)
        assert got.dtypes == df.dtypes
        assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted([(1, a), (2, b), (4, ""), (5, d), (5, c + " end")])
    assert sorted(map(repr, N.near_copies(docs([(None, a), (None, a + " end"), (None, b)])).collect())) == ["Row(doc_id=None, component_id=None)"] * 3


def test_without_documents(docs):
    assert N.without_near_copies(docs([]).where("doc_id < 0")).collect() == []
    assert N.near_copies(docs([]).where("doc_id < 0")).collect() == []


def test_texts_of_one_template_do_not_meet(spark):
    """Sets of 20 shingles whose first common one is the fifth cannot be similar to each other."""
    for n in (100, 1_000):
        rows = spark.range(n).selectExpr("7L as shingle", "id as node", "20 as n", "4 as i", "id as root", "-1L as largest")
        assert N._by_length(rows, 0.8).where("least <= 20 and 20 <= most").count() == 0
        assert N._crowded_pairs(rows, rows, 0.8).count() == 0
    met = spark.createDataFrame([(7, k, n, i, k, -1) for k, (n, i) in enumerate([(20, 0), (25, 0), (26, 0), (20, 4), (16, 0), (16, 1)])], "shingle bigint, node bigint, n int, i int, root bigint, largest bigint")
    sizes = {0: (20, 0), 1: (25, 0), 2: (26, 0), 3: (20, 4), 4: (16, 0), 5: (16, 1)}
    fits = lambda a, b: 9 * min(a[0] - a[1], b[0] - b[1]) >= 4 * (a[0] + b[0]) and 5 * min(a[0], b[0]) >= 4 * max(a[0], b[0])
    want = {(x, y) for x in sizes for y in sizes if x < y and fits(sizes[x], sizes[y])}
    assert {(r.a, r.b) for r in N._crowded_pairs(met, met, 0.8).collect()} == want and want


def test_copies_by_fingerprint_leave_the_corpus_too(spark, docs):
    """Texts of one repeated phrase with other words at the end: fingerprints agree, few shingles do. Groups of both kinds are one."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    said, plain = "one two three " * 80, words(200)
    texts = [plain, said + words(12), said + words(12), words(200), edited(rng, plain, 1)]
    assert len(shingles(texts[1]) & shingles(texts[2])) < 0.5 * len(shingles(texts[1]) | shingles(texts[2]))
    assert {r.doc_id for r in N.without_near_copies(docs(texts)).collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in C.drop_near_copies(spark, docs(texts), "").collect()} == {1, 2, 4}
    bridged = docs([(7, texts[1]), (9, texts[2]), (3, edited(rng, texts[2] + " " + words(30), 0)), (3, None), (None, ""), (8, plain), (8, plain)])
    a = spark.createDataFrame([(1, 1, (False, 1, 1)), (2, 2, (False, 1, 1)), (None, 5, (True, None, 5))], "doc_id bigint, text_hash bigint, least struct<no_id: boolean, doc_id: bigint, text_hash: bigint>")
    b = spark.createDataFrame([(2, 2, (False, 2, 2)), (3, 3, (False, 2, 2)), (None, 6, (True, None, 5)), (None, 5, (True, None, 5))], a.schema)
    assert {(r.doc_id, r.text_hash, r.least.doc_id, r.least.text_hash) for r in N.merged(a, b).collect()} == {(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 1, 1), (None, 5, None, 5), (None, 6, None, 5)}
    assert [r.doc_id for r in C.drop_near_copies(spark, bridged, "").orderBy("doc_id").collect()] == [3, 3, 8]
