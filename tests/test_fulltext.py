from __future__ import annotations

import random
import re

import pytest

from evidara.functions import fixed
from evidara.functions.stem import with_stems
from evidara.operators import fulltext

WORD = re.compile(r"[^\W_]+")


def parse(query):
    """Alternatives as lists of (excluded, [(place, word)])."""
    out = [[]]
    for said in re.findall(fulltext.PART, query or ""):
        if said.lower() == "or":
            out.append([])
            continue
        terms = [(k, w) for k, w in enumerate(WORD.findall(said.lower())) if w not in fixed.SEARCH_STOP_WORDS]
        if terms:
            out[-1].append((said.startswith("-"), terms))
    return out


def holds(text, terms):
    """(first, last) places of a part's occurrences."""
    first = terms[0][0]
    return [(p, p + terms[-1][0] - first) for p in range(len(text)) if all(p + k - first < len(text) and text[p + k - first] == w for k, w in terms)]


def plain(query, text, stems):
    """None, or the density by looking at every span of the text."""
    text = [stems[w] for w in WORD.findall((text or "").lower())]
    said = [[(x, [(k, stems[w]) for k, w in t]) for x, t in a] for a in parse(query)]
    fit = [a for a in said if any(not x for x, _ in a) and all(bool(holds(text, t)) != x for x, t in a)]
    if not fit:
        return None
    asked = {w for a in said for _, t in a for _, w in t}
    full = lambda p, q: any(all(x or any(p <= b and e <= q for b, e in holds(text, t)) for x, t in a) for a in fit)
    spans = [(p, q) for p in range(len(text)) for q in range(p, len(text)) if full(p, q)]
    least = [(p, q) for p, q in spans if not any((p, q) != o and p <= o[0] and o[1] <= q for o in spans)]
    return sum(0.1 / (1 + q - p + 1 - sum(w in asked for w in text[p : q + 1])) for p, q in least)


QUERIES = [
    "tax", "taxes income", '"income tax"', '"taxing of incomes"', "income OR asset", "tax -gold", 'tax -"gold asset"', '"gold asset" OR "tax income" -silver', "the of", "", None, "-gold", "or tax", "tax or", '"income tax', "40-10", "tax tax", 'or or "the tax" or',
    '"tax tax"', 'gold income "silver tax"',
]


def test_equals_looking_at_every_span(spark):
    rng = random.Random(4)
    pool = ["tax", "taxes", "taxed", "income", "incomes", "gold", "asset", "assets", "silver", "the", "of", "40", "10", "été"]
    texts = [(k, " ".join(rng.choice(pool) + rng.choice(["", "", ",", "-", "."]) for _ in range(rng.randrange(0, 14)))) for k in range(90)] + [(100, None), (101, "Gold ASSET, tax")]
    every = sorted({w for _, t in texts for w in WORD.findall((t or "").lower())} | {w for q in QUERIES for a in parse(q) for _, t in a for _, w in t})
    stems = {r.word: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in every], "word string")).collect()}
    got = {(r.query_id, r.chunk_id): r.score for r in fulltext.matches(spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string"), spark.createDataFrame(texts, "chunk_id int, text string")).collect()}
    want = {(q, k): s for q, query in enumerate(QUERIES) for k, t in texts if (s := plain(query, t, stems)) is not None}
    assert set(got) == set(want) and len(want) > 200
    assert got == pytest.approx(want)


def test_search_ranks_active_chunks(spark):
    chunks = spark.createDataFrame([(1, "tax of income", None, True), (2, "income tax", 2, True), (3, "taxed incomes", 1, True), (4, "income tax", 1, False), (5, "income and much more tax", 1, True)], "chunk_id int, text string, authority_rank int, is_active boolean")
    asked = spark.createDataFrame([(7, "income taxes")], "query_id int, query string")
    assert [(r.chunk_id, r["rank"]) for r in fulltext.search(asked, chunks).orderBy("rank").collect()] == [(3, 1), (2, 2), (1, 3), (5, 4)]
    assert fulltext.search(asked, chunks, 2).count() == 2 and fulltext.search(asked.where("false"), chunks).count() == 0


def test_only_wanted_words_are_shuffled(spark):
    """Words without a wanted stem stay where the texts are."""
    chunks = spark.createDataFrame([(k, "Running runs while others walk along the river") for k in range(20)], "chunk_id bigint, text string")
    held = fulltext.postings(chunks, spark.createDataFrame([("run",)], "stem string"))
    plan = held._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r.chunk_id, tuple(r.places["run"])) for r in held.collect()} == {(k, (0, 1)) for k in range(20)}


def test_a_compiled_query_serves_all_of_its_chunks():
    import numpy as np

    part = lambda alternative, excluded, *terms: {"alternative": alternative, "excluded": excluded, "terms": [{"stem": s, "place": p} for p, s in terms]}
    parts = [part(0, False, (0, "a"), (2, "b")), part(1, False, (0, "c")), part(1, True, (0, "d")), part(2, True, (0, "a"))]
    query = fulltext.compiled(parts)
    assert query == [([[("a", 0), ("b", 2)]], []), ([[("c", 0)]], [[("d", 0)]])]
    places = lambda **p: {k: np.array(v, np.int64) for k, v in p.items()}
    assert fulltext.cover(query, places(a=[1, 5], b=[4, 7], c=[], d=[])) == pytest.approx(0.1 / 2)
    assert fulltext.cover(query, places(a=[1], b=[2], c=[9], d=[3])) is None
    assert fulltext.cover(query, places(a=[], b=[], c=[9, 12], d=[])) == pytest.approx(0.2)
