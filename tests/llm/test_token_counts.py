from __future__ import annotations

import random

from evidara.llm import token_counts as T


def greedy(word, initial, inner):
    """Pieces by trying the longest first; None if there is no way on."""
    out, at = [], 0
    while at < len(word):
        words = inner if at else initial
        for end in range(len(word), at, -1):
            if word[at:end] in words:
                break
        else:
            return None
        out.append(word[at:end])
        at = end
    return out


def test_automaton_equals_greedy_matching():
    rng = random.Random(4)
    for _ in range(60):
        make = lambda n, k: {"".join(rng.choice("abc") for _ in range(rng.randrange(1, k))) for _ in range(n)}
        initial, inner = make(8, 5), make(8, 6)
        model = T.LongestMatch(sorted(initial), sorted(inner))
        for _ in range(150):
            w = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randrange(1, 14)))
            assert model.count(w) == len(greedy(w, initial, inner) or ()), (w, initial, inner)


def test_public_vocabulary_and_edges(docs):
    initial, inner = map(set, T.read_pieces(T.default_vocabulary()))
    texts = ["The quick brown fox, 12 times.　über 漢字 🙂 \x1c x", None, "", "   ", "w" * 50_000, "a b c"]
    want = []
    for k, t in enumerate(texts, 1):
        split = [greedy(w[-200:] if len(w) > 1000 else w, initial, inner) for w in (t or "").split()]
        if k != 5:
            want.append((k, len(split), sum(len(s) if s else 1 for s in split), sum(s is None for s in split)))
    got = sorted(tuple(r) for r in T.count_tokens(docs(texts)).collect())
    assert [g for g in got if g[0] != 5] == want
    assert got[4][1] == 1 and got[4][2] > 100
    assert T.count_tokens(docs([]).where("doc_id < 0")).collect() == []
    assert T.count_tokens(docs(["one two"] * 2).selectExpr("*", "1 as n_words")).count() == 2
