from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from evidara.llm import license_scan as L

NOTE = "Licensed under the Apache License, Version 2.0."
TWO = (L.Template("a", "One <<beginOptional>>big <<beginOptional>>red<<endOptional>><<endOptional>> Fox", True), L.Template("b", "by <<var;name=who;words=1..3>> fox"), L.Template("b", "red fox by"))


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def lengths(parts, words, at):
    """All ends of a template's matches from a word on, by trying."""
    if not parts:
        return {at}
    head, rest = parts[0], parts[1:]
    if isinstance(head, str):
        return lengths(rest, words, at + 1) if at < len(words) and words[at] == head else set()
    if isinstance(head, list):
        return lengths(head + rest, words, at) | lengths(rest, words, at)
    return set().union(*(lengths(rest, words, at + k) for k in range(head[0], head[1] + 1) if at + k <= len(words)))


def plain(text, templates):
    words = tokens(text)
    found = [(t.label, t.base, n, at, max(ends) - at) for at in range(len(words)) for n, t in enumerate(templates) if (ends := lengths(L.parsed(t.wording), words, at))]
    base = [m for m in found if m[1]]
    n = max((L.mandatory(templates[m[2]]) for m in found), default=0)
    join = lambda ms: ",".join(sorted({m[0] for m in ms}))
    return found, (len(words), len(base), min((m[3] for m in base), default=None), max((m[3] for m in base), default=None), join(base), join(found), 1 - 1 / (1 + n))


def full(name, **fill):
    """A template's wording with its optional parts in and its replaceable parts filled."""
    wording = next(t.wording for t in L.TEMPLATES if t.label == name)
    wording = re.sub(r"<<(begin|end)Optional>>", " ", wording)
    return re.sub(r"<<var;name=(\w+);[^>]*>>", lambda m: fill[m[1]], wording)


MIT = full("mit-text", software="this software", holder="THE AUTHORS OR COPYRIGHT HOLDERS")
TEXTS = [
    "Released under the MIT License.", NOTE, "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "APACHE  license\nmit-license mit License", "mit licenses, mitlicense, general public", "", None, "...", "mit", "license mit",
    MIT, MIT.replace("free of charge", "for a fee"), MIT.replace("liable", "Liable").replace("MERCHANTABILITY", "merchantability;"), MIT.replace("THE AUTHORS OR", "x " * 31), "licensed under a creative commons CC-BY 4.0", "x " * 900 + NOTE + " y" * 900,
    "general public license as published by the Free Software Foundation either version 2", "general public license as published by the Free Software Foundation, version 3", "general public license either version 2", full("bsd-text", organization="the X group", holder="us"), full("isc-text", author="me"),
]


def test_equals_trying_every_word(spark, docs):
    got = {r[0]: tuple(r)[1:] for r in L.license_labels(docs(TEXTS).repartition(3)).collect()}
    for k, text in enumerate(TEXTS, 1):
        assert got[k] == pytest.approx(plain(text, L.TEMPLATES)[1]), text
    assert got[12][5] == "mit-text" and got[13][5] == "" and got[14][5] == "mit-text" and got[15][5] == ""
    assert got[2][4:6] == ("apache", "apache,apache-2.0") and got[3][5] == "gpl,gpl-3.0" and got[4][4:6] == ("", "cc-by-nc-4.0")
    assert got[21][5] == "bsd-text" and got[22][5] == "isc-text"


@pytest.mark.parametrize("limit", [7, 60, 1_000_000])
def test_random_texts_in_any_pieces(monkeypatch, limit):
    monkeypatch.setattr(L, "STARTS", 5)
    monkeypatch.setattr(L, "STATES", 4)
    rng = random.Random(limit)
    texts = [" ".join(rng.choice(["one", "big", "red", "fox", "by", "x"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    automaton = L.Automaton(TWO)
    for at in range(0, 60, 20):
        batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([t.encode() for t in texts[at : at + 20]], pa.binary())], names=["doc_id", "text"])
        for r in L.matched(batch, automaton, TWO, limit).to_pylist():
            want = plain(texts[at + r["doc_id"]], TWO)
            assert [tuple(m.values()) for m in r["matches"]] == want[0] and r["n_words"] == want[1][0]


def test_edges(spark, docs):
    assert L.license_labels(docs([]).where("doc_id < 0")).collect() == []
    twice = L.license_labels(docs([(1, NOTE), (1, NOTE), (None, "MIT License")]).selectExpr("*", "1 as n_words", "'x' as matches", "2 as labels")).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in twice) == [(0, 1), (1, 1), (1, 1)]
    assert L.license_labels(docs(["mit license " * 50_000])).first()[1:5] == (100_000, 50_000, 0, 99_998)


@pytest.mark.parametrize("wording", ["<<beginOptional>>a<<endOptional>>", "a <<endOptional>>", "<<beginOptional>> a", "<<var;name=x;words=0..2>> a", "a <<var;name=x;words=0..2>>", "a <<unknown>> b", ""])
def test_wrong_markup_is_refused(docs, wording):
    with pytest.raises(ValueError):
        L.scan(docs(["a"]), (L.Template("x", wording),))
