from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from evidara.llm import langid as L

WORDS = {"en": "the of and to in is that it was for with".split(), "fr": "le la les des est une dans pour que qui".split(), "de": "der die und das ist nicht ein mit von auf".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "e", "en", "s"]) for _ in range(n))


def corpus(n=240):
    rng = random.Random(2)
    return [(k, "\n".join(sentence(rng, lang, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 5))), lang) for k in range(1, n) for lang in [rng.choice(list(WORDS))]]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_held_out_accuracy_and_odd_texts(spark):
    rows = corpus()
    odd = [(1001, None, "en"), (1002, "", "en"), (1003, "123 !? 456", "en"), (1004, "漢字", None), (1005, "der " * 30_000, None), (1006, "le", None)]
    got = {r.doc_id: r for r in L.identify(table(spark, rows + odd)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [got[k].lang_pred for k in (1001, 1002, 1003)] == ["und"] * 3 and got[1001].score == 0
    assert got[1005].lang_pred == "de" and got[1004].lang_pred in WORDS
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_text_is_an_input(spark):
    rows = corpus(120)
    swapped = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else None) for i, t, lang in rows]
    a = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(table(spark, rows)).collect()}
    b = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(table(spark, swapped)).collect()}
    assert a == b


def test_words_of_switched_text():
    rng = random.Random(3)
    rows = corpus()
    model = L.fit([t.encode() for _, t, _ in rows], [lang for *_, lang in rows])
    text = (sentence(rng, "en", 12) + " " + sentence(rng, "de", 12)).encode()
    _, _, _, gamma = L.label_words(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    labels = [model.langs[k] for k in gamma.argmax(axis=1)]
    assert labels[:12].count("en") >= 10 and labels[12:].count("de") >= 10


def test_switches_are_learned_from_spliced_lines():
    rng = random.Random(13)
    chains = [(" ".join(f"{lang}{k}" for k in range(rng.randrange(1, 90))).encode(), n) for n, lang in enumerate("abc") for _ in range(30)]
    lines = L.switched(chains)
    assert all(len(t.split()) == len(y) <= L.CHAIN for t, y in lines)
    words = lambda xs: sorted((w, int(n)) for t, y in xs for w, n in zip(t.split(), y))
    assert words(lines) == words([(t, np.full(len(t.split()), n)) for t, n in chains])
    y, heads = np.concatenate([y for _, y in lines]), np.cumsum([0, *(len(y) for _, y in lines[:-1])])
    pairs = L.seen_transitions(y, heads, 3)
    want = np.zeros((3, 3))
    for _, line in lines:
        for a, b in zip(line, line[1:]):
            want[a, b] += 1
    assert (pairs == want).all() and (want > 0).all() and np.trace(want) > want.sum() / 2
    rows = corpus()
    model = L.fit([t.encode() for _, t, _ in rows], [lang for *_, lang in rows])
    right = total = 0
    for _ in range(20):
        langs = [rng.choice(list(WORDS)) for _ in range(6)]
        text = " ".join(sentence(rng, lang, 5) for lang in langs).encode()
        gamma = L.label_words(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[3]
        right += sum(model.langs[k] == langs[i // 5] for i, k in enumerate(gamma.argmax(axis=1)))
        total += len(gamma)
    assert right >= 0.9 * total


def test_labels_and_scores_equal_a_plain_version(spark):
    """Every word's features one by one, plain forward and backward sums, means over the document."""
    df = table(spark, corpus(60) + [(901, None, "en"), (902, "", None), (903, "1 2", "fr"), (904, "Der\n\nTHE le " * 60, None)])
    model = L.fit(*L.sample(df))
    known, k = set(model.lexicon.tolist()), len(model.langs)
    hashed = lambda raw: int(L.range_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])
    bucket = lambda raw, tag: int(L._bucket(np.array([int.from_bytes(raw, "big")], np.uint32), tag)[0])

    def emission(w):
        f = [bucket(w[i : i + n], n) for n in L.GRAMS for i in range(len(w) - n + 1)]
        f += [bucket(x, tag + n) for n in (1, 2, 3) if len(w) >= n for x, tag in ((w[:n], 10), (w[-n:], 20))]
        f += [int(L._lexicon_bucket(np.array([hashed(w)], np.uint64))[0])] * (hashed(w) in known)
        return model.weights[f].astype(float).sum(axis=0)

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        total, n = np.zeros(k), 0
        for line in text.lower().encode().split(b"\n"):
            words = line.split()
            for at in range(0, len(words), L.CHAIN):
                e = [emission(w) for w in words[at : at + L.CHAIN]]
                m = len(e)
                a, b = np.zeros((m, k)), np.zeros((m, k))
                a[0] = model.start + e[0]
                for t in range(1, m):
                    a[t] = [e[t][y] + np.logaddexp.reduce(a[t - 1] + model.trans[:, y]) for y in range(k)]
                for t in range(m - 2, -1, -1):
                    b[t] = [np.logaddexp.reduce(model.trans[y] + e[t + 1] + b[t + 1]) for y in range(k)]
                total += np.exp(a + b - np.logaddexp.reduce(a[-1])).sum(axis=0)
                n += m
        return model.langs[int(total.argmax())], total.max() / n

    texts = {r.doc_id: r.text for r in df.collect()}
    got = L.identify(df).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score = plain(texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_a_language_gives_a_bounded_number_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_BYTES", 500)
    texts, langs = L.sample(table(spark, [(k, "wort " * 60, "de") for k in range(40)] + [(k, "mot " * 2_000, "fr") for k in range(40, 60)]))
    assert langs.count("de") == 2 and langs.count("fr") == 1


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    e, t, s = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first, length = np.array([0, 4, 5]), np.array([4, 1, 4])
    gamma, pairs, begun = L.forward_backward(e, first, length, t, s)
    want, want_pairs = np.zeros_like(gamma), np.zeros_like(pairs)
    for a, n in zip(first, length):
        z, g, p = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(s[path[0]] + sum(e[a + k, y] for k, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
            z += w
            for k, y in enumerate(path):
                g[k, y] += w
            for x, y in zip(path, path[1:]):
                p[x, y] += w
        want[a : a + n] = g / z
        want_pairs += p / z
    assert np.allclose(gamma, want) and np.allclose(pairs, want_pairs) and np.allclose(begun, want[first].sum(axis=0))


def test_nothing_to_learn_from_and_empty_table(spark):
    assert {r.lang_pred for r in L.identify(table(spark, [(1, "some text", None), (2, "more", None)])).collect()} == {"und"}
    assert L.identify(table(spark, [(1, "x", "en")]).where("doc_id < 0")).collect() == []
    kept = L.keep_told(table(spark, corpus(60) + [(999, "1 2 3", "en")]).selectExpr("*", "1 as score"), 0.5)
    assert kept.columns[-1] == "score" and kept.where("doc_id = 999").count() == 0 and kept.count() == 59


def test_labelled_rows_without_words(spark):
    rows = [(1, " \n ", "en"), (3, "", "fr"), (4, None, "fr")]
    assert {r.lang_pred for r in L.identify(table(spark, rows)).collect()} == {"und"}


def test_every_label_is_learned(spark, monkeypatch):
    """More labels than the 200 that were once kept, and more than the rows of a sample allow SAMPLE_DOCS of."""
    rows = [(k, f"word{k % 230}a word{k % 230}b", f"l{k % 230:03}") for k in range(230 * 8)]
    texts, langs = L.sample(table(spark, rows))
    assert len(set(langs)) == 230
    monkeypatch.setattr(L, "SAMPLE_ROWS", 460)
    few = L.sample(table(spark, rows))[1]
    assert len(set(few)) == 230 and max(map(few.count, set(few))) == 2


def test_sample_is_the_first_rows_by_hash(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "SAMPLE_DOCS", 15)
    df = table(spark, corpus())
    rows = df.where(~L.held_out()).orderBy(F.xxhash64("doc_id", "text")).collect()
    want = sorted((r.doc_id, r.lang, r.text.encode()) for lang in WORDS for r in [r for r in rows if r.lang == lang][:15])
    texts, langs = L.sample(df)
    assert list(zip(langs, texts)) == [(lang, t) for _, lang, t in want]
