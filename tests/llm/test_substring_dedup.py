from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from evidara.llm import substring_dedup as S


def brute(rows, length=50):
    """rows: (doc_id, bytes)"""
    holder = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            holder[w] = min(i, holder.get(w, i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if holder[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        left = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def run(df, **k):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.drop_repeated_strings(df, **k).collect())


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(6)]
    made = []
    for _ in range(n):
        t = " ".join(word() for _ in range(rng.randrange(0, 50)))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            t += p[a : a + rng.randrange(30, 120)] + word()
        made.append(t)
    return made + [made[3], made[3], made[5] + "x", "", None, "a" * 49, "a" * 50, "a" * 51, "a" * 700, "ab" * 400, "x" + "ab" * 300, "\x00" * 80, "é" * 40, "q" * 60_000]


@pytest.mark.parametrize("crowded", [256, 0])
def test_equals_brute_force(docs, crowded):
    made = texts(7)
    want = brute([(k, (t or "").encode()) for k, t in enumerate(made, 1)])
    assert run(docs(made), crowded=crowded, shares=5) == want


def test_one_share_and_many(docs):
    made = texts(8, 25)
    want = brute([(k, (t or "").encode()) for k, t in enumerate(made, 1)])
    assert run(docs(made), shares=1) == want
    assert run(docs(made).repartition(7), shares=23) == want


def test_repeated_ids_empty_table_and_extra_columns(docs):
    t = "the same text, long enough to be found again: " + "abcdefgh" * 5
    rows = [(1, t), (1, t), (2, t), (3, "short")]
    want = brute([(i, x.encode()) for i, x in rows])
    assert run(docs(rows).selectExpr("*", "1 as part", "2 as key", "3 as bucket")) == want
    assert run(docs([]).where("doc_id < 0")) == []
    assert {(r.doc_id, r.n_removed) for r in S.drop_repeated_strings(docs([(1, t), (None, t)])).collect()} == {(1, 0), (None, len(t))}


def test_interval_expansion_equals_sorted_prefixes():
    rng = np.random.default_rng(2)
    s = np.concatenate([rng.integers(1, 4, 400), [0], rng.integers(1, 4, 50), np.tile([1, 2], 60), [0]]).astype(np.uint16)
    order, interval = S.expand_intervals(s, 9)
    prefix = lambda p: tuple(s[p : p + 9])
    whole = [k for k in range(len(s)) if order[k] + 9 <= len(s)]
    for a, b in zip(whole, whole[1:]):
        if b == a + 1:
            assert (interval[a] == interval[b]) == (prefix(order[a]) == prefix(order[b]))


def test_kept_text_round_trip(docs):
    t = "abcdefghij" * 6
    got = {r.doc_id: bytes(r.kept) for r in S.drop_repeated_strings(docs([t, "x" + t + "y"]), with_text=True).collect()}
    assert got == {1: t.encode(), 2: b"xy"}


@pytest.mark.parametrize("crowded", [S.CROWDED, 3])
def test_copies_in_any_order_equal_brute_force(docs, crowded):
    made = texts(9, 30)
    rows = list(enumerate(made * 3, 1))[::-1] + [(4, made[3]), (2, made[8]), (200, made[3]), (200, made[3])]
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert run(docs(rows).coalesce(1), crowded=crowded, shares=5) == want
    assert run(docs(rows).repartition(6), crowded=crowded) == want
    no_id = "abcdefghijk" * 6
    got = S.drop_repeated_strings(docs([(None, no_id), (7, no_id), (None, no_id)]), with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == [(0, 66, 1, b""), (0, 66, 1, b""), (7, 0, 0, no_id.encode())]


@pytest.mark.parametrize("remembered", [2, 100])
def test_a_task_hands_over_a_text_once_and_spreads_its_copies(remembered):
    t = b"one text that very many documents share, as a notice or a page of errors"
    ids = [7, 5, *range(8, 1008), 5]
    batch = pa.record_batch({"key": pa.array(ids, pa.int64()), "text": pa.array([t] * len(ids), pa.binary())})
    (out,) = S.fold_copies(iter([batch]), 10, 50, remembered)
    rows = out.to_pylist()
    assert [r["key"] for r in rows if r["text"] is not None] == [7]
    assert [r["key"] for r in rows if r["digest"] is not None] == [7, 5, 5]
    assert len({r["part"] for r in rows if r["digest"] is not None}) == 1
    assert max(np.bincount([r["part"] for r in rows if r["digest"] is None], minlength=10)) < 200
    assert {r["size"] for r in rows} == {len(t)}


def dealt(pairs, shares=1):
    (out,) = S.fold_copies(iter([pa.record_batch({"key": pa.array([i for i, _ in pairs], pa.int64()), "text": pa.array([t for _, t in pairs], pa.binary())})]), shares, 50)
    return pa.Table.from_batches([out])


def test_copies_send_no_strings():
    made = [(x + " ").encode() * 3 for x in ("once upon a time there was a very long text", "and another one that has nothing to do with it")]
    copies = dealt([(i, made[i % 2]) for i in range(100)])
    answers = S.answer_names(S.ask_directory(copies, 4, 50, 20), S.CROWDED)
    assert S.send_strings(copies, answers, 4, 50, 20).num_rows == 0
    assert sum(S.cut_out(copies, pa.table({"part": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())}), 50, False).column("n_removed").to_pylist()) == sum(len(made[i % 2]) for i in range(2, 100))


def test_only_names_of_many_strings_are_dealt_out_by_window():
    def hot(texts_of_shares, crowded):
        asked = []
        for part, some in enumerate(texts_of_shares):
            t = dealt(list(enumerate(some)))
            asked.append(S.ask_directory(t.set_column(0, "part", pa.array([part] * t.num_rows, pa.int32())), 1, 50, 20))
        answers = S.answer_names(pa.concat_tables(asked), crowded)
        n = [len(x.as_py()) // 7 for x in pa.concat_tables(asked).column("blob")]
        return any(np.unpackbits(np.frombuffer(b.as_py(), np.uint8)[(k + 7) // 8 :], count=k).any() for b, k in zip(answers.column("blob"), n))

    line = b"this line stands in every share of the documents, and nowhere else does"
    assert not hot([[line]] * 300, 300)  # one string, however many shares have it
    assert not hot([[line, line + b"!"]] * 20, 300)
    rng = random.Random(5)
    assert hot([[rng.randbytes(40) + line + rng.randbytes(40) for _ in range(40)] for _ in range(20)], 300)


@pytest.mark.parametrize("length", [1, 2, 6, 7, 8, 14, 15, 22, 50])
def test_intervals_of_any_length_equal_sorted_prefixes(length):
    rng = np.random.default_rng(length)
    strings = [rng.integers(1, 3, int(k)) for k in rng.integers(1, 120, 40)] + [np.full(130, 256), np.tile([2, 1, 1], 60)]
    s = np.concatenate([np.append(x, 0) for x in [*strings, *strings[:9]]]).astype(np.uint16)
    order, interval = S.expand_intervals(s, length)
    prefix = [tuple(s[p : p + length]) for p in order]
    inside = [len(x) == length and 0 not in x for x in prefix]
    seen = {}
    for x, i, ok in zip(prefix, interval.tolist(), inside):
        if ok:
            assert seen.setdefault(x, i) == i
    assert len(set(seen.values())) == len(seen)
    assert not set(seen.values()) & {i for i, ok in zip(interval.tolist(), inside) if not ok}


def test_a_block_takes_three_sorts_and_few_levels(monkeypatch):
    calls = {"argsort": 0, "cumsum": 0}
    for name in calls:
        f = getattr(np, name)
        monkeypatch.setattr(np, name, lambda *a, f=f, name=name, **k: calls.update({name: calls[name] + 1}) or f(*a, **k))
    s = np.random.default_rng(1).integers(1, 257, 5_000).astype(np.uint16)
    S.expand_intervals(np.append(np.tile(s, 3), 0).astype(np.uint16), 50)
    assert calls["argsort"] <= 3 and calls["cumsum"] <= 10


def test_search_takes_equal_strings_once_and_leaves_lone_ones(monkeypatch):
    rng = random.Random(3)
    line, lone = rng.randbytes(400), [rng.randbytes(70) for _ in range(2)]
    shares = [dealt([(10 * p, rng.randbytes(30) + line + rng.randbytes(30)), (10 * p + 1, lone[p % 2] + b"-" * p)]) for p in range(30)]
    shares = [t.set_column(0, "part", pa.array([p] * t.num_rows, pa.int32())) for p, t in enumerate(shares)]
    answers = S.answer_names(pa.concat_tables([S.ask_directory(t, 1, 50, 20) for t in shares]), S.CROWDED)
    sent = pa.concat_tables([S.send_strings(t, answers.filter(pa.array([x == p for x in answers.column("part").to_pylist()])), 1, 50, 20) for p, t in enumerate(shares)])
    seen, search = [], S.repeated_windows
    monkeypatch.setattr(S, "repeated_windows", lambda text, size, *a: seen.append((len(size), int(size.sum()))) or search(text, size, *a))
    wanted = sorted(r for r in zip(*S.search_strings(sent, 50).to_pydict().values()))
    assert len(seen) == 1 and seen[0][1] < sum(int(S._unpack(x.as_py())[1].sum()) for x in sent.column("blob")) / 2
    seen.clear()
    monkeypatch.setattr(S, "COMPARED", 100)
    assert sorted(r for r in zip(*S.search_strings(sent, 50, block=300).to_pydict().values())) == wanted
    assert len(seen) > 1
