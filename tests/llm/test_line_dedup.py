from __future__ import annotations

import hashlib
import random

import numpy as np

from evidara.llm import line_dedup as L

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and i < max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def run(df):
    return sorted(tuple(r) for r in L.drop_repeated_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())


def test_equals_brute_force(docs):
    rng = random.Random(5)
    pool = [f"  Line number {k} is Repeated ÄÖ{'é' * (k % 3)}\t" for k in range(12)] + ["short", "", "x" * 19, "y" * 20, "é" * 19, "É" * 20]
    rows = [(k, "\n".join(rng.choice(pool + [f"only here {k} {j} and nowhere else"]) for j in range(rng.randrange(1, 9)))) for k in range(1, 90)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "z" * 200_000 + "\n" + pool[0].upper())]
    assert run(docs(rows)) == brute(rows)


def test_empty_table_and_clashing_columns(spark, docs):
    assert run(docs([]).where("doc_id < 0")) == []
    names = ["n_lines", "n_dropped", "kept_sha256", "_lost_id", "_lost_keys", "lost", "who", "which", "line", "keeper", "digest", "share"]
    for bound in (L.KNOWN_LINES, 0):
        df = docs(["a line that is long enough to count"] * 3).selectExpr("*", *(f"{k} as `{n}`" for k, n in enumerate(names)))
        got = L.drop_repeated_lines(df, most_known=bound)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", *names[3:], *names[:3]]
        rows = got.orderBy("doc_id").collect()
        assert [r.n_dropped for r in rows] == [1, 1, 0] and {r.which for r in rows} == {7}
        plain = L.drop_repeated_lines(df, report=False, count="n_chars", most_known=bound)
        assert plain.dtypes == df.dtypes
        assert [(r.text, r.n_chars, r.n_dropped) for r in plain.orderBy("doc_id").collect()] == [("", 0, 1), ("", 0, 1), ("a line that is long enough to count", 35, 1)]


def test_the_ways_for_few_and_many_lines_agree(docs):
    rng = random.Random(9)
    pool = [f"a line that may stand in several documents {k}" for k in range(9)]
    rows = [(rng.choice([k, k, 3, None]), "\n".join(rng.choices(pool, k=rng.randrange(1, 5)))) for k in range(40)] + [(None, None), (50, "")]
    df = docs(rows)
    both = [sorted(map(repr, L.drop_repeated_lines(df, most_known=n).collect())) for n in (L.KNOWN_LINES, 0)]
    assert both[0] == both[1]


def test_digests_that_share_a_half():
    d = np.array([[5, 1], [5, 9], [2, 2]], np.uint64)
    known = L.Known(d, np.array([10, 20, 30]))
    asked = [(5, 9), (5, 1), (5, 4), (2, 2), (7, 7)]
    assert known.keepers([a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in asked]).tolist()[:2] == [20, 10]
    assert known.keepers([(2).to_bytes(8, "big") * 2]).tolist() == [30]
    assert (known.keepers([(5).to_bytes(8, "big") + (4).to_bytes(8, "big")]) < 0).all()


def test_repeated_rows_count_as_one_document(docs):
    line = "a line that is long enough to count"
    assert run(docs([(1, line), (1, line), (2, line)])) == brute([(1, line), (1, line), (2, line)])


def test_filter_has_no_false_negative_even_when_full():
    h = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    bits = L.twice_seen([np.unique(h), np.unique(h[:3000])], [np.zeros(0, np.uint64)], 64)
    assert L.BloomFilter(bits).holds(h[:3000]).all()
