from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from evidara.llm import hard_negatives as H

ROWS = "vec_id bigint, embedding array<double>, label int"


def plain(rows, positives=5, negatives=3, low=50, high=95, every=50):
    """Every anchor with every row."""
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, tuple(math.floor(256 * x) for x in v))
        known[i] = min(known.get(i, row), row)
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lab) for i, (lab, w) in known.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(-n, i) for n, i, lab in scored if lab != label and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, k, i, -s, n) for k, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    return sorted(tuple(r) for r in H.mine(H.quantised(df), F.col("id") % 50 == 0, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def made(seed, n, labels, norms, dim=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.gauss(0, 1) + 1 for _ in range(dim)]
        size = norms(rng) / math.sqrt(sum(x * x for x in v))
        out.append((i, [x * size for x in v], rng.randrange(labels)))
    return out


@pytest.mark.parametrize(("labels", "norms"), [(3, lambda r: 1.0), (2, lambda r: r.choice([0.05, 0.3, 1, 4])), (40, lambda r: 10 ** r.uniform(-2, 3))])
def test_equals_trying_every_pair(spark, monkeypatch, labels, norms):
    monkeypatch.setattr(H, "BUCKET", 16)
    monkeypatch.setattr(H, "SHELF", 2)
    monkeypatch.setattr(H, "BLOCK", 3)
    monkeypatch.setattr(H, "GROUP", 2)
    rows = made(labels, 420, labels, norms)
    rows += [(1_000, rows[100][1], 1), (1_050, rows[100][1], 1), (1_100, rows[100][1], 0), (-50, rows[3][1], 0)]  # ties
    want = plain(rows)
    assert want and run(spark, rows) == want


def test_nulls_repeats_and_other_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(5, 120, 2, lambda r: 1.0)
    rows += [(None, rows[0][1], 1), (200, None, 1), (250, rows[1][1], None), (300, [1.0, None], 0), (350, [nan] * 6, 0), (400, [-inf] * 6, 0)]  # take no part
    rows += [rows[50], rows[50], (100, [0.1] * 6, 1), (450, [1.0, 2.0], 0), (451, [1.0, 2.0], 0), (452, [1.0, 1.0], 1), (500, [], 0), (501, [], 0), (502, [], 1), (550, [0.0] * 6, 0)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, positives=2, negatives=1, low=10, high=99) == plain(rows, 2, 1, 10, 99)
    assert run(spark, []) == [] and run(spark, rows[1:40]) == []
    named = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as id", "2 as q", "3 as norm", "4 as score")
    assert H.mine(H.quantised(named), F.col("id") % 50 == 0).count() == len(plain(rows))


def test_large_components_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(1, 2) * 1e6 for _ in range(4)], i % 2) for i in range(101)]  # products beyond 2^53
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows + [(50_000, [1e300] * 4, 0)]) == plain(rows)  # a score that no long holds


def test_needs_drop_buckets(spark, monkeypatch):
    """With norms far apart most pairs of block and bucket never meet."""
    met = []
    monkeypatch.setattr(H, "BUCKET", 8)
    b = H._Best(*(x.tobytes() for x in map(H.np.int64, ([1], [0]))), H.np.array([[100, 0]], H.np.int32).tobytes(), H.np.array([[0, 0, 5_000, 9_000, 5_000]]).tobytes(), 2, 1, False)
    b._meet = lambda *a: met.append(a[-1])
    for norm in (200.0, 50.0, 49.0, 1.0):
        b.meet(norm, H.np.array([2]), H.np.array([1]), H.np.array([[norm, 0]]))
    assert met == [200.0, 50.0]
