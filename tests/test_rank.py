from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidara.functions import stats
from evidara.operators import answer, evaluate, gates, rerank, retrieve


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, content string")


def test_greedy_deduplication_equals_a_loop(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.randrange(0, 6))) for _ in range(40)]
    rows = [(q, k, rng.choice(pool)) for q in range(5) for k in range(1, 61)]
    want = set()
    for q in range(5):
        kept = []
        for _, k, t in sorted(r for r in rows if r[0] == q):
            s = {w for w in t.split() if len(w) > 1}
            if not any(s == o or s | o and len(s & o) / len(s | o) >= 0.6 for o in kept):
                kept.append(s)
                want.add((q, k))
    got = {(r.query_id, r["rank"]) for r in rerank.deduplicated(candidates(spark, rows), threshold=0.6).collect()}
    assert got == want


def test_budget_skips_and_first_always_fits(spark):
    kids = spark.createDataFrame([(1, 1, "p1"), (1, 2, "p2"), (1, 3, "p1"), (1, 4, "p3"), (2, 1, "p2"), (2, 2, "p3")], "query_id int, reranked int, parent_id string")
    parents = spark.createDataFrame([("p1", 60), ("p2", 900), ("p3", 30)], "parent_id string, text_units int")
    got = {q: [(r.parent_id, r.used_units) for r in rows] for q, rows in _by(rerank.budgeted(kids, parents, 100, 10).orderBy("query_id", "ordinal").collect())}
    assert got == {1: [("p1", 60), ("p3", 90)], 2: [("p2", 900)]}
    assert [r.evidence_id for r in rerank.budgeted(kids, parents, 10_000, 2).where("query_id = 1").orderBy("ordinal").collect()] == ["E1", "E2"]


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append(r)
    return out.items()


def test_fusion_weights_ranks_and_last_channel(spark):
    ch = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id int, rank int")
    df = retrieve.fused({"exact": ch([(1, 7, 1)]), "lexical": ch([(1, 8, 1), (1, 7, 2)]), "dense": ch([(1, 9, 1), (1, 8, 2)])}, k=3)
    got = {r.chunk_id: r for r in df.collect()}
    assert got[7].score == pytest.approx(2 / 61 + 1 / 62) and got[7]["rank"] == 1 and got[7].last_channel == "lexical" and got[8].ranks == {"lexical": 1, "dense": 2}


def test_dense_search_equals_built_in_functions(spark):
    rng = random.Random(3)
    v = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)]
    v = [(k, [x / sum(y * y for y in e) ** 0.5 for x in e]) for k, e in v] + [(400, v[0][1])]
    vectors = spark.createDataFrame(v, "chunk_id bigint, embedding array<double>")
    asked = vectors.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())
    normal = vectors.withColumn("embedding", F.expr("transform(embedding, x -> x / sqrt(aggregate(embedding, 0D, (a, y) -> a + y * y)))"))
    assert key(retrieve.dense_candidates(asked, normal.repartition(5), 20)) == key(retrieve.dense_candidates_sql(normal.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), normal, 20))


def test_percentile_definitions(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 20, 21, 101):
        xs = [rng.randrange(0, 30) / 2 for _ in range(n)]
        df = spark.createDataFrame([(1, x) for x in xs], "g int, x double")
        r = stats.order_statistics(df, "x", ["g"], {"a": stats.nearest_rank(0.95), "b": stats.floor_rank(0.95), "m": stats.upper_median()}).first()
        s = sorted(xs)
        assert (r.a, r.b, r.m) == (s[min(n - 1, round((n - 1) * 0.95))], s[min(n - 1, int(n * 0.95))], s[n // 2])


def test_ndcg_and_its_corrected_form(spark):
    df = spark.createDataFrame([([0, 1, 0, 1],), ([0, 0],), ([1],)], "r array<int>")
    got = [tuple(round(x, 6) for x in r) for r in df.select(stats.ndcg(F.col("r"), 3), stats.ndcg(F.col("r"), 3, F.lit(2))).collect()]
    assert got == [(0.386853, 0.386853), (1.0, 0.0), (1.0, 0.613147)]


def test_validity_intervals_and_sub_maps(spark):
    f = spark.createDataFrame([(1, 10), (1, 20), (1, 30)], "k int, day int")
    v = spark.createDataFrame([(1, 10, 20), (1, 30, None)], "k int, valid_from int, valid_to int")
    assert [r.day for r in evaluate.as_of(f, v, ["k"], "day").orderBy("day").collect()] == [10, 20, 30]
    assert [r.day for r in evaluate.as_of(f, v, ["k"], "day", half_open=True).orderBy("day").collect()] == [10, 30]
    m = spark.createDataFrame([({"a": "1"}, {"a": "1", "b": "2"}), ({"a": "1"}, {"b": "2"}), ({}, {})], "e map<string,string>, a map<string,string>")
    assert [r[0] for r in m.select(evaluate.sub_map(F.col("e"), F.col("a"))).collect()] == [True, False, True]


def test_scope_is_refused_before_planning(spark):
    df = spark.createDataFrame([("t1", "m1", "PUBLIC_OFFICIAL"), ("t2", "m2", "PUBLIC_OFFICIAL")], "tenant_id string, matter_id string, classification string")
    assert gates.tenant_rows(df, None).count() == gates.tenant_rows(df, "").count() == 0
    assert gates.enforced(df, gates.Scope("t1", frozenset({"m1"})), "m1").count() == 1
    for scope, matter in ((None, None), (gates.Scope(None), None), (gates.Scope("t1"), "m1")):
        with pytest.raises(gates.ScopeError):
            gates.enforced(df, scope, matter)


def test_adequacy_rules_in_order(spark):
    unit = ("E1", "d", "v", "p", "TR 2022/3", "About trusts", "https://x", None, "dense+exact+reranker", 0.8, "income of trusts and rates")
    weak = unit[:8] + ("dense+reranker", 0.1, "nothing near")
    cases = [("trust income rates", [unit], "ADEQUATE"), ("trust income", [], "INADEQUATE"), ("HMRC rules", [unit], "INADEQUATE"), ("what does TR 2022/3 say", [unit], "ADEQUATE"), ("what does TR 9999/9 say", [unit], "INADEQUATE"), ("what is the", [unit], "INADEQUATE"), ("trust income rates", [weak], "INADEQUATE"), ("nothing near trust income rates", [weak], "WEAK")]
    df = spark.createDataFrame([(k, q, e) for k, (q, e, _) in enumerate(cases)], f"k int, q string, e {answer.EVIDENCE}")
    assert [r[1] for r in df.select("k", answer.adequacy(F.col("q"), F.col("e"))).orderBy("k").collect()] == [c[2] for c in cases]


def test_dense_search_in_small_pieces(spark, monkeypatch):
    """A batch of vectors meets the queries in pieces of a few scores, ties included, and finds the same."""
    rng = random.Random(31)
    rows = [(k, [float(rng.randrange(-2, 3)) for _ in range(3)] if k % 9 else None) for k in range(400)]
    vectors = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>").coalesce(2)
    asked = vectors.where("chunk_id % 25 = 1 and embedding is not null").withColumnRenamed("chunk_id", "query_id")
    found = []
    for scores in (1, 40, 10**6):
        monkeypatch.setattr(retrieve, "SCORES", scores)
        found.append(sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieve.dense_candidates(asked, vectors, 7).collect()))
    assert [f[:3] for f in found[0]] == [f[:3] for f in found[1]] == [f[:3] for f in found[2]] and len(found[0]) == 7 * asked.count()
