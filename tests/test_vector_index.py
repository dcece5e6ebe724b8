from __future__ import annotations

import random

import pytest

from evidara.operators import retrieve, vector_index

VECTORS = "chunk_id bigint, embedding array<float>"


def clustered(n, centres, dim=16, seed=5):
    rng = random.Random(seed)
    c = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(k, [x + rng.gauss(0, 0.35) for x in c[k % centres]]) for k in range(n)]


def pairs(df):
    return {(r.query_id, r.chunk_id) for r in df.collect()}


def asked(vectors):
    return vectors.where("chunk_id % 25 = 0").withColumnRenamed("chunk_id", "query_id")


def test_recall_against_the_exact_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    rows = clustered(3_000, 30) + [(k, clustered(1, 1)[0][1]) for k in range(3_000, 4_500)]  # one crowded cell of copies
    vectors = spark.createDataFrame(rows, VECTORS).repartition(5)
    vector_index.build(vectors, str(tmp_path / "i"))
    blocks = spark.read.parquet(str(tmp_path / "i/blocks"))
    assert blocks.selectExpr("sum(length(ids)) / 8").first()[0] == 4_500 and blocks.selectExpr("max(length(ids)) / 8").first()[0] <= 64
    wanted = vectors.where("chunk_id < 3000")
    exact = pairs(retrieve.dense_candidates(asked(wanted), vectors, 20))
    probes = vector_index.calibrated(wanted, str(tmp_path / "i"), 0.95, 20)
    found = pairs(vector_index.search(asked(wanted), str(tmp_path / "i"), probes, 20))
    assert len(found & exact) >= 0.95 * len(exact) and probes < 67 / 2


def test_all_cells_are_exact(spark, tmp_path):
    vectors = spark.createDataFrame(clustered(400, 7) + [(900, None), (901, [0.0] * 16), (902, clustered(1, 1)[0][1])], VECTORS)
    vector_index.build(vectors, str(tmp_path / "i"), cells=9)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, pytest.approx(r.score, abs=1e-6)) for r in df.collect())
    assert key(vector_index.search(asked(vectors), str(tmp_path / "i"), 9, 30)) == key(retrieve.dense_candidates(asked(vectors).where("embedding is not null"), vectors, 30))


def test_without_vectors(spark, tmp_path):
    vectors = spark.createDataFrame([], VECTORS)
    vector_index.build(vectors, str(tmp_path / "i"))
    assert vector_index.search(asked(vectors), str(tmp_path / "i"), 3).collect() == []
