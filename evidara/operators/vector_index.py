"""Approximate nearest vectors by an index of coarse cells, kept as tables.

Vectors belong to the cell of their nearest centroid by cosine. Centroids are fitted on a sample of at most
``SAMPLE`` vectors; every vector is indexed. A cell's vectors stand in blocks of at most ``BLOCK`` rows, so a crowded
cell is several blocks. A batch of queries is packed by the cells that it probes, and blocks meet in a
join on the cell: nothing is collected, and a row of the join is a block of vectors with a block of queries.

How many cells to probe depends on the data: `calibrated` finds the least number that reaches a given
recall for a sample of queries against the exact search.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import fixed
from evidara.operators.retrieve import dense_candidates, top

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4_096, 8
BLOCK, QUERIES = 2_048, 256
#: Queries that probes are calibrated with, and how far above the wanted recall.
CALIBRATION, MARGIN = 500, 0.015
SEED = 11

PACKED = "cell int, ids binary, vectors binary"
_PACKED = pa.schema([("cell", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])


def _unit(column: pa.Array, rows: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def fitted(vectors: DataFrame, cells: int, key: str = "chunk_id") -> np.ndarray:
    """Centroids of a sample of vectors (key, embedding), by spherical k-means."""
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64(key), key).select("embedding").limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0), np.float32)
    v = _unit(rows.column(0).combine_chunks(), rows.num_rows)
    rng = np.random.default_rng(SEED)
    c = v[rng.choice(len(v), min(cells, len(v)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = (v @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, v)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def _packed(rows: DataFrame, size: int, key: str) -> DataFrame:
    """Blocks of rows (cell, key, embedding) of the same cell."""

    def pack(batches):  # noqa: ANN001, ANN202
        cell, ids, vectors, held = None, [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vectors).tobytes()], pa.binary())], schema=_PACKED)

        for batch in batches:
            at, key_, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _unit(batch.column(2), batch.num_rows)
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                while lo < hi:
                    if held and (at[lo] != cell or held == size):
                        yield block()
                        ids, vectors, held = [], [], 0
                    cell, n = int(at[lo]), min(hi - lo, size - held)
                    ids.append(key_[lo : lo + n].astype(np.int64))
                    vectors.append(v[lo : lo + n])
                    lo, held = lo + n, held + n
        if held:
            yield block()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges part a crowded cell, too
    return rows.repartitionByRange(parts, "cell", F.xxhash64(key)).sortWithinPartitions("cell").mapInArrow(pack, PACKED)


def _nearest(rows: DataFrame, centroids: np.ndarray, probes: int, key: str) -> DataFrame:
    """(cell, key, embedding, place): each vector with its nearest cells."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CELLS

    def find(batches):  # noqa: ANN001, ANN202
        c = sent.value
        for batch in batches:
            order = np.argsort(-(_unit(batch.column(1), batch.num_rows) @ c.T), axis=1, kind="stable")[:, :probes]
            n = order.shape[1]
            take = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows))], names=["cell", key, "embedding", "place"])

    kind = dict(rows.dtypes)["embedding"]
    return rows.where("embedding is not null").select(F.col(key).cast("bigint").alias(key), "embedding").mapInArrow(find, f"cell int, {key} bigint, embedding {kind}, place int")


def build(vectors: DataFrame, folder: str, cells: int | None = None, key: str = "chunk_id") -> None:
    """Writes the index of vectors (key, embedding) to a new folder: centroids, which cell each vector is in, and the cells' blocks."""
    spark = vectors.sparkSession
    n = vectors.where("embedding is not null").count()
    centroids = fitted(vectors, cells or min(MOST_CELLS, max(1, math.isqrt(n))), key)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<float>").write.parquet(f"{folder}/centroids")
    if len(centroids):
        placed = _nearest(vectors, centroids, 1, key)
        placed.select("cell", key).write.parquet(f"{folder}/cells")
        _packed(placed, BLOCK, key).write.parquet(f"{folder}/blocks")


def centroids(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
    return np.array([r.centroid for r in rows], np.float32)


def search(queries: DataFrame, folder: str, probes: int, k: int = fixed.DENSE_LIMIT, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank): the k nearest by cosine among the vectors of each query's `probes` nearest cells; ties to the smaller key."""
    spark = queries.sparkSession
    c = centroids(spark, folder)
    empty = f"query_id bigint, {key} bigint, score double"
    if not len(c):
        return spark.createDataFrame([], empty + ", rank int")
    asked = _packed(_nearest(queries.select("query_id", "embedding"), c, probes, "query_id"), QUERIES, "query_id")
    pairs = spark.read.schema(PACKED).parquet(f"{folder}/blocks").join(asked.select("cell", F.col("ids").alias("asked"), F.col("vectors").alias("wanted")), "cell").select("ids", "vectors", "asked", "wanted")
    width = c.shape[1]

    def meet(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for ids, vectors, asked_, wanted in zip(*(col.to_pylist() for col in batch.columns)):
                ids, asked_ = np.frombuffer(ids, np.int64), np.frombuffer(asked_, np.int64)
                s = np.frombuffer(wanted, np.float32).reshape(len(asked_), width).astype(np.float64) @ np.frombuffer(vectors, np.float32).reshape(len(ids), width).astype(np.float64).T
                least = np.partition(s, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(asked_), -np.inf)
                q, v = np.nonzero(s >= least[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(asked_[q]), pa.array(ids[v]), pa.array(s[q, v])], names=["query_id", key, "score"])

    return top(pairs.mapInArrow(meet, empty), ["query_id"], [F.desc("score"), F.asc(key)], k)


def calibrated(vectors: DataFrame, folder: str, recall: float = 0.95, k: int = 20, key: str = "chunk_id") -> int:
    """The least number of cells to probe for the recall: where the exact neighbours of a sample of vectors lie in the order of cells."""
    spark = vectors.sparkSession
    c = centroids(spark, folder)
    drawn = vectors.where("embedding is not null").orderBy(F.xxhash64(key, F.lit(SEED)), key).limit(CALIBRATION).select(F.col(key).alias("query_id"), "embedding")
    exact = dense_candidates(drawn, vectors, k, key)
    order = _nearest(drawn, c, len(c), "query_id").select("query_id", "cell", "place")
    found = exact.join(spark.read.parquet(f"{folder}/cells"), key).join(order, ["query_id", "cell"])
    counts = {r.place: r.n for r in found.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_CELLS
    total, so_far = sum(counts.values()), 0
    for place in range(len(c)):
        so_far += counts.get(place, 0)
        if so_far >= min(1.0, recall + MARGIN) * total:
            return place + 1
    return max(1, len(c))
