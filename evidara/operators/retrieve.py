"""Retrieval for batches of queries: exact, lexical and dense channels, fused by rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.functions import fixed

#: Queries sent to the tasks at once.
QUERY_BLOCK = 4_096
#: Scores that a task holds at once: a batch of vectors meets a block of queries in pieces of so many.
SCORES = 250_000


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group with their rank; partitions keep k rows per group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def exact_candidates(wanted: DataFrame, index: DataFrame, chunks: DataFrame, k: int = fixed.EXACT_LIMIT) -> DataFrame:
    """(query_id, chunk_id, score, rank): wanted (query_id, normalized_identifier) against the identifier index.

    Ten times the best type's weight plus the number of identifiers matched, plus a chunk's
    lexical_rank where wanted rows bring one by chunk, plus 100 for opening paragraphs (a
    boolean column `opening` of chunks) of queries that prefer them; active chunks only; ties by
    authority (unranked last), then id.
    """
    weight = F.coalesce(*(F.when(F.col("identifier_type") == t, w) for t, w in fixed.IDENTIFIER_WEIGHTS.items()), F.lit(1))
    hits = index.join(wanted.distinct(), "normalized_identifier").groupBy("query_id", "chunk_id").agg((10 * F.max(weight) + F.count(F.lit(1))).alias("score"))
    live = chunks.where("is_active")
    found = hits.join(live.select("chunk_id", "authority_rank", *({"lexical_rank", "opening"} & set(chunks.columns))), "chunk_id")
    if "lexical_rank" in chunks.columns:
        found = found.withColumn("score", F.col("score") + F.coalesce("lexical_rank", F.lit(0.0))).drop("lexical_rank")
    if "opening" in chunks.columns:
        found = found.withColumn("score", F.col("score") + F.when(F.col("opening"), 100).otherwise(0)).drop("opening")
    return top(found, ["query_id"], [F.desc("score"), F.asc_nulls_last("authority_rank"), F.asc("chunk_id")], k).drop("authority_rank")


def dense_candidates(queries: DataFrame, vectors: DataFrame, k: int = fixed.DENSE_LIMIT, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank): exact cosine search of queries (query_id, embedding) over all vectors (key, embedding).

    Queries go out in blocks of QUERY_BLOCK; each partition multiplies matrices of SCORES numbers
    at most and keeps k rows per query, so what is shuffled is k rows per query and partition.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64())])
    found = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").collect()  # a block of the queries
        ids = np.array([r.query_id for r in rows], np.int64)
        matrix = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((ids, matrix))

        def search(batches, sent=sent):  # noqa: ANN001, ANN202
            qids, q = sent.value
            row, best_s, best_k = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # the k best of each query so far
            least = np.full(len(qids), -np.inf)
            waiting = []  # (row, score, key) of pieces not yet merged

            def merge() -> None:
                nonlocal row, best_s, best_k
                row, best_s, best_k = (np.concatenate(x) for x in zip((row, best_s, best_k), *waiting))
                waiting.clear()
                order = np.lexsort((best_k, -best_s, row))
                row, best_s, best_k = row[order], best_s[order], best_k[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, best_s, best_k = row[kept], best_s[kept], best_k[kept]
                full = np.bincount(row, minlength=len(qids)) >= k
                least[full] = np.maximum(least[full], best_s[np.searchsorted(row, np.flatnonzero(full), side="right") - 1])

            step = max(1, SCORES // max(1, len(qids)))
            for batch in batches:
                for first in range(0, batch.num_rows if len(qids) else 0, step):
                    piece = batch.slice(first, step)
                    keys = piece.column(0).to_numpy(zero_copy_only=False)
                    v = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(piece.num_rows, -1)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    s = q @ v.T
                    at, new = np.nonzero(s >= least[:, None])  # ties included
                    waiting.append((at, s[at, new], keys[new]))
                    if sum(len(w[0]) for w in waiting) >= max(SCORES, len(row)):
                        merge()
            if waiting:
                merge()
            yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(best_k.astype(np.int64)), pa.array(best_s)], schema=schema)

        part = vectors.where("embedding is not null").select(F.col(key).cast("bigint").alias(key), "embedding").mapInArrow(search, f"query_id bigint, {key} bigint, score double")
        found = part if found is None else found.unionByName(part)
    return top(found, ["query_id"], [F.desc("score"), F.asc(key)], k)


def dense_candidates_sql(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The same by built-in functions, as a check; refuses more queries than go out at once."""
    if queries.count() > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries")
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    pairs = vectors.join(F.broadcast(queries.select("query_id", F.col("embedding").alias("q"))), F.lit(True))  # at most QUERY_BLOCK rows
    return top(pairs.select("query_id", key, dot.alias("score")), ["query_id"], [F.desc("score"), F.asc(key)], k)


def fused(channels: dict[str, DataFrame], key: str = "chunk_id", k: int = fixed.FUSED_LIMIT, weights: dict[str, float] | None = None, offset: int = fixed.FUSION_OFFSET) -> DataFrame:
    """(query_id, key, score, ranks, last_channel, rank): the weighted sum of 1 / (offset + rank) over the channels.

    ranks maps channel to rank; the payload of a row is that of the last channel that has it.
    """
    weights = weights or fixed.CHANNEL_WEIGHTS
    rows = None
    for place, (name, df) in enumerate(channels.items()):
        part = df.select("query_id", key, F.lit(name).alias("channel"), F.lit(place).alias("place"), F.col("rank"), (F.lit(weights[name]) / (offset + F.col("rank"))).alias("share"))
        rows = part if rows is None else rows.unionByName(part)
    total = rows.groupBy("query_id", key).agg(
        F.sum("share").alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "rank")))).alias("ranks"),
        F.max_by("channel", "place").alias("last_channel"),
    )
    return top(total, ["query_id"], [F.desc(F.round("score", 12)), F.asc(key)], k)


def resolved_queries(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, resolved): whether all identifiers of a query are in the index, active or not; queries without any are resolved."""
    known = index.select("normalized_identifier").distinct().withColumn("known", F.lit(1))
    return wanted.distinct().join(known, "normalized_identifier", "left").groupBy("query_id").agg((F.count("known") == F.count(F.lit(1))).alias("resolved"))


def hydrated(ranked: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of chunks for ranked ids with their ranks; missing and inactive ones drop out."""
    return ranked.join(chunks.where("is_active"), key)
