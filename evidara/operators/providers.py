"""Calls to model providers behind an interface: batches, retries and checks of what comes back.

A provider is any callable; the defaults are deterministic and local. Nothing here opens a
connection. Rows go through in micro-batches inside Arrow maps.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 128
Embed = Callable[[Sequence[str]], tuple[list[list[float]], int]]
Score = Callable[[str, Sequence[str]], list[tuple[int, float]]]


class ProviderError(ValueError):
    pass


def with_retries(call: Callable[[], object], attempts: int = 8, first: float = 2.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep, retryable: tuple[type[Exception], ...] = (OSError, TimeoutError)):  # noqa: ANN201
    """Calls again after transport errors, waiting twice as long each time up to a bound."""
    wait = first
    for k in range(attempts):
        try:
            return call()
        except retryable:
            if k == attempts - 1:
                raise
            sleep(wait)
            wait = min(2 * wait, longest)


def micro_batches(rows: list, size: int = MOST) -> list[list]:
    if not 1 <= size <= MOST:
        raise ValueError(f"a batch has 1 to {MOST} rows")
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def checked_vectors(texts: Sequence[str], vectors: list[list[float]], tokens: int, dimension: int) -> list[list[float]]:
    """The vectors, if they are one per text, of the right dimension and finite numbers."""
    if not texts or len(texts) > MOST or not all(t.strip() for t in texts):
        raise ProviderError("a batch has 1 to 128 texts, none empty")
    if len(vectors) != len(texts):
        raise ProviderError("not one vector per text")
    a = np.asarray(vectors, np.float64)
    if a.shape != (len(texts), dimension) or not np.isfinite(a).all():
        raise ProviderError("a vector is not of the profile's shape")
    if not isinstance(tokens, int) or tokens < 0:
        raise ProviderError("usage is not a count")
    return vectors


def checked_scores(n: int, top: int, scores: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The scores, if they are for `top` different candidates and lie between 0 and 1."""
    index = [i for i, _ in scores]
    if len(scores) != min(top, n) or len(set(index)) != len(index) or not all(0 <= i < n for i in index) or not all(0.0 <= s <= 1.0 for _, s in scores):
        raise ProviderError("scores do not fit the candidates")
    return scores


def local_embedding(dimension: int = 64) -> Embed:
    """Hashed words, signed and normalised: no model, the same everywhere."""

    def embed(texts: Sequence[str]) -> tuple[list[list[float]], int]:
        out, n = [], 0
        for t in texts:
            v = np.zeros(dimension)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dimension] += 1 if h >> 63 else -1
                n += 1
            length = np.linalg.norm(v)
            out.append((v / length if length else np.eye(1, dimension)[0]).tolist())
        return out, n

    return embed


def embedded(rows: DataFrame, key: str, text: str, provider: Embed, dimension: int, size: int = MOST) -> DataFrame:
    """(key, embedding, input_sha256, input_tokens share of its batch); empty texts drop out."""
    schema = pa.schema([(key, pa.int64()), ("embedding", pa.list_(pa.float32())), ("input_sha256", pa.string()), ("batch_tokens", pa.int64())])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            pairs = [(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and t.strip()]
            for part in micro_batches(pairs, size):
                texts = [t for _, t in part]
                vectors, tokens = with_retries(lambda texts=texts: provider(texts))
                checked_vectors(texts, vectors, tokens, dimension)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array(vectors, schema[1].type), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]), pa.array([tokens] + [0] * (len(part) - 1), pa.int64())], schema=schema)

    return rows.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"{key} bigint, embedding array<float>, input_sha256 string, batch_tokens bigint")


def embedding_run(chunks: DataFrame, embeddings: DataFrame, profile: str, provider: Embed, dimension: int, ceiling: int | None = None) -> tuple[DataFrame, dict]:
    """(new vectors, ledger row): embeds what has no vector of the same input under the profile, unless its tokens would pass a ceiling.

    chunks: chunk_id, text, embedding_input_sha256. Running it again after the vectors were added embeds nothing.
    """
    from evidara.operators.index import missing_embeddings

    todo = missing_embeddings(chunks, embeddings, profile)
    estimate = todo.agg(F.count(F.lit(1)).alias("inputs"), F.coalesce(F.sum(F.ceil(F.length("text") / 4)), F.lit(0)).alias("tokens")).first()
    ledger = {"profile_id": profile, "inputs": estimate.inputs, "estimated_tokens": int(estimate.tokens), "batches": -(-estimate.inputs // MOST)}
    if ceiling is not None and estimate.tokens > ceiling:
        return embeddings.limit(0), ledger | {"status": "budget_stopped"}
    new = embedded(todo, "chunk_id", "text", provider, dimension).select("chunk_id", F.lit(profile).alias("profile_id"), "embedding", "input_sha256")
    return new, ledger | {"status": "complete"}


def provider_reranked(candidates: DataFrame, provider: Score, n: int) -> DataFrame:
    """Candidates (query_id, query, rank, content) with the provider's scores and ranks; a query's candidates, at most CANDIDATE_LIMIT, go in one call."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        got = checked_scores(len(pdf), n, with_retries(lambda: provider(pdf["query"][0], list(pdf["content"]))[:n]))
        order = sorted(got, key=lambda x: (-x[1], x[0]))
        return pd.DataFrame({"query_id": [pdf["query_id"][0]] * len(order), "rank": [pdf["rank"][i] for i, _ in order], "score": [s for _, s in order], "reranked": range(1, len(order) + 1)})

    from evidara.functions import fixed

    return candidates.where(F.col("rank") <= fixed.CANDIDATE_LIMIT).groupBy("query_id").applyInPandas(run, "query_id bigint, rank int, score double, reranked int")


#: Rows of a commit.
VECTORS = "chunk_id bigint, profile_id string, embedding array<float>, input_sha256 string, batch_tokens bigint, commit int"


def _commits(spark: SparkSession, folder: str) -> list[str]:
    """Folders of finished commits, in order; one that failed half way has no mark and is written over."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commit-*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(str(f.getPath().getParent().toString()) for f in found or ())


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, profile_id, embedding, input_sha256, batch_tokens, commit) of all finished commits."""
    paths = _commits(spark, folder)
    if not paths:
        return spark.createDataFrame([], VECTORS)
    return spark.read.schema(VECTORS).parquet(*paths)


def resumable_run(chunks: DataFrame, folder: str, profile: str, provider: Embed, dimension: int, ceiling: int | None = None, rows: int = 100_000, most: int | None = None) -> dict:
    """Embeds chunks (chunk_id, text, embedding_input_sha256) in commits of about `rows` rows under a folder, and returns the run's ledger row.

    What finished commits hold is left out, by an anti join, so a run that stopped or failed goes on where
    it was. It stops before a commit once the tokens of all commits reach the ceiling (budget_stopped), or
    after `most` commits (paused). The rows of a commit are drawn by a hash and embedded by all tasks.
    """
    from evidara.operators.index import missing_embeddings

    spark = chunks.sparkSession
    before = committed(spark, folder).where(F.col("profile_id") == profile)
    todo = missing_embeddings(chunks, before, profile)
    tokens = before.agg(F.coalesce(F.sum("batch_tokens"), F.lit(0))).first()[0]
    left, first = todo.count(), len(_commits(spark, folder))
    slices, done, embedded_rows, status = -(-left // rows), 0, 0, "complete"
    for k in range(slices):
        if most is not None and done >= most:
            status = "paused"
            break
        if ceiling is not None and tokens >= ceiling:
            status = "budget_stopped"
            break
        own = todo.where(F.pmod(F.xxhash64("chunk_id"), F.lit(slices)) == k)
        new = embedded(own, "chunk_id", "text", provider, dimension)
        out = f"{folder}/commit-{first + done:08d}"
        new.select("chunk_id", F.lit(profile).alias("profile_id"), "embedding", "input_sha256", "batch_tokens", F.lit(first + done).alias("commit")).write.mode("overwrite").parquet(out)
        counts = spark.read.schema(VECTORS).parquet(out).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("batch_tokens"), F.lit(0)).alias("tokens")).first()
        embedded_rows, tokens, done = embedded_rows + counts.n, tokens + counts.tokens, done + 1
    return {"profile_id": profile, "status": status, "commits": done, "embedded": embedded_rows, "corpus_tokens": int(tokens)}
