"""Hard-negative mining by norm-bucketed search (operator 11).

Components are quantised to integers, so scores - inner products - are exact. Rows are sorted by
norm, longest first, into shelves (ranges of the sort) and, in a shelf, into buckets of ``BUCKET`` rows with
their largest norm. Anchors go in blocks of ``BLOCK`` and look for the best rows within windows of
scores: first one open window over rows of their own label, which gives the positives; then a
window for each positive over rows of other labels, which gives the negatives.

By Cauchy-Schwarz no row of a bucket scores more than the anchor's norm times the bucket's largest
one. So an anchor needs no bucket whose norm falls short of its least need - a window's lower limit, or its running
k-th score, if higher - divided by its own norm. Shelves are searched in up to three waves of growing
size, longest norms first; after a wave the needs are those of all that was found, and anchors that need nothing
more drop out. A block meets the buckets of a shelf in a join on (shelf, group of blocks), a pair of block and bucket to a
row: no task holds more than a block, a bucket and the block's best rows.

Rows with a null label, a null vector, or any null or non-finite component take no part, nor do
rows without an id, which nothing could name, nor vectors whose squared quantised norm reaches
2^62, as their scores need not fit a long. An id names one row: rows that repeat it count once, as
the one that sorts first by label and vector. Vectors of different lengths do not pair; empty
ones score 0 with each other. Ties go to the smaller id. Empty tables give no rows, other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.llm.common import Batches, emit, one_thread, shared_folder

#: Rows of a bucket, buckets of a shelf; anchors of a block, blocks that meet a shelf in one group.
BUCKET, SHELF, BLOCK, GROUP = 2_048, 8, 256, 16

#: Norms and needs are doubles: bounds are loosened by this share.
SLACK = 1e-9

_BUCKETS = pa.schema([("shelf", pa.int32()), ("dim", pa.int32()), ("norm", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
_BLOCKS = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ratio", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("windows", pa.binary())])
_FOUND = pa.schema([("anchor_id", pa.int64()), ("window", pa.int64()), ("found_id", pa.int64()), ("score", pa.int64())])
_DDL = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {next(k for k, v in _DDL.items() if v == f.type)}" for f in schema)


def quantised(embeddings: DataFrame, label: Column | None = None, scale: int = 256) -> DataFrame:
    """(id, label, q, norm): floor(scale * x) of every row that takes part, one row an id."""
    known = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & known)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("id"), (F.col("label") if label is None else label).cast("bigint").alias("label"), whole.alias("q"))
    small = rows.where(square < float(1 << 62)).withColumn("q", F.col("q").cast("array<int>"))
    one = small.groupBy("id").agg(F.min(F.struct("label", "q")).alias("row")).select("id", "row.*")
    return one.withColumn("norm", F.sqrt(square))


def _runs(batches: Batches, size: int):  # noqa: ANN202
    """(dimension, rows) with at most `size` rows of the same dimension, in the order of the rows."""
    held: dict[int, list[pa.RecordBatch]] = {}
    count: dict[int, int] = {}

    def flush(dim: int):  # noqa: ANN202
        rows = pa.Table.from_batches(held.pop(dim)).combine_chunks()
        count.pop(dim)
        for at in range(0, rows.num_rows, size):
            yield dim, rows.slice(at, size)

    for batch in batches:
        dims = np.asarray(batch.column(batch.schema.get_field_index("q")).value_lengths())
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            held.setdefault(dim, []).append(part)
            count[dim] = count.get(dim, 0) + part.num_rows
            if count[dim] >= size:
                rows = pa.Table.from_batches(held[dim]).combine_chunks()
                full = rows.num_rows // size * size
                for at in range(0, full, size):
                    yield dim, rows.slice(at, size)
                held[dim], count[dim] = rows.slice(full).combine_chunks().to_batches(), rows.num_rows - full
                if not count[dim]:
                    held.pop(dim), count.pop(dim)
        if sum(count.values()) >= 4 * size:
            for dim in list(held):
                yield from flush(dim)
    for dim in list(held):
        yield from flush(dim)


def _columns(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    vectors = rows.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(rows.num_rows, dim)
    return rows.column("id").to_numpy(), rows.column("label").to_numpy(), vectors, rows.column("norm").to_numpy()


def shelved(rows: DataFrame, folder: str) -> DataFrame:
    """Buckets of all rows by falling norm, written to a folder."""
    n = rows.count()
    shelves = max(1, -(-n // (BUCKET * SHELF)))
    ranged = rows.repartitionByRange(shelves, F.desc("norm"), F.xxhash64("id")).sortWithinPartitions(F.desc("norm"))

    def pack(batches: Batches) -> Batches:
        shelf = TaskContext.get().partitionId()
        for dim, part in _runs(batches, BUCKET):
            ids, labels, vectors, norm = _columns(part, dim)
            order = np.argsort(ids)  # the first of equal scores is the smallest id
            yield emit(_BUCKETS, [[shelf], [dim], [float(norm.max())], [ids[order].tobytes()], [labels[order].tobytes()], [vectors[order].tobytes()]])

    ranged.mapInArrow(pack, _ddl(_BUCKETS)).write.parquet(folder)
    return rows.sparkSession.read.schema(_ddl(_BUCKETS)).parquet(folder)


def _blocks(anchors: DataFrame, groups: int) -> DataFrame:
    """Anchors (id, label, q, norm, ratio, windows) in groups, and in each group those of similar needs in blocks."""
    ranged = anchors.repartition(groups, "id").sortWithinPartitions("ratio")

    def pack(batches: Batches) -> Batches:
        k = TaskContext.get().partitionId() << 32
        for dim, part in _runs(batches, BLOCK):
            ids, labels, vectors, norm = _columns(part, dim)
            lists = part.column("windows").combine_chunks()
            at = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
            flat = lists.flatten()
            window, low, high, need = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("window", "low", "high", "need"))
            yield emit(_BLOCKS, [[k], [dim], [float(part.column("ratio").to_numpy().min())], [ids.tobytes()], [labels.tobytes()], [vectors.tobytes()], [np.stack([at, window, low, high, need], axis=1).tobytes()]])
            k += 1

    return ranged.mapInArrow(pack, _ddl(_BLOCKS))


class _Best:
    """The k best rows of every window of a block."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, windows: bytes, dim: int, k: int, same: bool):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(len(self.ids), dim).astype(np.float64)
        self.norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.at, self.window, self.low, self.high, self.need = np.frombuffer(windows, np.int64).reshape(-1, 5).T
        self.need = self.need.copy()
        self.score = np.full((len(self.at), k), np.iinfo(np.int64).min)
        self.found = np.full((len(self.at), k), np.iinfo(np.int64).max)
        self.k, self.same, self.dim = k, same, dim

    def meet(self, norm: float, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        # a window looks into a bucket only if its anchor can reach what it needs there
        open_ = np.flatnonzero((self.norm[self.at] * norm * (1 + SLACK) >= self.need) & (self.need <= self.high))
        if self.same:
            for label in np.unique(self.labels[self.at[open_]]):
                columns = np.flatnonzero(labels == label)
                if len(columns):
                    self._meet(open_[self.labels[self.at[open_]] == label], ids[columns], None, vectors[columns], norm)
        elif len(open_):
            self._meet(open_, ids, labels, vectors, norm)

    def _meet(self, windows: np.ndarray, ids: np.ndarray, labels: np.ndarray | None, vectors: np.ndarray, norm: float) -> None:
        rows, of = np.unique(self.at[windows], return_inverse=True)
        if self.norm[rows].max() * norm < 1 << 52:  # sums of products are exact in doubles
            scores = (self.vectors[rows] @ vectors.astype(np.float64).T).astype(np.int64)
        else:
            scores = self.vectors[rows].astype(np.int64) @ vectors.astype(np.int64).T
        never = np.iinfo(np.int64).min
        scores[ids[None, :] == self.ids[rows][:, None]] = never
        if labels is not None:
            scores[labels[None, :] == self.labels[rows][:, None]] = never
        for first in range(0, len(windows), BLOCK):
            w = windows[first : first + BLOCK]
            s = scores[of[first : first + BLOCK]]
            s = np.where((s >= self.need[w][:, None]) & (s <= self.high[w][:, None]), s, never)
            for _ in range(self.k):
                best = s.argmax(axis=1)
                top = s[np.arange(len(w)), best]
                there = top != never
                if not there.any():
                    break
                w, s, best, top = w[there], s[there], best[there], top[there]
                self._add(w, top, ids[best])
                s[np.arange(len(w)), best] = never

    def _add(self, w: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        scores, ids = np.concatenate([self.score[w], score[:, None]], axis=1), np.concatenate([self.found[w], found[:, None]], axis=1)
        order = np.lexsort((ids, ~scores), axis=1)  # by falling score, equal ones by id
        self.score[w], self.found[w] = np.take_along_axis(scores, order, 1)[:, : self.k], np.take_along_axis(ids, order, 1)[:, : self.k]
        self.need[w] = np.maximum(self.need[w], self.score[w][:, -1])

    def rows(self) -> pa.RecordBatch:
        window, place = np.nonzero(self.score != np.iinfo(np.int64).min)
        return emit(_FOUND, [self.ids[self.at[window]], self.window[window], self.found[window, place], self.score[window, place]])


def _waves(shelves: int) -> list[tuple[int, int]]:
    """Shelves in up to three runs, the first one alone: so many rounds whatever the number of shelves."""
    ends = sorted({min(shelves, n) for n in (1, 1 + math.isqrt(shelves) if shelves > 8 else shelves, shelves)})
    return [(at, to - 1) for at, to in zip([0, *ends], ends) if at < to]


def _search(anchors: DataFrame, n: int, buckets: DataFrame, k: int, same: bool, folder: str) -> DataFrame:
    """(anchor_id, window, found_id, score, place): the k best rows of each window of n anchors (id, label, q, norm, windows: window, low, high)."""
    spark = anchors.sparkSession
    norms = {r.shelf: r.norm for r in buckets.groupBy("shelf").agg(F.max("norm").alias("norm")).collect()}  # a number for each shelf
    groups = max(1, -(-n // (BLOCK * GROUP)))
    found = None

    def meet(batches: Batches) -> Batches:
        best, at = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                b = {name: batch.column(i)[r].as_py() for i, name in enumerate(batch.schema.names) if not name.startswith("block_")}
                if at != (b["block"], b["shelf"]):
                    if best:
                        yield best.rows()
                    at = (b["block"], b["shelf"])
                    own = [batch.column(batch.schema.get_field_index(f"block_{c}"))[r].as_py() for c in ("ids", "labels", "vectors", "windows")]
                    best = _Best(*own, b["dim"], k, same)
                ids = np.frombuffer(b["ids"], np.int64)
                best.meet(b["norm"], ids, np.frombuffer(b["labels"], np.int64), np.frombuffer(b["vectors"], np.int32).reshape(len(ids), b["dim"]))
        if best:
            yield best.rows()

    for wave, (at, to) in enumerate(_waves(max(norms, default=-1) + 1)):
        asked, need = anchors, lambda w: w["low"]
        if found is not None:
            kth = found.where(F.col("place") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))  # as many as windows
            asked, need = anchors.join(kth, anchors.id == kth.anchor_id, "left").drop("anchor_id"), lambda w: F.greatest(w["low"], F.coalesce(F.try_element_at("kth", w["window"]), w["low"]))
        asked = asked.withColumn("windows", F.transform("windows", lambda w: F.struct(w["window"].alias("window"), w["low"].alias("low"), w["high"].alias("high"), need(w).alias("need"))))  # noqa: B023
        least = F.array_min(F.transform("windows", lambda w: w["need"])).cast("double")
        # the norm that a row has to have at least
        ratio = F.when(F.col("norm") > 0, least / F.col("norm") * (1 - F.signum(least) * SLACK)).otherwise(F.when(least <= 0, -1.0).otherwise(float("inf")))
        asked = asked.withColumn("ratio", ratio).where(F.col("ratio") <= max((norms[s] for s in range(at, to + 1) if s in norms), default=0.0))
        own = _blocks(asked, groups).withColumn("salt", F.pmod(F.shiftright("block", 32), F.lit(groups))).withColumn("shelf", F.explode(F.sequence(F.lit(at), F.lit(to))))
        own = own.select("salt", "shelf", "dim", "block", "ratio", *(F.col(c).alias(f"block_{c}") for c in ("ids", "labels", "vectors", "windows")))
        theirs = buckets.where(F.col("shelf").between(at, to)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
        pairs = own.join(theirs, (own.salt == theirs.salt) & (own.shelf == theirs.shelf) & (own.dim == theirs.dim) & (own.ratio <= theirs.norm))
        pairs = pairs.select(own.block, own.shelf, own.dim, "block_ids", "block_labels", "block_vectors", "block_windows", "norm", "ids", "labels", "vectors")
        best = pairs.mapInArrow(meet, _ddl(_FOUND))
        best = best if found is None else best.unionByName(found.drop("place"))
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), F.asc("found_id"))
        best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).write.parquet(f"{folder}-{wave}")
        found = spark.read.schema(_ddl(_FOUND) + ", place int").parquet(f"{folder}-{wave}")
    return spark.createDataFrame([], _ddl(_FOUND) + ", place int") if found is None else found


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among the rows of `quantised`.

    A negative's score is at least `low` and at most `high` per cent of its positive's.
    """
    spark = rows.sparkSession
    one_thread(spark)
    folder = f"{shared_folder(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/rows")  # quantised once
    rows = spark.read.schema("id bigint, label bigint, q array<int>, norm double").parquet(f"{folder}/rows")
    buckets = shelved(rows, f"{folder}/buckets")
    anchors = rows.where(anchor)
    n, far = anchors.count(), 1 << 62
    window = lambda *w: F.struct(*(x.cast("bigint").alias(c) for x, c in zip(w, ("window", "low", "high"))))
    own = _search(anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(-far), F.lit(far)))), n, buckets, positives, True, f"{folder}/positives")
    own = own.select("anchor_id", F.col("found_id").alias("window"), F.col("score").alias("positive_score"))
    share = lambda p: F.col("positive_score").cast("decimal(20,0)") * p / 100
    windows = own.select("anchor_id", window(F.col("window"), F.ceil(share(low)), F.floor(share(high))).alias("w")).where("w.low <= w.high").groupBy("anchor_id").agg(F.collect_list("w").alias("windows"))  # as many as positives
    other = _search(anchors.join(windows, anchors.id == windows.anchor_id).drop("anchor_id"), n, buckets, negatives, False, f"{folder}/negatives")
    found = other.join(own, ["anchor_id", "window"])
    return found.select("anchor_id", F.col("window").alias("positive_id"), F.col("place").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH q AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT id, label, v FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY label, v) = 1),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3"""
