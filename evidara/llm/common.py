"""Helpers shared by the text operators: sessions, Arrow streams and byte-level word scanning.

Every Arrow operator works through its input in bounded chunks (``CHUNK_BYTES`` of text
at a time), so a worker's memory does not depend on the size of a partition.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled by one round of array operations in a worker.
CHUNK_BYTES = 1_500_000

#: The separators of words: [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keeps Arrow batches small: texts are long, and a worker holds a whole batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def one_thread(spark: SparkSession) -> None:
    """Lets a Python worker's matrix products run in its own thread, unless the session says otherwise: tasks share out the cores already."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")


def lean_workers(spark: SparkSession) -> None:
    """Lets Python workers give memory back: large arrays go to the system when they are freed, instead of staying with a worker that waits for its next task.

    All of a session's operators should ask for the same, before the first of them runs, as Spark keeps
    other workers for other environments.
    """
    one_thread(spark)
    for name, value in (("MALLOC_MMAP_THRESHOLD_", "1048576"), ("MALLOC_ARENA_MAX", "2"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        spark.sparkContext.environment.setdefault(name, value)


def parts(spark: SparkSession, times: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * times)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of what a frame reads: file sizes, no job; 0 where it knows none and says so by a huge number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, or the folder that the session already has; a temporary one only in local mode, as in tests."""
    context = spark.sparkContext
    already = context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (already and already.rsplit("/", 1)[0])  # Spark adds a folder of its own
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "evidara-checkpoints")
    if not already:
        context.setCheckpointDir(folder)
    return folder


def new_column(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Long vectors of counts are added up in pieces, and the pieces of very many tasks by lanes first.
PIECES, LANES = 32, 256
COUNTS_DDL = "piece int, lane int, counts binary"


def count_rows(total: np.ndarray) -> pa.RecordBatch:
    """A task's vector of counts as rows for `added_up`."""
    from pyspark import TaskContext

    lane = TaskContext.get().partitionId() % LANES
    rows = [(k, lane, part.astype(np.int64).tobytes()) for k, part in enumerate(np.array_split(total, PIECES))]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["piece", "lane", "counts"])


def added_up(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors; a worker holds the pieces of one lane, then those of all lanes."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in group.column("counts"))
        return pa.table({"piece": group.column("piece")[:1].cast(pa.int32()), "lane": group.column("lane")[:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    lanes = rows.groupBy("piece", "lane").applyInArrow(add, COUNTS_DDL)
    found = {r.piece: np.frombuffer(bytes(r.counts), np.int64) for r in lanes.groupBy("piece").applyInArrow(add, COUNTS_DDL).collect()}  # one vector
    return np.concatenate([found[k] for k in range(PIECES)]) if found else np.zeros(size, np.int64)


def as_bytes(col: str = "text"):
    """Whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def byte_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a binary column, about `limit` bytes each."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string()).view(pa.large_binary())
    col = col.cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * col.offset)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[ends[first] : ends[end]], ends[first : end + 1] - ends[first]
        first = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word [^\\x20\\x09-\\x0D]+ of concatenated documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[firsts[1:] - 1] = inside[firsts[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


_M = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 16)
        inv = pow(_M, -1, 1 << 64)
        with np.errstate(over="ignore"):
            p = np.full(size, np.uint64(_M), np.uint64)
            q = np.full(size, np.uint64(inv), np.uint64)
            p[0] = q[0] = 1
            _POWERS["p"], _POWERS["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same for equal bytes wherever they stand."""
    p, q = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * q[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def emit(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


Batches = Iterator[pa.RecordBatch]
ArrowMap = Callable[[Batches], Batches]
