"""Best-fit-decreasing packing of token ids into rows of one length (operator 6).

Documents are tokenised, overlong ones cut into pieces of at most ``capacity`` ids without
loss. Pieces are packed in blocks of ``BLOCK_TOKENS`` ids, longest first, each into the open row with
the least room that still takes it; a segment tree over the rooms finds it in log(capacity)
steps. Each packed row holds its ids as little-endian unsigned integers (padded with ``pad``),
cumulative segment lengths, the places where positions start again from zero, and for each
segment its document and its offset in it, so that documents can be put together again.

Blocks follow the rows of an input partition; nothing is shuffled. Null and empty texts are
segments of length zero. Repeated rows are packed like any other.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import Batches, emit, small_batches

CAPACITY, BLOCK_TOKENS = 2048, 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """(encode ordinary text, decode, free id for padding)"""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc.encode_ordinary, enc.decode_bytes, max(ranks.values()) + 1


class RoomTree:
    """Which rooms from 0 to capacity some open row has, as a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.size
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the smallest room of `least` or more; it is taken out."""
        k, found = least + self.size, self.any
        while not found[k]:
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if found[2 * k] else 2 * k + 1
        room = k - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            found[k] = 0
            k >>= 1
            while k and not (found[2 * k] or found[2 * k + 1]):
                found[k] = 0
                k >>= 1
        return room, row


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """The items of each row."""
    tree, rows = RoomTree(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        got = tree.take(sizes[k])
        if got is None:
            got = (capacity, len(rows))
            rows.append([])
        room, row = got
        rows[row].append(k)
        tree.put(room - sizes[k], row)
    return rows


SCHEMA = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])
DDL = "block bigint, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, offsets array<bigint>"


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """0, 1, 2, ... from every segment's start."""
    at = np.asarray(cu_seqlens)
    return np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Packed rows of all documents: a map over the scan."""
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def packed(block: int, pieces: list[tuple[int, int, np.ndarray]], pad: int, kind: str) -> pa.RecordBatch:
        out: list[list] = [[] for _ in SCHEMA]
        for row, items in enumerate(best_fit([len(p[2]) for p in pieces], capacity)):
            ids = np.full(capacity, pad, kind)
            cu = [0]
            for k in items:
                ids[cu[-1] : cu[-1] + len(pieces[k][2])] = pieces[k][2]
                cu.append(cu[-1] + len(pieces[k][2]))
            for c, v in zip(out, (block, row, cu[-1], ids.tobytes(), cu, cu[:-1], [pieces[k][0] for k in items], [pieces[k][1] for k in items])):
                c.append(v)
        return emit(SCHEMA, out)

    def run(batches: Batches) -> Batches:
        encode, _, pad = tokenizer(path)
        kind = "<u2" if pad < 1 << 16 else "<u4"
        block, held, pieces = (TaskContext.get().partitionId() << 32), 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py() or ""), kind)
                for at in range(0, max(1, len(ids)), capacity):
                    piece = ids[at : at + capacity]
                    pieces.append((doc_id, at, piece))
                    held += len(piece) + 1
                if held >= BLOCK_TOKENS:
                    yield packed(block, pieces, pad, kind)
                    block, held, pieces = block + 1, 0, []
        if pieces:
            yield packed(block, pieces, pad, kind)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, DDL)


def write_packed(docs: DataFrame, path: str, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Writes the packed rows as Parquet and reads them back."""
    pack_documents(docs, capacity, vocabulary).write.mode("errorifexists").parquet(path)
    return docs.sparkSession.read.parquet(path)


def matrix(rows: list, capacity: int, wide: bool = False) -> np.ndarray:
    """The ids of packed rows as one matrix."""
    return np.stack([np.frombuffer(bytes(r.ids), "<u4" if wide else "<u2") for r in rows]) if rows else np.zeros((0, capacity), "<u4" if wide else "<u2")
