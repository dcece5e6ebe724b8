"""Line deduplication behind two Bloom filters (operator 3).

1. Every task hashes its lines' keys. The hashes, not the lines, are dealt out by value;
   for each share of them a once-seen filter is filled, and a hash that it already seems to
   hold goes into the share's twice-seen filter, sized by what it has to hold.
2. The twice-seen filters are gathered under a fixed bound (``FILTER_BYTES``) and sent to
   all tasks. Only lines whose hash they may hold - suspected repeats - are shuffled, by
   their whole key, which confirms repeats exactly and chooses the document that keeps it.
   A filter that is full beyond its bound lets more lines through, never fewer.
3. The texts stay where they are: a digest and the keeper of each confirmed line go to them, as
   long as there are ``KNOWN_LINES`` of these at most. Where there are more, each row is joined
   with the digests that it loses instead, with the same result.

Null or empty text is one empty line; keys shorter than ``min_chars`` are never dropped, longer
ones count whole, however long. A document keeps all its own copies of a line, or loses them all;
ties cannot arise, as the keeper is the largest doc_id. Rows that repeat a doc_id count as one
document, rows without one as one that is smaller than all others. An empty table gives no rows.
Other columns stay as they are, in their order; only columns named like the report's
(n_lines, n_dropped, kept_sha256) give way to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evidara.llm.common import Batches, as_bytes, checkpointed, emit, input_bytes, mix64, new_column, parts, small_batches

MIN_CHARS, MIN_DOCS = 20, 3

#: All twice-seen filters together, whatever the size of the corpus.
FILTER_BYTES = 64 << 20

#: Confirmed lines that are sent to all tasks, 24 bytes each.
KNOWN_LINES = 2_500_000

#: A share of the hashes comes from no more than this of the input files, however few shuffle partitions are set.
SHARE_BYTES = 128 << 20

#: Hashes that a task gathers before it passes them on.
FLUSH = 400_000

WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without white space at its ends and with A-Z lowered; None if it is too short to count."""
    key = line.strip(WHITE).lower()
    n = len(key)
    if n < min_chars or n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def line_keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for x in text.split(b"\n") if (k := line_key(x, min_chars)) is not None}


def hashes_of(lines: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in lines], np.uint64)


class BloomFilter:
    """Four bits for each 64-bit hash, set and read for whole arrays."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of_size(cls, entries: int, most_bytes: int) -> BloomFilter:
        size = 64
        while size < 2 * entries and size * 2 <= most_bytes:
            size *= 2
        return cls(np.zeros(size, np.uint8))

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        m = np.uint64(len(self.bits) * 8 - 1)
        a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) & m for i in range(4)])

    def add(self, hashes: np.ndarray) -> None:
        for at in self._places(hashes):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for at in self._places(hashes):
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def twice_seen(hashes: list[np.ndarray], again: list[np.ndarray], most_bytes: int) -> np.ndarray:
    """The bits of the twice-seen filter for blocks of distinct hashes; again: hashes that a block holds twice by itself."""
    once = BloomFilter.of_size(sum(map(len, hashes)), 1 << 30)
    repeats = list(again)
    for block in hashes:
        repeats.append(block[once.holds(block)])
        once.add(block)
    found = np.unique(np.concatenate(repeats)) if repeats else np.zeros(0, np.uint64)
    twice = BloomFilter.of_size(len(found), most_bytes)
    twice.add(found)
    return twice.bits


def _dealt(hashes: np.ndarray, shares: int) -> np.ndarray:
    """The share of each hash and 32 other bits of it, as one number; shares grow with the input, so 32 bits stay enough."""
    return hashes % np.uint64(shares) << np.uint64(32) | hashes // np.uint64(shares) & np.uint64(0xFFFFFFFF)


class Filters:
    """The twice-seen filters of all shares."""

    def __init__(self, shares: int, bits: dict[int, bytes]):
        self.shares, self.bits = shares, bits

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        dealt = _dealt(hashes, self.shares)
        share, key = (dealt >> np.uint64(32)).astype(np.int64), mix64(dealt & np.uint64(0xFFFFFFFF))
        order = np.argsort(share, kind="stable")
        edges = np.flatnonzero(np.diff(share[order], prepend=-1, append=-1))
        hit = np.zeros(len(hashes), dtype=bool)
        for a, b in zip(edges[:-1], edges[1:]):
            bits = self.bits.get(int(share[order[a]]))
            if bits is not None:
                hit[order[a:b]] = BloomFilter(np.frombuffer(bits, np.uint8)).holds(key[order[a:b]])
        return hit


def _pressed(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as compressed steps."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpressed(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


BLOCKS = pa.schema([("share", pa.int32()), ("hashes", pa.binary()), ("again", pa.binary())])
BLOCKS_DDL = "share int, hashes binary, again binary"


def packed(seen: np.ndarray, shares: int) -> pa.RecordBatch:
    """Some hashes dealt out by value: for each share the distinct ones, and those that are there twice."""
    values, counts = np.unique(_dealt(seen, shares), return_counts=True)
    share, rest = (values >> np.uint64(32)).astype(np.int32), (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    edges = np.flatnonzero(np.diff(share, prepend=-1, append=-1))
    rows: list[list] = [[], [], []]
    for a, b in zip(edges[:-1], edges[1:]):
        rows[0].append(int(share[a]))
        rows[1].append(_pressed(rest[a:b]))
        rows[2].append(_pressed(rest[a:b][counts[a:b] > 1]))
    return emit(BLOCKS, rows)


def filled(dealt: DataFrame, shares: int) -> Filters:
    """The twice-seen filters for blocks of hashes (BLOCKS), gathered under FILTER_BYTES."""
    most = max(64, FILTER_BYTES // shares)

    def fill(group: pa.Table) -> pa.Table:
        blocks = [[mix64(_unpressed(x.as_py()).astype(np.uint64)) for x in group.column(c)] for c in ("hashes", "again")]
        bits = twice_seen(*blocks, most)
        return pa.table({"share": pa.array([group.column("share")[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = dealt.groupBy("share").applyInArrow(fill, "share int, bits binary").collect()  # FILTER_BYTES at most
    return Filters(shares, {r.share: bytes(r.bits) for r in rows})


def shares_of(docs: DataFrame) -> int:
    return max(parts(docs.sparkSession), -(-input_bytes(docs) // SHARE_BYTES))


def _filters(docs: DataFrame, min_chars: int) -> Filters:
    shares = shares_of(docs)

    def hashes(batches: Batches) -> Batches:
        seen: list[int] = []
        for batch in batches:
            for text in batch.column(0):
                seen += [xxhash.xxh3_64_intdigest(k) for k in line_keys(text.as_py(), min_chars)]
                if len(seen) >= FLUSH:
                    yield packed(np.array(seen, np.uint64), shares)
                    seen = []
        if seen:
            yield packed(np.array(seen, np.uint64), shares)

    return filled(docs.select(as_bytes().alias("text")).mapInArrow(hashes, BLOCKS_DDL), shares)


def _suspects(docs: DataFrame, key: list[str], min_chars: int, filters: Filters) -> DataFrame:
    """(*key, line): the suspected repeats among the lines' keys, each once for a row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filters)
    kind = ", ".join(f"{k} bigint" for k in key) + ", line binary"
    schema = pa.schema([*((k, pa.int64()) for k in key), ("line", pa.binary())])

    def run(batches: Batches) -> Batches:
        twice = sent.value
        for batch in batches:
            rows, lines = [], []
            for k, text in enumerate(batch.column(len(key))):
                found = line_keys(text.as_py(), min_chars)
                rows += [k] * len(found)
                lines += found
            at = np.flatnonzero(twice.hold(hashes_of(lines))) if lines else ()
            if len(at):
                taken = pa.array([rows[i] for i in at], pa.int64())
                yield emit(schema, [*(batch.column(c).take(taken) for c in range(len(key))), [lines[i] for i in at]])

    return docs.mapInArrow(run, kind)


def repeated_lines(docs: DataFrame, filters: Filters, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(digest, keeper): the lines that min_docs documents or more hold, confirmed by their whole keys, and the largest doc_id that does."""
    held = _suspects(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("text")), ["doc_id"], min_chars, filters)
    known = held.groupBy("line").agg(F.count_distinct(F.struct("doc_id")).alias("docs"), F.max("doc_id").alias("keeper"))
    return known.where(F.col("docs") >= min_docs).select(F.unhex(F.md5("line")).alias("digest"), "keeper")


class Known:
    """Digests of repeated lines and who keeps them, in order."""

    def __init__(self, digests: np.ndarray, keepers: np.ndarray):
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        self.high, self.low, self.keeper = digests[order, 0], digests[order, 1], keepers[order]

    def keepers(self, digests: list[bytes]) -> np.ndarray:
        """The keeper of each digest, or the least number there is."""
        asked = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
        out = np.full(len(asked), np.iinfo(np.int64).min)
        at = np.searchsorted(self.high, asked[:, 0])
        while len(self.high):  # several lines may share the first half
            here = np.minimum(at, len(self.high) - 1)
            same = (at < len(self.high)) & (self.high[here] == asked[:, 0])
            if not same.any():
                break
            hit = same & (self.low[here] == asked[:, 1])
            out[hit] = self.keeper[here[hit]]
            at = at + 1
        return out


def _known(lines: DataFrame) -> Known:
    table = lines.where("keeper is not null").toArrow()  # KNOWN_LINES rows at most
    raw = b"".join(x.as_py() for x in table.column("digest"))
    return Known(np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2), table.column("keeper").to_numpy().astype(np.int64))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, report: bool = True, count: str | None = None, most_known: int = KNOWN_LINES) -> DataFrame:
    """All columns of docs, with `text` rid of repeated lines; count: a column that gets the new length where lines went.

    With report, n_lines, n_dropped and kept_sha256 as well, which take the place of columns of these names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    filters = _filters(docs, min_chars)
    lines = checkpointed(repeated_lines(docs, filters, min_chars, min_docs))
    sent = spark.sparkContext.broadcast((filters, _known(lines) if lines.count() <= most_known else None))
    lost, source = None, docs
    if sent.value[1] is None:
        lost = new_column(docs, "lost")
        source = _with_lost(docs, lines, filters, min_chars, lost)
    extra = [("n_lines", LongType(), pa.int64()), ("n_dropped", LongType(), pa.int64()), ("kept_sha256", StringType(), pa.string())] if report else []
    names = [c for c in docs.columns if c.lower() not in {x for x, _, _ in extra}]
    fields = StructType([docs.schema[c] for c in names] + [StructField(name, kind) for name, kind, _ in extra])

    def gone_of(batch: pa.RecordBatch, texts: list[list[bytes]]) -> list[set[bytes]]:
        """The keys that each row loses."""
        gone: list[set[bytes]] = [set() for _ in texts]
        keys, rows = [], []
        for k, text in enumerate(texts):
            found = {x for line in text if (x := line_key(line, min_chars)) is not None}
            keys += found
            rows += [k] * len(found)
        twice, known = sent.value
        at = np.flatnonzero(twice.hold(hashes_of(keys))) if keys else ()
        if not len(at):
            return gone
        digests = [hashlib.md5(keys[i]).digest() for i in at]
        if known is None:
            held = [set(x or ()) for x in batch.column(batch.schema.get_field_index(lost)).to_pylist()]
            drops = [d in held[rows[i]] for i, d in zip(at, digests)]
        else:
            keeper = known.keepers(digests)
            ids = [np.iinfo(np.int64).min if x is None else int(x) for x in batch.column(batch.schema.get_field_index(doc_id)).to_pylist()]
            drops = keeper > np.array([ids[rows[i]] for i in at], np.int64)
        for i, drop in zip(at, drops):
            if drop:
                gone[rows[i]].add(keys[i])
        return gone

    doc_id, text_at = _name(docs, "doc_id"), _name(docs, "text")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            old = batch.column(batch.schema.get_field_index(text_at))
            texts = [(x.as_buffer().to_pybytes() if x.is_valid else b"").split(b"\n") for x in old]
            gone = gone_of(batch, texts)
            kept = [[x for x in t if line_key(x, min_chars) not in g] if g else t for t, g in zip(texts, gone)]
            left = [b"\n".join(t) for t in kept]
            new = {text_at: pa.array([x.decode("utf-8", "replace") for x in left], old.type)}
            changed = pa.array([bool(g) for g in gone])
            if count:
                was = batch.column(batch.schema.get_field_index(count))
                new[count] = pc.if_else(changed, pc.utf8_length(new[text_at]).cast(was.type), was)
            if not report:  # a text that lost nothing stays as it was, null included
                new[text_at] = pc.if_else(changed, new[text_at], old)
            report_columns = [[len(t) for t in texts], [len(t) - len(k) for t, k in zip(texts, kept)], [hashlib.sha256(x).hexdigest() for x in left]]
            columns = [new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [pa.array(v, t) for v, (_, _, t) in zip(report_columns, extra)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(x for x, _, _ in extra)])

    return source.select(*(F.col(f"`{c}`") for c in names), *([lost] if lost else [])).mapInArrow(run, fields)


def _name(docs: DataFrame, wanted: str) -> str:
    return next(c for c in docs.columns if c.lower() == wanted)


def _with_lost(docs: DataFrame, lines: DataFrame, filters: Filters, min_chars: int, lost: str) -> DataFrame:
    """docs with the digests of the lines that each row loses, where these are too many to send to all tasks.

    Rows are known by doc_id and a hash of their text, so that no list is longer than a text has lines.
    """
    who, which = new_column(docs, "who"), new_column(docs, "which")
    key = [F.col("doc_id").cast("bigint").alias("who"), F.xxhash64("text").alias("which")]
    held = _suspects(docs.select(*key, as_bytes().alias("text")), ["who", "which"], min_chars, filters)
    held = held.select("who", "which", F.unhex(F.md5("line")).alias("digest")).join(lines, "digest").where(F.col("who").isNull() | (F.col("who") < F.col("keeper")))
    lists = held.where("keeper is not null").groupBy(F.col("who").alias(who), F.col("which").alias(which)).agg(F.collect_set("digest").alias(lost))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(who)) & (F.xxhash64("text") == F.col(which))
    return docs.join(lists, same, "left").drop(who, which)


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.keeper IS NOT NULL AND k.doc_id < r.keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
