"""Ranked lexical search on dual-sorted wavelet trees (operator 12).

For every item the K documents of highest score are found exactly. A document's score is the sum,
over the item's distinct terms, of weight * ((10^9 tf) div (1000 tf + 20 m)): a term's weight is
floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 50 + (50 n N) div L, where N counts the
documents with a term, L all terms of these, n a document's terms, tf and df a term's counts.

One pass counts the asked terms of every document and is written to the shared folder; its sums
give N, L and df. Documents then come in shards of at most ``SHARD_POSTINGS`` postings. A shard's
postings, list by list in falling order of impact, are one sequence of document numbers, kept as a
wavelet tree: at every node a term's list is a range, still in falling order of impact, of the
documents whose numbers start with the node's bits. So a node's bound for a term is the impact
that its range starts with, and a range is moved to a child by counting bits. The search takes
nodes best bound first, some at a time, intersects the item's ranges with their children, and ends
when no node's bound reaches the K-th score so far, which goes on from shard to shard of a task.
A term with a weight below zero bounds an inner node by zero, as documents may lack it.

Terms are runs of letters, digits and characters outside ASCII, A-Z lower-cased, in whole texts.
Nulls: a null text has no terms and no score; a null doc_id comes after all others among equal
scores, a null item_id is an item like others. Empty texts and empty tables give no rows. Texts of
any length are read whole, piece by piece. Ties go to the smaller doc_id. Repeated documents are
documents each; repeated items (same item_id and text) count once, items that only share their
item_id are ranked apart. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.llm.common import CHUNK_BYTES, Batches, as_bytes, emit, shared_folder, small_batches
from evidara.llm.words import Vocabulary, word_chunks, word_ranges

#: Results of each item.
K = 50

#: Items, and bytes of their texts, that are searched at once.
ITEMS, ITEM_BYTES = 5_000, 8_000_000

#: Postings of one tree; a tree takes 8 bytes a posting and level.
SHARD_POSTINGS = 800_000

#: Nodes taken from the front of a search at once.
NODES = 64

_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])


def _terms(text: str | None) -> list[bytes]:
    """Distinct terms of an item."""
    column = pa.RecordBatch.from_arrays([pa.array([(text or "").encode()], pa.binary())], names=["text"])
    found = set()
    for _, _, data, offsets in word_chunks(column, "text"):
        start, end, _ = word_ranges(data, offsets)
        found.update(data[i:j].tobytes() for i, j in zip(start, end))
    return sorted(found)


def count_asked(batch: pa.RecordBatch, vocabulary: Vocabulary, limit: int = CHUNK_BYTES) -> pa.RecordBatch:
    """Counts of a batch (doc_id, text as bytes): each document's terms, and its terms of the vocabulary; documents without terms go."""
    size = max(1, len(vocabulary.words))
    n = np.zeros(batch.num_rows, np.int64)
    keys, counts = [], []
    held: tuple[int, np.ndarray] | None = None  # row and counts of a text that comes in pieces

    def close() -> None:
        if held is not None:
            key = np.flatnonzero(held[1])
            keys.append(held[0] * size + key)
            counts.append(held[1][key])

    for first, end, data, offsets in word_chunks(batch, "text", limit):
        start, stop, doc = word_ranges(data, offsets)
        n[first:end] += np.bincount(doc, minlength=end - first)
        number = vocabulary.numbers(data, start, stop)
        asked = number >= 0
        if held is not None and held[0] != first:
            close()
            held = None
        if end - first == 1:
            tf = np.bincount(number[asked], minlength=size)
            held = (first, tf if held is None else held[1] + tf)
        else:
            key, tf = np.unique((first + doc[asked]) * size + number[asked], return_counts=True)
            keys.append(key)
            counts.append(tf)
    close()
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    tf = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * size).astype(np.int32)
    whole = emit(_COUNTED, [batch.column(0), n, pa.ListArray.from_arrays(ends, (key % size).astype(np.int32)), pa.ListArray.from_arrays(ends, tf.astype(np.int64))])
    return whole.filter(pa.array(n > 0))


def _counted(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(doc_id, n, term, tf): the number of a document's terms, and its asked terms with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(words)  # the terms of a block of items

    def run(batches: Batches) -> Batches:
        vocabulary = Vocabulary(sent.value)
        for batch in batches:
            yield count_asked(batch, vocabulary)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("text")).mapInArrow(run, "doc_id bigint, n bigint, term array<int>, tf array<bigint>")


class Tree:
    """A wavelet tree over the document numbers of posting lists, each list in falling order of impact.

    Level by level, from the highest bit of a number on, all zeros stand before all ones; `zeros`
    counts the zeros before every place, `impact` follows the order of each level.
    """

    def __init__(self, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        self.levels = max(1, int(n_docs - 1).bit_length())
        self.n = len(doc)
        self.width = self.n + 1
        self.zeros = np.zeros((self.levels, self.width), np.int32)
        self.impact = np.zeros((self.levels + 1, max(1, self.n)), np.int64)
        for level in range(self.levels):
            self.impact[level, : self.n] = impact
            zero = (doc >> (self.levels - 1 - level)) & 1 == 0
            np.cumsum(zero, out=self.zeros[level, 1:])
            order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            doc, impact = doc[order], impact[order]
        self.impact[self.levels, : self.n] = impact
        self.total = self.zeros[:, -1].astype(np.int64)
        self.flat_zeros, self.flat_impact = self.zeros.ravel(), self.impact.ravel()

    def children(self, level: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges (nodes, terms) in the left child and, below them, in the right child."""
        at = (level * self.width)[:, None]
        z_low, z_high = self.flat_zeros[at + low].astype(np.int64), self.flat_zeros[at + high].astype(np.int64)
        total = self.total[level][:, None]
        return np.concatenate([z_low, total + low - z_low]), np.concatenate([z_high, total + high - z_high])

    def bounds(self, level: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """What no document below a node can exceed, as no impact is below zero; at leaves its score."""
        most = self.flat_impact[(level * max(1, self.n))[:, None] + np.minimum(low, self.n - 1)]
        return np.where(low < high, most, 0).sum(axis=1)

    def best(self, low: np.ndarray, high: np.ndarray, k: int, least: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, scores) of at least the k best of the documents with a score of `least` or more, ties by number."""
        none = np.zeros(0, np.int64)
        if not len(low) or not self.n:
            return none, none
        level, prefix, low, high = np.zeros(1, np.int64), np.zeros(1, np.int64), low[None, :], high[None, :]
        bound = self.bounds(level, low, high)
        docs, scores = none, none
        while len(bound):
            if len(bound) > nodes:
                cut = np.argpartition(bound, len(bound) - nodes)
                front, rest = cut[len(bound) - nodes :], cut[: len(bound) - nodes]
            else:
                front, rest = slice(None), slice(0, 0)
            new_low, new_high = self.children(level[front], low[front], high[front])
            new_level, new_prefix = np.tile(level[front] + 1, 2), np.concatenate([prefix[front] * 2, prefix[front] * 2 + 1])
            new_bound = self.bounds(new_level, new_low, new_high)
            leaf = new_level == self.levels
            if leaf.any():
                hit = leaf & (new_bound >= least)
                docs, scores = np.concatenate([docs, new_prefix[hit]]), np.concatenate([scores, new_bound[hit]])
                if len(docs) > k:
                    kept = np.lexsort((docs, -scores))[:k]
                    docs, scores = docs[kept], scores[kept]
                if len(docs) >= k:
                    least = max(least, int(scores.min()))
            inner = ~leaf & (new_bound >= least)
            old = bound[rest] >= least
            bound = np.concatenate([bound[rest][old], new_bound[inner]])
            level = np.concatenate([level[rest][old], new_level[inner]])
            prefix = np.concatenate([prefix[rest][old], new_prefix[inner]])
            low, high = np.concatenate([low[rest][old], new_low[inner]]), np.concatenate([high[rest][old], new_high[inner]])
        return docs, scores


def _shard(terms: np.ndarray, tfs: np.ndarray, doc: np.ndarray, m: np.ndarray, weight: np.ndarray, n_docs: int) -> tuple[Tree, np.ndarray]:
    """A shard's tree, and where each term's list starts in it."""
    impact = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
    order = np.lexsort((doc, -impact, terms))
    starts = np.searchsorted(terms[order], np.arange(len(weight) + 1))
    return Tree(doc[order], impact[order], n_docs), starts


def _lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """50 + (50 n N) div L."""
    if len(n) and int(n.max()) * 50 * documents >= 1 << 63:
        return np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)
    return 50 + 50 * n * documents // max(1, terms)


def _searched(counted: DataFrame, asked: list[np.ndarray], weight: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each item the k best documents of every task."""
    sent = counted.sparkSession.sparkContext.broadcast((asked, weight))  # a block of items
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def shards(batches: Batches):  # noqa: ANN202
        held, size = [], 0
        for batch in batches:
            ends = np.asarray(batch.column(2).offsets)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SHARD_POSTINGS - size, side="right")) - 1)
                to = min(to, batch.num_rows)
                if held and size + ends[to] - ends[at] > SHARD_POSTINGS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size = [], 0
                    continue
                held.append(batch.slice(at, to - at))
                size += int(ends[to] - ends[at])
                at = to
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Batches) -> Batches:
        items, w = sent.value
        best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(items)
        for rows in shards(batches):
            ids = rows.column("doc_id")
            missing = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            order = np.lexsort((ids, missing))  # documents are numbered in the order that breaks ties
            ids, missing = ids[order], missing[order]
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            lists = rows.column("term").combine_chunks()
            sizes = np.asarray(lists.value_lengths())
            tree, starts = _shard(lists.flatten().to_numpy().astype(np.int64), rows.column("tf").combine_chunks().flatten().to_numpy(), np.repeat(number, sizes), _lengths(rows.column("n").to_numpy(), documents, terms)[order], w, len(order))
            for item, numbers in enumerate(items):
                s, d, gone = best[item]
                least = int(s[-1]) if len(s) >= k else 1
                there = starts[numbers] < starts[numbers + 1]
                docs, scores = tree.best(starts[numbers][there], starts[numbers + 1][there], k, least)
                if len(docs):
                    s, d, gone = np.concatenate([s, scores]), np.concatenate([d, ids[docs]]), np.concatenate([gone, missing[docs]])
                    kept = np.lexsort((d, gone, -s))[:k]
                    best[item] = (s[kept], d[kept], gone[kept])
        for item, (s, d, gone) in enumerate(best):
            if len(s):
                yield emit(schema, [np.full(len(s), item, np.int32), pa.array(d, mask=gone), s])

    return counted.mapInArrow(run, "item int, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size.n // ITEMS), -(-(size.bytes or 0) // ITEM_BYTES))
    found = None
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # one block of the items
        part = _block(spark, docs, [(r.item_id, _terms(r.text)) for r in rows], k)
        found = part if found is None else found.unionByName(part)
    return found


def _block(spark: SparkSession, docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    words = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(words)}
    asked = [np.array([number[t] for t in terms], np.int64) for _, terms in items]
    folder = f"{shared_folder(spark).rstrip('/')}/ranked-{uuid.uuid4().hex}"
    _counted(docs, words).write.parquet(folder)  # documents are read once
    counted = spark.read.parquet(folder)
    sums = counted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = held.select("term", F.floor(1000 * F.log((F.lit(2) * sums.documents + 2).cast("double") / (2 * F.col("df") + 1))).alias("weight")).collect()  # a block's terms
    weight = np.zeros(len(words), np.int64)
    for r in weights:
        weight[r.term] = r.weight
    best = _searched(counted, asked, weight, sums.documents, sums.terms, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id bigint")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's names


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
a AS (SELECT DISTINCT item_id, unnest(t) AS term FROM b),
s AS (SELECT count(*) AS documents, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY doc_id, t, term),
w AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, documents),
r AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // terms))))::BIGINT AS score FROM a JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {K}"""
