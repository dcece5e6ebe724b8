"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 9).

Fingerprints of 64 bits that differ in at most 3 bits agree in at least 5 of their 8 bytes.
Split the positions into 0-3 and 4-7: five agreeing positions hold three on one side, so
two linked fingerprints meet in a posting of one of 8 position triples. Pairs of a posting
are tallied over all 8 positions, pairs short of 5 agreeing bytes are dropped, the others
verified bit by bit.

Equal fingerprints are first folded into one node. A posting of more than ``SMALL`` nodes is
not paired: its nodes go to the finer postings of all 56 position quintuples, exact as well;
what is still crowded there is linked by stars over the free 24 bits (every node names its
neighbours at one and at two flipped bits; who meets at a name is within 3 bits of the
smallest one-flip node there). So the work per node is bounded and no link is lost.

No words: fingerprint zero, linked like any other. Null text has no words. Repeated rows
get equal results; with no rows the result is empty.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import Batches, as_bytes, checkpointed, emit, small_batches
from evidara.llm.components import connected_components

#: Nodes of a triple's and of a quintuple's posting that are still compared pair by pair.
SMALL, SMALL_FINE = 16, 24

TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
QUINTUPLES = list(combinations(range(8), 5))
MAX_BITS, LEAST_BYTES = 3, 5


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half the XXH64 hashes of the text's shingles."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    joined, at, starts, ends = b" ".join(w), 0, [], []
    for x in w:
        starts.append(at)
        at += len(x)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_digest
    found = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :])])
    bits = np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): one signed 64-bit fingerprint per row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            fps = np.array([simhash(x.as_py(), words) for x in batch.column(2)], np.uint64).view(np.int64)
            yield emit(schema, [batch.column(0), batch.column(1), pa.array(fps)])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), as_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _postings(nodes: DataFrame, combos: list[tuple[int, ...]]) -> DataFrame:
    keys = [F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("bytes")) for k, c in enumerate(combos)]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.combo", "k.bytes")


def shared_bytes(a: Column, b: Column) -> Column:
    """At how many of the 8 positions two fingerprints hold the same byte."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(1, 8)), F.when(x.bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0))


def _pairs(sized: DataFrame, most: int) -> DataFrame:
    """Links among the nodes of small postings."""
    small = sized.where(F.col("n") <= most)
    groups = small.groupBy("combo", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    a = groups.select("fps", F.posexplode("fps").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("fps", F.col("i") + 2, most)).alias("b"))
    return pairs.where(shared_bytes(F.col("a"), F.col("b")) >= LEAST_BYTES).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")


def _sized(nodes: DataFrame, combos: list[tuple[int, ...]]) -> DataFrame:
    postings = _postings(nodes, combos)
    counts = postings.groupBy("combo", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return postings.join(counts, ["combo", "bytes"])


def _stars(crowded: DataFrame) -> DataFrame:
    """Links of crowded quintuple postings over the 24 bits that their bytes leave free."""
    flips = []
    for c in QUINTUPLES:
        free = [8 * p + i for p in range(8) if p not in c for i in range(8)]
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        one = [0, *(signed(1 << i) for i in free)]
        two = [signed(1 << i | 1 << j) for i, j in combinations(free, 2)]
        flips.append((one, two))
    spark = crowded.sparkSession
    rows = [(k, m, near) for k, (one, two) in enumerate(flips) for near, ms in ((True, one), (False, two)) for m in ms]
    table = F.broadcast(spark.createDataFrame(rows, "combo int, flip bigint, near boolean"))  # 56 x 301 rows
    named = crowded.join(table, "combo").select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("name"), "near")
    named = named.groupBy("name", "fp").agg(F.max("near").alias("near"))
    centre = named.where("near").groupBy("name").agg(F.min("fp").alias("b"))
    return named.join(centre, "name").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(nodes: DataFrame, small: int = SMALL, small_fine: int = SMALL_FINE) -> DataFrame:
    """(a, b): links that connect exactly what all links within 3 bits would connect; nodes: distinct fp."""
    coarse = checkpointed(_sized(nodes, TRIPLES))
    found = _pairs(coarse, small)
    crowded = coarse.where(F.col("n") > small).select("fp").distinct()
    fine = checkpointed(_sized(crowded, QUINTUPLES))
    return found.unionByName(_pairs(fine, small_fine)).unionByName(_stars(fine.where(F.col("n") > small_fine)))


def _rooted(nodes: DataFrame, small: int, small_fine: int) -> DataFrame:
    """nodes (fp, *) with the root of each one's component."""
    # written first: the optimiser (4.1) fails to carry constraints through a filter over this union
    roots = connected_components(checkpointed(links(nodes.select("fp"), small, small_fine)), "a", "b")
    return nodes.join(roots, nodes.fp == roots.node, "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, words: int = 3, small: int = SMALL, small_fine: int = SMALL_FINE) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id that each document reaches."""
    prints = checkpointed(fingerprints(docs, words).select("doc_id", "fp"))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = _rooted(nodes, small, small_fine)
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rows_in_groups(docs: DataFrame, words: int = 3, small: int = SMALL, small_fine: int = SMALL_FINE) -> DataFrame:
    """(doc_id, text_hash, least) of the rows in components of two rows or more; least: (no id, doc_id, text_hash) of the component's first row."""
    prints = checkpointed(fingerprints(docs, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least")
    nodes = checkpointed(prints.groupBy("fp").agg(first, F.count(F.lit(1)).alias("times")))
    rooted = checkpointed(_rooted(nodes, small, small_fine))
    groups = rooted.groupBy("root").agg(F.min("least").alias("first"), F.sum("times").alias("times")).where("times > 1")
    named = rooted.join(groups, "root").select("fp", F.col("first").alias("least"))
    return prints.join(named, "fp").select("doc_id", "text_hash", "least")
