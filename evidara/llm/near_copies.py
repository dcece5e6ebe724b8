"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The pipeline takes these links beside those of operator 9's fingerprints (``also``). An inverted index with count filtering as there, but over the
shingles themselves: fingerprints of 64 bits cannot guarantee to find a similarity of 0.8, whose
pairs differ in some ten bits, too many for any shared byte. Exact, by prefix filtering. All
shingles stand in one order, those of one text only first, then those of less crowded counters;
two sets of that similarity share a shingle among the first ``n - ceil(0.8 n) + 1`` of each. Pairs
that meet there, with lengths and positions that leave the similarity possible, are verified on
the whole sets. Any order finds the same pairs; a good one lets few rows meet.

1. A pass over the texts fills the counters, a second one a twice-seen Bloom filter of the
   shingles, as in ``line_dedup``. A third one lets only rows go on whose prefix has a suspected
   repeat, that is, of whose set at most a fifth is in no other text.
2. Equal sets are folded into one node. A posting of more than ``SMALL`` nodes is first
   compared with the centres of its length classes; what is then one component needs no more
   comparing among itself, so the nodes outside a posting's largest component are compared with
   all of the posting whose sizes the places allow: that bound is part of the join, so texts of
   one template that have too little in common never meet. No pair that could join two
   components is left out.

Words are those of ``simhash``: parted by ASCII white space, A-Z lower-cased. A text of fewer than
five words is one shingle, one without words (or null) has the empty set, which equals any other.
Very long texts count whole. Rows are told apart by doc_id and text, a null doc_id counts as larger
than all others; rows that repeat both are copies like any other, and any one of them may stay.
Without rows the result is empty. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm import common, line_dedup
from evidara.llm.common import LOWER, Batches, added_up, as_bytes, byte_chunks, checkpointed, count_rows, mix64, new_column, range_hashes, small_batches
from evidara.llm.components import connected_components

WORDS, SIMILAR = 5, 0.8
#: Nodes of a posting that are compared pair by pair at once.
SMALL = 16
#: Classes of sizes within a factor of the similarity.
CLASSES = 4
COUNTERS = 1 << 18
#: Hashes that a task gathers before it passes them on.
FLUSH = 2_000_000
#: Rows to drop that are sent to all tasks, 16 bytes each; more are joined.
SENT_ROWS = 1_000_000
#: The one shingle of a text without words.
NO_WORDS = np.uint64(0x5EED)


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the document of every shingle of concatenated documents, documents in order."""
    data, rows = LOWER[data], len(offsets) - 1
    start, end, doc = common.words_of(data, offsets)
    without = np.setdiff1d(np.arange(rows), doc)
    if not len(start):
        return np.full(rows, NO_WORDS), without
    h = range_hashes(data, start, end)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    long = np.minimum(count, words)[doc]  # words of the shingle that begins at a word
    last = np.cumsum(count)[doc]
    begins = np.flatnonzero((np.arange(len(doc)) + long <= last) & ((count[doc] > words) | (np.arange(len(doc)) == last - count[doc])))
    s, n = np.zeros(len(begins), np.uint64), long[begins]
    with np.errstate(over="ignore"):
        for k in range(words):
            more = k < n
            s[more] = mix64(s[more] * np.uint64(0x9E3779B97F4A7C15) + h[begins[more] + k] + np.uint64(1))
    if not len(without):
        return s, doc[begins]
    owner = np.concatenate([doc[begins], without])
    by = np.argsort(owner, kind="stable")
    return np.concatenate([s, np.full(len(without), NO_WORDS)])[by], owner[by]


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(30)).astype(np.int64) & (COUNTERS - 1)


def _counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles each of COUNTERS counters has."""

    def count(batches: Batches) -> Batches:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, data, offsets in byte_chunks(batch, "text"):
                total += np.bincount(_counter(_shingles(data, offsets, words)[0]), minlength=COUNTERS)
        yield count_rows(total)

    return added_up(texts.mapInArrow(count, common.COUNTS_DDL), COUNTERS)


def _sets(data: np.ndarray, offsets: np.ndarray, order: np.ndarray, twice: line_dedup.Filters, words: int, similar: float) -> tuple[np.ndarray, ...]:
    """The sets of concatenated documents in order: shingles, documents, sizes, places in the set, and which are suspects in a prefix."""
    h, doc = _shingles(data, offsets, words)
    shared = twice.hold(h)
    by = np.lexsort((h, order[_counter(h)], shared, doc))
    h, doc, shared = h[by], doc[by], shared[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc, shared = h[new], doc[new], shared[new]
    n = np.bincount(doc, minlength=len(offsets) - 1)
    place = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
    prefix = n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1
    return h, doc, n, place, shared & (place < prefix[doc])


def _lists(values: np.ndarray, owner: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


PRINTS_DDL = "doc_id bigint, text_hash bigint, node bigint, n int, places array<int>, suspects array<bigint>, shingles array<bigint>"


def _prints(docs: DataFrame, words: int, similar: float) -> DataFrame:
    """The rows that may have copies: their set's name and size, its suspected shingles with their places, and the whole set."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), as_bytes().alias("text"))
    order = spark.sparkContext.broadcast(_counts(texts.select("text"), words))  # COUNTERS numbers
    shares = line_dedup.shares_of(docs)

    def hashes(batches: Batches) -> Batches:
        seen, held = [], 0
        for batch in batches:
            for _, _, data, offsets in byte_chunks(batch, "text"):
                seen.append(_shingles(data, offsets, words)[0])
                held += len(seen[-1])
                if held >= FLUSH:
                    yield line_dedup.packed(np.concatenate(seen), shares)
                    seen, held = [], 0
        if held:
            yield line_dedup.packed(np.concatenate(seen), shares)

    twice = spark.sparkContext.broadcast(line_dedup.filled(texts.select("text").mapInArrow(hashes, line_dedup.BLOCKS_DDL), shares))
    names = ["doc_id", "text_hash", "node", "n", "places", "suspects", "shingles"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, data, offsets in byte_chunks(batch, "text"):
                h, doc, n, place, suspected = _sets(data, offsets, order.value, twice.value, words, similar)
                at = np.flatnonzero(suspected)
                rows = np.unique(doc[at])
                if not len(rows):
                    continue
                with np.errstate(over="ignore"):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h), dtype=np.uint64)])
                    first = np.concatenate([[0], np.cumsum(n)])
                    node = mix64(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
                whole = np.isin(doc, rows)
                owner, own = np.searchsorted(rows, doc[at]), np.searchsorted(rows, doc[whole])
                taken = pa.array(rows + a)
                columns = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(node[rows].view(np.int64)), pa.array(n[rows], pa.int32())]
                columns += [_lists(place[at], owner, len(rows), pa.int32()), _lists(h[at].view(np.int64), owner, len(rows), pa.int64()), _lists(h[whole].view(np.int64), own, len(rows), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, PRINTS_DDL)


def _possible(similar: float, n: Column, i: Column, m: Column, j: Column) -> Column:
    """Sets of n and m shingles whose first common one is at i and j can be so similar."""
    return (1 + F.least(n - i, m - j) - 1 >= F.lit(similar / (1 + similar)) * (n + m) - 1e-9) & (F.least(n, m) >= similar * F.greatest(n, m) - 1e-9)


def _length_class(n: Column, similar: float) -> Column:
    return F.floor(F.log(n.cast("double")) * (CLASSES / np.log(1 / similar))).cast("int")


def _by_length(postings: DataFrame, similar: float) -> DataFrame:
    """Postings with the range of sizes [least, most] that a similar set met there can have; those without any go.

    A set of n shingles met at its place i has at most n - i in common with the other one, which so
    has at least ``similar * n`` and at most ``(n - i) (1 + similar) / similar - n`` shingles.
    """
    sized = postings.withColumn("least", F.ceil(similar * F.col("n") - 1e-9)).withColumn("most", F.floor((F.col("n") - F.col("i")) * ((1 + similar) / similar) - F.col("n") + 1e-9))
    return sized.where("least <= most")


def _crowded_pairs(left: DataFrame, right: DataFrame, similar: float) -> DataFrame:
    """`_pairs` for crowded postings: only nodes of sizes that each other's place allows meet at all.

    The join is on the shingle and a class of sizes, so a posting is spread over its classes, and
    what is left of a hot one can be split by adaptive execution.
    """
    left = _by_length(left, similar)
    left = left.withColumn("class", F.explode(F.sequence(_length_class(F.greatest(F.lit(1), F.col("least")), similar), _length_class(F.greatest(F.lit(1), F.col("most")), similar))))
    right = _by_length(right, similar).withColumn("class", _length_class(F.col("n"), similar))
    b = right.select("shingle", "class", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("root_b"), F.col("least").alias("least_b"), F.col("most").alias("most_b"))
    both = left.join(b, ["shingle", "class"]).where((F.col("root") != F.col("root_b")) & F.col("m").between(F.col("least"), F.col("most")) & F.col("n").between(F.col("least_b"), F.col("most_b")))
    both = both.where(_possible(similar, F.col("n"), F.col("i"), F.col("m"), F.col("j")))
    return both.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _pairs(left: DataFrame, right: DataFrame, similar: float) -> DataFrame:
    """Distinct (a, b) of nodes that meet at a shingle and can be similar."""
    b = right.select("shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))
    both = left.join(b, "shingle").where(F.col("node") != F.col("b"))
    both = both.where(_possible(similar, F.col("n"), F.col("i"), F.col("m"), F.col("j")))
    return both.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _rows_in_groups(docs: DataFrame, words: int, similar: float, small: int) -> DataFrame:
    """(doc_id, text_hash, least) of the rows that may have copies; least: (no id, doc_id, text_hash) of the first row of their component."""
    small_batches(docs.sparkSession)
    prints = checkpointed(_prints(docs, words, similar))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least")
    nodes = checkpointed(prints.groupBy("node").agg(first, F.first("n").alias("n"), F.first(F.arrays_zip("places", "suspects")).alias("prefix"), F.first("shingles").alias("shingles")))
    postings = nodes.select("node", "n", F.explode("prefix").alias("p")).select("node", "n", F.col("p.places").alias("i"), F.col("p.suspects").alias("shingle"))
    counts = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = checkpointed(postings.join(counts, "shingle"))

    def similar_pairs(pairs: DataFrame) -> DataFrame:
        a, b = nodes.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), nodes.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        shared = F.size(F.array_intersect("sa", "sb"))
        found = checkpointed(pairs).join(a, "a").join(b, "b").select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("both"))
        return checkpointed(found.where(F.col("shared") >= similar * (F.col("both") - F.col("shared")) - 1e-9).select("a", "b"))

    few, crowded = sized.where(F.col("size") <= small), sized.where(F.col("size") > small)
    classed = crowded.withColumn("length", F.floor(F.log("n") / np.log(1 / similar)))
    # a centre has the fewest shingles before the posting's own, so it is the one that most others are similar to
    centre = classed.groupBy("shingle", "length").agg(F.min(F.struct("i", "n", "node")).alias("c"))
    centre = centre.select("shingle", F.explode(F.array(*(F.col("length") + k for k in (-1, 0, 1)))).alias("length"), "c")
    met = classed.join(centre, ["shingle", "length"]).where("node <> c.node").where(_possible(similar, F.col("n"), F.col("i"), F.col("c.n"), F.col("c.i")))
    met = met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
    found = similar_pairs(_pairs(few, few.where("true"), similar).union(met).distinct())

    # pairs of crowded postings that could still join two components
    roots = checkpointed(connected_components(found, "a", "b"))
    rooted = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    most = rooted.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count(F.lit(1)).alias("roots"))
    mixed = checkpointed(_by_length(rooted.join(most.where("roots > 1"), "shingle").select("shingle", "node", "n", "i", "root", "largest"), similar).drop("least", "most"))
    rest = _crowded_pairs(mixed.where("root <> largest"), mixed, similar)
    roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(similar_pairs(rest)), "a", "b")  # the first links' components stand for them

    rooted = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("node", F.col("first").alias("least"))
    return prints.select("doc_id", "text_hash", "node").join(named, "node").select("doc_id", "text_hash", "least")


def near_copies(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, small: int = SMALL) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id that it reaches over near copies; null where none has one."""
    grouped = _rows_in_groups(docs, words, similar, small)
    known = grouped.groupBy("doc_id", "text_hash").agg(F.first("least.doc_id").alias("component_id"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("own"), F.xxhash64("text").alias("own_hash"))
    joined = rows.join(known, rows.own.eqNullSafe(known.doc_id) & (rows.own_hash == known.text_hash), "left")
    return joined.select(F.col("own").alias("doc_id"), F.when(F.col("text_hash").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two groupings of rows (doc_id, text_hash, least) as one: rows that either puts together are together."""
    rows = checkpointed(a.unionByName(b))
    name = lambda c: F.xxhash64(c["doc_id"].isNull(), F.coalesce(c["doc_id"], F.lit(0)), c["text_hash"])
    named = rows.select("*", name({"doc_id": F.col("doc_id"), "text_hash": F.col("text_hash")}).alias("row"), name(F.col("least")).alias("of"))
    roots = checkpointed(connected_components(named.select("row", "of").distinct(), "row", "of"))
    rooted = named.join(roots, named.row == roots.node, "left").withColumn("root", F.coalesce("root", "row"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return rooted.join(firsts, "root").select("doc_id", "text_hash", F.col("first").alias("least"))


def without_near_copies(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, small: int = SMALL, most_sent: int = SENT_ROWS, also: DataFrame | None = None) -> DataFrame:
    """One row of each group of near copies, the first by doc_id, and all rows without copies; all columns as they are.

    also: another grouping of rows (doc_id, text_hash, least) of docs; groups that share a row are one.
    The texts stay where they are as long as there are no more rows to drop than can be sent to them.
    """
    found = _rows_in_groups(docs, words, similar, small)
    if also is not None:  # rows that repeat doc_id and text are in a group of either kind as often as in the other: they are counted once
        times = F.count(F.lit(1)).alias("times")
        own = also.groupBy("doc_id", "text_hash").agg(F.first("least").alias("least"), times)
        found = checkpointed(found.groupBy("doc_id", "text_hash").agg(F.first("least").alias("least"), times))
        least = merged(found.drop("times"), own.drop("times")).groupBy("doc_id", "text_hash").agg(F.first("least").alias("least"))
        both = found.unionByName(own).groupBy("doc_id", "text_hash").agg(F.max("times").alias("times"))
        pair = lambda d, n: d.withColumnsRenamed({"doc_id": f"{n}_id", "text_hash": f"{n}_hash"})
        joined = least.join(pair(both, "b"), F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash")))
        return _first_rows(docs, joined.select("doc_id", "text_hash", "least", "times"), most_sent)
    return _first_rows(docs, found.groupBy("doc_id", "text_hash").agg(F.first("least").alias("least"), F.count(F.lit(1)).alias("times")), most_sent)


def _first_rows(docs: DataFrame, grouped: DataFrame, most_sent: int) -> DataFrame:
    """Rows of docs that no group holds, and the first of each group; grouped: (doc_id, text_hash, least, times: rows that repeat both).

    Rows to drop are sent to the texts up to most_sent of them, else joined.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    judged = checkpointed(grouped.select("doc_id", "text_hash", stays.alias("stays"), "times").where("not stays or times > 1"))
    own, own_hash = new_column(docs, "own"), new_column(docs, "own_hash")
    rows = docs.withColumn(own, F.col("doc_id").cast("bigint")).withColumn(own_hash, F.xxhash64("text"))
    same = F.col(own).eqNullSafe(F.col("_judged.doc_id")) & (F.col(own_hash) == F.col("_judged.text_hash"))
    sent = (F.broadcast if judged.count() <= most_sent else lambda x: x)(judged.alias("_judged"))
    left = rows.join(sent, same, "left_anti")
    if not judged.where("stays").isEmpty():  # rows that repeat doc_id and text: one of them
        sent = (F.broadcast if judged.where("stays").count() <= most_sent else lambda x: x)(judged.where("stays").alias("_judged"))
        left = left.unionByName(rows.join(sent, same, "left_semi").dropDuplicates([own, own_hash]))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
