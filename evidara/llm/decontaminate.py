"""Benchmark decontamination by latent semantic retrieval (operator 4).

1. Document frequencies of hashed terms over all passages of all documents.
2. A randomised SVD of TF-IDF passages, distributed: the range of the passage matrix is
   sketched with a random test matrix and sharpened by a power step, each a pass that adds up
   partial products by task; the right singular vectors span the latent space. The basis is
   fitted on the items' own passages, so that it reaches every column, and on every passage of the
   documents, as are the frequencies and the search. Columns are the words of the benchmark; other words count in a passage's mass
   but cannot agree with an item.
3. Every overlapping passage of every whole document is projected and compared with the
   items' passages, words outside the benchmark counting in its length; one of which the basis
   holds next to nothing (``FAINT``) is compared with them as it is. A passage whose words of the
   benchmark have less than ``COSINE`` of its length is not projected, as its cosine must be less
   as well; nor are those of a segment that, with its surroundings, has too few words of every item for
   what follows, and the others are compared with the items that are left: both bounds are exact. Pairs over the threshold are verified on the words themselves, where the surroundings
   hold enough words of the item: the longest common subsequence of item and surroundings must hold
   ``SIMILAR`` of the item, or ``LOOSE`` of it and ``SIMILAR`` of its answer, which is its closing
   words, for paraphrases.

The benchmark is the query set; it is taken in blocks of ``ITEMS`` rows, each by itself: a block's
result is written before the next one is sent, so tasks hold one block. Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased.
Items of fewer than five words, null or empty ones, or ones without an id match nothing. Null text
has no words; very long ones are searched whole. Repeated rows are found alike; a document gives a
row for every item in it, so there are no ties. Without documents or items the result is empty. Only
doc_id and text are read, or all columns kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm import common
from evidara.llm.common import LOWER, Batches, added_up, as_bytes, byte_chunks, checkpointed, count_rows, emit, one_thread, range_hashes, small_batches

#: Passages are as long as the shortest item, within these bounds; a third of that is the stride.
SHORTEST, LONGEST = 8, 24
TERMS = 1 << 18
RANK, OVERSAMPLE = 64, 8
#: Passages that are multiplied at once (not a sample of them: all are), groups that a table of passages may name, and what products are multiplied by to be whole numbers.
SAMPLE, GROUPS, WHOLE = 64, 8, float(1 << 24)
ITEMS, LEAST_WORDS = 5_000, 5
COSINE, SIMILAR, LOOSE = 0.5, 0.8, 0.6
#: What words outside the benchmark count in a passage's squared length, as paraphrases put some in between.
OTHER = 0.5
#: An item's passages begin every 1 / STEP of their length.
STEP = 3
#: Numbers that a worker holds at once of a matrix of segments and items, and passages that it projects at once.
COSINES, PASSAGES = 5_000_000, 8_192
#: Words of the segments that are ruled out together.
SEGMENT = 256
#: The part of a passage's length below which its projection is not trusted.
FAINT = 0.05
SEED = 20

#: Blocks of TF-IDF rows: the column of every word, that of a passage's last one inverted (~), and the words' weights.
Blocks = Iterator[tuple[np.ndarray, np.ndarray]]

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PLAIN = np.where(_APART, 32, LOWER).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the document of every word."""
    plain = _PLAIN[data]
    start, end, doc = common.words_of(plain, offsets)
    return range_hashes(plain, start, end) if len(start) else np.zeros(0, np.uint64), doc


def windows(doc: np.ndarray, rows: int, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and document of the passages: every stride words, the last one reaching the end."""
    count = np.bincount(doc, minlength=rows)
    first = np.cumsum(count) - count
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - width) // stride)), 0)
    owner = np.repeat(np.arange(rows), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = first[owner] + k * stride
    return start, np.minimum(start + width, (first + count)[owner]), owner


def _column(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (TERMS - 1)


def passage_width(benchmark: DataFrame) -> int:
    n = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    shortest = benchmark.select(n.alias("n")).where(F.col("n") >= LEAST_WORDS).agg(F.min("n")).first()[0]
    return max(SHORTEST, min(LONGEST, shortest or LONGEST))


def _frequencies(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """In how many passages each hashed term is, and how many passages there are."""

    def count(batches: Batches) -> Batches:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for a, b, data, offsets in byte_chunks(batch, "text"):
                h, doc = words(data, offsets)
                if not len(h):
                    continue
                start, end, _ = windows(doc, b - a, width, width)
                passage = np.repeat(np.arange(len(start)), end - start)
                # terms of one passage once: sort pairs packed into one number
                pairs = passage * TERMS + _column(h)
                pairs = np.sort(pairs.astype(np.uint32) if len(start) * TERMS < 1 << 32 else pairs)
                total[:TERMS] += np.bincount(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] & (TERMS - 1), minlength=TERMS)
                total[TERMS] += len(start)
        yield count_rows(total)

    total = added_up(docs.mapInArrow(count, common.COUNTS_DDL), TERMS + 1)
    return total[:TERMS], int(total[TERMS])


@dataclass
class Items:
    width: int  # words of a passage
    ids: list[int]
    sequences: list[np.ndarray]  # word hashes
    vocabulary: np.ndarray  # sorted word hashes
    idf: np.ndarray  # of hashed terms
    maybe: np.ndarray  # bits of vocabulary hashes, to rule words out at once
    first: np.ndarray | None = None  # an index of the vocabulary for each of these bits
    basis: np.ndarray | None = None  # vocabulary x rank
    passages: np.ndarray | None = None  # unit latent vectors
    owner: np.ndarray | None = None  # the item of each
    held: tuple[_Pairs, _Pairs] | None = None  # of items and of their answers
    sizes: np.ndarray | None = None  # words of each item
    words_of_items: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # by word: where its items begin, the items, how often they have it
    posted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # by word: where its passages begin, the passages, unit weights

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary's index of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        bits = (h & np.uint64(0xFFFFF)).astype(np.int64)
        some = np.flatnonzero(self.maybe[bits])
        at = self.first[bits[some]].astype(np.int64)  # of the words of equal bits one; the few others are searched
        other = np.flatnonzero(self.vocabulary[at] != h[some])
        at[other] = np.minimum(np.searchsorted(self.vocabulary, h[some[other]]), len(self.vocabulary) - 1)
        at[other[self.vocabulary[at[other]] != h[some[other]]]] = -1
        out[some] = at
        return out


def read_items(rows: list[tuple[int, bytes]], idf: np.ndarray, width: int) -> Items:
    ids, sequences = [], []
    for i, text in rows:
        data = np.frombuffer(text, np.uint8)
        h, _ = words(data, np.array([0, len(data)]))
        if len(h) >= LEAST_WORDS:
            ids.append(i)
            sequences.append(h)
    vocabulary = np.unique(np.concatenate(sequences)) if sequences else np.zeros(0, np.uint64)
    maybe = np.zeros(1 << 20, bool)
    maybe[(bits := (vocabulary & np.uint64(0xFFFFF)).astype(np.int64))] = True
    first = np.zeros(1 << 20, np.int32)
    first[bits] = np.arange(len(vocabulary))
    return Items(width, ids, sequences, vocabulary, idf, maybe, first)


def _passages_of(items: Items, batches: Batches) -> Blocks:
    """TF-IDF rows of all passages of texts over the benchmark's words, a block of texts at a time."""
    plain = items.idf.astype(np.float32)
    for batch in batches:
        for a, b, data, offsets in byte_chunks(batch, "text", 500_000):
            h, doc = words(data, offsets)
            if not len(h):
                continue
            start, end, _ = windows(doc, b - a, items.width, items.width)
            idf, at = plain[_column(h)], items.lookup(h)
            scale = 1 / np.sqrt(np.add.reduceat(idf * idf, start))  # passages follow one another without gaps
            known = np.flatnonzero(at >= 0)
            passage = np.repeat(np.arange(len(start), dtype=np.int32), end - start)[known]
            cols = at[known]
            last = np.flatnonzero(passage[1:] != passage[:-1])
            cols[last] = ~cols[last]
            cols[-1:] = ~cols[-1:]
            yield cols, idf[known] * scale[passage]


def _passages_in(batches: Batches) -> Blocks:
    """TF-IDF rows that a table (cols: int32, weights: float32) holds."""
    for batch in batches:
        for c, w in zip(batch.column("cols"), batch.column("weights")):
            cols = np.frombuffer(c.as_py(), np.int32).astype(np.int64)
            cols[-1:] = np.where(cols[-1:] < 0, cols[-1:], ~cols[-1:])  # a row's end is a passage's
            yield cols, np.frombuffer(w.as_py(), np.float32)


def _own_rows(items: Items) -> list[tuple[np.ndarray, np.ndarray]]:
    """TF-IDF rows of the items' own passages."""
    rows = []
    for h in items.sequences:
        at, weights = items.lookup(h), items.idf[_column(h)]
        start, end, _ = windows(np.zeros(len(h), np.int64), 1, items.width, items.width)
        for s, e in zip(start, end):
            cols, back = np.unique(at[s:e], return_inverse=True)
            rows.append((cols, np.bincount(back, weights=weights[s:e]) / np.sqrt((weights[s:e] ** 2).sum())))
    return rows


def _add_products(total: np.ndarray, m: np.ndarray, cols: np.ndarray, weights: np.ndarray) -> None:
    """Adds A'A m of passages, SAMPLE of them at once, as a dense matrix over the words that these have."""
    ends = cols < 0
    plain, passage, place = np.where(ends, ~cols, cols), np.cumsum(ends) - ends, np.zeros(len(total), np.int64)
    starts = np.append(0, np.flatnonzero(ends)[:-1] + 1)[:: max(1, SAMPLE)] if ends.any() else np.zeros(0, np.int64)
    for k, (low, high) in enumerate(zip(starts, np.append(starts[1:], len(cols)))):
        c, row = plain[low:high], passage[low:high] - k * max(1, SAMPLE)
        used = np.flatnonzero(np.bincount(c, minlength=len(total)))
        place[used] = np.arange(len(used))
        a = np.bincount(row * len(used) + place[c], weights=weights[low:high], minlength=(int(row[-1]) + 1) * len(used)).reshape(-1, len(used)).astype(m.dtype)
        total[used] += a.T @ (a @ m[used])


def _gram_times(rows: DataFrame, test: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]], read: Callable[[Batches], Blocks]) -> np.ndarray:
    """A'A times a matrix, A all passages and the items' own: each task's partial product in whole numbers, added up."""
    sent, shape = rows.sparkSession.sparkContext.broadcast(test.astype(np.float32)), test.shape

    def multiply(batches: Batches) -> Batches:
        total = np.zeros(shape)
        for cols, weights in read(batches):
            _add_products(total, sent.value, cols, weights)
        yield count_rows(np.rint(total.ravel() * WHOLE))

    out = added_up(rows.mapInArrow(multiply, common.COUNTS_DDL), test.size).reshape(shape) / WHOLE
    sent.unpersist()
    for cols, weights in own:
        out[cols] += np.outer(weights, weights @ test[cols])
    return out


def latent_basis(rows: DataFrame, size: int, own: list[tuple[np.ndarray, np.ndarray]] | None = None, read: Callable[[Batches], Blocks] = _passages_in) -> np.ndarray:
    """The leading right singular vectors of the passages, by a sketch with one power step."""
    width = min(size, RANK + OVERSAMPLE)
    test = np.random.default_rng(SEED).standard_normal((size, width))
    q, _ = np.linalg.qr(_gram_times(rows, test, own or [], read))
    b = _gram_times(rows, q, own or [], read)
    values, vectors = np.linalg.eigh((q.T @ b + b.T @ q) / 2)
    keep = np.argsort(-values)[:RANK]
    return (q @ vectors[:, keep]).astype(np.float32)


def _basis(texts: DataFrame, items: Items) -> np.ndarray:
    """The basis of the items' words, fitted on every passage of every document."""
    sent = texts.sparkSession.sparkContext.broadcast(items)
    return latent_basis(texts, len(items.vocabulary), _own_rows(items), lambda batches: _passages_of(sent.value, batches))


def _project(items: Items, at: np.ndarray, weights: np.ndarray, length: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent vectors of passages [start, end) of words, scaled by the passages' whole length, and which are faint.

    at: the words' vocabulary indexes, weights: their IDF, length: of each passage, words outside the vocabulary included.
    """
    at_ = np.minimum(start[:, None] + np.arange(items.width), len(at) - 1)
    there = (start[:, None] + np.arange(items.width) < end[:, None]) & (at[at_] >= 0)
    weight = np.where(there, weights[at_], np.float32(0))
    out = np.matmul(weight[:, None, :], items.basis[np.maximum(at[at_], 0)])[:, 0, :]
    known = np.linalg.norm(weight, axis=1)
    latent = np.linalg.norm(out, axis=1)
    # what the basis leaves out of the known words is not held against a passage; unknown words are
    share = np.minimum(1, known / np.maximum(length, 1e-12)).astype(np.float32)
    return out * (share / np.maximum(latent, 1e-12))[:, None], latent < FAINT * known


def _unit(at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage's words of the vocabulary and their weights, scaled to length 1."""
    cols, back = np.unique(at[at >= 0], return_inverse=True)
    w = np.bincount(back, weights=weights[at >= 0], minlength=len(cols))
    return cols, w / max(1e-12, float(np.sqrt((w**2).sum())))


def index_items(items: Items) -> None:
    vectors, owner, cols, units = [], [], [], []
    for k, h in enumerate(items.sequences):
        start, end, _ = windows(np.zeros(len(h), np.int64), 1, items.width, max(1, items.width // STEP))
        at, weights = items.lookup(h), items.idf[_column(h)].astype(np.float32)
        vectors.append(_project(items, at, weights, np.zeros(len(start)), start, end)[0])
        owner.append(np.full(len(start), k))
        for s, e in zip(start, end):
            c, u = _unit(at[s:e], weights[s:e])
            cols.append(c)
            units.append(u)
    items.passages, items.owner = np.concatenate(vectors), np.concatenate(owner)
    passage, word = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols)
    by = np.argsort(word, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(items.vocabulary)))])
    items.sizes = np.array([len(h) for h in items.sequences])
    pairs, times = np.unique(np.concatenate([items.lookup(h) * len(items.sequences) + k for k, h in enumerate(items.sequences)]), return_counts=True)
    word_, item_ = np.divmod(pairs, len(items.sequences))
    items.words_of_items = np.concatenate([[0], np.cumsum(np.bincount(word_, minlength=len(items.vocabulary)))]), item_, times
    items.held = _Pairs(items, items.sequences), _Pairs(items, [answer_of(h) for h in items.sequences])
    items.posted = begin, passage[by].astype(np.int32), np.concatenate(units)[by].astype(np.float32)


def answer_of(sequence: np.ndarray) -> np.ndarray:
    """The closing words of an item."""
    return sequence[-max(LEAST_WORDS, len(sequence) // 4) :]


class _Pairs:
    """How often each sequence has each word of the vocabulary, by hashed pairs: never too few."""

    def __init__(self, items: Items, sequences: list[np.ndarray]):
        keys = np.concatenate([np.uint64(k) << np.uint64(32) | items.lookup(h).astype(np.uint64) for k, h in enumerate(sequences)])
        keys, n = np.unique(keys, return_counts=True)
        self.mask = np.uint64((1 << max(16, (16 * len(keys)).bit_length())) - 1)
        self.times = np.zeros(int(self.mask) + 1, np.uint8)
        np.maximum.at(self.times, self._place(keys), np.minimum(n, 255).astype(np.uint8))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (common.mix64(keys) & self.mask).astype(np.int64)

    def common_words(self, item: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, block: int = 20_000) -> np.ndarray:
        """At most how many words the words [start, end) have in common with each item, in any order."""
        out = np.zeros(len(item))
        for lo in range(0, len(item), block):
            first, n = start[lo : lo + block], end[lo : lo + block] - start[lo : lo + block]
            begin = np.concatenate([[0], np.cumsum(n)])
            word = at[np.repeat(first - begin[:-1], n) + np.arange(begin[-1])]
            owner = np.repeat(np.arange(len(n)), n)
            owner, word = owner[word >= 0], word[word >= 0].astype(np.uint64)
            place = self._place(item[lo + owner].astype(np.uint64) << np.uint64(32) | word)
            held = np.flatnonzero(self.times[place])
            pairs = np.sort(owner[held].astype(np.uint64) << np.uint64(32) | word[held])
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
            times, pairs = np.diff(first, append=len(pairs)), pairs[first]
            of = (pairs >> np.uint64(32)).astype(np.int64)
            most = np.minimum(times, self.times[self._place(item[lo + of].astype(np.uint64) << np.uint64(32) | pairs & np.uint64(0xFFFFFFFF))])
            out[lo : lo + block] = np.bincount(of, weights=most, minlength=len(n))
        return out


def _plain_cosines(items: Items, at: np.ndarray, weights: np.ndarray, length: float) -> np.ndarray:
    """Cosines of a passage with the items' passages over the words themselves."""
    begin, passage, unit = items.posted
    out = np.zeros(len(items.owner))
    cols, units = _unit(at, weights)
    known = float(np.linalg.norm(weights[at >= 0]))
    for c, u in zip(cols, units * min(1.0, known / max(length, 1e-12))):
        out[passage[begin[c] : begin[c + 1]]] += u * unit[begin[c] : begin[c + 1]]  # a passage has a word once
    return out


def common_subsequence(item: np.ndarray, masks: dict[int, int], text: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time; masks: where each word stands in it."""
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _masks(item: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


class Matcher:
    """Finds the items in chunks of documents."""

    def __init__(self, items: Items):
        self.items = items
        self.masks = [_masks(s) for s in items.sequences]
        self.answers = [(a, _masks(a)) for a in map(answer_of, items.sequences)]

    def verify(self, k: int, text: np.ndarray) -> float:
        """The share of the item that the text holds in order, or 0 if that is too little."""
        item = self.items.sequences[k]
        held = common_subsequence(item, self.masks[k], text) / len(item)
        if held >= SIMILAR:
            return held
        if held >= LOOSE:
            a, masks = self.answers[k]
            if common_subsequence(a, masks, text) >= SIMILAR * len(a):
                return held
        return 0.0

    def _possible(self, at: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """The length of a segment, each document's first segment, and the pairs (segment, item) that may hold enough of the item.

        An item found from a window has LOOSE of its words within its own length around the window; a
        segment and its surroundings hold at most its words that occur in them, each as often as the item has it.
        """
        it = self.items
        reach = int(it.sizes.max()) + it.width
        size = max(SEGMENT, 2 * reach)
        n = -(-count // size)
        base, segments = np.cumsum(n) - n, int(n.sum())
        known = np.flatnonzero(at >= 0)
        place, row = known - (np.cumsum(count) - count)[doc[known]], doc[known]
        low, high = np.maximum(0, (place - reach) // size), np.minimum(n[row] - 1, (place + reach) // size)
        many = high - low + 1
        back = np.repeat(np.arange(len(known)), many)
        near = base[row][back] + low[back] + np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many)
        near, word = np.divmod(np.unique(near * len(it.vocabulary) + at[known][back]), len(it.vocabulary))
        begin, item, times = it.words_of_items
        many = begin[word + 1] - begin[word]
        out_s, out_k = [], []
        step = max(1, COSINES // len(it.sizes))
        for first in range(0, segments, step):
            lo, hi = np.searchsorted(near, [first, first + step])
            for_ = np.repeat(np.arange(lo, hi), many[lo:hi])
            j = begin[word[for_]] + np.arange(len(for_)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
            rows = min(step, segments - first)
            held = np.bincount((near[for_] - first) * len(it.sizes) + item[j], weights=times[j], minlength=rows * len(it.sizes)).reshape(rows, -1)
            s, k = np.nonzero(held >= LOOSE * it.sizes - 1e-9)
            out_s.append(s + first)
            out_k.append(k)
        return size, base, np.concatenate(out_s) if out_s else np.zeros(0, np.int64), np.concatenate(out_k) if out_k else np.zeros(0, np.int64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(row, item, similarity, cosine) of the contaminated documents among the concatenated ones."""
        it, rows = self.items, len(offsets) - 1
        h, doc = words(data, offsets)
        if not len(h) or not it.ids:
            return []
        at = it.lookup(h)
        weights = it.idf[_column(h)].astype(np.float32)
        mass = weights.astype(np.float64) ** 2
        total = np.concatenate([[0.0], np.cumsum(np.where(at >= 0, mass, OTHER * mass))])
        known = np.concatenate([[0.0], np.cumsum(np.where(at >= 0, mass, 0))])
        start, end, owner = windows(doc, rows, it.width, max(1, it.width // 3))
        length = np.sqrt(total[end] - total[start])
        near = np.flatnonzero(known[end] - known[start] >= COSINE**2 * (total[end] - total[start]) - 1e-9)
        count = np.bincount(doc, minlength=rows)
        last = np.cumsum(count)
        sizes, answer_sizes = it.sizes, np.array([len(a) for a, _ in self.answers])
        # only windows of segments in which an item can be found at all are compared, and with such items alone
        size, base, segments, possible = self._possible(at, doc, count)
        begin = np.searchsorted(it.owner, np.arange(len(sizes) + 1))
        segment = base[owner[near]] + (start[near] - (last - count)[owner[near]]) // size
        hits: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        alive, first_pair = np.unique(segments, return_index=True)
        lows, highs, ends = np.searchsorted(segment, alive), np.searchsorted(segment, alive, side="right"), np.append(first_pair[1:], len(segments))
        cut = np.flatnonzero(np.diff(np.cumsum(highs - lows) // PASSAGES, prepend=-1))  # about PASSAGES windows at once
        for g, g_end in zip(cut, np.append(cut[1:], len(alive))):
            some = np.concatenate([near[lows[z] : highs[z]] for z in range(g, g_end)])
            if not len(some):
                continue
            vectors, faint = _project(it, at, weights, length[some], start[some], end[some])
            w_, k_, c_, done = [], [], [], 0
            for z in range(g, g_end):
                n = highs[z] - lows[z]
                v, weak, own = vectors[done : done + n], np.flatnonzero(faint[done : done + n]), some[done : done + n]
                done += n
                plain = [_plain_cosines(it, at[start[own[x]] : end[own[x]]], weights[start[own[x]] : end[own[x]]], length[own[x]]) for x in weak]
                for k in possible[first_pair[z] : ends[z]].tolist():
                    cosine = (v @ it.passages[begin[k] : begin[k + 1]].T).max(axis=1)
                    for x, p in zip(weak, plain):
                        cosine[x] = max(cosine[x], p[begin[k] : begin[k + 1]].max())
                    hit = np.flatnonzero(cosine >= COSINE)
                    w_.append(own[hit])
                    k_.append(np.full(len(hit), k))
                    c_.append(cosine[hit])
            w, k, c = np.concatenate(w_), np.concatenate(k_), np.concatenate(c_)
            if not len(w):
                continue
            by = np.lexsort((k, w))
            w, k, c = w[by], k[by], c[by]
            row = owner[w]
            a, b = np.maximum(last[row] - count[row], start[w] - sizes[k]), np.minimum(last[row], end[w] + sizes[k])
            # windows that follow one another are first bounded together, by all their surroundings
            name = row * len(sizes) + k
            by = np.argsort(name, kind="stable")
            name, at_ = name[by], start[w[by]]
            fresh = np.ones(len(by), bool)
            fresh[1:] = (name[1:] != name[:-1]) | (at_[1:] - at_[:-1] > it.width)
            head, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            may = it.held[0].common_words(k[by][head], a[by][head], np.maximum.reduceat(b[by], head), at)
            likely = np.sort(by[(may >= LOOSE * sizes[k[by][head]] - 1e-9)[group]])
            w, k, c, row, a, b = w[likely], k[likely], c[likely], row[likely], a[likely], b[likely]
            may = it.held[0].common_words(k, a, b, at)
            enough = may >= SIMILAR * sizes[k] - 1e-9
            loose = np.flatnonzero((may >= LOOSE * sizes[k] - 1e-9) & ~enough)
            enough[loose] = it.held[1].common_words(k[loose], a[loose], b[loose], at) >= SIMILAR * answer_sizes[k[loose]] - 1e-9
            for z in np.flatnonzero(enough):
                hits.setdefault((int(row[z]), int(k[z])), []).append((int(start[w[z]]), int(end[w[z]]), float(c[z])))
        found = []
        for (row, k), places in hits.items():
            n, best, cos = len(it.sequences[k]), 0.0, 0.0
            for s, e, c in sorted(places):
                cos = max(cos, c)
                a, b = max(int(last[row] - count[row]), s - n), min(int(last[row]), e + n)
                best = max(best, self.verify(k, h[a:b]))
            if best:
                found.append((row, it.ids[k], best, cos))
        return found


def prepare(docs: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    """The indexed benchmark, a block of at most about ITEMS rows at a time."""
    spark = docs.sparkSession
    small_batches(spark)
    one_thread(spark)
    texts = docs.select(as_bytes().alias("text"))
    width = passage_width(benchmark)
    counts, passages = _frequencies(texts, width)
    idf = np.log((1 + passages) / (1 + counts)) + 0.1
    blocks = max(1, -(-benchmark.count() // ITEMS))
    for block in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", as_bytes().alias("text")).collect()  # a block of the query set
        items = read_items(sorted((r.item_id, bytes(r.text)) for r in rows if r.item_id is not None), idf, width)
        if items.ids:
            items.basis = _basis(texts, items)
            index_items(items)
            yield items


def _matches(matcher: Matcher, batch: pa.RecordBatch, column: str) -> list[tuple[int, int, float, float]]:
    return [(a + row, *rest) for a, _, data, offsets in byte_chunks(batch, column) for row, *rest in matcher.find(data, offsets)]


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("cosine", pa.float64())])
FOUND_DDL = "doc_id bigint, item_id bigint, similarity double, cosine double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, cosine) for every item found in a document; each block of the benchmark goes through the documents."""
    spark = docs.sparkSession
    texts, out, sent = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("text")), None, None
    for items in prepare(docs, benchmark):
        if out is not None:
            out = checkpointed(out)  # a block's hits are written before the next one is sent
            sent.unpersist()
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Batches, sent=sent) -> Batches:  # noqa: ANN001
            matcher = Matcher(sent.value)
            for batch in batches:
                found = sorted(_matches(matcher, batch, "text"))
                ids = batch.column(0).to_pylist()
                yield emit(FOUND, [[ids[r] for r, *_ in found], *([f[k] for f in found] for k in (1, 2, 3))])

        part = texts.mapInArrow(run, FOUND_DDL)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], FOUND_DDL)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, all columns as they are: a map over the rows, for a benchmark of several blocks one after the other."""
    left, sent = docs, None
    for items in prepare(docs, benchmark):
        if sent is not None:
            left = checkpointed(left)  # what a block leaves is written before the next one is sent
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Batches, sent=sent) -> Batches:  # noqa: ANN001
            matcher = Matcher(sent.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in _matches(matcher, batch, "text")]] = False
                yield batch.filter(pa.array(keep))

        left = left.mapInArrow(run, docs.schema)
    return left
