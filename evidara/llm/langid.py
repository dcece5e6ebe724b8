"""Language of words and documents by a linear-chain conditional random field (operator 10).

Words are labelled in context: each has affix, character n-gram and lexicon features, and
learned transitions join neighbours; forward-backward gives every word's marginals. A chain
is a line of the text, at most ``CHAIN`` words of it (a longer line goes on in a new chain),
so every word of the whole text is labelled. A document's language is the label with the
largest mean marginal over its words, its score that mean.

The model is learned from a bounded sample of labelled rows: ``SAMPLE_DOCS`` per language,
in the order of a hash of doc_id and text, of these the shorter ones first up to ``SAMPLE_BYTES``,
and at most ``SAMPLE_WORDS`` words of each language's. Every label is learned; where there are so
many that this would exceed ``SAMPLE_ROWS``, each has an equal share of those, one row at least.
Only rows outside the held-out quarter are learned from. Only text is an input of a prediction.
A document has one label, so lines that change language are made for learning: some chains are
cut up and spliced with those of other languages, which is where transitions are learned from.

Null or empty text, or text without a letter: `und` with score 0. Rows without a doc_id are
predicted, not learned from; nulls in other columns do not matter. Very long texts are labelled
whole. Rows that repeat doc_id and text are learned from once and predicted alike. If there is
nothing to learn from, every row is `und`. Ties go to the language that sorts first. An empty table
gives no rows. Only doc_id, text and lang are read, or all columns kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import LOWER, Batches, as_bytes, byte_chunks, checkpointed, emit, mix64, range_hashes, small_batches, words_of

CHAIN = 96
SAMPLE_DOCS, SAMPLE_WORDS = 400, 50_000
SAMPLE_ROWS, SAMPLE_BYTES, HASH_RANGES = 80_000, 1_000_000, 1 << 12
#: Every SWITCHED-th chain is cut into stretches of SWITCH words, which are spliced to lines of several languages.
SWITCHED, SWITCH = 4, 16
BUCKETS = 1 << 17
GRAMS = (2, 3, 4)
EPOCHS, STEPS, RATE, DECAY = 6, 6, 0.35, 1e-6

UNKNOWN = "und"


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x langs
    lexicon: np.ndarray  # sorted hashes of known words
    trans: np.ndarray  # langs x langs
    start: np.ndarray


def _bucket(code: np.ndarray, tag: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (code + np.uint32(tag * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        return ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32)


def _lexicon_bucket(hashes: np.ndarray) -> np.ndarray:
    return _bucket((hashes >> np.uint64(32)).astype(np.uint32), 99)


def _codes(data: np.ndarray, most: int):
    """(n, the n bytes from each position as one number, zero beyond the end) for n from 1 to most."""
    code = data.astype(np.uint32)
    yield 1, code
    for n in range(2, most + 1):
        code = code << np.uint32(8)
        code[: len(data) - n + 1] |= data[n - 1 :]
        yield n, code


def _gram_positions(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each n: the buckets at all positions, and which positions hold a whole n-gram of one word."""
    room = np.zeros(len(data), np.int32)
    room[start] = np.diff(end, prepend=0)
    np.cumsum(room, out=room)  # the end of the last word that has begun
    room -= np.arange(len(data), dtype=np.int32)
    for n, code in _codes(data, max(GRAMS)):
        if n in GRAMS:
            yield n, _bucket(code, n), room >= n


def _affixes(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(words, buckets) for prefixes and suffixes of 1 to 3 bytes."""
    for n, codes in _codes(data, 3):
        words = np.flatnonzero(end - start >= n)
        yield words, _bucket(codes[start[words]], 10 + n)
        yield words, _bucket(codes[end[words] - n], 20 + n)


def _known(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return lexicon[at] == hashes


def range_hashes_of_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 200_000) -> np.ndarray:
    """range_hashes, some words at a time."""
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), block):
        b = min(len(start), a + block)
        lo, hi = start[a], end[b - 1]
        out[a:b] = range_hashes(data[lo:hi], start[a:b] - lo, end[a:b] - lo)
    return out


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) pairs of all features, for learning."""
    owner = np.searchsorted(start, np.arange(len(data)), side="right") - 1
    words, buckets = [], []
    for _, b, whole in _gram_positions(data, start, end):
        words.append(owner[whole])
        buckets.append(b[whole])
    for w, b in _affixes(data, start, end):
        words.append(w)
        buckets.append(b)
    h = range_hashes(data, start, end)
    w = np.flatnonzero(_known(lexicon, h))
    return np.concatenate([*words, w]).astype(np.int64), np.concatenate([*buckets, _lexicon_bucket(h[w])]).astype(np.int64)


def emissions(model: Crf, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The score of every label for every word."""
    zeroed = np.vstack([model.weights, np.zeros((1, len(model.langs)), np.float32)])
    total = np.zeros((len(data), len(model.langs)), np.float32)
    for _, b, whole in _gram_positions(data, start, end):
        b[~whole] = BUCKETS
        total += np.take(zeroed, b, axis=0)
    out = np.add.reduceat(total, start, axis=0)
    for w, b in _affixes(data, start, end):
        out[w] += model.weights[b]
    h = range_hashes(data, start, end)
    w = np.flatnonzero(_known(model.lexicon, h))
    out[w] += model.weights[_lexicon_bucket(h[w])]
    return out


def chains_of(data: np.ndarray, start: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain: a line of a document, in pieces of CHAIN words."""
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z
    line = np.cumsum(data == 10)[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(fresh)
    since = np.arange(len(start)) - np.repeat(head, np.diff(head, append=len(start)))
    first = np.flatnonzero(since % CHAIN == 0)
    return first, np.diff(first, append=len(start))


def forward_backward(emit_scores: np.ndarray, first: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every word, and the expected counts of transitions and of first labels; chains side by side."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    psi = np.exp(emit_scores - emit_scores.max(axis=1, keepdims=True)).astype(np.float64)
    m, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    steps = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # chains longer than t
    alpha = np.empty_like(psi)
    a = psi[first] * s
    a /= a.sum(axis=1, keepdims=True)
    alpha[first] = a
    for t in range(1, steps):
        k = active[t]
        at = first[:k] + t
        a = (a[:k] @ m) * psi[at] + 1e-300
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    gamma = np.empty_like(psi)
    pairs = np.zeros_like(m)
    beta = np.ones((len(first), psi.shape[1]))
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        if t + 1 < steps and (j := active[t + 1]):
            nxt = psi[at[:j] + 1] * beta[:j]
            x = alpha[at[:j]]
            z = ((x @ m) * nxt).sum(axis=1, keepdims=True) + 1e-300
            pairs += (x / z).T @ nxt * m
            back = nxt @ m.T
            beta[:j] = back / back.sum(axis=1, keepdims=True)
        g = alpha[at] * beta[:k]
        gamma[at] = g / g.sum(axis=1, keepdims=True)
    return gamma, pairs, gamma[first].sum(axis=0)


def switched(chains: list[tuple[bytes, int]]) -> list[tuple[bytes, np.ndarray]]:
    """Chains (text, label) as lines with a label for each word; every SWITCHED-th one is cut up and spliced with others, so that languages change in a line."""
    lines, parts = [], []
    for k, (text, label) in enumerate(chains):
        words = text.split()
        if k % SWITCHED:
            lines.append((text, np.full(len(words), label)))
        else:
            parts += [(b" ".join(words[at : at + SWITCH]), np.full(len(words[at : at + SWITCH]), label)) for at in range(0, len(words), SWITCH)]
    by = np.argsort(mix64(np.arange(len(parts), dtype=np.uint64)), kind="stable")
    for at in range(0, len(parts), CHAIN // SWITCH):
        some = [parts[k] for k in by[at : at + CHAIN // SWITCH]]
        lines.append((b" ".join(t for t, _ in some), np.concatenate([y for _, y in some])))
    return lines


def seen_transitions(y: np.ndarray, heads: np.ndarray, n_langs: int) -> np.ndarray:
    """How often each label follows each within the chains that begin at heads."""
    inside = np.ones(len(y), bool)
    inside[heads] = False
    at = np.flatnonzero(inside)
    return np.bincount(y[at - 1] * n_langs + y[at], minlength=n_langs * n_langs).reshape(n_langs, n_langs).astype(float)


def fit(texts: list[bytes], labels: list[str]) -> Crf | None:
    """Learns by adaptive gradient steps on the conditional likelihood of the word labels."""
    langs = sorted(set(labels))
    if not langs:
        return None
    n_langs = len(langs)
    # chains of all texts, some texts at a time: their bytes, words, labels and a hash that shuffles them
    texts_of, words_in, y, shuffle, hashes = [], [], [], [], []
    for k, (text, label) in enumerate(zip(texts, labels)):
        data = LOWER[np.frombuffer(text, np.uint8)]
        start, end, doc = words_of(data, np.array([0, len(data)]))
        first, length = chains_of(data, start, doc)
        if not len(first):
            continue
        h = range_hashes_of_words(data, start, end)
        hashes.append(h)
        texts_of += [data[start[f] : end[f + n - 1]].tobytes() for f, n in zip(first, length)]
        words_in.append(length)
        y.append(np.full(len(first), langs.index(label)))
        shuffle.append(mix64(h[first] + np.uint64(k) * np.uint64(CHAIN) + np.arange(len(first), dtype=np.uint64)))
    if not texts_of:
        return None
    length, y_chain = np.concatenate(words_in), np.concatenate(y)
    order = np.argsort(np.concatenate(shuffle), kind="stable")
    # words of each language up to the bound
    kept = []
    for k in range(n_langs):
        mine = order[y_chain[order] == k]
        kept.append(mine[: int(np.searchsorted(np.cumsum(length[mine]), SAMPLE_WORDS, side="right")) + 1])
    values, counts = np.unique(np.concatenate(hashes), return_counts=True)
    lexicon = values[counts > 1]
    del hashes, values, counts
    lines = switched([(texts_of[c], int(y_chain[c])) for c in np.concatenate(kept)])
    w, t, s = np.zeros((BUCKETS, n_langs), np.float32), np.zeros((n_langs, n_langs)), np.zeros(n_langs)
    gw, gt, gs = (np.full_like(x, 1e-6) for x in (w, t, s))
    prepared = []
    for piece in (lines[k::STEPS] for k in range(STEPS)):  # each piece's text by itself, a line for each chain
        part = np.frombuffer(b"\n".join(text for text, _ in piece), np.uint8)
        begin, stop, inside = words_of(part, np.array([0, len(part)]))
        heads, n = chains_of(part, begin, inside)
        owner, b = features(part, begin, stop, lexicon)
        prepared.append((owner.astype(np.int32), b.astype(np.int32), np.concatenate([np.zeros(0, np.int64), *(y for _, y in piece)]), heads, n))
    del texts_of, lines
    for _ in range(EPOCHS):
        for owner, b, y, heads, n in prepared:
            if not len(y):
                continue
            scores = np.stack([np.bincount(owner, weights=w[b, k], minlength=len(y)) for k in range(n_langs)], axis=1)
            gamma, pairs, begun = forward_backward(scores, heads, n, t, s)
            gamma[np.arange(len(y)), y] -= 1
            gamma /= len(y)
            grad = np.stack([np.bincount(b, weights=gamma[owner, k], minlength=BUCKETS) for k in range(n_langs)], axis=1) + DECAY * w
            seen_pairs, seen_first = seen_transitions(y, heads, n_langs), np.bincount(y[heads], minlength=n_langs)
            for x, g, acc in ((w, grad, gw), (t, (pairs - seen_pairs) / len(y) + 1e-3 * t, gt), (s, (begun - seen_first) / len(heads) + 1e-3 * s, gs)):
                acc += g * g
                x -= RATE * g / np.sqrt(acc)
    return Crf(langs, w, lexicon, t, s)


def label_words(model: Crf, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and marginals of every word of concatenated documents."""
    data = LOWER[data]
    start, end, doc = words_of(data, offsets)
    if not len(start):
        return start, end, doc, np.zeros((0, len(model.langs)))
    first, length = chains_of(data, start, doc)
    gamma, _, _ = forward_backward(emissions(model, data, start, end), first, length, model.trans, model.start)
    return start, end, doc, gamma


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[data])])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~found):
        found[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def held_out() -> Column:
    """The quarter of the documents that is never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def sample(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """Whole texts of SAMPLE_DOCS labelled rows of each language, no more than SAMPLE_BYTES and one text of them, and their labels."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    named = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.xxhash64("doc_id", "text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    named = named.withColumn("part", F.shiftright("h", 64 - (HASH_RANGES.bit_length() - 1)))
    # up to which range of hashes a language's first rows reach; only those are put in order
    counts = checkpointed(named.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")))
    langs = counts.select("lang").distinct().count()
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ROWS // max(1, langs)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = counts.withColumn("before", before).where(F.col("before") < each).select("lang", "part")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    placed = named.join(F.broadcast(reach), ["lang", "part"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)  # about `each` ranges a language at most
    placed = placed.withColumn("bytes", F.sum("size").over(Window.partitionBy("lang").orderBy("size", "h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)))
    wanted = placed.where(F.coalesce("bytes", F.lit(0)) < SAMPLE_BYTES).select(F.col("doc_id").alias("id"), "lang", "h").distinct()
    same = (F.col("doc_id").cast("bigint") == F.col("id")) & (rows.lang == wanted.lang) & (F.xxhash64("doc_id", "text") == F.col("h"))
    texts = rows.join(F.broadcast(wanted), same, "left_semi").select("doc_id", "lang", as_bytes().alias("text")).dropDuplicates()  # SAMPLE_ROWS ids, or one per language
    found = sorted((r.doc_id, bytes(r.text), r.lang) for r in texts.collect())
    return [x[1] for x in found if x[1]], [x[2] for x in found if x[1]]


def predict_batch(crf: Crf | None, batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The language and score of every row of a batch, and by how much the score exceeds the runner-up's."""
    pred, score, margin = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
    if crf is None:
        return pred, score, margin
    for a, b, data, offsets in byte_chunks(batch, column):
        _, _, doc, gamma = label_words(crf, data, offsets)
        if not len(doc):
            continue
        total = np.stack([np.bincount(doc, weights=gamma[:, k], minlength=b - a) for k in range(len(crf.langs))], axis=1)
        count = np.bincount(doc, minlength=b - a)
        sure = has_letter(data, offsets) & (count > 0)
        best = total.argmax(axis=1)
        pred[a:b][sure] = np.array(crf.langs, object)[best[sure]]
        mean = np.sort(np.pad(total, ((0, 0), (1, 0))), axis=1)[sure] / count[sure][:, None]
        score[a:b][sure] = np.clip(mean[:, -1], 0, 1)
        margin[a:b][sure] = mean[:, -1] - mean[:, -2]
    return pred, score, margin


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row: a map over the scan."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x languages and the sample's lexicon
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            pred, score, _ = predict_batch(sent.value, batch, "text")
            yield emit(schema, [batch.column(0), batch.column(1), pred.tolist(), score])

    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), as_bytes().alias("text"))
    return cols.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_told(docs: DataFrame, least_margin: float) -> DataFrame:
    """The rows whose language is told, its score that much over any other's, whatever the number of languages; all columns as they are."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs)))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            pred, _, margin = predict_batch(sent.value, batch, "text")
            yield batch.filter(pa.array((pred != UNKNOWN) & (margin >= least_margin)))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the labelled rows of docs and predicts all of its rows."""
    return predict(docs, fit(*sample(docs)))
