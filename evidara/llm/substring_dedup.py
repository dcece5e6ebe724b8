"""Removal of repeated byte strings by threshold-bounded interval expansion (operator 1).

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a
smaller doc_id. All strings are judged on the input, whole texts, nothing across documents.

Equal texts are dealt to one share and fold there: the smallest doc_id stands for all, the
others lose every byte. A map task hands over a text once, and copies it knows without text.

Locating. Windows of ``length`` bytes are named after the smallest hash of their ``GRAM``-byte
strings; equal windows have equal names, and neighbouring windows mostly share one, so a
document is a list of runs of windows with one name (about one run for every 16 bytes).

1. Each share of the documents asks a directory, dealt out by name, which of its names more
   than one document has. Only distinct names travel, a few bytes each.
2. The runs with shared names are sent, by name, as short byte strings, equal ones once per
   share. A name of very many strings would crowd one task: its windows go one by one instead,
   dealt out by their own hash.
3. What meets is searched by blocks of names, as far as a name has several strings: suffixes
   are ranked to the bounded depth, which gives the block's Burrows-Wheeler transform; the intervals of suffixes with a common prefix
   of 1, 8, 15, ... bytes are found level by level by extending the level before by ``STEP``
   symbols to the left, until ``length`` is reached. An interval left then is one string; the
   smallest doc_id in it decides for all its places.
4. The places to remove return to the documents' shares.

The texts are dealt out once (one exchange serves three passes). All state is per share or
per block, and each worker goes through its share in chunks.

Null text is empty. Rows that repeat a doc_id do not remove from one another. A null doc_id
counts as larger than all others. With no rows the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import as_bytes, byte_chunks, input_bytes, mix64, parts, range_hashes, small_batches

LENGTH, GRAM = 50, 20

#: Names of more strings than this, added up over the shares, are dealt out window by window.
CROWDED = 1 << 14

#: A share of the documents reads no more than this of the input files, however few shuffle partitions are set.
SHARE_BYTES = 32 << 20

#: Bytes of strings that are ranked and searched together, and of texts that are hashed together: what caches hold.
BLOCK, HASHED = 50_000, 100_000

#: Windows, of all places of the strings, that are compared with their owners together.
COMPARED = 1_000_000

#: Symbols by which intervals are extended at once; as many of 9 bits fill a word.
STEP = 7

#: Texts that a map task remembers. Beyond that it forgets them and hands over their copies as well.
REMEMBERED = 200_000

NO_DOC = np.iinfo(np.int64).max


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, little-endian, zero beyond the end."""
    n = len(data)
    padded = np.zeros((n + 15) // 8 * 8 + 8, np.uint8)
    padded[:n] = data
    out = np.empty(n, np.uint64)
    for r in range(8):
        out[r::8] = padded[r : r + 8 * ((n - r + 7) // 8)].view("<u8")
    return out


def _gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` (9 to 24) bytes from each position, from the 8 bytes there; the last ones are not whole."""
    pad = np.concatenate([x, np.zeros(24, np.uint64)])
    n = len(x)
    with np.errstate(over="ignore"):
        h = x * np.uint64(0x9E3779B97F4A7C15) + pad[gram - 8 : gram - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
        if gram > 16:
            h += pad[8 : 8 + n] * np.uint64(0x165667B19E3779F9)
    return mix64(h)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of `width` values from each position that has as many."""
    have, m = 1, h
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if have < width else m


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, name and look of each run of equally named windows; equal strings look alike."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    eights = _eights(data)
    names = np.zeros(n, np.uint64)
    names[: n - length + 1] = _sliding_min(_gram_hashes(eights, gram)[: n - gram + 1], length - gram + 1)
    valid = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    valid[offsets[long]] += 1
    valid[offsets[long + 1] - length + 1] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (names[1:] != names[:-1])
    fresh[offsets[long]] = True
    first = np.flatnonzero(fresh)
    stops = valid.copy()
    stops[:-1] &= ~valid[1:] | fresh[1:]
    last = np.flatnonzero(stops)
    return first, last + 1 - first, names[first], mix64(eights[first] ^ mix64(eights[last + length - 8] ^ (last - first).astype(np.uint64)))


DEALT_DDL = "part int, key bigint, size bigint, digest binary, text binary"


def fold_copies(batches: Iterator[pa.RecordBatch], shares: int, length: int, remembered: int = REMEMBERED) -> Iterator[pa.RecordBatch]:
    """Deals rows out to shares, equal texts to the same one, each with its text once.

    Rows with a digest and no text have that of another row of the share. Rows with neither
    are copies of a smaller doc_id's text, and rows with a text and no digest have no window;
    both are dealt out by doc_id, as they may be very many.
    """
    least: dict[bytes, int] = {}
    for batch in batches:
        ids, texts = batch.column("key").to_pylist(), batch.column("text")
        spread = (mix64(np.array(ids, np.int64).view(np.uint64)) % np.uint64(shares)).tolist()
        sizes, digests, given = [], [], []
        for k, (i, text) in enumerate(zip(ids, texts)):
            raw = text.as_buffer()
            sizes.append(raw.size)
            digest, give = None, True
            if raw.size >= length:
                digest = hashlib.blake2b(raw, digest_size=16).digest()
                known = least.get(digest)
                give = known is None
                if not give and i > known:
                    digest = None
                else:
                    if len(least) >= remembered:
                        least.clear()
                    least[digest] = i
                    spread[k] = int.from_bytes(digest[:8], "little") % shares
            digests.append(digest)
            given.append(give)
        if not all(given):
            texts = texts.take(pa.array([k if g else None for k, g in enumerate(given)], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(spread, pa.int32()), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), texts],
            names=["part", "key", "size", "digest", "text"],
        )


def _distinct_texts(table: pa.Table) -> tuple[pa.Table, np.ndarray, dict[bytes, int]]:
    """A share's texts that have windows, each once and in an order that does not depend on how rows arrived; their smallest doc_ids; their numbers by digest."""
    digests, given = table.column("digest").to_pylist(), table.column("text").is_valid().to_pylist()
    at: dict[bytes, int] = {}
    least: dict[bytes, int] = {}
    for k, (digest, i) in enumerate(zip(digests, table.column("key").to_pylist())):
        if digest is not None:
            least[digest] = min(i, least.get(digest, i))
            if given[k]:
                at.setdefault(digest, k)
    order = sorted(at)
    return table.select(["text"]).take(pa.array([at[d] for d in order], pa.int64())), np.array([least[d] for d in order], np.int64), {d: k for k, d in enumerate(order)}


def _share_chunks(table: pa.Table):
    """(first row, bytes, offsets) over a share's texts."""
    row = 0
    for batch in table.select(["text"]).to_batches():
        for a, _, data, offsets in byte_chunks(batch, "text", HASHED):
            yield row + a, data, offsets
        row += batch.num_rows


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _slots(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each name, and what of it is kept there: 48 bits."""
    return (names % np.uint64(buckets)).astype(np.int64), names // np.uint64(buckets) & np.uint64((1 << 48) - 1)


class _ShareNames:
    """The distinct names of a share by bucket, in a fixed order."""

    def __init__(self, names: np.ndarray, buckets: int):
        bucket, key = _slots(names, buckets)
        # one sort of both in a word, where they fit; the order among equal ones does not matter
        self.order = np.argsort(bucket.astype(np.uint64) << np.uint64(48) | key) if buckets <= 1 << 16 else np.lexsort((key, bucket))
        b, k = bucket[self.order], key[self.order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.empty(len(b), np.int64)
        self.group[self.order] = np.cumsum(new) - 1
        self.bucket, self.key = b[self.first], k[self.first]
        self.edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))

    def spans(self):
        for a, b in zip(self.edges[:-1], self.edges[1:]):
            yield int(self.bucket[a]), a, b


def _share_runs(table: pa.Table, length: int, gram: int):
    """All runs of a share: row, place in the row's text, windows, name, look."""
    rows, places, counts, names, looks = [], [], [], [], []
    for row, data, offsets in _share_chunks(table):
        first, n, name, look = runs_of(data, offsets, length, gram)
        doc = np.searchsorted(offsets, first, side="right") - 1
        rows.append(doc + row)
        places.append(first - offsets[doc])
        counts.append(n)
        names.append(name)
        looks.append(look)
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return cat(rows, np.int64), cat(places, np.int64), cat(counts, np.int64), cat(names, np.uint64), cat(looks, np.uint64)


REQUEST = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
REQUEST_DDL = "bucket int, part int, blob binary"


def ask_directory(table: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    """A share's distinct names, each with whether several of its own texts have it (the highest bit) and how many strings do (a power of two)."""
    part = table.column("part")[0].as_py()
    table, _, _ = _distinct_texts(table)
    rows, _, _, names, looks = _share_runs(table, length, gram)
    s = _ShareNames(names, buckets)
    note = np.zeros(len(s.first), np.uint8)
    if len(rows):
        d = rows[s.order]
        note[np.minimum.reduceat(d, s.first) != np.maximum.reduceat(d, s.first)] = 128
        often = np.bincount(s.group) > 1
        some = np.flatnonzero(often[s.group])
        some = some[np.lexsort((looks[some], s.group[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (s.group[some[1:]] != s.group[some[:-1]]) | (looks[some[1:]] != looks[some[:-1]])
        note[often] |= np.ceil(np.log2(np.bincount(s.group[some[new]], minlength=len(note))[often])).astype(np.uint8)
    out: list[list] = [[], [], []]
    for bucket, a, b in s.spans():
        out[0].append(bucket)
        out[1].append(part)
        out[2].append(_six(s.key[a:b]) + note[a:b].tobytes())
    return pa.table([pa.array(c, t.type) for c, t in zip(out, REQUEST)], schema=REQUEST)


def answer_names(table: pa.Table, crowded: int) -> pa.Table:
    """For every name asked for: do two texts or more have it, and do very many strings."""
    blobs = [x.as_py() for x in table.column("blob")]
    sizes = [len(b) // 7 for b in blobs]
    keys = np.concatenate([_from_six(b[: 6 * n]) for b, n in zip(blobs, sizes)])
    note = np.concatenate([np.frombuffer(b[6 * n :], np.uint8) for b, n in zip(blobs, sizes)])
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[inverse[note >= 128]] = True
    hot = np.bincount(inverse, weights=np.ldexp(1.0, note & 127)) > crowded
    out = []
    at = 0
    for n in sizes:
        mine = inverse[at : at + n]
        out.append(np.packbits(shared[mine]).tobytes() + np.packbits(hot[mine]).tobytes())
        at += n
    return pa.table([table.column("bucket").combine_chunks(), table.column("part").combine_chunks(), pa.array(out, pa.binary())], schema=REQUEST)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of count[0] numbers, then those of the next."""
    total = int(count.sum())
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)


def send_strings(table: pa.Table, answers: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    """The strings of a share's runs with shared names, equal ones once, with all their places."""
    out: list[list] = [[], [], []]
    if not table.num_rows or not answers.num_rows:
        return pa.table([pa.array(c, t.type) for c, t in zip(out, REQUEST)], schema=REQUEST)
    part = table.column("part")[0].as_py()
    table, key, _ = _distinct_texts(table)
    rows, places, counts, names, _ = _share_runs(table, length, gram)
    s = _ShareNames(names, buckets)
    shared, hot = np.zeros(len(s.first), bool), np.zeros(len(s.first), bool)
    said = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))
    for bucket, a, b in s.spans():
        bits, half = said[bucket], (b - a + 7) // 8
        shared[a:b] = np.unpackbits(np.frombuffer(bits[:half], np.uint8), count=b - a)
        hot[a:b] = np.unpackbits(np.frombuffer(bits[half:], np.uint8), count=b - a)
    shared, hot = shared[s.group], hot[s.group]
    kept: list[tuple] = []
    for row, data, offsets in _share_chunks(table):
        a, b = np.searchsorted(rows, [row, row + len(offsets) - 1])
        mine = a + np.flatnonzero(shared[a:b])
        cold, warm = mine[~hot[mine]], mine[hot[mine]]
        begin = np.concatenate([offsets[rows[cold] - row] + places[cold], _ranges(offsets[rows[warm] - row] + places[warm], counts[warm])])
        windows = np.concatenate([counts[cold], np.ones(int(counts[warm].sum()), np.int64)])
        doc = np.concatenate([rows[cold], np.repeat(rows[warm], counts[warm])])
        if not len(begin):
            continue
        whole = range_hashes(data, begin, begin + windows + length - 1)
        slot = np.concatenate([names[cold], whole[len(cold) :]])
        order = np.lexsort((begin, whole, slot))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (slot[a] != slot[b]) | (whole[a] != whole[b]) | (windows[a] != windows[b])
        head = order[new]
        size = windows[head] + length - 1
        text = data[_ranges(begin[head], size)]
        kept.append((slot[head], size, text, np.diff(np.flatnonzero(new), append=len(order)), key[doc[order]], doc[order], (begin - offsets[doc - row])[order]))
    if kept:
        slot, size, n_occ = (np.concatenate([k[c] for k in kept]) for c in (0, 1, 3))
        text = np.concatenate([k[2] for k in kept])
        occ = [np.concatenate([k[c] for k in kept]) for c in (4, 5, 6)]
        bucket = (slot % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        at_text, at_occ = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(n_occ)])
        edges = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
        pack = zstandard.ZstdCompressor(level=1)
        for a, b in zip(edges[:-1], edges[1:]):
            x = by[a:b]
            o = _ranges(at_occ[x], n_occ[x])
            pieces = [
                np.array([len(x), len(o)], np.int64),
                (slot[x] // np.uint64(buckets)).astype(np.uint64),
                size[x].astype(np.uint32),
                n_occ[x].astype(np.uint32),
                occ[0][o].astype(np.int64),
                occ[1][o].astype(np.uint32),
                occ[2][o].astype(np.uint32),
                text[_ranges(at_text[x], size[x])],
            ]
            out[0].append(int(bucket[x[0]]))
            out[1].append(part)
            out[2].append(pack.compress(b"".join(p.tobytes() for p in pieces)))
    return pa.table([pa.array(c, t.type) for c, t in zip(out, REQUEST)], schema=REQUEST)


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2)
    at, got = 16, []
    for kind, count in ((np.uint64, n), (np.uint32, n), (np.uint32, n), (np.int64, m), (np.uint32, m), (np.uint32, m)):
        got.append(np.frombuffer(raw, kind, count, at))
        at += got[-1].nbytes
    return [*got, np.frombuffer(raw, np.uint8, -1, at)]


def bounded_ranks(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols or more, and the first `STEP` symbols of each in 9 bits; symbols: 0 to 256.

    The depth grows as many times in a round as ranks go into a word: three times for blocks of up to two million.
    """
    n = len(symbols)
    pad = np.concatenate([symbols.astype(np.uint64), np.zeros(STEP, np.uint64)])
    start = np.zeros(n, np.uint64)
    for k in range(STEP):
        start = start << np.uint64(9) | pad[k : k + n]
    bits = (n + 1).bit_length()
    times = 64 // bits
    key, have = start, STEP
    while True:
        order = np.argsort(key)  # ties are beyond the depth: any order will do
        if have >= depth:
            return order, start
        ordered = key[order]
        new = np.zeros(n, bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint32)
        key = rank.copy()
        rank += np.uint64(1)
        for k in range(1, times):
            key <<= np.uint64(bits)
            key[: max(0, n - k * have)] |= rank[k * have :]
        have *= times


def expand_intervals(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place of it the interval of suffixes with the same first `length` symbols.

    Breadth first by the length of the common prefix: the boundaries between intervals of
    l + STEP symbols are the backward extensions of those of l symbols. Extending to the left
    by the STEP symbols before the transform's place k takes it to the order's place back[k];
    two neighbours with the same first STEP symbols part at l + STEP if what follows these parts at l.
    """
    n = len(symbols)
    order, start = bounded_ranks(symbols, length)
    place = np.empty(n + STEP, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    place[n:] = 0
    following = place[order + STEP]  # the place of the suffix STEP symbols shorter: inverse of the backward step
    level = (length - 1) % STEP + 1
    first = start[order]
    steps, parted = np.ones(n, bool), np.ones(n, bool)
    steps[1:] = first[1:] != first[:-1]
    first >>= np.uint64(9 * (STEP - level))
    parted[1:] = first[1:] != first[:-1]
    together = np.flatnonzero(~steps)
    right, left = following[together], following[together - 1]
    interval = np.empty(n, np.int32)
    while level < length:
        np.cumsum(parted, dtype=np.int32, out=interval)
        splits = interval[right] != interval[left]
        parted = steps
        parted[together[splits]] = True
        stay = ~splits
        together, right, left = together[stay], right[stay], left[stay]
        level += STEP
    return order, np.cumsum(parted, dtype=np.int32) - 1


def repeated_windows(text: np.ndarray, size: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For every window of some strings, one after the other: the smallest document that holds it."""
    n = len(size)
    symbols = np.zeros(len(text) + n, np.uint16)
    begin = np.concatenate([[0], np.cumsum(size[:-1] + 1)]).astype(np.int64)
    symbols[_ranges(begin, size)] = text.astype(np.uint16) + 1
    order, interval = expand_intervals(symbols, length)
    windows = _ranges(begin, size - length + 1)
    owner = np.full(len(symbols), NO_DOC, np.int64)
    owner[windows] = np.repeat(least, size - length + 1)
    head = np.flatnonzero(np.diff(interval, prepend=-1))
    smallest = np.minimum.reduceat(owner[order], head)
    of = np.empty(len(symbols), np.int64)
    of[order] = interval
    return smallest[of[windows]]


REMOVE = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def search_strings(table: pa.Table, length: int, block: int = BLOCK) -> pa.Table:
    """The places (row, from, to) that each share has to remove."""
    part_of = table.column("part").to_pylist()
    got = [_unpack(x.as_py()) for x in table.column("blob")]
    sub, size, n_occ = (np.concatenate([g[c] for g in got]) for c in range(3))
    size, n_occ = size.astype(np.int64), n_occ.astype(np.int64)
    doc, row, place = (np.concatenate([g[c] for g in got]) for c in (3, 4, 5))
    text = np.concatenate([g[6] for g in got])
    source = np.repeat(np.arange(len(got)), [len(g[3]) for g in got])
    got.clear()
    at_text, at_occ = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(n_occ)])
    least = np.minimum.reduceat(doc, at_occ[:-1])
    whole = range_hashes_by_blocks(text, at_text)
    order = np.lexsort((size, whole, sub))
    new = np.ones(len(order), bool)
    x, y = order[1:], order[:-1]
    new[1:] = (sub[x] != sub[y]) | (whole[x] != whole[y]) | (size[x] != size[y])
    head = np.flatnonzero(new)
    distinct, which = order[head], np.cumsum(new) - 1
    smallest, windows = np.minimum.reduceat(least[order], head), size[distinct] - length + 1
    at_window = np.concatenate([[0], np.cumsum(windows)])
    owners = np.repeat(smallest, windows)
    # a window has one name, so strings without others of their name share none; the rest goes by blocks of whole names
    same = sub[distinct[1:]] == sub[distinct[:-1]]
    some = np.flatnonzero(np.append(same, False) | np.append(False, same))
    total = np.cumsum(size[distinct[some]])
    changes = np.flatnonzero(np.append(np.diff(sub[distinct[some]]) != 0, True)) + 1
    a = 0
    while a < len(some):
        b = int(changes[np.searchsorted(changes, max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + block))))])
        k = some[a:b]
        d = distinct[k]
        owners[_ranges(at_window[k], windows[k])] = repeated_windows(text[_ranges(at_text[d], size[d])], size[d], smallest[k], length)
        a = b
    o = _ranges(at_occ[order], n_occ[order])
    k = np.repeat(which, n_occ[order])
    recs, sources = [np.zeros((0, 3), np.uint32)], [np.zeros(0, np.int64)]
    reach, hi = np.cumsum(windows[k]), 0
    while hi < len(o):
        lo, hi = hi, max(hi + 1, int(np.searchsorted(reach, (reach[hi - 1] if hi else 0) + COMPARED, side="right")))
        some, ks = o[lo:hi], k[lo:hi]
        n = windows[ks]
        gone = owners[_ranges(at_window[ks], n)] < np.repeat(doc[some], n)
        step = np.diff(gone.astype(np.int8), prepend=0, append=0)
        edge = np.concatenate([[0], np.cumsum(n)])
        inner = edge[1:-1]
        both = inner[gone[inner] & gone[inner - 1]]  # a string ends and the next begins
        starts = np.sort(np.concatenate([np.flatnonzero(step == 1), both]))
        stops = np.sort(np.concatenate([np.flatnonzero(step == -1), both]))
        which_occ = np.searchsorted(edge, starts, side="right") - 1
        p = place[some[which_occ]].astype(np.int64)
        recs.append(np.stack([row[some[which_occ]].astype(np.int64), p + starts - edge[which_occ], p + stops - edge[which_occ] + length - 1], axis=1).astype(np.uint32))
        sources.append(source[some[which_occ]])
    rec, src = np.concatenate(recs), np.concatenate(sources)
    by = np.argsort(src, kind="stable")
    rec, src = rec[by], src[by]
    cuts = np.flatnonzero(np.diff(src, prepend=-1, append=-1)) if len(src) else []
    pack = zstandard.ZstdCompressor(level=1)
    blobs = [(part_of[src[c]], pack.compress(rec[c:d].tobytes())) for c, d in zip(cuts[:-1], cuts[1:])]
    return pa.table([pa.array([p for p, _ in blobs], pa.int32()), pa.array([r for _, r in blobs], pa.binary())], schema=REMOVE)


def range_hashes_by_blocks(text: np.ndarray, edges: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """range_hashes of consecutive strings, some at a time."""
    out, a = np.empty(len(edges) - 1, np.uint64), 0
    while a < len(out):
        b = min(len(out), max(a + 1, int(np.searchsorted(edges, edges[a] + block))))
        out[a:b] = range_hashes(text[edges[a] : edges[b]], edges[a:b] - edges[a], edges[a + 1 : b + 1] - edges[a])
        a = b
    return out


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
KEPT_DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or touching [from, to)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.ones(len(spans), bool)
    head[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(head)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], axis=1)


def cut_out(table: pa.Table, removals: pa.Table, length: int, with_text: bool) -> pa.Table:
    """The share's documents without what they have to remove."""
    out: list[list] = [[] for _ in KEPT]
    if table.num_rows:
        texts, least, number = _distinct_texts(table)
        z = zstandard.ZstdDecompressor()
        recs = [np.frombuffer(z.decompress(x.as_py()), np.uint32).reshape(-1, 3) for x in removals.column("blob")] if removals.num_rows else []
        rec = np.concatenate(recs) if recs else np.zeros((0, 3), np.uint32)
        rec = rec.astype(np.int64)
        spans = merged((rec[:, :1] << 32) + rec[:, 1:]) if len(rec) else rec[:, 1:]  # texts lie far apart
        edges = np.searchsorted(spans[:, 0] >> 32, np.arange(len(least) + 1)).tolist()
        spans = (spans & (1 << 32) - 1).tolist()

        def without(raw: pa.Buffer, spans: list) -> tuple:
            kept, at = [], 0
            for a, b in spans:
                kept.append(memoryview(raw)[at:a])
                at = b
            kept.append(memoryview(raw)[at:])
            left = b"".join(kept)
            return raw.size - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if with_text else None

        results = []
        for k, text in enumerate(texts.column("text")):
            results.append(without(text.as_buffer(), spans[edges[k] : edges[k + 1]]))
        nothing = hashlib.sha256(b"").hexdigest(), b"" if with_text else None
        for i, size, digest, text in zip(*(table.column(c).to_pylist() for c in ("key", "size", "digest")), table.column("text")):
            if digest is None and text.is_valid:
                result = without(text.as_buffer(), [])  # no window
            elif digest is None or i > least[number[digest]]:
                result = (size, 1, *nothing)  # a copy
            else:
                result = results[number[digest]]
            for c, v in zip(out, (None if i == NO_DOC else i, size, *result)):
                c.append(v)
    return pa.table([pa.array(c, t.type) for c, t in zip(out, KEPT)], schema=KEPT)


def drop_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED, shares: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; kept as well if asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    n = shares or max(parts(spark, 2), -(-input_bytes(docs) // SHARE_BYTES))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NO_DOC)))
    dealt = docs.select(key.alias("key"), as_bytes().alias("text")).mapInArrow(lambda batches: fold_copies(batches, n, length), DEALT_DDL)
    asked = dealt.groupBy("part").applyInArrow(lambda t: ask_directory(t, n, length, gram), REQUEST_DDL)
    answers = asked.groupBy("bucket").applyInArrow(lambda t: answer_names(t, crowded), REQUEST_DDL)
    strings = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda t, a: send_strings(t, a, n, length, gram), REQUEST_DDL)
    places = strings.groupBy("bucket").applyInArrow(lambda t: search_strings(t, length), "part int, blob binary")
    kept = dealt.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(lambda t, r: cut_out(t, r, length, with_text), KEPT_DDL)
    return kept if with_text else kept.drop("kept")


#: Every window of every document, in hexadecimal and named by its MD5: feasible on small tables only.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(greatest(0, length(h) // 2 - {LENGTH - 1}))) AS i, unnest(list_transform(range(greatest(0, length(h) // 2 - {LENGTH - 1})), lambda i: md5_number(substr(h, 2 * i + 1, {2 * LENGTH})))) AS s FROM d),
p AS (SELECT doc_id, unnest(range(length(h) // 2)) AS i, unnest(list_transform(range(length(h) // 2), lambda i: substr(h, 2 * i + 1, 2))) AS b FROM d),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.first < w.doc_id),
c AS (SELECT p.doc_id, p.i, p.b, coalesce(max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) > p.i - {LENGTH}, false) AS gone
  FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c)
SELECT d.doc_id, count(g.i)::BIGINT AS n_bytes, (count(*) FILTER (g.gone))::BIGINT AS n_removed, (count(*) FILTER (g.opens))::BIGINT AS n_spans,
  sha256(unhex(coalesce(string_agg(g.b, '' ORDER BY g.i) FILTER (NOT g.gone), ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""
