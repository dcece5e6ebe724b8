"""BPE encoding and decoding by forced-boundary splitting (operator 8).

A byte pair that occurs inside no vocabulary token can never be merged across, so it marks
a certain cut: the fragments between such cuts are encoded independently and the ids are
concatenated. The merges of one fragment never see another one, hence the result equals
that of the whole word.

Nulls and empty texts give no ids; very long texts and words are encoded whole, in near linear
time; repeated rows give repeated results, equal texts equal ones; an empty table gives no rows.
Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from evidara.llm.common import Batches, emit, small_batches

#: From here on every character is the library's to judge: rare, private or unassigned ones to U+10FFFF.
BEYOND = 0x32400

#: Words that each of a worker's two generations of remembered words holds.
CACHE_ENTRIES = 250_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter for each byte, as byte-level vocabularies spell them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class ForcedBoundaryBpe:
    """A BPE vocabulary with word ends, encoded piece by piece between certain cuts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        letters = byte_letters()
        self.inner = [self.vocab.get(x, -1) for x in letters]
        self.last = [self.vocab.get(x + self.suffix, -1) for x in letters]
        code = {x: b for b, x in enumerate(letters)}
        joined = bytearray(256 * 256)
        for token in self.vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            raw = [code[x] for x in body]
            for x, y in zip(raw, raw[1:]):
                joined[x << 8 | y] = 1
        #: joined[x << 8 | y]: the pair x, y occurs inside some token; 0 marks a forced boundary.
        self.joined = bytes(joined)
        self.library = Tokenizer.from_file(path)
        self.library_split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.unsure = self.unsure_characters()
        #: Words met lately and, from the time before these filled up, older ones.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cuts(self, word: bytes) -> list[int]:
        joined = self.joined
        return [i + 1 for i in range(len(word) - 1) if not joined[word[i] << 8 | word[i + 1]]]

    def fragment(self, raw: bytes, ends: bool) -> bytes:
        """Ids of one fragment as little-endian 32-bit integers; ends: it ends its word."""
        ids = [self.inner[b] for b in raw]
        if ends:
            ids[-1] = self.last[raw[-1]]
        ids = [i for i in ids if i >= 0]
        if len(ids) > 64:
            return self._long(ids)
        get, merged, none = self.ranks.get, self.merged, len(self.merged)
        pairs = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) < none:
            k = pairs.index(best)
            ids[k] = merged[best]
            del ids[k + 1], pairs[k]
            if k:
                pairs[k - 1] = get(ids[k - 1] << 32 | ids[k], none)
            if k < len(pairs):
                pairs[k] = get(ids[k] << 32 | ids[k + 1], none)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _long(self, ids: list[int]) -> bytes:
        """The same merges by a heap and links, so that very long words stay near linear."""
        import heapq

        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if (p := pair[0] << 32 | pair[1]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = self.merged[ranks[a << 32 | b]], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := ranks.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        left, k = [], 0
        while k >= 0:
            left.append(ids[k])
            k = after[k]
        return struct.pack(f"<{len(left)}I", *left)

    def word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            raw = word.encode()
            at, out = 0, []
            for end in [*self.cuts(raw), len(raw)]:
                out.append(self.fragment(raw[at:end], end == len(raw)))
                at = end
            ids = b"".join(out)
        if len(word) <= 32:
            if len(self.words) >= CACHE_ENTRIES:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def unsure_characters(self) -> frozenset[str]:
        """Characters below BEYOND that the Unicode tables here and those of the library may treat differently, unassigned ones included."""
        every = [chr(c) for c in range(128, BEYOND) if not 0xD800 <= c < 0xE000]
        whole = "\0".join(every)
        theirs = self.library.normalizer.normalize_str(whole).split("\0")
        odd = {c for c, t in zip(every, theirs) if self.normal(c) != t} if len(theirs) == len(every) else set(every)
        odd |= {c for c in every if unicodedata.category(c) == "Cn"}
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            split = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
            odd |= {t for t, _ in split.pre_tokenize_str(whole)} ^ set(regex.findall(kind, whole))
        return frozenset(odd - {"\0"})

    def words_in(self, text: str) -> list[str]:
        """The words of a text; texts with unsure characters are normalised and split by the library itself."""
        if not (text.isascii() or (max(text) < chr(BEYOND) and self.unsure.isdisjoint(text))):
            plain = self.library.normalizer.normalize_str(text)
            return [w for w, _ in self.library_split.pre_tokenize_str(plain)]
        return self.pattern.findall(self.normal(text))

    @staticmethod
    def normal(text: str) -> str:
        """Canonical composition, then lower case letter by letter (no final-sigma rule)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _ordinary(self, text: str, out: list[bytes]) -> None:
        get, word = self.words.get, self.word
        for w in self.words_in(text):
            out.append(get(w) or word(w))

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        if not self.special_split or "<|" not in text:
            self._ordinary(text, out)
            return b"".join(out)
        at = 0
        for m in self.special_split.finditer(text):
            self._ordinary(text[at : m.start()], out)
            out.append(struct.pack("<I", self.specials[m[0]]))
            at = m.end()
        self._ordinary(text[at:], out)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The vocabulary has no decoder, so tokens are joined by spaces, word ends included."""
        texts = self.texts
        return " ".join([texts[i] for (i,) in struct.iter_unpack("<I", packed)])


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; ids as well if asked for.

    A map over the scan: no shuffle, and nothing depends on the size of a partition.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Batches) -> Batches:
        bpe = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            rows: list[list] = [[] for _ in range(3 + with_ids)]
            for k in range(len(texts)):
                packed = bpe.encode(texts[k].as_py())
                rows[0].append(len(packed) // 4)
                rows[1].append(hashlib.sha256(packed).hexdigest())
                rows[2].append(hashlib.sha256(bpe.decode(packed).encode()).hexdigest())
                if with_ids:
                    rows[3].append([i for (i,) in struct.iter_unpack("<I", packed)])
            yield emit(arrow, [batch.column(0), *rows])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
