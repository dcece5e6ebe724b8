"""Token counts by a linear longest-match automaton (operator 2).

The vocabulary is a trie of word-initial pieces and of pieces that go on in a word. Every
trie node has a failure link - where matching goes on once the longest piece of what was
read so far has been taken off - and the number of pieces that this takes off. So greedy
longest-match counts come from one pass over a word's characters, without building pieces.

A word is a maximal run of characters that are not white space (as str.split sees it). A
word that cannot be split whole counts as one unknown token. Null or empty text: zeros.
The vocabulary is a public one whose pieces mark word starts; its path is a parameter.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import Batches, emit, small_batches

MARK = "▁"
CACHE_ENTRIES = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """(word-initial pieces, pieces inside words) of a piece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    initial = [p[1:] for p in whole if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    inner = [p for p in whole if MARK not in p]
    return initial, inner


class LongestMatch:
    """Node 0 is the start of a word, node 1 the start of what follows its first piece."""

    def __init__(self, initial: list[str], inner: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        self.fail = [-1, -1]
        self.pops = [0, 0]
        piece = [False, False]
        for root, words in ((0, initial), (1, inner)):
            for w in words:
                node = root
                for c in w:
                    to = self.next[node].get(c)
                    if to is None:
                        to = self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.fail.append(-1)
                        self.pops.append(0)
                        piece.append(False)
                    node = to
                piece[node] = True
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, to in self.next[node].items():
                queue.append(to)
                if piece[to]:
                    self.fail[to], self.pops[to] = 1, 1  # all of it is one piece
                    continue
                # pieces that the parent takes off, then those that let c go on
                at, n = self.fail[node], self.pops[node]
                while at >= 0 and c not in self.next[at]:
                    at, n = self.fail[at], n + self.pops[at]
                if at >= 0:
                    self.fail[to], self.pops[to] = self.next[at][c], n
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it cannot be split."""
        nexts, fail, pops = self.next, self.fail, self.pops
        node, n = 0, 0
        for c in word:
            while (to := nexts[node].get(c)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = to
        while node > 1:
            n += pops[node]
            node = fail[node]
        return n if node == 1 else 0

    def tally(self, text: str) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text."""
        cache, count = self.cache, self.count
        words = text.split()
        tokens = unknown = 0
        for w in words:
            n = cache.get(w)
            if n is None:
                n = count(w)
                if len(w) <= 32:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[w] = n
            if n:
                tokens += n
            else:
                unknown += 1
        return len(words), tokens + unknown, unknown


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*read_pieces(path))


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every whole text: a map over the scan."""
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches: Batches) -> Batches:
        model = automaton(path)
        for batch in batches:
            rows = [model.tally(t.as_py() or "") for t in batch.column(1)]
            yield emit(schema, [batch.column(0), *([r[k] for r in rows] for k in range(3))])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
