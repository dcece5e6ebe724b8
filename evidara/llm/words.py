"""Words of letters and digits in UTF-8 bytes, and their places in a vocabulary.

A word is a maximal run of bytes 0-9, A-Z, a-z and of bytes from 0x80 on, which are those of
characters outside ASCII. Capitals are lower-cased by the caller's table. Texts longer than a
chunk are cut between words, so memory depends on the chunk and on the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from evidara.llm.common import CHUNK_BYTES, LOWER, byte_chunks, range_hashes

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word of concatenated documents."""
    inside = WORD[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]
    stops[firsts[1:] - 1] = inside[firsts[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def pieces(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about `limit` bytes, cut where no word stands."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            free = np.flatnonzero(~WORD[data[end : end + limit]])
            if len(free):
                end += int(free[0])
                break
            end += limit
        end = min(end, len(data))
        yield data[at:end]
        at = end


def word_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, lower-cased bytes, offsets) as `byte_chunks` gives them; a text that is longer than a chunk comes in pieces, each with its row."""
    for first, end, data, offsets in byte_chunks(batch, column, limit):
        if end - first == 1 and len(data) > limit:
            for piece in pieces(data, limit):
                yield first, end, LOWER[piece], np.array([0, len(piece)], np.int64)
        else:
            yield first, end, LOWER[data], offsets


class Vocabulary:
    """Numbers of words, by hash and then by the bytes themselves."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([0, *map(len, words)]).astype(np.int64)
        hashes = range_hashes(data, ends[:-1], ends[1:])
        self.number = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.number]
        self.data, self.start, self.size = data, ends[:-1], np.diff(ends)
        self.words = words

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each data[start:end] the number of the equal word, or -1."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.words) or not len(start):
            return out
        hashes = range_hashes(data, start, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        number = self.number[at[hit]]
        hit, number = hit[(same := self.size[number] == end[hit] - start[hit])], number[same]
        if len(hit):
            size = self.size[number]
            begins = np.cumsum(size) - size
            within = np.arange(begins[-1] + size[-1]) - np.repeat(begins, size)
            equal = data[np.repeat(start[hit], size) + within] == self.data[np.repeat(self.start[number], size) + within]
            good = np.logical_and.reduceat(equal, begins)
            out[hit[good]] = number[good]
        return out
