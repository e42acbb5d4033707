"""Vectorised text scanning shared by the word-based operators.

A batch of texts is one UTF-8 byte buffer plus offsets. Words, their hashes
and n-grams of words come from array passes over that buffer, so Python runs
per batch and never per word. Words never cross documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are scanned in slices of about this many bytes (one text is never split).
SLICE_BYTES = 1 << 20

BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = np.uint64(pow(BASE, -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word: digits, letters a-z after lowering and all of UTF-8 beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

_powers = {"up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between batches."""
    if len(_powers["up"]) < n:
        size = 1 << max(16, int(n).bit_length())
        for key, base in (("up", np.uint64(BASE)), ("down", _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of ranges one after the other."""
    at = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - at, sizes)


class Prefix:
    """Polynomial hashes of byte ranges of one buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * self.up[: len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary array; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows whose texts have about ``most`` bytes together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def table_slices(table: pa.Table | pa.RecordBatch, text_column: str, most: int = SLICE_BYTES):
    """Row ranges of a batch with their byte buffers: (lo, hi, data, offsets)."""
    data, offsets = text_buffer(table.column(text_column))
    for lo, hi in slices(offsets, most):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


@dataclass
class Words:
    """Words of a slice: byte ranges, 64-bit hashes, and where each document's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n_docs + 1 positions in the arrays above

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes that do not cross ``offsets``."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(inside))]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def scan_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Lower-cased words of every document of a slice."""
    low = LOWER[data]
    starts, ends = runs(WORD_BYTE[low], offsets)
    hashes = Prefix(low).ranges(starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and the position of each first word; none crosses documents."""
    total = len(words.hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(total - n + 1, np.uint64)
    for j in range(n):
        out += words.hashes[j : total - n + 1 + j] * np.uint64(pow(BASE, j + 1, 1 << 64))
    last = np.repeat(words.first[1:], words.counts)[: total - n + 1]
    at = np.flatnonzero(np.arange(total - n + 1) + n <= last)
    return mix(out[at]), at


def segments(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets into ``at`` (sorted word positions) of every document."""
    return np.searchsorted(at, first)
