"""Arrow text columns as byte arrays, and hashes of words and spans without per-row Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 512 << 10
NO_ID = 1 << 62  # above every doc_id
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# the lowest 0 to 8 bytes of a value
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the ``n + 1`` row borders; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_string()), "")
    else:
        column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[borders[0]:borders[-1]]
    return raw, borders - borders[0]


def place(doc_id: Column, text: Column) -> Column:
    """The order of documents: ``doc_id``, and for null ids a number above them that tells the text."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2).bitwiseOR(F.lit(NO_ID))
    return F.coalesce(doc_id.cast("long"), hashed)


def text_slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of a batch of about ``size`` bytes of column ``text``: ``(rows, bytes, borders)``."""
    raw, borders = text_bytes(batch.column("text"))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = int(np.searchsorted(borders, borders[at] + size, "right")) - 1
        to = min(rows, max(at + 1, to))
        yield batch.slice(at, to - at), raw[borders[at]:borders[to]], borders[at:to + 1] - borders[at]
        at = to


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection, so distinct values stay distinct)."""
    v = values.astype(np.uint64)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < size:
        length = max(size, 1 << 16)
        forward, back = np.full(length, base, np.uint64), np.full(length, pow(base, -1, 1 << 64), np.uint64)
        forward[0] = back[0] = 1
        kept = (np.cumprod(forward, dtype=np.uint64), np.cumprod(back, dtype=np.uint64))
        if length <= 8 << 20:
            _POWERS[base] = kept
    return kept


class SpanHashes:
    """Polynomial hashes, modulo 2^64, of any span of a value sequence."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        forward, self._back = _powers(base, len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64, copy=False) * forward[:len(values)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * self._back[starts]


class Words:
    """Words (runs without ASCII white space) of a byte slice: borders, row of each word, hashes."""

    def __init__(self, raw: np.ndarray, borders: np.ndarray, is_word: np.ndarray | None = None):
        inside = ~_SPACE[raw] if is_word is None else is_word[raw]
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = inside
        firsts = borders[:-1][borders[:-1] < len(raw)]
        opened = before[:-1].copy()
        opened[firsts] = False
        self.starts = np.flatnonzero(inside & ~opened)
        closed = np.zeros(len(raw), bool)
        closed[:-1] = inside[1:]
        lasts = borders[1:-1]
        lasts = lasts[lasts > 0] - 1
        closed[lasts] = False
        self.ends = np.flatnonzero(inside & ~closed) + 1
        self.first = np.searchsorted(self.starts, borders)  # first word of each row, and the total
        self.row = np.repeat(np.arange(len(borders) - 1), np.diff(self.first))
        self.raw = raw

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        """One 64-bit value a word: eight bytes at a time are mixed with their place in the word and added up.

        No sum of powers, for which long words of two letters in a certain order would be equal.
        """
        lengths = self.ends - self.starts
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.raw) + 1,), "<u8", padded, strides=(1,))
        total = lengths.astype(np.uint64) * np.uint64(base)
        active, part = np.arange(len(lengths)), 0
        while len(active):
            left = np.minimum(lengths[active] - 8 * part, 8)
            chunk = eight[self.starts[active] + 8 * part] & _BYTES[left]
            total[active] += mix(chunk ^ np.uint64((base * (2 * part + 1)) & (1 << 64) - 1))
            part += 1
            active = active[lengths[active] > 8 * part]
        return mix(total)

    def windows(self, size: int) -> np.ndarray:
        """Positions of the words that start a window of ``size`` words inside one row."""
        count = len(self.row)
        if count < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[size - 1:] == self.row[:count - size + 1])


def window_hashes(word_hashes: np.ndarray, at: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    return mix(SpanHashes(word_hashes, base).of(at, at + size))
