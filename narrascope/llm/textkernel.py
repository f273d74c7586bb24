"""Vectorised word splitting and hashing over whole Arrow text columns.

Texts stay UTF-8 bytes: both word rules of this package separate words by ASCII bytes only, so
every word boundary is found with one table lookup per byte and every word is hashed with a
prefix sum of a polynomial modulo 2**64, without a Python object per word. Such polynomials are
weak on long words of a regular build, so words of more than `_PLAIN` bytes get a BLAKE2 digest
instead. Hashes are 64 bits wide, equal in every process, and lower-case A-Z on the fly; where two
words must never be taken for one another, callers compare bytes on a hit.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 17  # bytes hashed at a time, small enough for the CPU's caches
_PLAIN = 64  # bytes of the longest word with a polynomial hash

_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_EXACT = BYTE_VALUE.copy()  # for hashes that tell cases apart
BYTE_VALUE[ord("A") : ord("Z") + 1] = BYTE_VALUE[ord("a") : ord("z") + 1]

#: In-word bytes of the rule `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: In-word bytes of the rule `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words of some texts: byte ranges `start`..`end`, and `first`, the number of the first word of each text (one more entry than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data, self.offsets = data, offsets
        if len(data):
            inner = inside[data]
            begins = inner.copy()
            begins[1:] &= ~inner[:-1]
            edge = offsets[:-1][np.diff(offsets) > 0]
            begins[edge] = inner[edge]
            ends = inner.copy()
            ends[:-1] &= ~inner[1:]
            ends[edge[1:] - 1] = inner[edge[1:] - 1]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
        out, done = np.empty(len(self), np.uint64), 0
        while done < len(self):
            base = self.start[done]
            stop = max(done + 1, int(np.searchsorted(self.end, base + _BLOCK, "right")))
            n = int(self.end[stop - 1] - base)
            power, inverse = powers(n)
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values[self.data[base : base + n]] * power[:n], out=sums[1:])
            s, e = self.start[done:stop] - base, self.end[done:stop] - base
            out[done:stop] = (sums[e] - sums[s]) * inverse[s]
            done = stop
        out = mix(out)
        for i in np.flatnonzero(self.end - self.start > _PLAIN).tolist():
            word = self.data[self.start[i] : self.end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word if values is BYTE_EXACT else lower_ascii(word), digest_size=8).digest(), "little")
        return out

    def lowered(self, a: int, b: int) -> list[bytes]:
        """The words a..b-1 themselves, A-Z lower-cased."""
        if a >= b:
            return []
        base = int(self.start[a])
        raw = lower_ascii(self.data[base : self.end[b - 1]].tobytes())
        return [raw[s - base : e - base] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, _BLOCK)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, U(base))
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def eights(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place, as numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[start] & _FIRST[np.clip(size, 0, 8)]


_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def marks(words: Words) -> np.ndarray:
    """Length and first eight bytes of each word, in 64 bits: beside the hash, a second key of a table."""
    size = words.end - words.start
    return eights(words.data, words.start, size) ^ (size.astype(np.uint64) * U(_BASE))


class WordTable:
    """A hash table from words to numbers in numpy arrays, all lookups of a batch at once: 24 bytes a slot."""

    def __init__(self, bits: int = 16):
        self.size = 0
        self.keys, self.seconds, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of words, by hash and mark; -1 for unknown ones."""
        mask = U(len(self.keys) - 1)
        h = np.maximum(h, U(1))  # 0 marks a free slot
        out, slot, live = np.full(len(h), -1, np.int32), (h & mask).astype(np.int64), None
        hs, ss = h, second
        while True:
            k = self.keys[slot]
            hit = (k == hs) & (self.seconds[slot] == ss)
            if live is None:
                out[hit] = self.numbers[slot[hit]]
                live = np.flatnonzero(~hit & (k != 0))
                slot = slot[live]
            else:
                out[live[hit]] = self.numbers[slot[hit]]
                going = ~hit & (k != 0)
                live, slot = live[going], slot[going]
            if not len(live):
                return out
            slot = (slot + 1) & int(mask)
            hs, ss = h[live], second[live]

    def add(self, h: np.ndarray, second: np.ndarray, numbers: np.ndarray) -> None:
        """Add distinct words that are not in the table."""
        if 2 * (self.size + len(h)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            old = self.keys[used], self.seconds[used], self.numbers[used]
            size = 1 << int(np.ceil(np.log2(4 * (self.size + len(h)))))
            self.keys, self.seconds, self.numbers = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(*old)
        self.size += len(h)
        self._place(h, second, numbers)

    def _place(self, h: np.ndarray, second: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        h = np.maximum(h, U(1))
        slot = (h & U(mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.numbers[slot[free]] = numbers[free]  # of several for one slot the last one stays
            won = free[self.numbers[slot[free]] == numbers[free]]
            self.keys[slot[won]], self.seconds[slot[won]] = h[won], second[won]
            going = np.ones(len(h), bool)
            going[won] = False
            h, second, numbers, slot = h[going], second[going], numbers[going], (slot[going] + 1) & mask


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes (also over text borders: the caller leaves those out)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= U(0x2545F4914F6CDD1D)
        out += h[i : i + n]
    return mix(out)


def hash_word_list(words: list[bytes]) -> np.ndarray:
    """The hashes that `Words.hashes` gives for these words."""
    ends = np.cumsum([0, *map(len, words)])
    w = Words.__new__(Words)
    w.data, w.start, w.end = np.frombuffer(b"".join(words), np.uint8), ends[:-1], ends[1:]
    return w.hashes()


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21):
    """Cut a batch into runs of rows with at most `limit` bytes of text each, or one row."""
    column = batch.column(batch.schema.get_field_index(column))
    _, at = text_bytes(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which Spark uses again, gives its free memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped
