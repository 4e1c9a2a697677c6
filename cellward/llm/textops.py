"""Vectorised text primitives that the operators share inside their tasks.

All of them work on a small slice of an Arrow batch at a time (SLICE_BYTES of text), so a task's
memory is bounded by the slice and by the longest single text, never by the partition.
"""

from __future__ import annotations

import ctypes
import gc
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mix(x):
    """Finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


@lru_cache(maxsize=2)
def _powers(size: int):
    up, down = np.full(size, U64(_P)), np.full(size, U64(_P_INV))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(n: int):
    size = 1 << 20
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


class Rolling:
    """Hashes of any substrings of a byte buffer, from one prefix sum modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * up[:-1], dtype=U64, out=self.sums[1:])

    def of(self, start, end):
        length = (end - start).astype(U64)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + length * U64(0xA24BAED4963EE407))

    def grams(self, k: int):
        """Hash of every k-byte substring."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def release() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, and others start beside it."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


_HELD: dict[tuple, object] = {}


def held(key: tuple, build):
    """What a worker keeps from task to task, such as models or a table of pieces: one thing only, so that no stage pays for the last one's."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        release()
        _HELD[key] = build()
    return _HELD[key]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text: (batch, list of bytes; null is empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                piece = batch.slice(a, b - a)
                texts = pc.fill_null(col.slice(a, b - a).cast(pa.large_binary()), b"").to_pylist()
                yield piece, texts
    release()


def joined(texts: list[bytes]):
    """One buffer with a line feed after each text, and each text's start and end in it."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size + 1) - 1
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), end - size, end


def _word_lut():
    lut = np.zeros(256, np.uint8)
    lut[0x30:0x3A] = np.arange(0x30, 0x3A)
    lut[0x41:0x5B] = np.arange(0x61, 0x7B)
    lut[0x61:0x7B] = np.arange(0x61, 0x7B)
    lut[0x80:] = np.arange(0x80, 0x100)
    return lut


#: A-Z lower-cased; 0 for what is between words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORDS = _word_lut()


def _space_lut():
    lut = np.arange(256).astype(np.uint8)
    lut[0] = 0x20  # free, as 0x20 itself is a separator
    lut[[0x20, *range(0x09, 0x0E)]] = 0
    return lut


#: 0 for what is between words ``[^\x20\x09-\x0D]+``.
SPACES = _space_lut()


class Words:
    """The words of some texts: start and end in the buffer, number of the text, 64-bit hash."""

    def __init__(self, texts: list[bytes], lut: np.ndarray = WORDS):
        raw, self.text_start, self.text_end = joined(texts)
        self.buf = lut[raw]
        edge = np.diff((self.buf != 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = Rolling(self.buf).of(self.start, self.end)
        first = np.searchsorted(self.start, self.text_start)
        self.first = np.append(first, len(self.start))  # of each text, its first word
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = np.zeros(m, U64)
    for i in range(n):
        out = out * U64(_P) + hashes[i : i + m]
    return mix(out)


def in_one(text: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n consecutive words lie in one text."""
    m = len(text) - n + 1
    return text[:m] == text[n - 1 :] if m > 0 else np.empty(0, bool)


def per_text(text: np.ndarray, n_texts: int, flags: np.ndarray) -> np.ndarray:
    """How many of the flagged items each text has."""
    return np.bincount(text[flags], minlength=n_texts).astype(np.int64)


def look_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def spread(mask_starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Flags of ``size`` items covered by windows of n items that start at the given places."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, mask_starts, 1)
    np.add.at(step, np.minimum(mask_starts + n, size), -1)
    return np.cumsum(step[:-1]) > 0
