"""Whole-batch text work on Arrow buffers: words, word hashes, n-gram hashes.

A batch of texts is one byte buffer with offsets. All white space and all ASCII
separators are single bytes that never occur inside a longer UTF-8 sequence, so
words are found on bytes. Hashes are 64-bit polynomials modulo 2^64 over random
byte values, scrambled afterwards; they depend on the content alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 512 << 10

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Word bytes of the two definitions in use: all but ASCII white space; letters, digits and all beyond ASCII.
NOT_SPACE = ~(((_BYTES >= 9) & (_BYTES <= 13)) | (_BYTES == 32))
LETTERS = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (
    (_BYTES >= 65) & (_BYTES <= 90))


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits; one to one."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_VALUES = scramble(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
_BASE, _BASE_INVERSE = U(0x9FB21C651E98DF25), U(pow(0x9FB21C651E98DF25, -1, 1 << 64))
_GRAM, _GRAM_INVERSE = U(0xD6E8FEB86659FD93), U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for i below n."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * SLICE_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return unused memory to the system: Python workers outlive their tasks, and the next ones share the executor with them."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with their text bytes and offsets; a null text is empty."""
    n = batch.num_rows
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j
    give_back()


def spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run of ``inside`` bytes, and each text's first run (one entry more at the end)."""
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = inside[buf]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    start[cuts] |= word[cuts]
    end[cuts - 1] |= word[cuts - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hash of the bytes of every span."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    values = _VALUES[LOWER] if lower else _VALUES
    np.cumsum(values[buf] * powers(_BASE, len(buf)), out=sums[1:])
    out = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(buf) + 1)[starts]
    return scramble(out + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; windows over the end of a text have to be left out by the caller."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    if n <= 6:
        out = words[:len(words) - n + 1].copy()
        for i in range(1, n):
            out *= _GRAM
            out += words[i:len(words) - n + 1 + i]
        return scramble(out)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_GRAM_INVERSE, len(words)), out=sums[1:])
    out = (sums[n:] - sums[:-n]) * powers(_GRAM, len(words))[:len(words) - n + 1]
    return scramble(out)


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Positions of the words that begin a run of n words within one text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + shift


def owners(first: np.ndarray) -> np.ndarray:
    """The text of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def mark(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the given spans."""
    edge = np.bincount(starts, minlength=n + 1)[:n + 1] - np.bincount(ends, minlength=n + 1)[:n + 1]
    return np.cumsum(edge)[:n] > 0


def ints(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as the signed ones that Spark has."""
    return pa.array(values.view(np.int64))
