"""Words, word hashes and window hashes of whole Arrow text columns.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. UTF-8 never uses these
bytes inside a longer character, so splitting bytes equals splitting characters.
The functions run inside Spark tasks on one batch or one block of documents.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at once; bounds the memory of prefix sums, whatever the batch holds.
SLICE_BYTES = 1 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    """``data``: bytes of all texts; word i is ``data[start[i]:end[i]]``; document d
    owns words ``bounds[d]`` to ``bounds[d + 1]`` (exclusive)."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def docs(self) -> np.ndarray:
        """Document number of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte offsets of a string array; null counts as empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    if body is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_set(members: bytes) -> np.ndarray:
    """True for the bytes that are members."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def split_words(texts, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    data, offsets = text_bytes(texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    if lower:
        data = LOWER[data]
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return Words(data, start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 8 * SLICE_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: Words) -> np.ndarray:
    """64-bit polynomial hash of every word, mixed; equal bytes give equal hashes."""
    inverse = pow(_BYTE_BASE, -1, 1 << 64)
    out = np.empty(len(words.start), np.uint64)
    i, n = 0, len(out)
    while i < n:
        j = max(i + 1, int(np.searchsorted(words.end, words.start[i] + SLICE_BYTES, side="right")))
        a, b = int(words.start[i]), int(words.end[j - 1])
        size = b - a
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((words.data[a:b].astype(np.uint64) + np.uint64(1)) * _power(_BYTE_BASE, size)[:size], out=sums[1:])
        s, e = words.start[i:j] - a, words.end[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * _power(inverse, size)[s])
        i = j
    return out


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every ``size``-word window inside one document, and its first word."""
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(hashes))
    at = np.flatnonzero(room >= size)
    if not len(at):
        return np.zeros(0, np.uint64), at
    inverse = pow(_WORD_BASE, -1, 1 << 64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(_WORD_BASE, len(hashes))[:len(hashes)], out=sums[1:])
    return mix((sums[at + size] - sums[at]) * _power(inverse, len(hashes))[at]), at


def slices(batch, column: str, most_bytes: int = SLICE_BYTES):
    """A record batch in runs of rows with at most ``most_bytes`` of text (one row at least).

    A run's arrays take some 60 bytes a byte of text; 1 MB keeps two workers small
    beside an executor's heap.
    """
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


def free_name(name: str, taken) -> str:
    """A column name that isn't taken, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
