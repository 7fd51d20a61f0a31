"""A set of cut offsets in the manner of a Roaring bitmap.

Offsets are grouped by their upper 16 bits. Each group is kept in the smallest of three
containers: a sorted array of lower halves, a bitmap of 65,536 bits, or runs of
consecutive values. Cumulative cardinalities over the containers turn ``select`` into a
search for the container and a select inside it, so the offset of any boundary of a
text is found without listing the others.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 16
ARRAY_LIMIT = 4096  # an array of more values is larger than a bitmap


class ArrayContainer:
    """Sorted lower halves."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """65,536 bits, with the ones before each 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[low] = 1
        self.bits = np.packbits(bits, bitorder="little")
        self.before = np.concatenate(([0], np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))))

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        ones = np.flatnonzero(np.unpackbits(self.bits[8 * word:8 * word + 8], bitorder="little"))
        return 64 * word + int(ones[k - self.before[word]])


class RunContainer:
    """Starts of runs, with the values before each run."""

    def __init__(self, starts: np.ndarray, before: np.ndarray):
        self.starts, self.before = starts.astype(np.uint16), before

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(low: np.ndarray):
    """The smallest container for ascending lower halves."""
    first = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
    if 4 * len(first) < min(2 * len(low), CHUNK // 8):
        return RunContainer(low[first], first)
    return ArrayContainer(low) if len(low) <= ARRAY_LIMIT else BitmapContainer(low)


class BoundarySet:
    """Ascending offsets; ``select(k)`` is the k-th, counted from 0."""

    def __init__(self):
        self.keys: list[int] = []
        self.containers: list = []
        self.through: list[int] = []

    def __len__(self) -> int:
        return self.through[-1] if self.through else 0

    def append(self, key: int, low: np.ndarray) -> None:
        """The lower halves (int64, ascending) of all offsets whose upper half is ``key``; keys ascend."""
        if len(low):
            self.keys.append(key)
            self.containers.append(container(low))
            self.through.append(len(self) + len(low))

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.through, k, side="right"))
        inside = k - (self.through[at - 1] if at else 0)
        return self.keys[at] * CHUNK + self.containers[at].select(inside)


def line_boundaries(text: str) -> BoundarySet:
    """Code points before, between and after the lines of a text; boundary k lies after k lines."""
    out, n = BoundarySet(), len(text)
    ends_open = n > 0 and text[-1] != "\n"
    for key in range(n // CHUNK + 1):
        first = key * CHUNK
        # An offset is a boundary if the code point before it is a line break.
        before = text[max(first - 1, 0):min(first + CHUNK, n + 1) - 1]
        hit = np.flatnonzero(np.frombuffer(before.encode("utf-32-le"), np.uint32) == 10) + (0 if first else 1)
        ends = [0] if first == 0 else []
        tail = [n - first] if ends_open and first <= n < first + CHUNK else []
        out.append(key, np.concatenate((ends, hit, tail)).astype(np.int64))
    return out
