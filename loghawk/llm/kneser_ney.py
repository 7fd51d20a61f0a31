"""Interpolated modified Kneser-Ney n-gram model of any order, counted in Spark, memory-mapped by workers.

Tokens are the lower-cased words of a whole text and one end token; ``order - 1`` start tokens
come before the first. The model is a folder of sorted arrays on storage that all workers
mount (by default below ``spark.checkpoint.dir``):

- ``words-*``: sorted word hashes by ranges of the hash, and the rank of each by count. The
  id of a word is its rank times the number of ranges, plus its range, so that frequent words
  have small ids anywhere. Counts fall with the rank and are kept as runs.
- ``grams-k-*``: the k-grams, k from 2 to the order, by context: sorted context hashes in buckets of
  about twelve (the bucket gives the upper bits, 32 more are kept), how many words follow each, and
  these words' ids and counts, in half a byte each; higher ones have an array of their own, as have
  total, and number of words seen once, twice, three times or more, of contexts with ``LONG``
  grams and more. Shorter ones are summed when read. Shards are hash ranges of the context's first
  word, and of the others too if that has over an eighth of ``split_tokens`` tokens; a context
  whose rarest word has over ``split_tokens`` tokens is spread over several by the last word, so
  that a frequent context never meets in one task.
- ``hot-k-*``: the same numbers of spread contexts.
- ``before-*``: by words' ranges, how many distinct words a token follows.

Only the highest order counts occurrences. Each of its distinct grams adds one to its last
k - 1 words, whose shards do the same one order below (continuation counts). Tasks combine
counts before they send them, as gaps of sorted ids, each byte plane compressed by itself; sizes of
shards, the frequent words, discounts and totals are all that reaches the driver. Ids have
as many bits as the words need; there is no limit to either. A context's hash isn't verified
beyond its bucket and 32 bits: a lookup hits a wrong one with odds of about 4 x 10^-9.

``p(w | h) = max(c(h w) - D, 0) / c(h) + l(h) p(w | h')`` with the usual three discounts an order,
``h'`` being ``h`` without its first word; after a context that training hasn't seen it is
``p(w | h')``. ``p(w)`` is interpolated with ``1 / (V + 1)``, which is also what an unknown word gets.

Edge cases: a null or wordless text is the end token alone; repeated rows count each;
with no training rows every probability is ``1 / (V + 1) = 1``; null ids are carried;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.llm import blocks as B
from loghawk.llm import text as T
from loghawk.session import ensure_checkpoint_dir

START, END = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
SHARD_BYTES, SLICE_BYTES, SPLIT_TOKENS, FLUSH = 16 << 20, 2 << 20, 1 << 20, 1 << 20
ORDER, LONG, MAPPED_BYTES = 3, 16, 128 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
GRAMS, HOT, TALLY = 0, 1, 2  # kinds of messages


class Model(NamedTuple):
    folder: str
    order: int
    sizes: np.ndarray      # words of each shard
    split_tokens: int
    tokens: int            # training tokens, end tokens included
    types: int             # distinct ones
    discounts: dict        # order -> of counts 1, 2, 3 and more
    followed: int          # distinct pairs: the sum of ``before``
    lower_weight: float    # left for 1 / (V + 1)

    @property
    def shards(self) -> int:
        return len(self.sizes)

    @property
    def bits(self) -> int:
        return _bits(self.sizes)


def _bits(sizes: np.ndarray) -> int:
    """Bits of an id, in whole bytes, so that each of a message's planes is of one id."""
    return 8 * max(1, -(-(int(sizes.max()) * len(sizes)).bit_length() // 8))


def _save(folder: str, name: str, arrays: list) -> None:
    """Whole files only: a task that is run again, or twice, replaces like with like."""
    part = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tofile(f)
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(part, os.path.join(folder, name))


_maps: dict[str, list] = {}


def _map(folder: str, name: str, kinds: tuple) -> list | None:
    """A file's arrays as memory maps, None if there is none; a worker keeps at most ``MAPPED_BYTES`` open."""
    path = os.path.join(folder, name)
    if path not in _maps:
        if len(_maps) > 4096 or sum(a.nbytes for m in _maps.values() if m for a in m) > MAPPED_BYTES:
            _maps.clear()
        _maps[path] = None
        if os.path.exists(path):
            whole = np.asarray(np.memmap(path, np.uint8, "r"))
            sizes = whole[8:8 * (1 + len(kinds))].view(np.int64)
            ends = 8 * (1 + len(kinds)) + np.cumsum(-(-sizes // 8) * 8)
            _maps[path] = [whole[e + -(-n // 8) * -8:][:n].view(k) for e, n, k in zip(ends, sizes, kinds)]
    return _maps[path]


def _order(words: list) -> np.ndarray:
    """Sorts rows of key columns, not stable: by the rank of the columns so far beside the next one."""
    key = words[0]
    for w in words[1:] if len(key) else []:
        order = np.argsort(key)
        ranks, key = np.empty(len(key), np.uint64), key[order]
        ranks[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])), dtype=np.uint64)
        width = int(w.max()).bit_length()
        if width + len(key).bit_length() > 64:
            return np.lexsort(words[::-1])
        key = ranks << np.uint64(width) | w
    return np.argsort(key)


def _combine(words: list, counts: np.ndarray):
    """Distinct rows of one or more key columns, sorted, with their summed counts."""
    order = _order(words)
    words = [w[order] for w in words]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    return [w[first] for w in words], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _columns_packed(columns: list, bits: int) -> list:
    """Columns of ids in as few 64-bit words as hold them; the words sort as the columns do."""
    each = 64 // bits
    out = []
    for i in range(0, len(columns), each):
        word = columns[i].astype(np.uint64)
        for c in columns[i + 1:i + each]:
            word = (word << np.uint64(bits)) | c.astype(np.uint64)
        out.append(word)
    return out


def _columns_unpacked(words: list, n: int, bits: int) -> list:
    each, mask = 64 // bits, np.uint64((1 << bits) - 1) if bits < 64 else ~np.uint64(0)
    out = []
    for i, word in enumerate(words):
        held = min(each, n - i * each)
        out += [(word >> np.uint64(bits * (held - 1 - j))) & mask for j in range(held)]
    return out


def _encoded(words: list, counts: np.ndarray) -> tuple[bytes, bytes]:
    """A message: gaps of the first word's ascending values, the other words and the counts, plane by plane."""
    gaps = np.diff(words[0], prepend=np.uint64(0))
    return b"".join([_planes(w) for w in (gaps, *words[1:])]), _planes(counts)


def _planes(values: np.ndarray) -> bytes:
    """Byte planes, each compressed by itself: none if all zero, as it is if that is shorter."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    for plane in np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T):
        raw = plane.tobytes() if plane.any() else b""
        packed = codec.compress(raw, asbytes=True) if raw else raw
        out.append(min(raw, packed, key=len))  # of equal ones the raw
    return np.array([len(values), *map(len, out)], "<u4").tobytes() + b"".join(out)


def _from_planes(raw: bytes) -> list:
    """The columns that ``_planes`` has written one after the other."""
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(raw):
        n, *sizes = np.frombuffer(raw, "<u4", 9, at).tolist()
        planes, at = np.zeros((n, 8), np.uint8), at + 36
        for k, size in enumerate(sizes):
            if size:
                plane = raw[at:at + size]
                planes[:, k] = np.frombuffer(plane if size == n else codec.decompress(plane, n, asbytes=True), np.uint8)
                at += size
        out.append(planes.view("<u8").ravel())
    return out


def _decoded(keys: bytes, counts: bytes) -> tuple[list, np.ndarray]:
    words = _from_planes(keys)
    return [np.cumsum(words[0], dtype=np.uint64), *words[1:]], _from_planes(counts)[0].astype(np.int64)


def _tokens(texts, pad: int):
    """Token hashes with ``pad`` starts before and an end after each document's words, and the documents' bounds."""
    words = T.split_words(texts, lower=True)
    bounds = words.bounds + (pad + 1) * np.arange(len(words.bounds))
    out = np.full(bounds[-1], START, np.uint64)
    inside = np.ones(len(out), bool)
    for k in range(pad):
        inside[bounds[:-1] + k] = False
    inside[bounds[1:] - 1] = False
    out[inside] = T.word_hashes(words)
    out[bounds[1:] - 1] = END
    return out, bounds


def _predicted(bounds: np.ndarray, pad: int) -> np.ndarray:
    """Places of the tokens that are no starts."""
    real = np.ones(bounds[-1], bool)
    for k in range(pad):
        real[bounds[:-1] + k] = False
    return np.flatnonzero(real)


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return B.bucket_of(hashes, shards).astype(np.int64)


def _by_shard(words: list, counts: np.ndarray, shard: np.ndarray):
    """(shard, keys, counts) messages of sorted rows."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) > 0, [True]))) if len(shard) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        yield int(shard[own[0]]), *_encoded([w[own] for w in words], counts[own])


def _packed(batches, keys_of, shard_of):
    """Combined keys and counts of the task's texts, packed by shard."""
    held, size = [], 0

    def merged():
        return _combine([np.concatenate(c) for c in zip(*[w for w, _ in held])], np.concatenate([c for _, c in held]))

    def flush():
        words, counts = merged()
        rows = list(_by_shard(words, counts, shard_of(words)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]),
                                           pa.array([r[2] for r in rows])], names=["shard", "keys", "counts"])

    for batch in batches:
        for part in T.slices(batch, "text", SLICE_BYTES):
            words = keys_of(part.column(0))
            held.append(_combine(words, np.ones(len(words[0]), np.int64)))
            size += len(held[-1][1])
            if size > FLUSH:
                held[:] = [merged()]
                size = len(held[0][1])
                if size > FLUSH // 2:
                    yield flush()
                    held, size = [], 0
    if size:
        yield flush()


_PACKED = "shard int, keys binary, counts binary"


def _merged(table: pa.Table):
    parts = [_decoded(k.as_py(), c.as_py()) for k, c in zip(table["keys"], table["counts"])]
    return _combine([np.concatenate(c) for c in zip(*[w for w, _ in parts])], np.concatenate([c for _, c in parts]))


_WORDS = (np.uint64, np.uint32, np.int64, np.int64)  # hashes, ranks; first ranks of a count, counts


def _ids(folder: str, shards: int, hashes: np.ndarray) -> np.ndarray:
    """Ids of sorted distinct hashes; -1 for unknown ones."""
    out = np.full(len(hashes), -1, np.int64)
    shard = _word_shard(hashes, shards)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        have, a, b = _map(folder, f"words-{s:06d}", _WORDS), cuts[s], cuts[s + 1]
        if not have:
            continue
        at = np.searchsorted(have[0], hashes[a:b])
        hit = at < len(have[0])
        hit[hit] = have[0][at[hit]] == hashes[a:b][hit]
        out[a:b][hit] = have[1][at[hit]].astype(np.int64) * shards + s
    return out


def _by_id(shards: int, ids: np.ndarray, read) -> np.ndarray:
    """``read(shard, ranks)`` of ids >= 0; else 0."""
    out = np.zeros(len(ids), np.int64)
    known = np.flatnonzero(ids >= 0)
    shard = ids[known] % shards
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        own = known[order[cuts[s]:cuts[s + 1]]]
        out[own] = read(s, ids[own] // shards)
    return out


def _word_counts(folder: str, shards: int, ids: np.ndarray) -> np.ndarray:
    def read(s, ranks):
        *_, first, counts = _map(folder, f"words-{s:06d}", _WORDS)
        return counts[np.searchsorted(first, ranks, side="right") - 1]

    return _by_id(shards, ids, read)


def _before(folder: str, shards: int, ids: np.ndarray) -> np.ndarray:
    def read(s, ranks):
        have = _map(folder, f"before-{s:06d}", _COUNTS)
        return _read_counts(have, ranks) if have else 0

    return _by_id(shards, ids, read)


def _context_hash(columns: list) -> np.ndarray:
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = T.mix(out + (c.astype(np.uint64) + np.uint64(1)) * _STEP)
    return out


def _home(context: np.ndarray, columns: list, first_count: np.ndarray, split: int) -> np.ndarray:
    """What deals out a context: its first word, so that a message's grams are neighbours; if that has
    ``split`` tokens and more, one of several values, by the words after it."""
    if len(columns) < 2:
        return context
    first = _context_hash(columns[:1])
    salt = _context_hash(columns[1:]) % (1 + first_count // split).astype(np.uint64)
    return np.where(salt == 0, first, T.mix(first + salt * _STEP))


def _gram_shard(context: np.ndarray, last: np.ndarray, splits: np.ndarray, shards: int) -> np.ndarray:
    salt = T.mix(last.astype(np.uint64) + np.uint64(1)) % splits.astype(np.uint64)
    return B.bucket_of(np.where(salt == 0, context, T.mix(context + salt * _STEP)), shards).astype(np.int64)


def _context_key(context: np.ndarray) -> np.ndarray:
    """What a context is found by in its shard; independent of the bits that choose the shard."""
    return T.mix(context + _STEP)


def _bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper ``bits`` of a context's key and the 32 after them."""
    half = np.uint64(32)
    return ((keys >> half) >> np.uint64(32 - bits)).astype(np.int64), ((keys << np.uint64(bits)) >> half).astype(np.uint32)


def _head_tokens(split: int) -> int:
    """Tokens of a word beyond which the contexts that begin with it are dealt out."""
    return max(1, split // 8)


def _splits(columns: list, count_of, split: int) -> np.ndarray:
    """Shards a context is spread over, by the count of its rarest word."""
    rarest = count_of(columns[0])
    for c in columns[1:]:
        rarest = np.minimum(rarest, count_of(c))
    return 1 + rarest // split


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple:
    """Modified Kneser-Ney discounts from counts of counts.

    Fixed ones where a count is missing or a discount would leave nothing, or too much, for the order below.
    """
    fixed = (0.5, 1.0, 1.5)
    if min(n1, n2, n3, n4) == 0:
        return fixed
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d <= k + 1 else fixed[k] for k, d in enumerate(found))


def _discounted(counts: np.ndarray, discounts: tuple) -> np.ndarray:
    table = np.array([0.0, *discounts])
    return np.maximum(counts - table[np.minimum(counts, 3).astype(np.int64)], 0.0)


def model_folder(spark) -> str:
    """A new folder below the shared one, as a path that tasks can open."""
    shared = ensure_checkpoint_dir(spark)
    if "://" in shared and not shared.startswith("file://") or shared.startswith(("hdfs:", "s3")):
        raise ValueError(f"the model's arrays need a mounted folder; {shared} is none: pass one as folder")
    path = shared[shared.index("file:") + 5:] if shared.startswith("file:") else shared
    return os.path.join("/" + path.lstrip("/"), f"kneser-ney-{uuid.uuid4().hex}")


_COUNTS = (np.uint8, np.uint32, np.int64)  # half bytes; places and values of 15 and more


def _packed_counts(counts: np.ndarray) -> list:
    small = np.minimum(counts, 15).astype(np.uint8)
    small = np.append(small, np.zeros(len(small) % 2, np.uint8))
    large = np.flatnonzero(counts >= 15)
    return [small[::2] | small[1::2] << 4, large.astype(np.uint32), counts[large].astype(np.int64)]


def _read_counts(have: list, at: np.ndarray) -> np.ndarray:
    small, places, values = have
    out = (small[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15).astype(np.int64)
    full = np.flatnonzero(out == 15)
    if len(full):
        out[full] = values[np.searchsorted(places, at[full])]
    return out


def _last_kinds(bits: int) -> tuple:
    """Types that hold the lower 16 bits of an id, and the rest."""
    return np.uint16, np.uint8 if bits <= 24 else np.uint16 if bits <= 32 else np.uint64


def _gram_kinds(bits: int) -> tuple:
    """First context and first gram of each bucket; contexts' hashes and lengths, places and lengths of
    255 and more, places and statistics of long ones; last words, lower and upper part; counts."""
    return (np.uint32, np.uint32, np.uint32, np.uint8, np.uint32, np.int64, np.uint32, np.int64,
            *_last_kinds(bits), *_COUNTS)


def _lasts(have: list, at: np.ndarray) -> np.ndarray:
    return have[9][at].astype(np.int64) << 16 | have[8][at]


def _lengths(have: list, at: np.ndarray) -> np.ndarray:
    out = have[3][at].astype(np.int64)
    full = np.flatnonzero(out == 255)
    if len(full):
        out[full] = have[5][np.searchsorted(have[4], at[full])]
    return out


def _run_stats(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Total, and grams counted once, twice, three times or more, of each run."""
    if not len(first):
        return np.zeros((0, 4), np.int64)
    return np.stack([np.add.reduceat(x, first) for x in
                     (counts, *[(k(counts)).astype(np.int64) for k in _TIMES])], axis=1)


_TIMES = (lambda c: c == 1, lambda c: c == 2, lambda c: c >= 3)
_MESSAGE = "level int, kind int, " + _PACKED + ", n1 long, n2 long, n3 long, n4 long, more long, total long"


def _tallies(counts: np.ndarray) -> list:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum()), int(counts.sum())]


def _messages(rows: list) -> pa.Table:
    """Rows of (level, kind, shard, keys, counts, tallies) as Spark reads them back."""
    schema = pa.schema([("level", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()),
                        ("counts", pa.binary()), *[(n, pa.int64()) for n in ("n1", "n2", "n3", "n4", "more", "total")]])
    columns = list(zip(*[(*r[:5], *r[5]) for r in rows])) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_NONE = [0] * 6


class _Counter:
    """What the counting tasks need: the folder, the shards' sizes, and ids and counts of frequent words."""

    def __init__(self, folder: str, sizes: np.ndarray, often: np.ndarray, split: int):
        self.folder, self.sizes, self.shards, self.split, self.bits = folder, sizes, len(sizes), split, _bits(sizes)
        self.often = often[np.argsort(often[:, 0])]

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words that have ``_head_tokens(split)`` and more; else 0."""
        out = np.zeros(len(ids), np.int64)
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often[:, 0], ids.astype(np.int64)), len(self.often) - 1)
            hit = self.often[at, 0] == ids.astype(np.int64)
            out[hit] = self.often[at[hit], 1]
        return out

    def place(self, columns: list):
        """Context hash, number of shards and own shard of every gram."""
        context, splits = _context_hash(columns[:-1]), _splits(columns[:-1], self.count_of, self.split)
        home = _home(context, columns[:-1], self.count_of(columns[0]), _head_tokens(self.split))
        return context, splits, _gram_shard(home, columns[-1], splits, self.shards)

    def write(self, table: pa.Table) -> pa.Table:
        """Write a group's arrays; pass on what its grams add to the order below."""
        level, kind, shard = (table[c][0].as_py() for c in ("level", "kind", "shard"))
        if kind == TALLY:
            return _messages([(level, TALLY, shard, b"", b"", [int(np.sum(table[c].to_numpy())) for c in table.column_names[5:]])])
        if kind == HOT:
            return self._write_hot(level, shard, table)
        words, counts = _merged(table)
        if level == 1:
            return self._write_words(shard, words[0].astype(np.int64), counts)
        return self._write_grams(level, shard, words, counts)

    def _write_words(self, shard: int, ids: np.ndarray, counts: np.ndarray) -> pa.Table:
        before = np.zeros(int(self.sizes[shard]), np.int64)
        before[ids // self.shards] = counts
        _save(self.folder, f"before-{shard:06d}", _packed_counts(before))
        return _messages([(1, TALLY, 0, b"", b"", _tallies(counts))])

    def _write_hot(self, level: int, shard: int, table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k.as_py(), np.uint64) for k in table["keys"]])
        stats = np.concatenate([np.frombuffer(c.as_py(), np.int64).reshape(-1, 4) for c in table["counts"]])
        keys, back = np.unique(keys, return_inverse=True)
        total = np.zeros((len(keys), 4), np.int64)
        np.add.at(total, back, stats)
        _save(self.folder, f"hot-{level}-{shard:06d}", [keys, total])
        return _messages([])

    def _write_grams(self, level: int, shard: int, words: list, counts: np.ndarray) -> pa.Table:
        columns = _columns_unpacked(words, level, self.bits)
        context, splits, _ = self.place(columns)
        order = np.argsort(_context_key(context), kind="stable")  # a context's grams stay sorted
        context, splits, last, sorted_counts = context[order], splits[order], columns[-1][order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        lengths, stats, spread = np.diff(np.append(first, len(order))), _run_stats(sorted_counts, first), splits[first] > 1
        bits = min(31, (len(first) >> 4).bit_length())
        bucket, rest = _bucket(_context_key(context[first]), bits)
        begin = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        large, long = np.flatnonzero(lengths >= 255), np.flatnonzero(~spread & (lengths >= LONG))
        low, high = _last_kinds(self.bits)
        _save(self.folder, f"grams-{level}-{shard:06d}", [
            begin.astype(np.uint32), np.append(first, len(order))[begin].astype(np.uint32), rest,
            np.minimum(lengths, 255).astype(np.uint8), large.astype(np.uint32), lengths[large],
            long.astype(np.uint32), stats[long], last.astype(low), (last >> np.uint64(16)).astype(high),
            *_packed_counts(sorted_counts)])
        rows = [(level, TALLY, 0, b"", b"", _tallies(counts))]
        hashes = context[first[spread]]
        to = _word_shard(hashes, self.shards)
        for s in np.unique(to):
            rows.append((level, HOT, int(s), hashes[to == s].tobytes(), stats[spread][to == s].tobytes(), _NONE))
        below = [c for c in columns[1:]]
        words, counts = _combine(_columns_packed(below, self.bits), np.ones(len(counts), np.int64))
        if level > 2:
            to = self.place(_columns_unpacked(words, level - 1, self.bits))[2]
        else:
            to = words[0].astype(np.int64) % self.shards
        rows += [(level - 1, GRAMS, *message, _NONE) for message in _by_shard(words, counts, to)]
        return _messages(rows)


def fit(docs: DataFrame, text_col: str = "text", folder: str | None = None, order: int = ORDER,
        shard_bytes: int = SHARD_BYTES, split_tokens: int = SPLIT_TOKENS) -> Model:
    """Count the training documents and write the model's arrays; ``order`` is 2 or more."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    folder, pad = folder or model_folder(docs.sparkSession), order - 1
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(F.col(text_col).alias("text"))
    shards = B.parts_for(B.text_size(texts), shard_bytes)

    def send_words(batches):
        return _packed(batches, lambda t: [_tokens(t, pad)[0]], lambda w: _word_shard(w[0], shards))

    def write_words(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        (keys,), counts = _merged(table)
        order = np.argsort(-counts, kind="stable")
        ranks, falling = np.empty(len(order), np.uint32), counts[order]
        ranks[order] = np.arange(len(order))
        first = np.flatnonzero(np.concatenate(([True], falling[1:] != falling[:-1])))
        _save(folder, f"words-{shard:06d}", [keys, ranks, first, falling[first]])
        start = int(counts[0]) if len(keys) and keys[0] == START else 0
        often = falling[:np.count_nonzero(falling >= _head_tokens(split_tokens))]
        often = np.stack([np.arange(len(often)) * shards + shard, often], axis=1).astype(np.int64)
        return pa.table([[shard], [len(keys)], [int(counts.sum()) - start], [int(start > 0)], [often.tobytes()]],
                        names=["shard", "n", "tokens", "starts", "often"])

    rows = texts.mapInArrow(send_words, _PACKED).groupBy("shard") \
        .applyInArrow(write_words, "shard long, n long, tokens long, starts long, often binary").collect()
    sizes = np.zeros(shards, np.int64)
    for r in rows:
        sizes[r["shard"]] = r["n"]
    often = np.frombuffer(b"".join(bytes(r["often"]) for r in rows), np.int64).reshape(-1, 2)
    counter = _Counter(folder, sizes, often, split_tokens)

    def keys_of(t):
        hashes, bounds = _tokens(t, pad)
        words, back = np.unique(hashes, return_inverse=True)
        ids = _ids(folder, shards, words)[back]
        at = _predicted(bounds, pad)
        return _columns_packed([ids[at - pad + j] for j in range(order)], counter.bits)

    def send_grams(batches):
        return _packed(batches, keys_of, lambda w: counter.place(_columns_unpacked(w, order, counter.bits))[2])

    def write(table: pa.Table) -> pa.Table:
        return counter.write(table)

    names = ["n1", "n2", "n3", "n4", "more", "total"]
    level = texts.mapInArrow(send_grams, _PACKED).select(
        F.lit(order).alias("level"), F.lit(GRAMS).alias("kind"), "shard", "keys", "counts",
        *[F.lit(0).cast("long").alias(n) for n in names])
    for _ in range(order):
        level = level.groupBy("level", "kind", "shard").applyInArrow(write, _MESSAGE)
    found = {r["level"]: r for r in level.where(F.col("kind") == TALLY).groupBy("level")
             .agg(*[F.sum(n).alias(n) for n in names]).collect()}
    discounts = {k: _discounts(*[found[k][f"n{i}"] if k in found else 0 for i in (1, 2, 3, 4)]) for k in range(1, order + 1)}
    one = found.get(1)
    weight = sum(d * n for d, n in zip(discounts[1], (one["n1"], one["n2"], one["more"]))) / one["total"] if one else 1.0
    types = int(sizes.sum()) - max([r["starts"] for r in rows], default=0)
    return Model(folder, order, sizes, split_tokens, sum(r["tokens"] for r in rows), types, discounts,
                 one["total"] if one else 0, weight)


def _lower_probability(model: Model, ids: np.ndarray) -> np.ndarray:
    before = _before(model.folder, model.shards, ids)
    return _discounted(before, model.discounts[1]) / max(1, model.followed) + model.lower_weight / (model.types + 1)


def _find_contexts(have: list, keys: np.ndarray):
    """Place, first gram and number of grams of contexts in a shard; no grams if it hasn't the context."""
    bucket, rest = _bucket(keys, (len(have[0]) - 1).bit_length() - 1)
    place, start, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    at, end, gram = have[0][bucket].astype(np.int64), have[0][bucket + 1], have[1][bucket].astype(np.int64)
    todo = np.flatnonzero(at < end)
    at, end, gram, rest = at[todo], end[todo], gram[todo], rest[todo]
    while len(todo):
        found, size = have[2][at], _lengths(have, at)
        hit = found == rest
        own = todo[hit]
        place[own], start[own], length[own] = at[hit], gram[hit], size[hit]
        go = np.flatnonzero((found < rest) & (at + 1 < end))
        todo, at, end, gram, rest = todo[go], at[go] + 1, end[go], gram[go] + size[go], rest[go]
    return place, start, length


def _find_lasts(have: list, start: np.ndarray, length: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of grams by the last word, among ``length`` ascending ones from ``start`` on; -1 for none."""
    out = np.full(len(last), -1, np.int64)
    todo = np.flatnonzero(length > 0)
    low, high, last = start[todo], start[todo] + length[todo], last[todo]
    while len(todo):
        middle = (low + high) >> 1
        found = _lasts(have, middle)
        hit = found == last
        out[todo[hit]] = middle[hit]
        less = found < last
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        go = np.flatnonzero(~hit & (low < high))
        todo, low, high, last = todo[go], low[go], high[go], last[go]
    return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start`` to ``start + length`` of each, one after the other."""
    return np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)


def _look_up(model: Model, level: int, columns: list, counts: list):
    """Count of each gram, and (total, once, twice, more) of its context; ids below 0 are unknown.

    Grams of a context are neighbours, and its words are all known; only the last word may not be.
    """
    n = len(columns[0])
    seen = np.zeros(n, np.int64)
    if not n:
        return seen, np.zeros((0, 4), np.int64)
    last, splits = columns[-1], 1 + np.minimum.reduce(counts[:-1]) // model.split_tokens
    new = splits > 1
    new[0] = True
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)  # a context, or a gram of a spread one, is looked up once
    many, spread, stats = np.diff(np.append(first, n)), splits[first] > 1, np.zeros((len(first), 4), np.int64)
    context = _context_hash([c[first] for c in columns[:-1]])
    keys = _context_key(context)
    home = _home(context, [c[first] for c in columns[:-1]], counts[0][first], _head_tokens(model.split_tokens))
    shard = _gram_shard(home, np.maximum(last[first], 0), splits[first], model.shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(model.shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        own, have = order[cuts[s]:cuts[s + 1]], _map(model.folder, f"grams-{level}-{s:06d}", _gram_kinds(model.bits))
        if not have:
            continue
        own = own[np.argsort(keys[own])]
        place, start, length = _find_contexts(have, keys[own])
        hit = length > 0
        own, place, start, length = own[hit], place[hit], start[hit], length[hit]
        grams = _ranges(first[own], many[own])
        at = _find_lasts(have, np.repeat(start, many[own]), np.repeat(length, many[own]), last[grams])
        seen[grams[at >= 0]] = _read_counts(have[10:], at[at >= 0])
        whole, short = ~spread[own], length < LONG
        one = whole & short
        times = _read_counts(have[10:], _ranges(start[one], length[one]))
        if len(times):
            stats[own[one]] = _run_stats(times, np.cumsum(length[one]) - length[one])
        one = whole & ~short
        stats[own[one]] = have[7].reshape(-1, 4)[np.searchsorted(have[6], place[one])]
    spread = np.flatnonzero(spread)
    to = _word_shard(context[spread], model.shards)
    for s in np.unique(to):
        own, have = spread[to == s], _map(model.folder, f"hot-{level}-{s:06d}", (np.uint64, np.int64))
        if not have:
            continue
        place = np.searchsorted(have[0], context[own])
        hit = place < len(have[0])
        hit[hit] = have[0][place[hit]] == context[own][hit]
        stats[own[hit]] = have[1].reshape(-1, 4)[place[hit]]
    return seen, np.repeat(stats, many, axis=0)


def _distinct(columns: list, bits: int) -> tuple[list, np.ndarray]:
    """Distinct rows of columns of small ids, sorted, and each row's place among them."""
    packed = _columns_packed(columns, bits)
    order = _order(packed)
    packed = [w[order] for w in packed]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for w in packed:
        new[1:] |= w[1:] != w[:-1]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return [c.astype(np.int64) for c in _columns_unpacked([w[new] for w in packed], len(columns), bits)], back


def score_batch(model: Model, texts):
    """(tokens, known tokens, base score, score) of every text; scores are log10 sums."""
    pad = model.order - 1
    hashes, bounds = _tokens(texts, pad)
    n = len(bounds) - 1
    words, back = np.unique(hashes, return_inverse=True)
    ids = _ids(model.folder, model.shards, words)
    counts = _word_counts(model.folder, model.shards, ids)
    at = _predicted(bounds, pad)
    doc = np.repeat(np.arange(n), np.diff(bounds) - pad)
    base = np.log10((counts + 1) / (model.tokens + 1 * (model.types + 1)))
    own = max(1, len(words)).bit_length()
    levels, columns = [], [back[at - pad + j] for j in range(model.order)]
    for level in range(model.order, 1, -1):  # distinct grams, and each one's place among those an order above
        columns, to = _distinct(columns, own)
        levels.append((level, columns, to))
        columns = columns[1:]
    p = _lower_probability(model, ids)[columns[0]]
    for level, columns, to in reversed(levels):
        rows = np.flatnonzero(np.logical_and.reduce([ids[c] >= 0 for c in columns[:-1]]))  # known contexts
        found = [c[rows] for c in columns]
        seen, stats = _look_up(model, level, [ids[c] for c in found], [counts[c] for c in found])
        met = stats[:, 0] > 0
        rows, seen, stats, d = rows[met], seen[met], stats[met], model.discounts[level]
        kept = stats[:, 1] * d[0] + stats[:, 2] * d[1] + stats[:, 3] * d[2]
        p[rows] = (_discounted(seen, d) + kept * p[rows]) / stats[:, 0]
        if level < model.order:
            p = p[to]
    per_doc = lambda values: np.bincount(doc, values, minlength=n)
    return (np.diff(bounds) - pad, per_doc(counts[back[at]] > 0).astype(np.int64), per_doc(base[back[at]]),
            per_doc(np.log10(p)[to]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          flag_col: str | None = None) -> DataFrame:
    """One row per document: tokens, known tokens, add-one base score and the model's log10 probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number a shard

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text", SLICE_BYTES):
                tokens, known, base, logp = score_batch(shared.value, part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(tokens.astype(np.int64)), pa.array(known),
                     pa.array(np.full(len(tokens), shared.value.tokens)), pa.array(base), pa.array(logp)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    flag = F.col(flag_col) if flag_col else F.lit(False)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), flag.alias("held_out"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                             "base_score double, score double"))
