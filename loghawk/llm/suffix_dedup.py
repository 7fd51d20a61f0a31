"""Suffix-array de-duplication over sparse, content-selected suffixes.

A suffix is kept where its first ``anchor`` words hash to the minimum among
``least - anchor + 1`` neighbouring positions (a minimiser). Any ``least`` words that
occur twice hold the same minimiser both times, so nothing that long is missed,
while about one position in thirteen is kept.

1. Blocks of documents send each kept suffix's first ``anchor`` words, hashed, once.
2. Buckets sort the suffixes by it and compare neighbours: a suffix without an equal
   neighbour is unique and goes no further.
3. The others are extended left and right: each stands for the stretches of ``least``
   words that select it, from as far left to as far right of it as the minimiser
   reaches. Their hashes are sorted, neighbours compared, and the first occurrence by
   (doc_id, place) is named.
4. Stretches that occur again and overlap in a document merge into maximal spans.

Every occurrence is reported; ``n_removed`` counts the words of the span that occur in
an earlier place, which are the ones to remove. A block sends a hash once, so a
passage that a third of all documents share is one entry a block.

Edge cases: a null text has no words; texts shorter than ``least`` words have no span;
null ids come after all others and keep their null; rows that repeat id and text are
different places of the same id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loghawk.llm import blocks as B
from loghawk.llm import text as T
from loghawk.llm.substring_dedup import cover

LEAST_WORDS, ANCHOR_WORDS = 50, 26
_HASH = 7  # bytes sent of a hash; its bucket adds more
_LOW = np.uint64((1 << 56) - 1)
_LAST = np.int64(np.iinfo(np.int64).max)
_SENT = ("bucket int, block int, width int, hashes binary, repeated binary, places binary, lowest long, id_width int, "
         "docs binary, starts binary")
_TOLD = "block int, hashes binary"
_FOUND = "block int, width int, places binary, firsts binary, lowest long, id_width int, owners binary"
RESULT = "doc_id long, start_word int, end_word int, n_words long, n_removed long, first_doc_id long"


class _Block:
    """A block's words, its stretches of ``least`` words and the suffix that each selects."""

    def __init__(self, table: pa.Table, least: int, anchor: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = table["doc_id"].combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = T.split_words(table["text"])
        hashes = T.word_hashes(self.words)
        self.stretch, self.at = T.windows(hashes, self.words.bounds, least)
        grams, places = T.windows(hashes, self.words.bounds, anchor)
        self.gram = np.zeros(len(hashes), np.uint64)
        self.gram[places] = grams
        self.anchor = np.zeros(len(self.at), np.int64)
        reach = least - anchor + 1
        step = 1 << 16
        for a in range(0, len(self.at), step):
            some = self.at[a:a + step]
            best, value = some.copy(), self.gram[some]
            for k in range(1, reach):
                lower = self.gram[some + k] < value
                best[lower] = some[lower] + k
                value = np.minimum(value, self.gram[some + k])
            self.anchor[a:a + step] = best
        self.doc = self.words.docs


def _first_of(keys: np.ndarray):
    """Distinct keys, the first row of each, and whether it has more."""
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0))) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((new, [len(keys)])))
    return keys[order][new], order[new], count > 1


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, names)], names=[n for n, _ in names])


def _send_suffixes(least: int, anchor: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        own = _Block(table, least, anchor)
        keys, _, repeated = _first_of(own.gram[np.unique(own.anchor)])
        cuts = np.searchsorted(B.bucket_of(keys, buckets), np.arange(buckets + 1))
        block = table["block"][0].as_py()
        return _table(_SENT, [(b, block, 0, B.pack(keys[i:j], _HASH), repeated[i:j].tobytes(), b"", 0, 0, b"", b"")
                              for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j])
    return send


def _neighbours(keys: np.ndarray, again: np.ndarray, *tie):
    """Order by key (then ``tie``), which sorted rows occur again, and the head of each one's run."""
    order = np.lexsort((*tie, keys)) if tie else np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    hit = again[order]
    hit[1:] |= same
    hit[:-1] |= same
    head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
    return order, np.flatnonzero(hit), head


def _read(table: pa.Table):
    rows = table.to_pydict()
    keys = [B.unpack(h, _HASH) for h in rows["hashes"]]
    size = np.array([len(k) for k in keys])
    again = np.concatenate([np.frombuffer(r, bool) for r in rows["repeated"]])
    return rows, np.concatenate(keys), again, np.repeat(np.arange(len(size)), size), size


def _by_part(part: np.ndarray, parts: int):
    """(part, its rows) for every part that has rows."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield k, order[cuts[k]:cuts[k + 1]]


def _shared_suffixes(table: pa.Table) -> pa.Table:
    """Sort the suffixes, compare neighbours; to each block, its suffixes that occur again."""
    rows, keys, again, part, size = _read(table)
    order, found, _ = _neighbours(keys, again)
    hit = order[found]
    return _table(_TOLD, [(rows["block"][k], B.pack(keys[hit[own]], _HASH)) for k, own in _by_part(part[hit], len(size))])


def _first_occurrences(table: pa.Table) -> pa.Table:
    """Sort the stretches, compare neighbours; to each block, its stretches that occur again.

    With each goes whether this is the smallest (doc_id, place), and that one's doc_id.
    """
    rows, keys, again, part, size = _read(table)
    places, docs = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    ends = np.cumsum(size)
    for k, (a, b) in enumerate(zip(ends - size, ends)):
        places[a:b] = B.unpack(rows["places"][k], rows["width"][k])
        ids = _unpack_ids(rows["docs"][k], rows["lowest"][k], rows["id_width"][k])
        starts = B.unpack(rows["starts"][k], rows["width"][k]).astype(np.int64)
        docs[a:b] = ids[np.searchsorted(starts, places[a:b], side="right") - 1]
    order, found, head = _neighbours(keys, again, places, np.array(rows["block"])[part], docs)
    hit, first = order[found], head[found] == found
    owner = docs[order[head[found]]]
    out = []
    for k, own in _by_part(part[hit], len(size)):
        width, lowest, id_width, ids = rows["width"][k], *_pack_ids(owner[own])
        out.append((rows["block"][k], width, B.pack(places[hit[own]].astype(np.uint64), width), first[own].tobytes(),
                    lowest, id_width, ids))
    return _table(_FOUND, out)


def _pack_ids(ids: np.ndarray) -> tuple[int, int, bytes]:
    """Smallest id, bytes an id, and the ids above the smallest (modulo 2**64, so for any ids)."""
    lowest = int(ids.min())
    above = ids.astype(np.int64).view(np.uint64) - np.uint64(lowest & 0xFFFFFFFFFFFFFFFF)
    width = max(1, -(-int(above.max()).bit_length() // 8))
    return lowest, width, B.pack(above, width)


def _unpack_ids(raw: bytes, lowest: int, width: int) -> np.ndarray:
    return (B.unpack(raw, width) + np.uint64(lowest & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def _extend(least: int, anchor: int, buckets: int):
    def extend(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows or not answers.num_rows:
            return _table(_SENT, [])
        own = _Block(texts, least, anchor)
        told = np.sort(np.concatenate([B.unpack(x.as_py(), _HASH) for x in answers["hashes"]]))
        mine = own.gram[own.anchor] & _LOW
        shared = told[np.minimum(np.searchsorted(told, mine), len(told) - 1)] == mine
        stretch, at = own.stretch[shared], own.at[shared]
        keys, first, repeated = _first_of(stretch)
        places, width = at[first], B.index_width(len(own.words.start))
        cuts = np.searchsorted(B.bucket_of(keys, buckets), np.arange(buckets + 1))
        block, out = texts["block"][0].as_py(), []
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            if i < j:
                docs = np.unique(own.doc[places[i:j]])
                out.append((b, block, width, B.pack(keys[i:j], _HASH), repeated[i:j].tobytes(), B.pack(places[i:j], width),
                            *_pack_ids(own.ids[docs]), B.pack(own.words.bounds[docs], width)))
        return _table(_SENT, out)
    return extend


def _spans(least: int, anchor: int):
    def spans(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(texts, least, anchor)
        n = len(own.words.start)
        # What is told names the first place of a stretch in the block; it holds for all its places.
        told, first, owner = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, np.int64)
        for row in answers.to_pylist():
            places = B.unpack(row["places"], row["width"]).astype(np.int64)
            told[places] = True
            first[places] = np.frombuffer(row["firsts"], bool)
            owner[places] = _unpack_ids(row["owners"], row["lowest"], row["id_width"])
        order = np.argsort(own.stretch, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = own.stretch[order][1:] != own.stretch[order][:-1]
        lead = np.empty(len(order), np.int64)
        lead[order] = own.at[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else lead
        hit = told[lead]
        at, lead = own.at[hit], lead[hit]
        inside = cover(at, least, n)
        removed = cover(at[~((at == lead) & first[lead])], least, n)
        edges = np.zeros(n + 1, bool)
        edges[own.words.bounds] = True
        begins = inside & (edges[:-1] | ~np.concatenate(([False], inside[:-1])))
        ends = inside & (edges[1:] | ~np.concatenate((inside[1:], [False])))
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = own.doc[start]
        base = own.words.bounds[:-1][doc]
        sums = np.concatenate(([0], np.cumsum(removed)))
        # Stretches are in place order: those of one span stand together.
        lowest = np.minimum.reduceat(owner[lead], np.searchsorted(at, start)) if len(start) else np.zeros(0, np.int64)
        return pa.table([
            pa.array(own.ids[doc], mask=~own.known[doc]), pa.array((start - base).astype(np.int32)),
            pa.array((end - base).astype(np.int32)), pa.array((end - start).astype(np.int64)),
            pa.array((sums[end] - sums[start]).astype(np.int64)), pa.array(lowest, mask=lowest == _LAST)],
            names=["doc_id", "start_word", "end_word", "n_words", "n_removed", "first_doc_id"])
    return spans


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS,
                 anchor: int = ANCHOR_WORDS, block_bytes: int = B.BLOCK_BYTES,
                 bucket_bytes: int = B.BUCKET_BYTES) -> DataFrame:
    """One row per maximal span of at least ``least`` words that occurs elsewhere, too."""
    if not 0 < anchor <= least:
        raise ValueError("anchor must lie between 1 and least")
    size = B.text_size(docs, text_col)
    buckets = B.parts_for(size, bucket_bytes)
    texts = B.with_block(docs, id_col, text_col, B.parts_for(size, block_bytes))
    blocks = texts.groupBy("block")
    suffixes = blocks.applyInArrow(_send_suffixes(least, anchor, buckets), _SENT)
    shared = suffixes.groupBy("bucket").applyInArrow(_shared_suffixes, _TOLD)
    stretches = blocks.cogroup(shared.groupBy("block")).applyInArrow(_extend(least, anchor, buckets), _SENT)
    found = stretches.groupBy("bucket").applyInArrow(_first_occurrences, _FOUND)
    return blocks.cogroup(found.groupBy("block")).applyInArrow(_spans(least, anchor), RESULT)
