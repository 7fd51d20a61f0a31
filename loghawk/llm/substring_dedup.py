"""Substring de-duplication: Rabin-Karp hashes of every fixed-length word window.

1. Documents are grouped into blocks (one shuffle of the text, reused below).
2. A block hashes every ``window``-word window of its whole texts and sends each
   distinct hash once, from its document with the smallest id, to the hash's bucket.
3. A bucket sorts its hashes, takes each hash's smallest document over all blocks
   and returns the entries that start in a larger one.
4. The block hashes its texts again, adds what it knows itself (a larger document
   of the same block, more places in the same document), merges the windows into
   maximal word intervals and removes them.

A passage that a third of all documents share costs one entry a block, never a
group of documents. Hashes keep 56 bits beside the bucket's range; two different
windows share one with probability below 2**-56 a pair.

Edge cases: a null text has no words; a null id is neither smaller nor larger
than another, so that row keeps all its words; rows that repeat an id are judged
each on their own text, and none of them counts as the smaller one; shorter
texts have no window; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loghawk.llm import blocks as B
from loghawk.llm import text as T

WINDOW_WORDS = 13
HASH_BYTES = 7
_PACKED = ("bucket int, block int, width int, hashes binary, firsts binary, lowest long, id_width int, docs binary, "
           "starts binary")
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _entries(table: pa.Table, window: int):
    """Window hashes of a block's documents, sorted by (hash, document, place).

    Documents are put in id order, null ids last, so that a smaller number means
    a smaller id; equal ids share a rank.
    """
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table["doc_id"].combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = T.split_words(table["text"])
    hashes, at = T.windows(T.word_hashes(words), words.bounds, window)
    doc = words.docs[at]
    usable = known[doc]
    hashes, at, doc = hashes[usable], at[usable], doc[usable]
    order = np.argsort(hashes, kind="stable")
    return words, ids, hashes[order], at[order], doc[order]


def _run_starts(values: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def _send(window: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        words, ids, hashes, at, _ = _entries(table, window)
        new = _run_starts(hashes)
        hashes, at = hashes[new], at[new]  # sorted by place within a hash: the smallest document
        bucket_at = B.bucket_of(hashes, buckets)
        order = np.lexsort((at, bucket_at))
        hashes, at = hashes[order], at[order]
        width = B.index_width(len(words.start))
        lowest = int(ids.min())
        above = ids.view(np.uint64) - np.uint64(lowest & 0xFFFFFFFFFFFFFFFF)  # modulo 2**64, so for any ids
        id_width = max(1, -(-int(above.max()).bit_length() // 8))
        cuts = np.searchsorted(bucket_at, np.arange(buckets + 1))
        out = []
        for bucket in range(buckets):
            a, b = cuts[bucket], cuts[bucket + 1]
            if a == b:
                continue
            owner = np.unique(np.searchsorted(words.bounds, at[a:b], side="right") - 1)
            out.append((bucket, block, width, B.pack(hashes[a:b], HASH_BYTES), B.pack_ascending(at[a:b], width), lowest, id_width,
                        B.pack(above[owner], id_width), B.pack(words.bounds[owner], width)))
        cols = list(zip(*out)) or [[]] * 9
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(),
                 pa.binary()]
        names = ["bucket", "block", "width", "hashes", "firsts", "lowest", "id_width", "docs", "starts"]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)
    return send


def _answer(table: pa.Table) -> pa.Table:
    """For each block, the places whose window starts in a smaller document."""
    rows = table.to_pydict()
    hashes, ids, firsts, part = [], [], [], []
    for k in range(len(rows["hashes"])):
        hashes.append(B.unpack(rows["hashes"][k], HASH_BYTES))
        width, at = rows["width"][k], B.unpack_ascending(rows["firsts"][k], rows["width"][k]).astype(np.int64)
        starts = B.unpack(rows["starts"][k], width).astype(np.int64)
        above = B.unpack(rows["docs"][k], rows["id_width"][k])
        own = (above + np.uint64(rows["lowest"][k] & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
        ids.append(own[np.searchsorted(starts, at, side="right") - 1])
        rows["hashes"][k] = rows["firsts"][k] = None
        firsts.append(at)
        part.append(np.full(len(at), k, np.int32))
    hashes, ids, firsts, part = (np.concatenate(x) for x in (hashes, ids, firsts, part))
    order = np.argsort(hashes, kind="stable")
    new = _run_starts(hashes[order])
    smallest = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[ids[order] > smallest]
    out = {"block": [], "width": [], "places": []}
    hit = hit[np.lexsort((firsts[hit], part[hit]))]  # by part, then place: one sort, however many parts
    cuts = np.flatnonzero(_run_starts(part[hit]))
    for a, e in zip(cuts, np.append(cuts[1:], len(hit))):
        k = part[hit[a]]
        width = rows["width"][k]
        out["block"].append(rows["block"][k])
        out["width"].append(width)
        out["places"].append(B.pack_ascending(firsts[hit[a:e]], width))
    return pa.table([pa.array(out["block"], pa.int32()), pa.array(out["width"], pa.int32()),
                     pa.array(out["places"], pa.binary())], names=["block", "width", "places"])


def cover(places: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` words starting at one of ``places``."""
    marks = np.bincount(places, minlength=n + 1) - np.bincount(places + size, minlength=n + 1)
    return np.cumsum(marks[:n]) > 0


def _finish(window: int):
    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        words, ids, hashes, at, doc = _entries(texts, window)
        group = np.cumsum(_run_starts(hashes)) - 1
        if len(hashes):
            smallest = np.minimum.reduceat(ids[doc], np.flatnonzero(_run_starts(hashes)))[group]
        else:
            smallest = np.zeros(0, np.int64)
        gone = ids[doc] > smallest
        places = [B.unpack_ascending(p.as_py(), w.as_py()) for p, w in zip(answers["places"], answers["width"])]
        if places and len(hashes):
            told = np.isin(at, np.concatenate(places).astype(np.int64))
            gone |= np.bincount(group, told, minlength=group[-1] + 1)[group] > 0
        removed = cover(at[gone], window, len(words.start))
        out_sha, out_n, spans = [], [], []
        body = words.data.tobytes()
        for d in range(len(words.bounds) - 1):
            a, b = words.bounds[d], words.bounds[d + 1]
            own = removed[a:b]
            n = int(own.sum())
            if n:
                keep = np.flatnonzero(~own) + a
                step = np.diff(np.concatenate(([0], own.astype(np.int8), [0])))
                spans.append([{"start": int(s), "end": int(e)}
                              for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
            else:
                keep = np.arange(a, b)
                spans.append([])
            kept = b" ".join([body[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist())])
            out_sha.append(hashlib.sha256(kept).hexdigest())
            out_n.append(n)
        return pa.table([texts["doc_id"].combine_chunks().cast(pa.int64()), pa.array(words.counts, pa.int64()),
                         pa.array(out_n, pa.int64()), pa.array(out_sha, pa.string()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                        names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])
    return finish


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW_WORDS, block_bytes: int = B.BLOCK_BYTES,
                    bucket_bytes: int = B.BUCKET_BYTES) -> DataFrame:
    """One row per document: words, removed words, digest of the kept words, removed word spans."""
    size = B.text_size(docs, text_col)
    buckets = B.parts_for(size, bucket_bytes)
    texts = B.with_block(docs, id_col, text_col, B.parts_for(size, block_bytes))
    sent = texts.groupBy("block").applyInArrow(_send(window, buckets), _PACKED)
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block int, width int, places binary")
    return (texts.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(_finish(window), RESULT))
