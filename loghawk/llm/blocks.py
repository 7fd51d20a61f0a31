"""Blocks of documents and buckets of hashes: the exchange behind the repeat operators.

Documents are grouped into blocks by a hash of their id. A block sends each of
its distinct hashes once, packed, to the bucket that owns the hash's range, so
that a bucket holds at most one entry per block and hash, however often a
passage occurs. The bucket answers with entries of the block, and the block,
read again from the same shuffle, applies the answer to its texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes in a block (one task's working set) and behind a bucket of hashes.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20


def text_size(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in the table, from one pass over the text column."""
    return docs.select(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def parts_for(size: int, each: int) -> int:
    return max(1, -(-size // each))


def with_block(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """(doc_id, text, block); a null id is spread by its text."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.pmod(key, F.lit(blocks)).cast("int").alias("block"))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Range bucket by the upper 32 bits; ascending in the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def pack(values: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of each unsigned value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :width] = body
    return out.view("<u8").ravel()


def pack_ascending(values: np.ndarray, width: int) -> bytes:
    """Gaps between ascending values, byte plane by byte plane: the upper planes are nearly
    all zero, and the shuffle's compression drops them."""
    gaps = np.diff(values.astype("<u8"), prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_ascending(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def index_width(n: int) -> int:
    return 3 if n <= 1 << 24 else 4
