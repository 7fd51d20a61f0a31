"""Fill-in-the-middle documents, cut at line boundaries.

Each text is cut in two places between its lines (``[^\\n]*\\n|[^\\n]+``) and written in
one of two orders: ``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix, middle;
each part follows its mark. Both cuts come from the text's boundary set
(``boundary_set.py``): the number of lines is its size less one, and the drawn cut
numbers are selected from it as code point offsets.

Draws are the hex digits of sha256("SEED:ID"), so that reruns and lost executors give
the same rows. There is no shuffle; a task holds some 1 MB of text, or one longer text,
at a time. A bitmap of a text's boundaries takes at most an eighth of a byte a code point.

Edge cases: a null text is empty; an empty text, a text that holds a mark, and a draw
beyond ``rate`` stay as they are (``plain``, no counts); a null id draws as an empty
string; rows with equal ids draw alike; ids keep their type; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loghawk.llm.boundary_set import line_boundaries
from loghawk.llm.text import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50


def draws(key: str, seed: int) -> tuple[int, ...]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in range(0, 32, 8))


def transform(text: str, key: str, seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, prefix code points, middle code points, output) of one text."""
    bounds = line_boundaries(text)
    n = len(bounds) - 1
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (bounds.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row a document: id, lines ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                done = [transform(text or "", key or "", seed, rate, spm_rate)
                        for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist())]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array([row[k] for row in done], kind) for k, kind in enumerate(kinds))],
                    names=schema.names)

    plain = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"),
                        F.col(text_col).alias("text"))
    schema = StructType([StructField(id_col, plain.schema["id"].dataType), StructField("n", LongType()),
                         StructField("form", StringType()), StructField("prefix_chars", LongType()),
                         StructField("middle_chars", LongType()), StructField("output", StringType())])
    return plain.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of; each mark occurs once in an output that isn't plain."""
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))
    middle = part(output, MIDDLE, 2)
    psm = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), middle, part(part(output, MIDDLE, 1), SUFFIX, 2))
    spm = F.concat(part(part(output, MIDDLE, 1), PREFIX, 2), middle, part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
