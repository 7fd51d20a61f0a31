"""Quality rules: hashed n-gram likelihood ratio of trusted target against raw corpus.

The corpus is counted twice as a multinomial over ``buckets`` hashed word uni- and
bigrams: all documents (raw) and the trusted ones among them (target). A text's
score is the sum of ``log(p_target / p_raw)`` over its n-grams, divided by their
number. A text is kept if it passes the base rules and its score reaches the fixed
``threshold``, whatever else is in the corpus at hand; nothing is drawn at random.

``p_raw = (raw - own + 1) / (R - n + buckets)``, where ``own`` and ``n`` are the text's
own n-grams, so that no text is held against itself; ``p_target = (target + buckets *
p_raw) / (T + buckets)``: with few trusted texts the ratio tends to 1 and rejects
nothing. Counts are whole; one row a bucket reaches the driver, whatever the input.

``fit_distinct`` counts each distinct text (sequence of lower-cased words) once, in
raw, and in target if one of its copies is trusted; ``own`` then is the text's whole
class of copies, however many there are. ``fit`` counts the rows it is given.

Edge cases: a null or wordless text has zero counts, score 0 and fails the base
rules; trusted ids that no document has, repeated trusted ids and null ids add
nothing; extra columns are carried by ``apply_quality_rules`` and ignored elsewhere;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.llm import text as T
from loghawk.llm.substring_dedup import cover

BUCKETS = 1 << 13
#: Trusted ids, or classes of equal texts, that may be broadcast: about 32 MB.
BROADCAST_IDS = 1 << 20
THRESHOLD = -0.05
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _word_grams(words: T.Words, hashes: np.ndarray, buckets: int):
    pairs, at = T.windows(hashes, words.bounds, 2)
    doc = words.docs
    return (np.concatenate((hashes, pairs)) % np.uint64(buckets)).astype(np.int64), np.concatenate((doc, doc[at]))


def _grams(texts, buckets: int):
    """Bucket and document of every lower-cased uni- and bigram."""
    words = T.split_words(texts, lower=True)
    return _word_grams(words, T.word_hashes(words), buckets)


def _text_keys(words: T.Words, hashes: np.ndarray) -> np.ndarray:
    """64-bit hash of each text's word sequence; not verified (a false match halves two texts' counts)."""
    place = (np.arange(len(hashes)) - words.bounds[words.docs]).astype(np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(T.mix(hashes + T.mix(place + np.uint64(1))), out=sums[1:])
    return T.mix(sums[words.bounds[1:]] - sums[words.bounds[:-1]]).view(np.int64)


def _marked(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, good) of every row."""
    ids = trusted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    if ids.count() <= BROADCAST_IDS:  # else both sides are shuffled by id
        ids = F.broadcast(ids)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .join(ids.withColumn("good", F.lit(True)), "doc_id", "left")
            .select("text", F.coalesce("good", F.lit(False)).alias("good")))


def _counts(marked: DataFrame, buckets: int, classes=None) -> np.ndarray:
    """Raw and target count of every bucket over (text, good).

    ``classes`` is a broadcast of sorted keys, sizes and trust of the texts that occur
    more than once: each of their rows counts one part in the class's size.
    """
    def count(batches):
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for batch in batches:
            for part in T.slices(batch, "text"):
                words = T.split_words(part.column(0), lower=True)
                hashes = T.word_hashes(words)
                bucket, doc = _word_grams(words, hashes, buckets)
                good, weight = part.column(1).to_numpy(zero_copy_only=False).copy(), np.ones(part.num_rows)
                if classes is not None and len(classes.value[0]):
                    keys, sizes, trust = classes.value
                    own = _text_keys(words, hashes)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    again = keys[at] == own
                    weight[again], good[again] = 1 / sizes[at[again]], trust[at[again]]
                raw += np.bincount(bucket, weight[doc], minlength=buckets)
                target += np.bincount(bucket, (weight * good)[doc], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])],
                                         names=["bucket", "raw", "target"])

    rows = (marked.mapInArrow(count, "bucket long, raw double, target double")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    counts = np.zeros((2, buckets))
    counts[:, rows["bucket"].to_numpy()] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    return np.rint(counts)  # a class's parts add up to whole numbers


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        buckets: int = BUCKETS) -> np.ndarray:
    """Raw and target count of every bucket; ``trusted`` holds the ids of trusted documents."""
    return _counts(_marked(docs, trusted, id_col, text_col), buckets)


def fit_distinct(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 buckets: int = BUCKETS, most_classes: int = BROADCAST_IDS) -> np.ndarray:
    """``fit`` over the distinct texts; one is trusted if a row with it is.

    Up to ``most_classes`` repeated texts are broadcast as keys; beyond, one text of each
    class is kept by an aggregation with map-side combining, which shuffles the texts.
    """
    marked = _marked(docs, trusted, id_col, text_col)

    def key(batches, carry=False):
        for batch in batches:
            for part in T.slices(batch, "text"):
                words = T.split_words(part.column(0), lower=True)
                keys = pa.array(_text_keys(words, T.word_hashes(words)))
                cols, names = [keys, part.column(1)], ["key", "good"]
                if carry:
                    cols, names = [*cols, part.column(0)], [*names, "text"]
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(words.counts > 0))

    repeated = (marked.mapInArrow(key, "key long, good boolean")
                .groupBy("key").agg(F.count("*").alias("n"), F.max("good").alias("good")).where("n > 1")
                .limit(most_classes + 1).toArrow())
    if repeated.num_rows > most_classes:
        one = (marked.mapInArrow(lambda batches: key(batches, True), "key long, good boolean, text string")
               .groupBy("key").agg(F.first("text").alias("text"), F.max("good").alias("good")))
        return _counts(one.select("text", "good"), buckets)
    repeated = repeated.sort_by("key")
    classes = docs.sparkSession.sparkContext.broadcast(tuple(
        repeated[c].to_numpy() for c in ("key", "n", "good")))
    return _counts(marked, buckets, classes)


def text_stats(texts) -> dict[str, np.ndarray]:
    """Base counts of every text."""
    data, offsets = T.text_bytes(texts)
    words = T.split_words(texts)
    n_docs = len(offsets) - 1

    def per_doc(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    inside = ~T._SPACE[data] & ((data & 0xC0) != 0x80)  # the first byte of each character in a word
    newline = np.flatnonzero(data == 0x0A)
    first = np.sort(np.concatenate((offsets[:-1], newline + 1)))
    last = np.sort(np.concatenate((newline, offsets[1:])))
    has_word = np.searchsorted(words.start, last) > np.searchsorted(words.start, first)
    first, last = first[has_word], last[has_word]
    line_doc = np.searchsorted(offsets, first, side="right") - 1
    salt = T.mix(np.arange(1, n_docs + 1, dtype=np.uint64))
    lines = T.mix(T.word_hashes(T.Words(words.data, first, last, words.bounds)) ^ salt[line_doc])
    _, once = np.unique(lines, return_index=True)
    dup_lines = np.bincount(line_doc, minlength=n_docs) - np.bincount(line_doc[once], minlength=n_docs)
    grams, at = T.windows(T.word_hashes(words), words.bounds, REPEAT_WINDOW)
    _, back, times = np.unique(T.mix(grams ^ salt[words.docs[at]]), return_inverse=True, return_counts=True)
    repeated = cover(at[times[back] > 1], REPEAT_WINDOW, len(words.start))
    return {"n_words": words.counts.astype(np.int64), "word_chars": per_doc(inside, offsets),
            "n_symbols": per_doc(_SYMBOL[data], offsets), "n_dup_lines": dup_lines.astype(np.int64),
            "n_repeat_words": per_doc(repeated, words.bounds)}


def ratio_scores(texts, counts: np.ndarray) -> np.ndarray:
    """Mean log(p_target / p_raw) over each text's n-grams; 0 without any."""
    (raw, target), buckets = counts, counts.shape[1]
    bucket, doc = _grams(texts, buckets)
    key, own = np.unique(doc * buckets + bucket, return_counts=True)
    doc, bucket = key // buckets, key % buckets
    grams = np.bincount(doc, own, minlength=len(texts))
    # A text that was not counted (scored only) may hold more than the corpus: at least 0.
    p_raw = (np.maximum(raw[bucket] - own, 0) + 1) / (np.maximum(raw.sum() - grams[doc], 0) + buckets)
    p_target = (target[bucket] + buckets * p_raw) / (target.sum() + buckets)
    return np.bincount(doc, own * np.log(p_target / p_raw), minlength=len(texts)) / np.maximum(grams, 1)


def judge(texts, counts: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    out = text_stats(texts)
    out["score"] = ratio_scores(texts, counts)
    words = out["n_words"]
    out["base_failed"] = (words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
    out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
    return out


def quality_report(docs: DataFrame, counts: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts, base_failed, score, kept."""
    model = docs.sparkSession.sparkContext.broadcast(counts)  # two numbers a bucket

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                got = judge(part.column(1), model.value, threshold)
                names = [*_STATS, "base_failed", "kept", "score"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[k]) for k in names)],
                                                 names=["doc_id", *names])

    stats = ", ".join(f"{k} long" for k in _STATS)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id long, {stats}, base_failed boolean, kept boolean, score double"))


def apply_quality_rules(docs: DataFrame, counts: np.ndarray, text_col: str = "text",
                        threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are kept, all columns unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(counts)
    index = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, text_col):
                yield part.filter(pa.array(judge(part.column(index), model.value, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)
