"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

Test items are the indexed side, by length class (up to 8, 16, 32 ... words). For each
class every training text is cut into overlapping passages, long enough that any
stretch of an item's length lies whole in one, and every passage is a query. Items are retrieved if their BM25 score reaches
``retrieve`` of the score the item gives itself. Postings are in item order and cut
into blocks; bounds are checked from loose to tight, and only what can still reach
the threshold goes on:

1. the sum of the passage's terms' largest impacts,
2. per block of items, the sum of the terms' largest impacts in that block,
3. the score itself, for the items of the blocks that are left.

A retrieved item is verified in its passage: at least ``overlap`` of its question's
five-word shingles, and of the words of its answer (the last ``answer_share`` of
the item), occur there. Shingles of the whole item may stand in for those of the
question, and must where the question is shorter than a shingle. Impacts are divided by the item's threshold, so that 1 is
the bar throughout.

The indexes hold at most ``index_items`` items and ``index_words`` words at a time (one
item at least); a larger benchmark is indexed and queried part by part, in the order of
the items' lengths. Item number, document frequencies and mean length are those of the
whole benchmark, and a class's passages have a fixed length, so that scores and passages
don't depend on the parts.

Edge cases: null texts are empty, match nothing and are kept; an item without words
is never retrieved; items with fewer than five words use one shingle of all their
words; repeated items are reported each under its id, repeated documents each on
its own; null ids, of items too, stay null; extra columns are carried; empty tables give no rows
(an empty benchmark: nothing is contaminated).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.llm import text as T

K1, BM25_B = 1.2, 0.75
RETRIEVE, OVERLAP, SHINGLE, ANSWER_SHARE = 0.5, 0.8, 5, 0.25
BLOCK_ITEMS, INDEX_ITEMS, INDEX_WORDS = 16, 20_000, 1 << 21
#: Longest items of the shortest length class, in words.
LEAST_LENGTH = 8
RESULT = ("doc_id long, item_id long, passage_start int, score double, item_overlap double, "
          "question_overlap double, answer_overlap double")


class Index(NamedTuple):
    ids: list              # item id of each item number
    terms: np.ndarray      # sorted term hashes
    top: np.ndarray        # largest impact of each term
    block_at: np.ndarray   # postings by block: term t owns block_at[t] .. block_at[t + 1]
    block: np.ndarray
    block_top: np.ndarray
    item_at: np.ndarray    # postings by item, in item order
    item: np.ndarray
    impact: np.ndarray
    words: list            # word hashes of each item
    passage: int           # passage length and step, in words
    step: int


def _sum_by(key: np.ndarray, value: np.ndarray):
    keys, back = np.unique(key, return_inverse=True)
    return keys, np.bincount(back, value, minlength=len(keys))


class Whole(NamedTuple):
    """What BM25 takes from the whole benchmark; ``df`` belongs to the sorted ``terms``."""
    n_items: int
    mean_length: float
    terms: np.ndarray
    df: np.ndarray


def length_class(n_words: int) -> int:
    """Most words of the items in the class: a power of two."""
    return max(LEAST_LENGTH, 1 << max(0, n_words - 1).bit_length())


def build_index(ids, texts, retrieve: float = RETRIEVE, whole: Whole | None = None) -> Index:
    """Index of items; ``whole`` says what they are a part of (None: they are all)."""
    words = T.split_words(texts, lower=True)
    hashes, doc = T.word_hashes(words), words.docs
    n_items = max(1, len(ids))
    terms, term = np.unique(hashes, return_inverse=True)
    pairs, tf = np.unique(term * n_items + doc, return_counts=True)
    term, item = pairs // n_items, pairs % n_items
    if whole is None:
        whole = Whole(n_items, words.counts.mean() if len(ids) else 1.0, terms, np.bincount(term, minlength=len(terms)))
    df = whole.df[np.searchsorted(whole.terms, terms)]
    idf = np.log1p((whole.n_items - df + 0.5) / (df + 0.5))
    length = words.counts / max(1.0, whole.mean_length)
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - BM25_B + BM25_B * length[item]))
    own = np.bincount(item, weight, minlength=n_items)
    impact = weight / (retrieve * own[item])
    top = np.zeros(len(terms))
    np.maximum.at(top, term, impact)
    blocks = -(-n_items // BLOCK_ITEMS)
    key = term * blocks + item // BLOCK_ITEMS
    block_key, back = np.unique(key, return_inverse=True)
    block_top = np.zeros(len(block_key))
    np.maximum.at(block_top, back, impact)
    edges = np.arange(len(terms) + 1)
    longest = length_class(int(words.counts.max()) if len(ids) else 0)
    split = [hashes[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:])]
    return Index(ids, terms, top, np.searchsorted(block_key // blocks, edges), block_key % blocks, block_top,
                 np.searchsorted(term, edges), item, impact, split, 2 * longest, longest)


def _postings(at: np.ndarray, query: np.ndarray, term: np.ndarray):
    """All postings of the (query, term) rows: query of each, and its place in the lists."""
    count = at[term + 1] - at[term]
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[term], count)
    return np.repeat(query, count), place


def _retrieve(index: Index, query: np.ndarray, term: np.ndarray, n_queries: int):
    """(passage, item, score) of every score of 1 or more; rows are distinct (passage, term)."""
    bar = 1 - 1e-9
    alive = np.bincount(query, index.top[term], minlength=n_queries) >= bar
    keep = alive[query]
    query, term = query[keep], term[keep]
    blocks = int(index.block.max()) + 1 if len(index.block) else 1
    q, place = _postings(index.block_at, query, term)
    key, bound = _sum_by(q * blocks + index.block[place], index.block_top[place])
    key = key[bound >= bar]
    if not len(key):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    keep = np.isin(query, key // blocks)
    q, place = _postings(index.item_at, query[keep], term[keep])
    keep = np.isin(q * blocks + index.item[place] // BLOCK_ITEMS, key)
    n_items = len(index.ids)
    key, score = _sum_by(q[keep] * n_items + index.item[place[keep]], index.impact[place[keep]])
    key, score = key[score >= bar], score[score >= bar]
    return key // n_items, key % n_items, score


def _shingles(hashes: np.ndarray) -> np.ndarray:
    size = min(SHINGLE, len(hashes))
    return np.unique(T.windows(hashes, np.array([0, len(hashes)]), size)[0]) if size else hashes


def _overlaps(item: np.ndarray, passage: np.ndarray) -> tuple[float, float, float]:
    """Shares of the item's shingles, its question's shingles and its answer's words in the passage."""
    size = min(SHINGLE, len(item))
    there = np.unique(T.windows(passage, np.array([0, len(passage)]), size)[0])
    cut = len(item) - max(1, round(ANSWER_SHARE * len(item)))
    share = lambda own: float(np.isin(own, there).mean()) if len(own) else 1.0
    question = item[:cut]
    return (share(_shingles(item)), share(_shingles(question)) if cut >= size else 1.0,
            float(np.isin(item[cut:], passage).mean()))


def _verified(item: np.ndarray, found: tuple[float, float, float], overlap: float) -> bool:
    """Question and answer, or item and answer, are there."""
    asks = len(item) - max(1, round(ANSWER_SHARE * len(item))) >= SHINGLE
    return found[2] >= overlap and (found[0] >= overlap or (asks and found[1] >= overlap))


def leaks(indexes: list[Index], texts, overlap: float = OVERLAP):
    """(document number, item id, first word of the passage, score, overlaps), best passage of each pair."""
    words = T.split_words(texts, lower=True)
    hashes = T.word_hashes(words)
    return [row for index in indexes if len(index.terms) for row in _leaks(index, words, hashes, overlap)]


def _leaks(index: Index, words: T.Words, hashes: np.ndarray, overlap: float):
    per_doc = np.where(words.counts > 0, np.maximum(1, -(-(words.counts - index.step) // index.step)), 0)
    first_passage = np.cumsum(per_doc) - per_doc
    term = np.searchsorted(index.terms, hashes)
    term[term == len(index.terms)] = 0
    known = np.flatnonzero(index.terms[term] == hashes)
    doc = words.docs[known]
    slot = (known - words.bounds[doc]) // index.step
    n = int(per_doc.sum())
    # A word lies in the passage that starts in its own step, and in the one a step before.
    here, before = slot < per_doc[doc], slot > 0
    query = np.concatenate(((first_passage[doc] + slot)[here], (first_passage[doc] + slot - 1)[before]))
    named = np.concatenate((term[known][here], term[known][before]))
    key = np.unique(query * len(index.terms) + named)
    passages, items, scores = _retrieve(index, key // len(index.terms), key % len(index.terms), n)
    best: dict[tuple, tuple] = {}
    owner = np.searchsorted(first_passage + per_doc, passages, side="right")
    for p, i, s, d in zip(passages.tolist(), items.tolist(), scores.tolist(), owner.tolist()):
        at = (p - int(first_passage[d])) * index.step
        a = int(words.bounds[d]) + at
        found = _overlaps(index.words[i], hashes[a:min(a + index.passage, int(words.bounds[d + 1]))])
        if _verified(index.words[i], found, overlap):
            row = (found[0], s, -at, found)
            if (d, i) not in best or row > best[d, i]:
                best[d, i] = row
    return [(d, index.ids[i], -row[2], row[1] * 1.0, *row[3]) for (d, i), row in sorted(best.items())]


def _document_frequencies(rows: DataFrame) -> DataFrame:
    def terms(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                words = T.split_words(part.column(0), lower=True)
                terms, term = np.unique(T.word_hashes(words), return_inverse=True)
                pairs = np.unique(term * part.num_rows + words.docs) // max(1, part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(terms[pairs].view(np.int64))], names=["term"])

    return rows.select("text").mapInArrow(terms, "term long").groupBy("term").agg(F.count("*").alias("df"))


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, retrieve: float, index_items: int, index_words: int):
    """Lists of indexes, one index a length class, of at most so many items and words, shortest items first."""
    spark = benchmark.sparkSession
    n_words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = (benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
            .withColumn("n_words", n_words))
    n_items, mean = rows.agg(F.count("*"), F.avg("n_words")).first()
    if not n_items:
        return
    frequencies = _document_frequencies(rows).persist()

    def build(items):
        texts = pa.array([r.text for r in items], pa.string())
        own = np.unique(T.word_hashes(T.split_words(texts, lower=True)))
        asked = spark.createDataFrame(pa.table({"term": own.view(np.int64)}))
        got = frequencies.join(asked, "term").toArrow()
        terms = got["term"].to_numpy().view(np.uint64)
        order = np.argsort(terms)
        whole = Whole(n_items, mean, terms[order], got["df"].to_numpy()[order])
        classes: dict[int, list] = {}
        for r in items:
            classes.setdefault(length_class(r.n_words), []).append(r)
        return [build_index([r.item_id for r in c], pa.array([r.text for r in c], pa.string()), retrieve, whole)
                for c in classes.values()]

    items, held = [], 0
    for r in rows.where("n_words > 0").orderBy("n_words", "item_id", "text").toLocalIterator():
        if items and (len(items) >= index_items or held + r.n_words > index_words):
            yield build(items)
            items, held = [], 0
        items.append(r)
        held += r.n_words
    if items:
        yield build(items)
    frequencies.unpersist()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", retrieve: float = RETRIEVE, overlap: float = OVERLAP,
                       index_items: int = INDEX_ITEMS, index_words: int = INDEX_WORDS) -> DataFrame:
    """One row per document and test item that it contains, with its best passage."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], RESULT)
    for indexes in _indexes(benchmark, item_col, "text", retrieve, index_items, index_words):
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches, shared=shared):
            for batch in batches:
                for part in T.slices(batch, "text"):
                    rows = leaks(shared.value, part.column(1), overlap)
                    ids = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                    cols = [[r[k] for r in rows] for k in range(1, 7)]
                    kinds = [pa.int64(), pa.int32()] + [pa.float64()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [ids, *(pa.array(c, k) for c, k in zip(cols, kinds))],
                        names=[x.split()[0] for x in RESULT.split(", ")])

        out = out.unionByName(texts.mapInArrow(run, RESULT))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                        retrieve: float = RETRIEVE, overlap: float = OVERLAP,
                        index_items: int = INDEX_ITEMS, index_words: int = INDEX_WORDS) -> DataFrame:
    """The rows whose text contains no test item, all columns unchanged."""
    column = docs.columns.index(text_col)
    for indexes in _indexes(benchmark, item_col, "text", retrieve, index_items, index_words):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches, shared=shared):
            for batch in batches:
                for part in T.slices(batch, text_col):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r[0] for r in leaks(shared.value, part.column(column), overlap)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
