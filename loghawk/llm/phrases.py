"""Phrase collocation mining on a weighted de Bruijn graph of words.

Per language, nodes are word sequences and an edge is a five-word gram, from its first four
words to its last four. Only longest grams are counted: every word position gives one gram of
up to five words, cut short by the end of its piece. The count of a shorter phrase is the
flow out of its node, the sum of the edges that begin with it, plus a correction for the
pieces that end with it (the short grams, which have no edge).

1. One pass counts the words of each language; a word seldom enough can't be part of a
   phrase and ends a piece for the steps below. The others are numbered by frequency.
2. Tasks count the grams of about a million positions at a time and send them, packed to some
   ten bytes, to the bucket of their first two words. Two-word prefixes with a large share of a
   sample are dealt by their third word also, and so on; their flows arrive in parts and are
   summed afterwards. Beyond ``FAN`` buckets, grams pass through groups of buckets first.
3. A bucket sums equal grams, sorts them and takes the flows of all prefixes. Unary paths
   are compacted: prefixes whose whole flow goes on to one longer gram are one row with it.
4. Left and right parts of the phrases find their counts by joins; the lowest score over the
   cuts counts, in exact decimals. A phrase is dropped if a one-word longer one, to its left
   or right, has its count (or ``absorb`` percent of it): any longer phrase around it implies
   such a one, as counts don't grow with length. Each task keeps the ``top`` rows a language
   before they meet.

Nothing is sampled but the choice of prefixes to deal further, which doesn't change results.
Where the frequent words of all languages exceed ``DICTIONARY_WORDS`` or their bytes
``DICTIONARY_BYTES``, grams are counted as arrays of words instead, by Spark alone.

Edge cases: a null text is empty; a null language is ``und``; equal rows count each; ids aren't
read; extra columns are ignored; an empty table, or one without frequent phrases, gives no rows;
long texts are read in chunks of some 1 MB that look four words ahead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loghawk.llm.blocks import pack, pack_ascending, parts_for, unpack, unpack_ascending
from loghawk.llm.text import SLICE_BYTES, byte_set, mix, slices, split_words, text_bytes, word_hashes
from loghawk.session import scratch_path

LONGEST, LEAST, ABSORB, TOP = 5, 100, 100, 2000
#: Numbered words at most (21 bits a word, 0 is none) and their bytes; both bound what is broadcast.
BITS = 21
DICTIONARY_WORDS, DICTIONARY_BYTES = (1 << BITS) - 1, 64 << 20
#: Grams that a task gathers before it sends them, positions behind a bucket, buckets of one exchange.
GATHER, BUCKET_GRAMS, FAN = 1 << 20, 1 << 20, 8192
#: Words of the sample that finds common prefixes, and the share that makes one common.
SAMPLE_WORDS, COMMON_SHARE = 1 << 18, 512

_BREAKS = byte_set(b".,;:!?\n\v\f\r")
_SEPARATORS = _BREAKS | byte_set(b" \t")
_MASK = np.uint64((1 << BITS) - 1)


def _lang_key(lang: str, seed: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little"))


def _next(data: np.ndarray, at: int, separator: bool) -> int:
    """The first place from ``at`` on that is (or isn't) a separator."""
    while at < len(data):
        hit = np.flatnonzero(_SEPARATORS[data[at:at + 4096]] == separator)
        if len(hit):
            return at + int(hit[0])
        at += 4096
    return len(data)


def _chunks(data: np.ndarray, most: int):
    """(start, end, end with the words looked at): cuts between words, each text byte in one chunk."""
    start = 0
    while start < len(data):
        end = ahead = _next(data, min(start + most, len(data)), True)
        for _ in range(LONGEST - 1):
            ahead = _next(data, _next(data, ahead, False), True)
        yield start, end, ahead
        start = end


class _Piecewise:
    """Words of some texts: hash of language and word, piece number, and how many count as their own."""

    def __init__(self, texts, langs: list[str], seed: int, own_bytes: int | None = None):
        words = split_words(texts, lower=True, space=_SEPARATORS)
        known = {lang: _lang_key(lang, seed) for lang in set(langs)}
        self.words, self.lang = words, words.docs
        key = np.array([known[lang] for lang in langs], np.uint64)
        self.key = mix(word_hashes(words) ^ key[self.lang])
        breaks = np.cumsum(_BREAKS[words.data], dtype=np.int32)
        self.piece = breaks[words.start] + self.lang if len(words.start) else np.zeros(0, np.int64)
        self.own = len(words.start) if own_bytes is None else int(np.searchsorted(words.start, own_bytes))


def _pieces(batches, seed: int):
    """The texts of the batches in runs of about 1 MB; a longer text in chunks."""
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").to_pylist()
            data, offsets = text_bytes(part.column("text"))
            if len(data) <= 2 * SLICE_BYTES:
                yield _Piecewise(part.column("text"), langs, seed), langs
                continue
            for start, end, ahead in _chunks(data, SLICE_BYTES):  # one row
                raw = data[start:ahead].tobytes()
                text = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(raw)], np.int32)), pa.py_buffer(raw))
                yield _Piecewise(text, langs, seed, end - start), langs


VOCABULARY = "lang string, word string, key long, n long"


def _count_words(batches, seed: int):
    """Counts of a task's words, handed on when many are held."""
    names = [field.split()[0] for field in VOCABULARY.split(", ")]
    keys, counts, words, of_lang = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(of_lang, pa.string()), pa.array(words, pa.string()),
                                           pa.array(keys.view(np.int64)), pa.array(counts)], names=names)

    for p, langs in _pieces(batches, seed):
        own = p.key[:p.own]
        found, first, n = np.unique(own, return_index=True, return_counts=True)
        at = np.searchsorted(keys, found)
        seen = np.zeros(len(found), bool)
        inside = at < len(keys)
        seen[inside] = keys[at[inside]] == found[inside]
        counts[at[seen]] += n[seen]
        new = np.flatnonzero(~seen)
        if len(new):
            data = p.words.data.tobytes()
            fresh = [data[p.words.start[i]:p.words.end[i]].decode() for i in first[new]]
            order = np.argsort(np.concatenate((keys, found[new])), kind="stable")
            words = words + fresh
            of_lang = of_lang + [langs[p.lang[i]] for i in first[new]]
            words, of_lang = [words[i] for i in order], [of_lang[i] for i in order]
            keys, counts = np.concatenate((keys, found[new]))[order], np.concatenate((counts, n[new]))[order]
        if len(keys) > 1 << 18:
            yield out()
            keys, counts, words, of_lang = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], []
    yield out()


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, key, n) of all words, and the seed for which no two of them share a key."""
    seed = 0
    while True:
        found = _stored(docs.mapInArrow(lambda batches, s=seed: _count_words(batches, s), VOCABULARY)
                        .groupBy("lang", "word", "key").agg(F.sum("n").alias("n")), "phrase-words")
        if not found.groupBy("key").count().where("count > 1").limit(1).count():
            return found, seed
        seed += 1


class _Dictionary:
    """Frequent words, numbered from 1 by falling count."""

    def __init__(self, table: pa.Table):
        key = table.column("key").to_numpy().view(np.uint64)
        order = np.lexsort((key, -table.column("n").to_numpy()))
        self.words = table.column("word").combine_chunks().take(pa.array(order))
        self.langs = table.column("lang").combine_chunks().take(pa.array(order)).dictionary_encode()
        self.keys = np.sort(key)
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(1, len(order) + 1)
        self.numbers = number[np.argsort(key)]

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], 0)


def _grams(p: _Piecewise, known: _Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """(first two words, further three) of the longest gram at each own position, if it has two words."""
    number = known.lookup(p.key)
    n, cols = len(number), []
    valid = number[:p.own] > 0
    for k in range(LONGEST):
        at = np.minimum(np.arange(p.own) + k, n - 1) if n else np.zeros(0, np.int64)
        inside = np.arange(p.own) + k < n
        valid = valid & inside & (p.piece[at] == p.piece[:p.own]) & (number[at] > 0)
        cols.append(np.where(valid, number[at], 0).astype(np.uint64))
    b = np.uint64(BITS)
    hi, lo = cols[0] << b | cols[1], (cols[2] << b | cols[3]) << b | cols[4]
    keep = cols[1] > 0
    return hi[keep], lo[keep]


def _merged(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None = None):
    """Equal grams summed, ascending."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    if not len(hi):
        return hi, lo, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
    ones = np.ones(len(hi), np.int64) if counts is None else counts[order]
    return hi[first], lo[first], np.add.reduceat(ones, first)


def _isin(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


class _Common:
    """Prefixes of two to four words that are dealt by one more word."""

    def __init__(self, rows):
        self.by_size = {}
        for size in (2, 3, 4):
            hi, lo = (np.array([r[name] for r in rows if r["size"] == size], np.int64).view(np.uint64) for name in ("hi", "lo"))
            self.by_size[size] = np.sort(self._key(hi, lo))

    @staticmethod
    def _key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return mix(mix(hi) ^ lo)

    def among(self, hi: np.ndarray, lo: np.ndarray, size: int) -> np.ndarray:
        """Whether the prefix of ``size`` words is common."""
        return _isin(self._key(hi, _prefix(lo, size)), self.by_size[size]) if size < LONGEST else np.zeros(len(hi), bool)

    def deal(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The hash that finds a gram's bucket: of its first two words, or of a longer prefix after a common one."""
        dealt, deeper = self._key(hi, _prefix(lo, 2)), self.among(hi, lo, 2)
        for size in (3, 4, 5):
            dealt = np.where(deeper, self._key(hi, _prefix(lo, size)), dealt)
            deeper = deeper & self.among(hi, lo, size)
        return dealt


def _prefix(lo: np.ndarray, size: int) -> np.ndarray:
    """The further three words with those behind the first ``size`` of the gram blanked."""
    shift = np.uint64(BITS * (LONGEST - size))
    return lo >> shift << shift if size > 2 else np.zeros_like(lo)


def _messages(bucket: np.ndarray, grams) -> pa.RecordBatch:
    """One packed row a bucket, of merged grams in order of bucket, then gram."""
    hi, lo, counts = grams
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    bodies = []
    for a, e in zip(cuts, ends):
        thirds = [np.ascontiguousarray(((lo[a:e] >> np.uint64(shift)) & _MASK).view(np.uint8).reshape(-1, 8)[:, :3].T).tobytes()
                  for shift in (2 * BITS, BITS, 0)]
        bodies.append(int(e - a).to_bytes(4, "little") + pack_ascending(hi[a:e], 6) + b"".join(thirds)
                      + pack(counts[a:e].astype(np.uint64), 5))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(bodies, pa.binary())],
                                      names=["bucket", "body"])


def _read(body: bytes):
    n = int.from_bytes(body[:4], "little")
    hi, at, lo = unpack_ascending(body[4:4 + 6 * n], 6), 4 + 6 * n, np.zeros(n, np.uint64)
    for _ in range(3):
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :3] = np.frombuffer(body, np.uint8, 3 * n, at).reshape(3, n).T
        lo, at = lo << np.uint64(BITS) | planes.view("<u8").ravel(), at + 3 * n
    return hi, lo, unpack(body[at:], 5).astype(np.int64)


def _send(held: list, common: _Common, buckets: int, each: int) -> pa.RecordBatch:
    """Gathered grams -> messages to groups of ``each`` buckets."""
    counts = np.concatenate([h[2] for h in held]) if held and held[0][2] is not None else None
    hi, lo, counts = _merged(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), counts)
    to = (common.deal(hi, lo) % np.uint64(buckets)) // np.uint64(each)
    order = np.argsort(to, kind="stable")
    return _messages(to[order], (hi[order], lo[order], counts[order]))


def _gathered(parts, common: _Common, buckets: int, each: int):
    """Messages from a stream of (hi, lo, counts or None)."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= GATHER:
            yield _send(held, common, buckets, each)
            held, size = [], 0
    if size:
        yield _send(held, common, buckets, each)


FLOWS = "lang string, gram array<string>, least int, f long"


def _flows(table: pa.Table, known: _Dictionary, common: _Common, least: int) -> pa.Table:
    """A bucket's messages -> compacted paths: a gram, its count, and the shortest prefix with the same count."""
    parts = [_read(body) for body in table.column("body").to_pylist()]
    hi, lo, counts = _merged(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
    flow, kept, part_of = {}, {}, {}
    for size in range(2, LONGEST + 1):
        node = _prefix(lo, size)
        first = np.concatenate(([True], (hi[1:] != hi[:-1]) | (node[1:] != node[:-1])))
        starts = np.flatnonzero(first)
        total = np.zeros(len(hi), np.int64)
        total[starts] = np.add.reduceat(counts, starts)
        if size > 2:  # a gram that ends before has no such prefix; it sorts first below its node
            total[(node >> np.uint64(BITS * (LONGEST - size))) & _MASK == 0] = 0
        part_of[size] = common.among(hi, lo, size) & (total > 0)
        flow[size], kept[size] = total, (total >= least) | part_of[size]
    shortest, done = np.full(len(hi), 2), []
    for size in range(2, LONGEST + 1):
        on = kept[size]
        if size < LONGEST:  # the whole flow goes on: one row with the longer gram
            on = on & ~((flow[size + 1] == flow[size]) & ~part_of[size] & ~part_of[size + 1])
        at = np.flatnonzero(on)
        done.append((hi[at], _prefix(lo[at], size), shortest[at], flow[size][at], size))
        if size < LONGEST:
            merged = kept[size] & ~on
            shortest = np.where(merged, shortest, size + 1)
    numbers, sizes, of_lang, leasts, f = [], [], [], [], []
    for h, rest, short, total, size in done:
        shifts = [(h, BITS), (h, 0), (rest, 2 * BITS), (rest, BITS), (rest, 0)][:size]
        words = np.stack([(x >> np.uint64(s)) & _MASK for x, s in shifts], axis=1) if len(h) else np.zeros((0, size), np.uint64)
        numbers.append(words.ravel().astype(np.int64) - 1)
        of_lang.append(words[:, 0].astype(np.int64) - 1)
        sizes.append(np.full(len(h), size))
        leasts.append(short)
        f.append(total)
    ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
    grams = pa.ListArray.from_arrays(pa.array(ends), known.words.take(pa.array(np.concatenate(numbers))))
    langs = known.langs.take(pa.array(np.concatenate(of_lang))).cast(pa.string())
    return pa.table({"lang": langs, "gram": grams, "least": pa.array(np.concatenate(leasts).astype(np.int32)),
                     "f": pa.array(np.concatenate(f))})


def _common_prefixes(docs: DataFrame, seed: int, known, words: int, share: int) -> _Common:
    """Prefixes with more than 1 / share of a sample's grams: fewer than ``share`` of each size."""
    def count(batches):
        held = [_grams(p, known.value) for p, _ in _pieces(batches, seed)]
        hi, lo = (np.concatenate([h[k] for h in held] or [np.zeros(0, np.uint64)]) for k in range(2))
        for size in (2, 3, 4):
            node = _prefix(lo, size)
            at = (node >> np.uint64(BITS * (LONGEST - size)) & _MASK > 0) if size > 2 else np.ones(len(hi), bool)
            a, b, n = _merged(hi[at], node[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), size, np.int32)), pa.array(a.view(np.int64)),
                                              pa.array(b.view(np.int64)), pa.array(n)], names=["size", "hi", "lo", "n"])

    one_in = max(1, words // SAMPLE_WORDS)
    sample = docs.where(F.pmod(F.xxhash64("text", "lang"), F.lit(one_in)) == 0)
    counts = sample.mapInArrow(count, "size int, hi long, lo long, n long").groupBy("size", "hi", "lo").agg(F.sum("n").alias("n"))
    largest = counts.where(F.col("n") > 1).orderBy(F.desc("n")).limit(3 * share)
    grams = counts.where("size = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return _Common(largest.where(F.col("n") * share > grams).collect())


def _paths(docs: DataFrame, seed: int, words: int, table: pa.Table, least: int, bucket_grams: int, share: int) -> DataFrame:
    """Compacted paths from packed grams."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(_Dictionary(table))
    buckets = parts_for(words, bucket_grams)
    common = _common_prefixes(docs, seed, known, words, share) if buckets > 1 else _Common([])
    each = 1 if buckets <= FAN else parts_for(buckets, int(buckets ** 0.5))
    ddl = "bucket int, body binary"

    def first(batches):
        yield from _gathered(((*_grams(p, known.value), None) for p, _ in _pieces(batches, seed)), common, buckets, each)

    def again(batches):
        parts = (_read(body) for batch in batches for body in batch.column("body").to_pylist())
        yield from _gathered(parts, common, buckets, 1)

    sent = docs.mapInArrow(first, ddl)
    if each > 1:
        groups = parts_for(buckets, each)
        sent = sent.repartitionById(groups, F.col("bucket")).select("bucket", "body").mapInArrow(again, ddl)
    return sent.groupBy("bucket").applyInArrow(lambda t: _flows(t, known.value, common, least), FLOWS)


def _plain_paths(docs: DataFrame, vocabulary: DataFrame, least: int) -> DataFrame:
    """The same flows by Spark alone, for more words than a dictionary may hold."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = docs.select("lang", F.explode(F.split(text, r"[.,;:!?\n-\r]")).alias("piece"))
    words = pieces.select("lang", F.regexp_extract_all("piece", F.lit(r"[^\x20\x09]+"), F.lit(0)).alias("ws")).where("size(ws) > 1")
    now = words.select("lang", F.explode(F.expr(f"transform(sequence(1, size(ws) - 1), i -> slice(ws, i, {LONGEST}))")).alias("gram")) \
        .groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("f"))
    out = None
    for size in range(LONGEST, 1, -1):  # longer flows first; each level sums the level above and the short grams
        level = now.where(F.size("gram") == size)
        kept = level.where(F.col("f") >= least).select("lang", "gram", F.lit(size).alias("least"), "f")
        out = kept if out is None else out.unionByName(kept)
        now = now.select("lang", F.slice("gram", 1, size - 1).alias("gram"), "f").groupBy("lang", "gram").agg(F.sum("f").alias("f"))
    return out


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  bucket_grams: int = BUCKET_GRAMS, share: int = COMMON_SHARE,
                  dictionary_words: int = DICTIONARY_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (lang, gram, f), frequent words in the same form, and (lang, n) of all words."""
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocabulary, seed = _vocabulary(docs)
    sizes = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = vocabulary.where(F.col("n") >= least)
    held = frequent.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang")),
                                                                  F.lit(0)).alias("size")).first()
    words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if held["n"] <= dictionary_words and held["size"] <= DICTIONARY_BYTES:
        paths = _paths(docs, seed, words, frequent.toArrow(), least, bucket_grams, share)
    else:
        paths = _plain_paths(docs, vocabulary, least)
    flows = _stored(paths, "phrase-paths").select(
        "lang", F.explode(F.sequence("least", F.size("gram"))).alias("size"), "gram", "f") \
        .select("lang", F.slice("gram", F.lit(1), F.col("size")).alias("gram"), "f")
    # Flows of common prefixes come in parts.
    flows = _stored(flows.groupBy("lang", "gram").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrase-counts")
    return flows, frequent.select("lang", F.array("word").alias("gram"), F.col("n").alias("f")), sizes


def cut_scores(phrases: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, gram, a, n, score, k, l, r): each phrase at its lowest-scoring cut."""
    counts = phrases.unionByName(words)
    cuts = phrases.withColumnRenamed("f", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)))
    left = counts.select("lang", F.col("gram").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("gram").alias("right"), F.col("f").alias("r"))
    joined = (cuts.withColumn("left", F.slice("gram", F.lit(1), F.col("k"))).join(left, ["lang", "left"])
              .withColumn("right", F.slice("gram", F.col("k") + 1, F.size("gram"))).join(right, ["lang", "right"])
              .join(sizes, "lang"))
    score = F.expr("(1000BD * cast(a as decimal(18, 0)) * cast(n as decimal(18, 0)))"
                   " div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))").cast("long")
    best = joined.groupBy("lang", "gram").agg(F.first("a").alias("a"), F.first("n").alias("n"),
                                              F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "gram", "a", "n", "best.*")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, absorb: int = ABSORB,
                 top: int = TOP, **parts) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, and the cut's place k."""
    phrases, words, sizes = phrase_counts(docs, text_col, lang_col, least, **parts)
    longer = phrases.where(F.size("gram") > 2).select(
        "lang", F.explode(F.array(F.expr("slice(gram, 1, size(gram) - 1)"), F.expr("slice(gram, 2, size(gram) - 1)"))).alias("gram"),
        "f").groupBy("lang", "gram").agg(F.max("f").alias("longer"))
    kept = cut_scores(phrases, words, sizes).join(longer, ["lang", "gram"], "left") \
        .where(F.coalesce(F.col("longer") * 100 < F.col("a") * absorb, F.lit(True)))
    phrase: Column = F.array_join("gram", " ")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order).cast("long")) \
        .where(F.col("rank") <= top) \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("k"))
