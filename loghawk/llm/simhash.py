"""SimHash near-duplicates found by the general pigeonhole principle.

1. A fingerprint bit is the majority of that bit over the XXH64 values of a
   text's word shingles. Equal fingerprints become one row at once.
2. The 64 bits are grouped so that correlated bits share a partition, from the
   bits' covariance over all fingerprints.
3. For each number of partitions a dynamic programme gives every partition its own
   threshold (-1: not probed) so that the thresholds sum to
   ``distance - partitions + 1``, at the least estimated number of keys and
   candidate pairs. The estimate comes from a bounded sample of fingerprints;
   it decides the cost, never the result: under any allocation of that sum, two
   fingerprints within the distance agree on some partition within its threshold.
4. Every fingerprint probes with its key of each partition (threshold 1 or 2:
   also with all keys one bit away, so that two such keys meet). Members of a key
   are compared, and the links that hold are thinned to a spanning forest.
5. A key with more than ``group_limit`` fingerprints isn't compared member by
   member. Its fingerprints meet at the values one bit away instead: two
   fingerprints differ in at most two bits if and only if they share such a value,
   and no value has more than 65 of them.
6. Components of the links give each document the smallest document id it reaches.

Edge cases: a null or wordless text has fingerprint zero, which links like any
other; a null id gets its component's smallest id (null if none has one) and is
never the smallest; repeated rows share a component; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loghawk.llm import text as T
from loghawk.llm.components import components

SHINGLE_WORDS, MAX_DISTANCE, BITS = 3, 2, 64
#: Fingerprints compared member by member under one key; beyond it, meeting at the
#: 65 values one bit away costs less than the comparisons.
GROUP_LIMIT = 8192
#: Cost of one shuffled key in compared pairs, for the allocation only.
KEY_COST = 100
#: Fingerprints behind the candidate estimate; bounds the driver's pairs.
SAMPLE = 2048


def _shingle_spans(words: T.Words, size: int):
    """The words joined by single spaces, and each shingle's bytes and document."""
    length = words.end - words.start
    first = np.cumsum(length + 1) - (length + 1)
    body = np.full(int((length + 1).sum()), 0x20, np.uint8)
    if len(length):
        source = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        body[np.repeat(first, length) + source] = words.data[np.repeat(words.start, length) + source]
    count = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    doc = np.repeat(np.arange(len(count)), count)
    at = words.bounds[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    until = np.minimum(at + size, words.bounds[1:][doc]) - 1
    return body.tobytes(), first[at], first[until] + length[until], count


def fingerprint_batch(texts, size: int = SHINGLE_WORDS) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    import xxhash
    body, start, end, count = _shingle_spans(T.split_words(texts, lower=True), size)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[a:b], 42) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        tail = np.cumsum(count)
        totals = np.zeros((len(some), BITS), np.int64)
        step = 1 << 18  # hashes unpacked at once
        for a in range(0, len(hashes), step):
            b = min(a + step, len(hashes))
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = np.searchsorted(tail[some], [a, b - 1], side="right")
            firsts = np.maximum((tail - count)[some][inside[0]:inside[1] + 1] - a, 0)
            totals[inside[0]:inside[1] + 1] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
        major = (2 * totals > count[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    return _keyed_prints(rows, "text", shingle).withColumnRenamed("row", "doc_id")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def bit_covariance(fps: DataFrame) -> np.ndarray:
    """64 x 64 covariance of the bits over all fingerprints (4,160 sums reach the driver)."""
    def run(batches):
        total = np.zeros((BITS + 1, BITS))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float64)
            total[:BITS] += bits.T @ bits
            total[BITS] += bits.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])
    rows = fps.select("fp").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((BITS + 1) * BITS)
    for r in rows:
        total[r["k"]] = r["v"]
    total = total.reshape(BITS + 1, BITS)
    n = max(1, fps.count())
    mean = total[BITS] / n
    return total[:BITS] / n - np.outer(mean, mean)


def correlated_partitions(cov: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size; correlated bits share a group."""
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    link = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(link, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(left, key=lambda b: (round(link[b, left].sum(), 6), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (round(link[b, group].mean(), 6), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _costs(groups: list[list[int]], sample: np.ndarray, n: int, most: int) -> list[list[float]]:
    """Estimated cost of each partition under thresholds -1 .. most: keys plus candidate pairs."""
    differ = sample[:, None] ^ sample[None, :]
    upper = np.triu_indices(len(sample), 1)
    out = []
    for group in groups:
        mask = np.uint64(sum(1 << b for b in group))
        apart = np.bitwise_count(differ[upper] & mask)
        row = [0.0]
        for t in range(most + 1):
            reach = 0 if t == 0 else 2  # keys one bit away meet at up to two bits
            uniform = sum(math.comb(len(group), j) for j in range(min(reach, len(group)) + 1)) / 2.0 ** len(group)
            share = ((apart <= reach).sum() + 10 * uniform) / (len(apart) + 10)
            row.append(KEY_COST * n * (1 if t == 0 else 1 + len(group)) + share * n * n / 2)
        out.append(row)
    return out


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1 .. distance) of least total cost that sum to distance - partitions + 1."""
    # In units of threshold + 1 the sum to reach is distance + 1.
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for units, more in enumerate(row):
                if used + units <= distance + 1:
                    now = (cost + more, [*chosen, units - 1])
                    if used + units not in step or now < step[used + units]:
                        step[used + units] = now
        best = step
    return best[distance + 1]


def plan_probes(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    n = fps.count()
    rows = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    if len(sample) < 2:
        return [(list(range(BITS)), distance)] if distance < 3 else [(list(range(0)), 0)]
    cov = bit_covariance(fps)
    options = []
    for parts in range(1, distance + 3):
        groups = correlated_partitions(cov, parts)
        cost, thresholds = allocate(_costs(groups, sample, n, min(distance, 2)), distance) \
            if parts * (min(distance, 2) + 1) >= distance + 1 else (math.inf, [])
        options.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def _keys(fp: Column, part: int, bits: list[int], threshold: int) -> list[Column]:
    mask = F.lit(_signed(sum(1 << b for b in bits))).cast("long")
    out = [fp.bitwiseAND(mask)]
    if threshold > 0:
        out += [fp.bitwiseXOR(F.lit(_signed(1 << b)).cast("long")).bitwiseAND(mask) for b in bits]
    return [F.struct(F.lit(part).alias("part"), k.alias("key")) for k in out]


def _forest(distance: int):
    """Members of each key -> a spanning forest of the links that hold."""
    def links(members: np.ndarray):
        left = np.unique(members)
        while len(left) > 1:  # grow one component after another; each member is compared once per wave
            root, wave = left[0], left[:1]
            left = left[1:]
            while len(wave) and len(left):
                hit = np.zeros(len(left), bool)
                for a in range(0, len(wave), 64):
                    hit |= (np.bitwise_count(wave[a:a + 64, None] ^ left[None, :]) <= distance).any(axis=0)
                wave, left = left[hit], left[~hit]
                for x in wave:
                    yield root, x

    def run(batches):
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                for x, y in links(np.array(row.as_py(), np.int64).view(np.uint64)):
                    a.append(int(np.uint64(x).view(np.int64)))
                    b.append(int(np.uint64(y).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _meet(dense: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints that share a value at most one bit away from each."""
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b)).cast("long")) for b in range(BITS)]
    shared = (dense.select("fp", F.explode(F.array(*near)).alias("value"))
              .groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1))
    if distance == 2:  # any two members differ in two bits at most
        return shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return (shared.where(F.array_contains("fps", F.col("value")) & F.lit(distance == 1))
            .select(F.col("value").alias("a"), F.explode("fps").alias("b")).where("a <> b"))


def near_links(fps: DataFrame, distance: int = MAX_DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b) over distinct fingerprints; their components equal those of all links."""
    if distance > 2:
        raise ValueError("distances up to 2 are supported: dense keys are resolved by values one bit away")
    found = plan_probes(fps, distance)
    probes = [k for part, (bits, t) in enumerate(found) for k in _keys(F.col("fp"), part, bits, t)]
    keyed = fps.select("fp", F.explode(F.array(*probes)).alias("k")).select("fp", "k.part", "k.key")
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("members")).where("members > 1")
    joined = keyed.join(sizes, ["part", "key"]).checkpoint()
    few = (joined.where(F.col("members") <= group_limit).groupBy("part", "key")
           .agg(F.collect_list("fp").alias("fps")).select("fps")
           .mapInArrow(_forest(distance), "a long, b long"))
    dense = joined.where(F.col("members") > group_limit).select("fp").distinct()
    return few.unionByName(_meet(dense, distance)).distinct()


def component_ids(prints: DataFrame, distance: int, group_limit: int) -> DataFrame:
    """(fp, root): one fingerprint that stands for the component of each distinct ``fp``."""
    fps = prints.select("fp").distinct().checkpoint()
    labels = components(near_links(fps, distance, group_limit))
    return fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                   distance: int = MAX_DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per document: fingerprint (16 hex digits) and component_id."""
    prints = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = first.join(component_ids(prints, distance, group_limit), "fp").checkpoint()
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
               distance: int = MAX_DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row of each component, all columns unchanged: the smallest id, then text hash.

    Null ids come last. Of rows that repeat both id and text one is kept.
    """
    def key(i, t):
        return F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), F.hex(F.xxhash64(F.coalesce(t, F.lit("")))))

    named, nth = T.free_name("key", docs.columns), T.free_name("nth", docs.columns)
    slim = docs.select(F.struct(F.col(id_col).isNull(), F.col(id_col).cast("long"),
                                key(F.col(id_col), F.col(text_col)).alias("key")).alias("row"), text_col)
    # The row's key takes the id's place, and so follows its fingerprint.
    prints = _keyed_prints(slim, text_col, shingle).checkpoint()
    roots = component_ids(prints, distance, group_limit)
    first = prints.groupBy("fp").agg(F.min("row").alias("row")).join(roots, "fp") \
        .groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.key").alias(named))
    keyed = docs.withColumn(named, key(F.col(id_col), F.col(text_col)))
    once = Window.partitionBy(named).orderBy(named)
    return (keyed.join(first.distinct(), named, "left_semi").withColumn(nth, F.row_number().over(once))
            .where(F.col(nth) == 1).select(*docs.columns))


def _keyed_prints(rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(row, fp) for any ``row`` column beside the text."""
    def run(batches):
        for batch in batches:
            for part in T.slices(batch, text_col):
                fp = fingerprint_batch(part.column(1), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["row", "fp"])
    schema = StructType([rows.schema["row"], StructField("fp", LongType())])
    return rows.select("row", text_col).mapInArrow(run, schema)
