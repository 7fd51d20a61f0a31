"""Second-order boosted trees with log loss (M5), trained by distributed histograms.

1. One pass sketches each feature; its quantiles are the cuts between bins.
2. The rows are binned and counted: trees split between bins, so rows alike in all bins have
   the same margin (log-odds so far) and pass down every tree together. Each such cell is kept
   once, with its rows and how many of them have label 1; its gradient and Hessian are those of
   its rows, added up. There are no more cells than rows, nor than bins to the power of the
   features, so a round's work stops growing with the rows. Cells are packed into blocks of
   numpy arrays, which carry their margins, and stored in the shared folder.
3. Two levels of a tree are one job: each partition adds its gradients and Hessians per
   (node, feature, bin, feature, bin) and sends each node's sums to that node's task. It adds
   them in the order of the partitions and takes the node's best regularised split; the bins on
   one side of it, summed up, are the child's sums, which give the child's split. The driver gets
   the splits alone, a few numbers a node. Where the sums of pairs would exceed ``PAIR_CELLS``,
   and for an odd last level, a level is a job, with sums per (node, feature, bin). Both give the
   same splits.
4. A finished tree is added to the margins in the next level's job. Margins are written
   to the checkpoint folder every ``CHECKPOINT_ROUNDS`` trees, which cuts the lineage: a lost
   executor costs a few trees' additions, not the fit.

A split of gradient sums G and Hessian sums H gains GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l);
a leaf is worth -G/(H+l), times the step. Partitions follow from the number of cells and cells
are placed by a hash of their bins, so the same data give the same model on any cluster.
Missing values (NaN) go right. The model is a ``pyspark.ml`` Model that can be written and
read, alone or in a ``PipelineModel``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasStepSize
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.operators.prepare import cut_lineage

BINS, BLOCK_ROWS, CHECKPOINT_ROUNDS = 64, 1 << 16, 10
#: Cells of a partition's pair sums: 8 MB.
PAIR_CELLS = 1 << 20
LAMBDA, LEAST_HESSIAN, LEAST_GAIN = 1.0, 1.0, 1e-6
#: Cells of a partition: a level's work on fewer is less than the job around it. A partition
#: sends up to 8 MB of sums a level, so beyond ``WIDE_PARTITIONS`` partitions grow before their number does.
PARTITION_ROWS, WIDE_PARTITIONS, MOST_ROWS = 50_000, 100, 500_000


def boosting_partitions(n_cells: int) -> int:
    return max(1, min(math.ceil(n_cells / PARTITION_ROWS), WIDE_PARTITIONS), math.ceil(n_cells / MOST_ROWS))


class Tree:
    """Nodes in heap order (children of k: 2k + 1, 2k + 2); feature -1 is a leaf."""

    def __init__(self, depth: int):
        size = (2 << depth) - 1
        self.depth = depth
        self.feature, self.at = np.full(size, -1, np.int16), np.zeros(size, np.int32)
        self.threshold, self.value = np.zeros(size), np.zeros(size)

    def place(self, columns: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Node of every row of ``columns`` (rows x features); left is at most ``cuts[node]``."""
        node, rows = np.zeros(len(columns), np.int64), np.arange(len(columns))
        for _ in range(self.depth):
            f = self.feature[node]
            left = columns[rows, np.maximum(f, 0)] <= cuts[node]
            node = np.where(f >= 0, 2 * node + 2 - left, node)
        return node

    def handed_down(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, threshold, value) with each leaf's value handed down to the last level, which all rows then reach."""
        value, leaf = np.array(self.value), np.asarray(self.feature) < 0
        for k in range((1 << self.depth) - 1):
            if leaf[k]:
                value[2 * k + 1] = value[2 * k + 2] = value[k]
        return np.where(leaf, 0, self.feature).astype(np.int64), np.asarray(self.threshold), value


def _margins(trees: list[tuple], base: float, x: np.ndarray) -> np.ndarray:
    """Log-odds of every row from trees' :meth:`Tree.handed_down` arrays."""
    out, cells, first = np.full(len(x), base), np.ascontiguousarray(x, dtype=float).ravel(), np.arange(len(x)) * x.shape[1]
    for feature, threshold, value in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(len(value).bit_length() - 1):
            node = 2 * node + 2 - (cells.take(first + feature.take(node)) <= threshold.take(node))
        out += value.take(node)
    return out


def best_split(sums: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's best split, from (2, features, bins) sums."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :1, -1:]
    right = whole - left
    worth = lambda s: s[0] ** 2 / (s[1] + LAMBDA)
    gain = worth(left) + worth(right) - worth(whole)
    gain[(left[1] < LEAST_HESSIAN) | (right[1] < LEAST_HESSIAN)] = -np.inf
    best = int(gain.argmax())
    return float(gain.flat[best]), best // gain.shape[1], best % gain.shape[1]


def _gradients(block, tree: Tree, level: int):
    """Of the cells in nodes of a level: the node's number in it, bins, and their rows' gradients and Hessians added up."""
    codes, n, ones, margin = block
    node = tree.place(codes, tree.at) - ((1 << level) - 1)
    inside = node >= 0
    p = 1 / (1 + np.exp(-margin[inside]))
    n = n[inside]
    return node[inside], codes[inside].astype(np.int64), (n * p - ones[inside], n * p * (1 - p))


def _level_sums(block, tree: Tree, level: int, bins: int) -> np.ndarray:
    """Sums (2, nodes, features, bins) of a block's cells in the nodes of a level."""
    node, codes, weights = _gradients(block, tree, level)
    width, size = 1 << level, codes.shape[1]
    out = np.empty((2, width, size, bins))
    for f in range(size):
        key = node * bins + codes[:, f]
        for k, weight in enumerate(weights):
            out[k, :, f] = np.bincount(key, weight, minlength=width * bins).reshape(width, bins)
    return out


def _pair_sums(block, tree: Tree, level: int, bins: int) -> np.ndarray:
    """Sums (2, nodes, pairs, bins, bins): the bins of each feature, split up by those of itself and every later one."""
    node, codes, weights = _gradients(block, tree, level)
    width, pairs = 1 << level, _pairs(codes.shape[1])
    out = np.empty((2, width, len(pairs), bins, bins))
    for nth, (f, g) in enumerate(pairs):
        key = (node * bins + codes[:, f]) * bins + codes[:, g]
        for k, weight in enumerate(weights):
            out[k, :, nth] = np.bincount(key, weight, minlength=width * bins * bins).reshape(width, bins, bins)
    return out


def _pairs(size: int) -> list[tuple[int, int]]:
    return [(f, g) for f in range(size) for g in range(f, size)]


def _split_up(sums: np.ndarray, size: int, feature: int) -> np.ndarray:
    """(2, bins, features, bins) of one feature, from a node's pair sums."""
    at = {pair: nth for nth, pair in enumerate(_pairs(size))}
    cells = [sums[:, at[feature, g]] if feature <= g else sums[:, at[g, feature]].transpose(0, 2, 1) for g in range(size)]
    return np.stack(cells, axis=2)


def _grown(k: int, sums: np.ndarray, size: int) -> list[tuple]:
    """(node, its sums, feature, bin, sums left of it, sums right of it) of node ``k`` and, from pair sums, its children."""
    pairs = sums.ndim == 4
    here = np.stack([_split_up(sums, size, f)[:, :, 0].sum(axis=2) for f in range(size)], axis=1) if pairs else sums
    gain, feature, at = best_split(here)
    whole, cells = here[:, 0].sum(axis=1), here[:, feature]
    if gain <= LEAST_GAIN:
        return [(k, whole, -1, 0, whole, whole)]
    out = [(k, whole, feature, at, cells[:, :at + 1].sum(axis=1), cells[:, at + 1:].sum(axis=1))]
    if pairs:
        cells = _split_up(sums, size, feature)
        out += _grown(2 * k + 1, cells[:, :at + 1].sum(axis=1), size)
        out += _grown(2 * k + 2, cells[:, at + 1:].sum(axis=1), size)
    return out


def _splits(state: RDD, tree: Tree, level: int, nodes: list[int], size: int, pairs: bool, bins: int = BINS) -> list[tuple]:
    """What :func:`_grown` finds of a level's nodes. Each node is summed in one task, in the order of the partitions."""
    work, first = _pair_sums if pairs else _level_sums, (1 << level) - 1

    def send(part, blocks):
        total = None
        for block in blocks:
            sums = work(block, tree, level, bins)
            total = sums if total is None else np.add(total, sums, out=total)
        if total is not None:
            for nth, k in enumerate(nodes):
                yield (nth, part), total[:, k - first]

    def grow(rows):
        nth = total = None
        for (to, _), sums in rows:
            if to != nth:
                if total is not None:
                    yield from _grown(nodes[nth], total, size)
                nth, total = to, sums.copy()
            else:
                total += sums
        if total is not None:
            yield from _grown(nodes[nth], total, size)

    return state.mapPartitionsWithIndex(send) \
        .repartitionAndSortWithinPartitions(len(nodes), lambda key: key[0]).mapPartitions(grow).collect()


def _feature_cuts(df: DataFrame, features_col: str, size: int, bins: int) -> list[np.ndarray]:
    """Ascending cuts of each feature: bin b holds values above cut b - 1, up to cut b."""
    shares = [k / bins for k in range(1, bins)]
    x = vector_to_array(F.col(features_col))
    finite = [F.when(~F.isnan(x[k]), x[k]) for k in range(size)]
    got = df.agg(*[F.percentile_approx(c, shares, 20 * bins).alias(f"f{k}") for k, c in enumerate(finite)]).first()
    return [np.unique(np.array(cut or [], float)) for cut in got]


def _cells(df: DataFrame, features_col: str, y_col: str, size: int, cuts: list[np.ndarray]) -> DataFrame:
    """(codes, n, ones): the bins that rows fall in, a byte a feature, their rows, and those of label 1."""
    def binned(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            codes = np.stack([np.searchsorted(cuts[f], x[:, f]).astype(np.uint8) for f in range(size)], axis=1)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(x), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([packed.cast(pa.binary()), batch.column("y")], names=["codes", "y"])

    return df.select(vector_to_array(F.col(features_col)).alias("x"), F.col(y_col).cast("int").alias("y")) \
        .mapInArrow(binned, "codes binary, y int") \
        .groupBy("codes").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))


def _blocks(cells: DataFrame) -> DataFrame:
    """One row a block: its partition and place, its cells' bins, rows and rows of label 1 as bytes."""
    def pack(batches):
        held, count, part, nth = [], 0, TaskContext.get().partitionId(), 0

        def out():
            columns = [pa.array([b"".join(h[k] for h in held)], pa.binary()) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), *columns],
                                              names=["part", "nth", "codes", "n", "ones"])

        for batch in batches:
            counts = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("n", "ones")]
            held.append((b"".join(batch.column("codes").to_pylist()), *counts))
            count += batch.num_rows
            if count >= BLOCK_ROWS:
                yield out()
                held, count, nth = [], 0, nth + 1
        if count:
            yield out()

    return cells.mapInArrow(pack, "part int, nth int, codes binary, n binary, ones binary")


class _BoostingParams(HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize, HasPredictionCol, HasProbabilityCol):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits in a tree", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "row ids; unused, kept for models stored with it", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the cells' placement", TypeConverters.toInt)


class BoostedTrees(Estimator, _BoostingParams):
    """Estimator; the label is 0 or 1."""

    def __init__(self, **values):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxIter=100, stepSize=0.15, predictionCol="prediction",
                         probabilityCol="probability", maxDepth=5, idCol="row_id", seed=42)
        self._set(**values)

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        from loghawk.session import ship_package
        ship_package(dataset.sparkSession)
        get = self.getOrDefault
        features, y = get("featuresCol"), get("labelCol")
        counted = dataset.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("mean"),
                              F.first(F.size(vector_to_array(F.col(features)))).alias("size")).first()
        if not counted["n"]:
            raise ValueError("boosted trees need rows")
        size = counted["size"]
        cuts = _feature_cuts(dataset, features, size, BINS)
        cells = cut_lineage(_cells(dataset, features, y, size, cuts).select("codes", "n", "ones"))
        parts = boosting_partitions(cells.count())
        part = F.pmod(F.xxhash64("codes", F.lit(get("seed"))), F.lit(parts)).cast("int")
        stored = cut_lineage(_blocks(cells.repartitionById(parts, part).sortWithinPartitions("codes")))
        mean = min(max(counted["mean"], 1e-6), 1 - 1e-6)
        base = math.log(mean / (1 - mean))
        trees = _boost(stored, size, parts, base, get("maxIter"), get("maxDepth"), get("stepSize"))
        for tree in trees:
            for node in np.flatnonzero(tree.feature >= 0):
                tree.threshold[node] = cuts[tree.feature[node]][tree.at[node]]
        model = BoostedTreesModel(_table(trees), base)
        return self._copyValues(model)


def _boost(stored: DataFrame, size: int, parts: int, base: float, rounds: int, depth: int, step: float) -> list[Tree]:
    def opened(row):
        n, ones = (np.frombuffer(row[c], np.int64).astype(float) for c in ("n", "ones"))
        return np.frombuffer(row["codes"], np.uint8).reshape(-1, size), n, ones, np.full(len(n), base)

    # However the files are read, blocks meet in their partition and order again: sums then add up alike.
    placed = stored.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "nth")
    state = placed.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[Tree] = []
    older = []
    for nth in range(rounds):
        tree = Tree(depth)
        level = 0
        while level < depth:
            open_nodes = [k for k in _level_nodes(level) if level == 0 or tree.feature[(k - 1) // 2] >= 0]
            if not open_nodes:
                break
            pairs = level + 1 < depth and 2 * (1 << level) * (size * BINS) ** 2 <= PAIR_CELLS
            found = _splits(state, tree, level, open_nodes, size, pairs)
            for rdd in older:  # the newer margins have been computed by now
                rdd.unpersist()
            older = []
            for k, whole, feature, at, left, right in found:
                if k == 0:
                    _set_leaf(tree, 0, whole, step)
                if feature >= 0:
                    tree.feature[k], tree.at[k] = feature, at
                    _set_leaf(tree, 2 * k + 1, left, step)
                    _set_leaf(tree, 2 * k + 2, right, step)
            level += 2 if pairs else 1
        trees.append(tree)
        if nth + 1 == rounds:
            break
        added = state.map(lambda b, t=tree: (*b[:3], b[3] + t.value[t.place(b[0], t.at)])).persist(StorageLevel.MEMORY_AND_DISK)
        if (nth + 1) % CHECKPOINT_ROUNDS == 0:
            added.checkpoint()
        older, state = [state], added
    for rdd in [*older, state]:
        rdd.unpersist()
    return trees


def _level_nodes(level: int) -> range:
    return range((1 << level) - 1, (2 << level) - 1)


def _set_leaf(tree: Tree, node: int, sums: np.ndarray, step: float) -> None:
    tree.value[node] = -step * sums[0] / (sums[1] + LAMBDA)


def _table(trees: list[Tree]) -> pd.DataFrame:
    rows = [(t, k, int(tree.feature[k]), float(tree.threshold[k]), float(tree.value[k]))
            for t, tree in enumerate(trees) for k in range(len(tree.feature))]
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "value"])


class BoostedTreesModel(Model, _BoostingParams, MLWritable, MLReadable):
    """Adds the probabilities of 0 and 1 as a vector, and the label of the larger one."""

    def __init__(self, nodes: pd.DataFrame | None = None, base: float = 0.0):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", probabilityCol="probability")
        self.nodes, self.base = nodes, base

    def margins(self, x: np.ndarray) -> np.ndarray:
        return _margins([tree.handed_down() for tree in self._trees()], self.base, x)

    def _trees(self) -> list[Tree]:
        if not hasattr(self, "_kept"):
            self._kept = []
            for _, rows in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
                tree = Tree(len(rows).bit_length() - 1)
                tree.feature, tree.threshold, tree.value = (rows[c].to_numpy() for c in ("feature", "threshold", "value"))
                self._kept.append(tree)
        return self._kept

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from loghawk.session import ship_package
        ship_package(dataset.sparkSession)
        trees = [tree.handed_down() for tree in self._trees()]
        shared = dataset.sparkSession.sparkContext.broadcast((trees, self.base))  # a model of fixed size

        @F.arrow_udf("double")
        def probability(rows: pa.Array) -> pa.Array:
            kept, base = shared.value
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            return pa.array(1 / (1 + np.exp(-_margins(kept, base, x))))

        p, prob = probability(vector_to_array(F.col(self.getOrDefault("featuresCol")))), self.getOrDefault("probabilityCol")
        out = dataset.withColumn(prob, p).withColumn(self.getOrDefault("predictionCol"), (F.col(prob) >= 0.5).cast("double"))
        return out.withColumn(prob, array_to_vector(F.array(1 - F.col(prob), F.col(prob))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"base": self.model.base})
        self.sparkSession.createDataFrame(self.model.nodes).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BoostedTreesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.parquet(f"{path}/nodes").toPandas()
        model = self.cls(nodes, metadata["base"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
