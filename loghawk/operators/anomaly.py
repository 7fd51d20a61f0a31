"""Isolation forest anomaly detection.

Published algorithm (Liu, Ting, Zhou 2008): each tree isolates a random
subsample of psi rows with random axis-parallel cuts; short average paths
mean anomalies. Built as Spark jobs:

1. every tree draws from all rows: a row joins a tree if the pair's hash is
   below a share a little above psi / n, so about 1.5 psi rows a tree are left
   whatever n is, and only these rows are emitted;
2. ``row_number() <= psi`` per tree keeps the tree's sample;
3. ``groupBy(tree).applyInPandas`` grows each tree on its psi rows;
4. the node table (at most trees x (2 psi - 1) rows: a model of fixed
   size) is broadcast, and a vectorised pandas UDF walks all trees for
   every row in Arrow batches.

``IsolationForest`` and ``IsolationForestModel`` are a ``pyspark.ml`` Estimator and Model over
plain numeric columns: the model can be written and read, alone or in a ``PipelineModel``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, HasSeed
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk import constants as C
from loghawk.functions.stats import quantiles

HASH_STEPS = 1 << 40
_EULER = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
])


def average_path_length(n):
    """c(n): mean path length of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + _EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Grow one isolation tree; returns node rows (node, feature, threshold, left, right, size)."""
    nodes = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx)])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= thr
        nodes[me][1], nodes[me][2] = f, thr
        nodes[me][3] = build(idx[go_left], depth + 1)
        nodes[me][4] = build(idx[~go_left], depth + 1)
        return me

    build(np.arange(len(x)), 0)
    return nodes


def _builder(feature_cols: list[str], max_depth: int, seed: int, id_col: str):
    def build_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(id_col)
        x = pdf[feature_cols].to_numpy(dtype=float)
        rows = _grow(x, np.random.default_rng([seed, tree]), max_depth)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "size"])
        out.insert(0, "tree", tree)
        return out.astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32",
                           "right": "int32", "size": "int32", "threshold": "float64"})
    return build_tree


class _Trees:
    """Node arrays of a fitted forest, padded to (trees, max nodes)."""

    def __init__(self, nodes: pd.DataFrame, sample_size: int):
        n_trees = int(nodes["tree"].max()) + 1
        width = int(nodes.groupby("tree")["node"].max().max()) + 1
        self.feature = np.full((n_trees, width), -1, dtype=np.int64)
        self.threshold = np.zeros((n_trees, width))
        self.left = np.zeros((n_trees, width), dtype=np.int64)
        self.right = np.zeros((n_trees, width), dtype=np.int64)
        self.size = np.zeros((n_trees, width))
        t, n = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        self.feature[t, n] = nodes["feature"].to_numpy()
        self.threshold[t, n] = nodes["threshold"].to_numpy()
        self.left[t, n] = nodes["left"].to_numpy()
        self.right[t, n] = nodes["right"].to_numpy()
        self.size[t, n] = nodes["size"].to_numpy()
        self.sample_size = sample_size
        self.n_trees = n_trees
        self._prepare()

    def _prepare(self) -> None:
        """For scoring: leaves lead to themselves, and each node's path length is known beforehand."""
        n_trees, width = self.feature.shape
        inner, own = self.feature >= 0, np.arange(width)
        self._feature = np.where(inner, self.feature, 0)
        self._next = np.stack([np.where(inner, self.left, own), np.where(inner, self.right, own)], axis=2).reshape(n_trees, -1)
        self._path, self._levels = average_path_length(self.size), np.zeros(n_trees, np.int64)
        for t in range(n_trees):
            level, nodes = 0, np.zeros(1, np.int64)
            while len(nodes):
                self._path[t, nodes] = level + self._path[t, nodes]
                nodes = nodes[inner[t, nodes]]
                nodes = np.concatenate([self.left[t, nodes], self.right[t, nodes]])
                level += bool(len(nodes))
            self._levels[t] = level

    def score(self, x: np.ndarray) -> np.ndarray:
        """Raw anomaly score 2^(-E[h(x)] / c(psi)): higher is more anomalous."""
        k = len(x)
        total, cells, first = np.zeros(k), np.ascontiguousarray(x, dtype=float).ravel(), np.arange(k) * x.shape[1]
        for t in range(self.n_trees):
            feature, threshold, child = self._feature[t], self.threshold[t], self._next[t]
            node = np.zeros(k, dtype=np.int64)
            for _ in range(self._levels[t]):
                right = ~(cells.take(first + feature.take(node)) <= threshold.take(node))
                node = child.take(2 * node + right)
            total += self._path[t].take(node)
        mean_depth = total / self.n_trees
        return np.power(2.0, -mean_depth / average_path_length([self.sample_size])[0])


class _ForestParams(HasInputCols, HasOutputCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "trees of the forest", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "rows a tree is grown on", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "unique id that decides which trees a row joins", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(numTrees=C.IFOREST_TREES, maxSamples=C.IFOREST_MAX_SAMPLES, idCol="row_id",
                         seed=C.MODEL_SEED, outputCol="iso_score")


class IsolationForest(Estimator, _ForestParams):
    """M13 as an Estimator; the same rows and seed give the same forest, however they are partitioned."""

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> IsolationForestModel:
        from loghawk.session import ship_package
        ship_package(dataset.sparkSession)
        n_trees, max_samples, seed, id_col = (self.getOrDefault(p) for p in ("numTrees", "maxSamples", "seed", "idCol"))
        features = list(self.getInputCols())
        n = dataset.count()
        psi = max(1, min(max_samples, n))
        max_depth = int(math.ceil(math.log2(max(psi, 2))))
        if n == 0:
            raise ValueError("an isolation forest needs rows")
        # 64 over half as many again: fewer than psi hits is beyond nine standard deviations.
        below = int(min(1.0, (1.5 * psi + 64) / n) * HASH_STEPS)

        def draw(tree):
            return F.pmod(F.xxhash64(F.col(id_col), tree, F.lit(seed)), F.lit(HASH_STEPS))

        # Every pair is made and dropped again within generated code, several times faster than F.filter's lambda.
        pairs = dataset.select(id_col, *features, F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
        offered = pairs.where(draw(F.col("tree")) < below)
        pick = F.row_number().over(Window.partitionBy("tree").orderBy(draw(F.col("tree")), F.col(id_col)))
        samples = offered.withColumn("_pick", pick).where(F.col("_pick") <= psi).drop("_pick")
        nodes = samples.groupBy("tree").applyInPandas(_builder(features, max_depth, seed, id_col), NODE_SCHEMA)
        return self._copyValues(IsolationForestModel(nodes.toPandas(), psi))


class IsolationForestModel(Model, _ForestParams, MLWritable, MLReadable):
    """Adds the raw score 2^(-E[h(x)] / c(psi)) of every row: higher is more anomalous."""

    def __init__(self, nodes: pd.DataFrame | None = None, sample_size: int = 1):
        super().__init__()
        self._defaults()
        self.nodes, self.sample_size = nodes, sample_size
        self._trees = None

    @property
    def trees(self) -> _Trees:
        if self._trees is None:
            self._trees = _Trees(self.nodes, self.sample_size)
        return self._trees

    @property
    def feature(self) -> np.ndarray:
        return self.trees.feature

    @property
    def threshold(self) -> np.ndarray:
        return self.trees.threshold

    @property
    def size(self) -> np.ndarray:
        return self.trees.size

    @property
    def n_trees(self) -> int:
        return self.trees.n_trees

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.trees.score(x)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from loghawk.session import ship_package
        ship_package(dataset.sparkSession)
        shared = dataset.sparkSession.sparkContext.broadcast(self.trees)  # a model of fixed size

        @F.pandas_udf(T.DoubleType())
        def score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            return pd.Series(shared.value.score(x))

        return dataset.withColumn(self.getOutputCol(), score(*[F.col(c) for c in self.getInputCols()]))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, model: IsolationForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession,
                                         extraMetadata={"sampleSize": self.model.sample_size})
        self.sparkSession.createDataFrame(self.model.nodes, NODE_SCHEMA).write.parquet(f"{path}/nodes")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> IsolationForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/nodes").toPandas(), metadata["sampleSize"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def fit_isolation_forest(df: DataFrame, feature_cols: list[str], n_trees: int = C.IFOREST_TREES,
                         max_samples: int = C.IFOREST_MAX_SAMPLES, seed: int = C.MODEL_SEED,
                         id_col: str = "row_id") -> IsolationForestModel:
    """M13 (fit). One count and one tree-building job; the node table is the model."""
    return IsolationForest(inputCols=list(feature_cols), numTrees=n_trees, maxSamples=max_samples, seed=seed,
                           idCol=id_col).fit(df)


def isolation_scores(df: DataFrame, model: IsolationForestModel, out_col: str = "iso_score") -> DataFrame:
    """M13 (apply): raw score per row, computed in Arrow batches from a broadcast model."""
    return model.transform(df, {model.outputCol: out_col})


def normalise_scores(df: DataFrame, raw_col: str = "iso_score", out_col: str = "anomaly_score") -> DataFrame:
    """Min-max the raw score to 0-100 (100 = most anomalous); all 0 when flat."""
    mm = df.agg(F.struct(F.min(raw_col).alias("lo"), F.max(raw_col).alias("hi"))).scalar()
    rng = mm["hi"] - mm["lo"]
    return df.withColumn(out_col, F.when(rng < F.lit(1e-9), F.lit(0.0))
                         .otherwise((F.col(raw_col) - mm["lo"]) / rng * F.lit(100.0)))


def flag_anomalies(df: DataFrame, raw_col: str = "iso_score",
                   contamination: float = C.DEFAULT_CONTAMINATION, out_col: str = "is_anomaly") -> DataFrame:
    """The most anomalous ``contamination`` share (strictly above the cut)."""
    cut = quantiles(df, [raw_col], [1.0 - contamination])[raw_col][0]
    return df.withColumn(out_col, F.coalesce(F.col(raw_col) > F.lit(cut), F.lit(False)))
