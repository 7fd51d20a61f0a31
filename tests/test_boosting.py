"""The boosted trees: a plain version, both ways to sum, held-out loss, storage."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loghawk.operators import boosting as B
from loghawk.operators.detect import _p1


def _data(spark, n=1200, seed=5):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.lognormal(0, 3, n), r.integers(0, 4, n).astype(float)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 2) | (x[:, 2] == 3) & (r.random(n) < 0.7)).astype(int)
    rows = [(k, *map(float, v), int(t)) for k, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y int").repartition(3)
    return df.withColumn("features", array_to_vector(F.array("a", "b", "c"))), x, y


def _slow(x, y, cuts, rounds, depth, step):
    """Margins after growing trees row by row in plain Python loops over nodes, features and cuts."""
    base = math.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        add = np.zeros(len(y))

        def grow(rows, level):
            best = (B.LEAST_GAIN, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for cut in cuts[f]:
                        left = rows & (x[:, f] <= cut)
                        right = rows & ~left
                        if h[left].sum() < B.LEAST_HESSIAN or h[right].sum() < B.LEAST_HESSIAN:
                            continue
                        worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + B.LAMBDA)
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
            if best[1] is None:
                add[rows] = -step * g[rows].sum() / (h[rows].sum() + B.LAMBDA)
            else:
                for side in best[1]:
                    grow(side, level + 1)

        grow(np.ones(len(y), bool), 0)
        margin = margin + add
    return margin


@pytest.mark.parametrize("cells", [1 << 20, 0])
def test_equals_a_plain_version(spark, monkeypatch, cells):
    monkeypatch.setattr(B, "PAIR_CELLS", cells)  # two levels a job, or one
    df, x, y = _data(spark, 400)
    model = B.BoostedTrees(labelCol="y", maxIter=3, maxDepth=3, stepSize=0.3).fit(df)
    cuts = B._feature_cuts(df, "features", 3, B.BINS)
    expected = _slow(x, y, cuts, 3, 3, 0.3)
    got = {r["row_id"]: r["p"] for r in model.transform(df).select("row_id", _p1("probability").alias("p")).collect()}
    assert all(abs(got[k] - 1 / (1 + math.exp(-m))) < 1e-9 for k, m in enumerate(expected))


def test_held_out_loss_is_no_worse_than_sparks_booster(spark):
    df, _, _ = _data(spark, 3000)
    train, test = df.where("row_id % 4 > 0").cache(), df.where("row_id % 4 = 0")
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
    loss = lambda m: m.transform(test).select("y", _p1("probability").alias("p")).agg(
        F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]
    ours = loss(B.BoostedTrees(labelCol="y", maxIter=20, maxDepth=4).fit(train))
    sparks = loss(GBTClassifier(labelCol="y", maxIter=20, maxDepth=4, stepSize=0.15, seed=1).fit(train))
    assert ours <= sparks


def test_model_is_stored_alone_and_in_a_pipeline(spark, tmp_path):
    df, _, _ = _data(spark, 300)
    model = B.BoostedTrees(labelCol="y", maxIter=4, maxDepth=2, probabilityCol="pp", predictionCol="hat").fit(df)
    scores = lambda m: sorted((r["row_id"], r["p"], r["hat"]) for r in m.transform(df).select(
        "row_id", _p1("pp").alias("p"), "hat").collect())
    model.write().overwrite().save(f"file://{tmp_path}/one")
    again = B.BoostedTreesModel.load(f"file://{tmp_path}/one")
    assert scores(again) == scores(model) and again.uid == model.uid
    PipelineModel([model]).write().overwrite().save(f"file://{tmp_path}/all")
    assert scores(PipelineModel.load(f"file://{tmp_path}/all")) == scores(model)


def test_one_label_missing_values_and_no_rows(spark):
    df, _, _ = _data(spark, 60)
    flat = df.withColumn("y", F.lit(1))
    model = B.BoostedTrees(labelCol="y", maxIter=2).fit(flat)
    assert model.transform(flat).select(F.min(_p1("probability"))).first()[0] > 0.99
    holes = df.withColumn("features", array_to_vector(F.array(F.when(F.col("row_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("a")), "b", "c")))
    out = B.BoostedTrees(labelCol="y", maxIter=2).fit(holes).transform(holes)
    assert out.where(_p1("probability").between(0, 1)).count() == 60
    with pytest.raises(ValueError):
        B.BoostedTrees(labelCol="y").fit(df.where("false"))


def test_driver_gets_splits_and_no_sums(spark, monkeypatch):
    df, _, _ = _data(spark, 1500)
    seen, work = [], B._splits

    def watched(state, tree, level, nodes, *more):
        seen.append((work(state, tree, level, nodes, *more), state.getNumPartitions(), len(nodes)))
        return seen[-1][0]

    monkeypatch.setattr(B, "_splits", watched)
    monkeypatch.setattr(B, "PARTITION_ROWS", 300)
    fit = lambda: B.BoostedTrees(labelCol="y", maxIter=2, maxDepth=5).fit(df).nodes
    first = fit()
    assert {parts for _, parts, _ in seen} == {5}
    # Nine numbers a node; a task answers for a node and its two children at most.
    assert all(sum(np.size(v) for row in found for v in row) <= 9 * 3 * nodes for found, _, nodes in seen)
    assert first.equals(fit())  # partitions are added in order: the same data give the same numbers


def test_partitions_grow_before_their_number_does():
    assert [B.boosting_partitions(n) for n in (0, 50_000, 4_600_000, 27_500_000, 10**9)] == [1, 1, 92, 100, 2000]


def test_margins_equal_a_walk_down_each_tree(spark):
    df, x, _ = _data(spark, 800)
    model = B.BoostedTrees(labelCol="y", maxIter=4, maxDepth=4).fit(df)
    x[0, 1] = np.nan
    walked = sum((tree.value[tree.place(x, tree.threshold)] for tree in model._trees()), np.full(len(x), model.base))
    assert (model.margins(x) == walked).all()


def test_rows_alike_in_all_bins_are_one_cell(spark, monkeypatch):
    df, x, y = _data(spark, 400)
    many = df.crossJoin(spark.range(30).withColumnRenamed("id", "copy")) \
        .withColumn("row_id", F.col("row_id") + 400 * F.col("copy"))
    seen, work = set(), B._splits

    def watched(state, *more):
        seen.add((state.getNumPartitions(), state.map(lambda block: len(block[0])).sum()))
        return work(state, *more)

    monkeypatch.setattr(B, "_splits", watched)
    monkeypatch.setattr(B, "PARTITION_ROWS", 500)
    model = B.BoostedTrees(labelCol="y", maxIter=3, maxDepth=3, stepSize=0.3).fit(many)
    (parts, cells), = seen
    assert parts == 1 and cells <= 400  # 12,000 rows: a round's work follows the cells
    cuts = B._feature_cuts(many, "features", 3, B.BINS)
    expected = _slow(np.tile(x, (30, 1)), np.tile(y, 30), cuts, 3, 3, 0.3)
    assert np.allclose(model.margins(x), expected[:400], atol=1e-9)


def test_rows_without_an_id_count_too(spark):
    df, _, _ = _data(spark, 200)
    fit = lambda d: B.BoostedTrees(labelCol="y", maxIter=2, maxDepth=3).fit(d).nodes
    assert fit(df).equals(fit(df.withColumn("row_id", F.lit(None).cast("long")).repartition(5)))
