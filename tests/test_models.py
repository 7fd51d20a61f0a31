"""Invariants of the fitted models on generated, labelled logs."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loghawk.operators import anomaly as AN
from loghawk.operators import detect as D
from loghawk.operators import prepare as P
from loghawk.plans.pipeline import run_pipeline
from loghawk.sources.synthetic import synthetic_logs

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def clean(spark):
    raw = synthetic_logs(spark, 2000, seed=7, start=START)
    raw = raw.select("row_id", *[F.col(c).cast("string") for c in raw.columns if c != "row_id"])
    return P.clean_logs(raw).checkpoint(eager=True)


def test_stratified_split_exact_share(spark, clean):
    lab = D.binary_label(clean)
    for bits in (1, 4, 16):
        split = D.stratified_split(lab, "y", bits=bits)
        got = {r["y"]: (r["n"], r["t"]) for r in split.groupBy("y").agg(
            F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
        for n, t in got.values():
            assert t == math.ceil(0.25 * n), (bits, got)
        assert split.count() == lab.count()
    a = D.stratified_split(lab, "y").where("is_test").select("row_id").collect()
    b = D.stratified_split(lab.repartition(3), "y").where("is_test").select("row_id").collect()
    assert sorted(a) == sorted(b)


def test_isolation_forest_invariants(spark, clean):
    feats = clean.select("row_id", *P.FEATURE_COLUMNS)
    model = AN.fit_isolation_forest(feats, P.FEATURE_COLUMNS, n_trees=50)
    scored = AN.flag_anomalies(AN.normalise_scores(AN.isolation_scores(feats, model)))
    st = scored.agg(F.min("anomaly_score"), F.max("anomaly_score"), F.count_if("is_anomaly"), F.count("*")).first()
    assert st[0] == 0.0 and abs(st[1] - 100.0) < 1e-9
    assert abs(st[2] - 0.1 * st[3]) <= 0.02 * st[3]
    again = AN.fit_isolation_forest(feats, P.FEATURE_COLUMNS, n_trees=50)
    assert (model.threshold == again.threshold).all()


def test_isolation_forest_ranks_planted_outliers_high(spark, clean):
    feats = clean.select("row_id", *P.FEATURE_COLUMNS)
    planted = spark.createDataFrame([(10_000 + i, 12.0, 12.0, 12.0, 0) for i in range(5)], feats.schema)
    both = feats.unionByName(planted)
    model = AN.fit_isolation_forest(both, P.FEATURE_COLUMNS, n_trees=50)
    s = AN.isolation_scores(both, model)
    median = s.agg(F.percentile("iso_score", 0.5)).first()[0]
    assert all(r[0] > median for r in s.where("row_id >= 10000").select("iso_score").collect())


def test_pipeline_invariants(spark, clean):
    res = run_pipeline(clean, rf_trees=20, rf_depth=6, gbt_rounds=10, gbt_depth=3, iso_trees=30)
    sc = res.scored
    n = clean.count()
    assert sc.count() == n and sc.select("row_id").distinct().count() == n
    st = sc.agg(F.min("attack_probability"), F.max("attack_probability"),
                F.min("threat_score"), F.max("threat_score")).first()
    assert 0 <= st[0] <= st[1] <= 1 and 0 <= st[2] <= st[3] <= 100
    m = {r["model"]: r for r in res.detection_metrics.collect()}
    majority = max(0.22, 0.78)
    assert m["random_forest"]["accuracy"] > majority and m["random_forest"]["f1"] > 0.5
    assert set(res.class_names) <= {"DDoS", "DoS", "Brute Force", "Port Scan", "SQL Injection", "Botnet",
                                    "Malware", "Phishing", "Unknown Threat"}
    bad = sc.where((F.col("predicted_label") == "Normal") & (F.col("attack_type_predicted") != "Normal")).count()
    assert bad == 0
    assert res.metrics.first()["total_logs"] == n


def test_class_probabilities_sum_to_one(spark, clean):
    cls = D.classify_attacks(P.feature_vector(clean), trees=10, depth=5)
    sums = cls.scored.select(F.aggregate("class_probability", F.lit(0.0), lambda a, x: a + x).alias("s"))
    st = sums.agg(F.min("s"), F.max("s")).first()
    assert abs(st[0] - 1) < 1e-9 and abs(st[1] - 1) < 1e-9


def test_single_class_falls_back_to_labels(spark, clean):
    normal_only = clean.where("attack_type = 'Normal'")
    det = D.detect_attacks(P.feature_vector(normal_only))
    assert det.warning and det.metrics is None
    assert det.scored.agg(F.max("attack_probability")).first()[0] == 0.0
    cls = D.classify_attacks(P.feature_vector(normal_only))
    assert cls.warning and cls.model is None


def test_unlabelled_file_scores_everything_as_unknown_attack(spark, clean):
    raw = synthetic_logs(spark, 300, seed=11, start=START).drop("attack_type")
    raw = raw.select("row_id", *[F.col(c).cast("string") for c in raw.columns if c != "row_id"])
    c = P.clean_logs(raw)
    res = run_pipeline(c, rf_trees=5, rf_depth=3, gbt_rounds=3, gbt_depth=2, iso_trees=10)
    assert len(res.warnings) == 2 and res.detection_metrics is None and res.class_names == []
    st = res.scored.agg(F.min("attack_probability"), F.count_if(F.col("predicted_label") != "Attack"),
                        F.collect_set("attack_type_predicted"), F.collect_set("attack_type_confidence"),
                        F.collect_set("severity_weight")).first()
    assert st[0] == 1.0 and st[1] == 0
    assert st[2] == ["Unknown"] and st[3] == [0.5] and st[4] == [50.0]


def test_training_partitions_follow_the_rows_alone():
    assert [D.training_partitions(n) for n in (0, 1_500, 76_000, 10**7, 2 * 10**7, 10**10)] == [1, 1, 8, 1000, 2000, 20000]


def test_fits_do_not_depend_on_the_partitioning(spark, clean):
    split = D.stratified_split(D.binary_label(P.feature_vector(clean)), "y")
    got = []
    for parts in (2, 4):
        df = split.repartition(parts)
        rf, gbt = D.fit_detectors(df, rf_trees=8, rf_depth=4, gbt_rounds=3, gbt_depth=2)
        out = gbt.transform(rf.transform(split))
        got.append(sorted((r["row_id"], r["a"], r["b"]) for r in out.select(
            "row_id", D._p1("rf_prob").alias("a"), D._p1("gbt_prob").alias("b")).collect()))
    assert got[0] == got[1]


def test_isolation_trees_draw_from_all_rows(spark):
    n = 50_000
    rows = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 977).cast("double").alias("f"))
    models = [AN.fit_isolation_forest(rows.repartition(p), ["f"], n_trees=40) for p in (2, 5)]
    assert (models[0].threshold == models[1].threshold).all() and (models[0].size[:, 0] == 256).all()
    empty = rows.where("false")
    with pytest.raises(ValueError):
        AN.fit_isolation_forest(empty, ["f"])


def test_null_labels_are_attacks_and_a_stratum(spark):
    rows = spark.createDataFrame([(k, ["Normal", "DDoS", None][k % 3]) for k in range(12)], "row_id long, attack_type string")
    assert sum(r["y"] for r in D.binary_label(rows).collect()) == 8
    guard = D.classifier_guard(rows, min_rows=8).first()
    assert guard["attack_rows"] == 8
    split = D.stratified_split(rows, "attack_type")
    assert split.count() == 12 and split.where("is_test").count() == 3


def test_few_test_rows_fall_back_to_one_stratum(spark):
    labels = ["A", "B", "C", "D", "E", "F"]
    rows = spark.createDataFrame([(k, labels[k % 6], float(k % 6), 1.0 * (k % 2), 0.5, 0) for k in range(12)],
                                 ["row_id", "attack_type", *P.FEATURE_COLUMNS])
    cls = D.classify_attacks(P.feature_vector(rows), trees=3, depth=2)
    assert cls.accuracy.first()["test_rows"] == 3  # ceil(12 / 4): a test row a label would be 6


def test_run_in_pool_sets_and_clears_the_pool(spark):
    from loghawk.session import run_in_pool
    sc = spark.sparkContext
    seen = run_in_pool(spark, "boosting", lambda: sc.getLocalProperty("spark.scheduler.pool"))
    assert seen == "boosting"
    assert sc.getLocalProperty("spark.scheduler.pool") is None
    with pytest.raises(ZeroDivisionError):
        run_in_pool(spark, "forest", lambda: 1 / 0)
    assert sc.getLocalProperty("spark.scheduler.pool") is None


def test_pipeline_stops_when_detection_fails_before_fitting(spark, clean, monkeypatch):
    import loghawk.plans.pipeline as PL

    def broken(*args, **kwargs):
        raise RuntimeError("no detector")

    def must_not_run(*args, **kwargs):
        raise AssertionError("started after a failed detection")

    monkeypatch.setattr(PL.D, "detect_attacks", broken)
    monkeypatch.setattr(PL.D, "classify_attacks", must_not_run)
    monkeypatch.setattr(PL.AN, "fit_isolation_forest", must_not_run)
    with pytest.raises(RuntimeError, match="no detector"):
        PL.run_pipeline(clean)


def test_forest_partitions_follow_from_the_rows_and_stay_few():
    assert [D.forest_partitions(n) for n in (0, 1_500, 76_000, 765_000, 27_500_000, 10**9)] == [1, 1, 8, 24, 138, 5000]


def test_training_frame_is_even_and_has_alike_rows_together(spark, clean):
    wide = P.feature_vector(clean).select("row_id", "features", *P.FEATURE_COLUMNS)
    copies = spark.range(40).select(F.col("id").alias("k"))
    rows = wide.crossJoin(copies).select((F.col("row_id") + 10_000 * F.col("k")).alias("row_id"), "features")
    n = rows.count()
    frames = [D.training_frame(df, n) for df in (rows, rows.repartition(7))]
    coarse = F.transform(vector_to_array("features"), lambda v: F.rint(4 * F.asinh(v)))
    got = [[r.asDict() for r in f.select("row_id", coarse.alias("c"), F.spark_partition_id().alias("p")).collect()] for f in frames]
    for f in frames:
        f.unpersist()
    assert got[0] == got[1]
    sizes = [sum(r["p"] == p for r in got[0]) for p in range(D.forest_partitions(n))]
    assert sum(sizes) == n and len(sizes) > 1 and min(sizes) > 0.8 * n / len(sizes)
    for p in range(len(sizes)):
        part = [r["c"] for r in got[0] if r["p"] == p]
        assert part == sorted(part)


def test_training_frame_keeps_rows_without_an_id(spark, clean):
    rows = P.feature_vector(clean).select(F.when(F.col("row_id") % 3 > 0, F.col("row_id")).alias("row_id"), "features")
    frame = D.training_frame(rows, 50_000)
    assert frame.rdd.getNumPartitions() == 5
    assert (frame.count(), frame.where("row_id IS NULL").count()) == (rows.count(), rows.where("row_id IS NULL").count())
    frame.unpersist()


def test_isolation_scores_equal_a_walk_down_each_tree(spark, clean):
    feats = clean.select("row_id", *P.FEATURE_COLUMNS)
    model = AN.fit_isolation_forest(feats, P.FEATURE_COLUMNS, n_trees=20)
    x = np.array([tuple(r)[1:] for r in feats.limit(200).collect()], float)
    x[0, 0] = np.nan  # goes right
    trees = model.trees

    def path(row, t):
        node = depth = 0
        while trees.feature[t, node] >= 0:
            side = trees.left if row[trees.feature[t, node]] <= trees.threshold[t, node] else trees.right
            node, depth = side[t, node], depth + 1
        return depth + AN.average_path_length(trees.size[t, node:node + 1])[0]

    mean = np.array([sum(path(row, t) for t in range(20)) / 20 for row in x])
    assert np.allclose(model.score(x), 2.0 ** (-mean / AN.average_path_length([trees.sample_size])[0]), rtol=1e-12, atol=0)
    assert len(model.score(x[:0])) == 0
