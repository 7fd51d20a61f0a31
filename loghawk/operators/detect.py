"""Attack detection and attack-type classification.

Models come from ``pyspark.ml`` (distributed tree learners). Predictions are
columns on the same rows (keyed by ``row_id``), never positional arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.functions import portable_hash, round_half_even
from loghawk.operators.boosting import BoostedTrees
from loghawk.operators.prepare import cut_lineage

SPLIT_BITS = 16
#: Labels of a classifier; each is a column of the model's output.
MAX_CLASSES = 1000
HASH_BITS = 60


def binary_label(df: DataFrame, label_col: str = "attack_type", out_col: str = "y") -> DataFrame:
    """M1: 1 for anything but "Normal" (a missing label, null or "Unknown", is an attack)."""
    return df.withColumn(out_col, F.when(is_attack_label(label_col), 1).otherwise(0).cast("int"))


def is_attack_label(label_col: str) -> Column:
    return ~F.col(label_col).eqNullSafe("Normal")


def class_guard(df: DataFrame, y_col: str = "y") -> DataFrame:
    """M2: one row (n_classes, trainable); fewer than 2 classes -> no detector."""
    return df.agg(F.countDistinct(y_col).alias("n_classes")) \
             .withColumn("trainable", F.col("n_classes") >= 2)


def classifier_guard(df: DataFrame, label_col: str = "attack_type",
                     min_rows: int = C.MIN_CLASSIFIER_ROWS) -> DataFrame:
    """One row over the true attack rows: rows, labels, trainable."""
    attacks = df.where(is_attack_label(label_col))
    return attacks.agg(F.count(F.lit(1)).alias("attack_rows"),
                       F.countDistinct(label_col).alias("attack_labels")) \
                  .withColumn("trainable", (F.col("attack_rows") >= min_rows) & (F.col("attack_labels") >= 2))


def stratified_split(df: DataFrame, strata_col: str | None, test_fraction: float = C.TEST_FRACTION,
                     seed: int = C.MODEL_SEED, id_col: str = "row_id",
                     bits: int = SPLIT_BITS) -> DataFrame:
    """M3: adds ``is_test``; per stratum exactly ceil(fraction x rows) test rows.

    Rows are ordered by a portable hash of (id, seed). The hash's top ``bits`` bits
    cut each stratum into up to 2^bits ordered buckets; a running count over
    the (stratum, bucket) count table (small: strata x 2^bits rows) decides
    whole buckets, and only the one boundary bucket per stratum is ranked
    row by row. No task sorts a whole stratum, so a stratum holding a third
    of all rows is fine. ``strata_col=None`` splits without strata.
    """
    strata = F.col(strata_col) if strata_col else F.lit(0)
    h = portable_hash(id_col, seed)  # 60-bit, non-negative
    keyed = df.withColumns({"_s": strata, "_h": h, "_b": F.shiftright(h, HASH_BITS - bits)})
    counts = keyed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    per_stratum = Window.partitionBy("_s")
    running = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    plan = (counts.withColumns({
        "_k": F.ceil(F.sum("_c").over(per_stratum) * F.lit(test_fraction)),
        "_through": F.sum("_c").over(running)})
        .withColumn("_before", F.col("_through") - F.col("_c"))
        .select("_s", "_b", "_k", "_through", "_before"))
    plan = plan.select(F.col("_s").alias("_ps"), F.col("_b").alias("_pb"), "_k", "_through", "_before")
    same = keyed["_s"].eqNullSafe(plan["_ps"]) & (keyed["_b"] == plan["_pb"])  # null is a stratum of its own
    joined = keyed.join(plan, same).drop("_ps", "_pb")
    boundary = (F.col("_before") < F.col("_k")) & (F.col("_through") > F.col("_k"))
    whole = joined.where(~boundary).withColumn("is_test", F.col("_through") <= F.col("_k"))
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", id_col))
    edge = joined.where(boundary).withColumn("is_test", rank <= F.col("_k") - F.col("_before"))
    return whole.unionByName(edge).drop("_s", "_h", "_b", "_k", "_through", "_before")


MIN_TRAIN_ROWS, MAX_TRAIN_ROWS, WIDE_TRAIN_PARTITIONS = 10_000, 500_000, 2_000


def training_partitions(n_rows: int) -> int:
    """Partitions for a training set: a function of its rows alone.

    One per 10,000 rows up to 2,000 partitions, then one per 500,000. Bagging is
    seeded by partition, so a count that followed the cores would make the same
    data and seed give another model on another machine.
    """
    wide = min(math.ceil(n_rows / MIN_TRAIN_ROWS), WIDE_TRAIN_PARTITIONS)
    return max(1, wide, math.ceil(n_rows / MAX_TRAIN_ROWS))


#: A forest's partitions beyond ``training_partitions`` of a small table: so many, then one per ``FOREST_ROWS`` rows.
FOREST_PARTITIONS, FOREST_ROWS = 24, 200_000


def forest_partitions(n_rows: int) -> int:
    """Partitions of a forest's training rows: a function of their number alone.

    On every level a partition sends sums of all open nodes of all trees, whatever its rows:
    60 MB before compression for 80 trees, two labels and 512 nodes, and more with more labels.
    So partitions grow before their number does.
    """
    return max(1, min(training_partitions(n_rows), FOREST_PARTITIONS), math.ceil(n_rows / FOREST_ROWS))


def training_frame(df: DataFrame, n_rows: int, id_col: str = "row_id", seed: int = C.MODEL_SEED,
                   features_col: str = "features") -> DataFrame:
    """Cache a training set, its rows placed by a hash of their ids and ordered by coarse features and that hash.

    However the input is partitioned, the same rows meet in the same partition in
    the same order, so a fit depends on the data and the seed alone. Alike rows in a row
    meet the same nodes of a tree, which are in the processor's cache by then. One partition
    alone is small enough without that, and ordered by the hash.
    """
    parts = forest_partitions(n_rows)
    key = portable_hash(id_col, seed)
    coarse = F.transform(vector_to_array(F.col(features_col)), lambda v: F.rint(4 * F.asinh(v)))
    part = F.coalesce(F.pmod(key, F.lit(parts)).cast("int"), F.lit(0))  # rows without an id stay together
    placed = df.repartitionById(parts, part).withColumn("_coarse", coarse)
    order = ["_coarse", key, id_col] if parts > 1 else [key, id_col]
    return placed.sortWithinPartitions(*order).drop("_coarse").persist(StorageLevel.MEMORY_AND_DISK)


def _p1(prob_col: str = "probability"):
    return vector_to_array(F.col(prob_col))[1]


@dataclass
class Detection:
    scored: DataFrame            # input rows + p_rf, p_gbt, attack_probability, ensemble_pred
    metrics: DataFrame | None    # per model: accuracy, precision, recall, f1, tn, fp, fn, tp
    warning: str | None = None
    models: dict = field(default_factory=dict)


def _booster(features_col: str, y_col: str, rounds: int, depth: int, step: float, seed: int) -> BoostedTrees:
    return BoostedTrees(featuresCol=features_col, labelCol=y_col, maxIter=rounds, maxDepth=depth, stepSize=step,
                        seed=seed, predictionCol="gbt_pred", probabilityCol="gbt_prob")


def fit_detectors(df: DataFrame, features_col: str = "features", y_col: str = "y",
                  rf_trees: int = C.RF_TREES, rf_depth: int = C.RF_DEPTH,
                  gbt_rounds: int = C.GBT_ROUNDS, gbt_depth: int = C.GBT_DEPTH,
                  gbt_step: float = C.GBT_STEP, seed: int = C.MODEL_SEED, on_fit=None):
    """M4 + M5 on the training split (``is_test`` false), fitted concurrently.

    Both learners read one cached, right-sized copy of the training rows.
    ``on_fit`` (no arguments) is called when the fits are about to start.
    """
    from concurrent.futures import ThreadPoolExecutor

    from loghawk.session import run_in_pool
    sel = df.where(~F.col("is_test")).select("row_id", features_col, y_col)
    train = training_frame(sel, sel.count(), features_col=features_col)
    rf_est = RandomForestClassifier(featuresCol=features_col, labelCol=y_col, numTrees=rf_trees,
                                    maxDepth=rf_depth, seed=seed, probabilityCol="rf_prob",
                                    rawPredictionCol="rf_raw", predictionCol="rf_pred")
    gbt_est = _booster(features_col, y_col, gbt_rounds, gbt_depth, gbt_step, seed)
    if on_fit is not None:
        on_fit()
    try:
        with ThreadPoolExecutor(max_workers=2) as pool:
            spark = train.sparkSession
            rf_f = pool.submit(run_in_pool, spark, "forest", rf_est.fit, train)
            gbt_f = pool.submit(run_in_pool, spark, "boosting", gbt_est.fit, train)
            return rf_f.result(), gbt_f.result()
    finally:
        train.unpersist()


def fit_detector(df: DataFrame, which: str, features_col: str = "features", y_col: str = "y",
                 rf_trees: int = C.RF_TREES, rf_depth: int = C.RF_DEPTH, gbt_rounds: int = C.GBT_ROUNDS,
                 gbt_depth: int = C.GBT_DEPTH, gbt_step: float = C.GBT_STEP, seed: int = C.MODEL_SEED):
    """M4 (``which="random_forest"``) or M5 (``"gbt"``) alone, on the training split."""
    sel = df.where(~F.col("is_test")).select("row_id", features_col, y_col)
    train = training_frame(sel, sel.count(), features_col=features_col)
    try:
        if which == "random_forest":
            est = RandomForestClassifier(featuresCol=features_col, labelCol=y_col, numTrees=rf_trees,
                                         maxDepth=rf_depth, seed=seed, probabilityCol="rf_prob",
                                         rawPredictionCol="rf_raw", predictionCol="rf_pred")
        else:
            est = _booster(features_col, y_col, gbt_rounds, gbt_depth, gbt_step, seed)
        return est.fit(train)
    finally:
        train.unpersist()


def ensemble_vote(df: DataFrame, p_cols=("p_rf", "p_gbt"), out_prob: str = "attack_probability",
                  out_pred: str = "ensemble_pred") -> DataFrame:
    """M6: mean of the detectors' attack probabilities; attack when >= 0.5."""
    mean = sum((F.col(c) for c in p_cols), F.lit(0.0)) / F.lit(float(len(p_cols)))
    return df.withColumn(out_prob, mean).withColumn(out_pred, (F.col(out_prob) >= 0.5).cast("int"))


def classification_metrics(df: DataFrame, y_col: str, pred_cols: dict[str, str]) -> DataFrame:
    """M7: per model on the rows given: accuracy, precision, recall, F1 (4 dp; 0 on 0/0)
    and the 2x2 confusion counts, from one aggregate."""
    cells = []
    for name, p in pred_cols.items():
        y, yhat = F.col(y_col), F.col(p)
        cells.append(F.struct(
            F.lit(name).alias("model"),
            F.count_if((y == 0) & (yhat == 0)).alias("tn"), F.count_if((y == 0) & (yhat == 1)).alias("fp"),
            F.count_if((y == 1) & (yhat == 0)).alias("fn"), F.count_if((y == 1) & (yhat == 1)).alias("tp")))
    wide = df.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("m")).select("m.*")

    def ratio(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return wide.select(
        "model",
        round_half_even(ratio(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"),
        round_half_even(precision, 4).alias("precision"),
        round_half_even(recall, 4).alias("recall"),
        round_half_even(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
        "tn", "fp", "fn", "tp")


def confusion_matrix(metrics: DataFrame) -> DataFrame:
    """M8: (model, actual, predicted, count) with all four cells, zeros kept."""
    return metrics.selectExpr(
        "model", "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, count)")


def model_comparison(metrics: DataFrame, models=("random_forest", "gbt")) -> DataFrame:
    """M9: metric x model table."""
    long = metrics.selectExpr(
        "model", "stack(4, 0, 'Accuracy', accuracy, 1, 'Precision', precision, 2, 'Recall', recall, "
        "3, 'F1 Score', f1) AS (position, metric, value)")
    return (long.groupBy("position", "metric").pivot("model", list(models)).agg(F.first("value"))
            .withColumn("position", F.col("position").cast("int")))


def detect_attacks(df: DataFrame, features_col: str = "features", label_col: str = "attack_type",
                   seed: int = C.MODEL_SEED, on_fit=None, split_bits: int = SPLIT_BITS, **params) -> Detection:
    """M1-M8: label, guard, split, fit both detectors, ensemble on all rows, test metrics.

    ``on_fit`` (no arguments) is called once the detector fits start, or when
    it is clear that there will be none.
    """
    labelled = binary_label(df, label_col)
    n_classes = class_guard(labelled).first()["n_classes"]
    if n_classes < 2:
        if on_fit is not None:
            on_fit()
        fallback = labelled.withColumns({
            "attack_probability": F.col("y").cast("double"), "ensemble_pred": F.col("y")})
        return Detection(scored=fallback, metrics=None, warning=(
            "All labels fall in one class, so no detector was trained: the labels stand in for "
            "predictions and there are no metrics."))
    split = cut_lineage(stratified_split(labelled, "y", seed=seed, bits=split_bits))
    rf, gbt = fit_detectors(split, features_col, seed=seed, on_fit=on_fit, **params)
    out = gbt.transform(rf.transform(split))
    out = out.withColumns({"p_rf": _p1("rf_prob"), "p_gbt": _p1("gbt_prob")}) \
             .drop("rf_prob", "rf_raw", "gbt_prob")
    out = ensemble_vote(out)
    metrics = classification_metrics(out.where(F.col("is_test")), "y",
                                     {"random_forest": "rf_pred", "gbt": "gbt_pred"})
    return Detection(scored=out.drop("rf_pred", "gbt_pred"), metrics=metrics,
                     models={"random_forest": rf, "gbt": gbt})


@dataclass
class Classification:
    scored: DataFrame | None     # input rows + class_probability array
    class_names: list[str]
    accuracy: DataFrame | None
    warning: str | None = None
    model: object | None = None


def classify_attacks(df: DataFrame, features_col: str = "features", label_col: str = "attack_type",
                     trees: int = C.RF_TREES, depth: int = C.RF_DEPTH,
                     seed: int = C.MODEL_SEED, apply_to: DataFrame | None = None,
                     split_bits: int = SPLIT_BITS) -> Classification:
    """Multiclass forest on the true attack rows; class probabilities for all rows.

    Labels are coded alphabetically; a missing label is "Unknown". The 75/25 split is
    stratified by label where that is possible: every label has two rows, and either
    part has room for every label. One count per label decides all of it.
    """
    df = df.withColumn(label_col, F.coalesce(F.col(label_col), F.lit("Unknown")))
    attacks = df.where(is_attack_label(label_col))
    by_label = attacks.groupBy(label_col).count()
    size = by_label.agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("labels"), F.min("count").alias("least")).first()
    if (size["rows"] or 0) < C.MIN_CLASSIFIER_ROWS or size["labels"] < 2:
        return Classification(None, [], None, warning=(
            "Too few attack rows or attack labels for a type classifier; types and confidences "
            "come from the labels."))
    if size["labels"] > MAX_CLASSES:
        raise ValueError(f"{size['labels']} attack labels; a forest holds one probability a label and takes {MAX_CLASSES}")
    test_rows = math.ceil(C.TEST_FRACTION * size["rows"])
    stratified = size["least"] >= 2 and min(test_rows, size["rows"] - test_rows) >= size["labels"]
    indexer = StringIndexer(inputCol=label_col, outputCol="_cls", stringOrderType="alphabetAsc").fit(by_label)
    names = list(indexer.labels)
    split = cut_lineage(stratified_split(indexer.transform(attacks), label_col if stratified else None, seed=seed,
                                         bits=split_bits))
    sel = split.where(~F.col("is_test")).select("row_id", features_col, "_cls")
    train = training_frame(sel, size["rows"] - test_rows, features_col=features_col)
    try:
        rf = RandomForestClassifier(featuresCol=features_col, labelCol="_cls", numTrees=trees, maxDepth=depth,
                                    seed=seed, probabilityCol="_cprob", rawPredictionCol="_craw",
                                    predictionCol="_cpred").fit(train)
    finally:
        train.unpersist()
    accuracy = (rf.transform(split.where(F.col("is_test")))
                .agg(round_half_even(F.avg((F.col("_cpred") == F.col("_cls")).cast("double")), 4)
                     .alias("accuracy"), F.count(F.lit(1)).alias("test_rows")))
    scored = rf.transform(apply_to if apply_to is not None else df) \
               .withColumn("class_probability", vector_to_array(F.col("_cprob"))) \
               .drop("_cprob", "_craw", "_cpred")
    return Classification(scored, names, accuracy, model=rf)


def assign_attack_type(df: DataFrame, class_names: list[str] | None, pred_col: str = "ensemble_pred",
                       prob_col: str = "class_probability", label_col: str = "attack_type") -> DataFrame:
    """Predicted type and its confidence per row.

    Detected rows take the most probable class (first on ties) and its
    probability; other rows are "Normal" with 0. Without a classifier the
    true label stands in ("Normal" -> "Unknown Threat") with confidence 0.5.
    """
    detected = F.col(pred_col) == 1
    if class_names:
        probs = F.col(prob_col)
        pos = F.array_position(probs, F.array_max(probs))
        names = F.array(*[F.lit(n) for n in class_names])
        kind = F.element_at(names, pos.cast("int"))
        conf = F.array_max(probs)
    else:
        kind = F.when(is_attack_label(label_col), F.coalesce(F.col(label_col), F.lit("Unknown"))) \
            .otherwise(F.lit("Unknown Threat"))
        conf = F.lit(0.5)
    return df.withColumns({
        "attack_type_predicted": F.when(detected, kind).otherwise(F.lit("Normal")),
        "attack_type_confidence": F.when(detected, conf).otherwise(F.lit(0.0)),
    })


def apply_classifier(df: DataFrame, model) -> DataFrame:
    """Class probabilities of a fitted M11 forest as an array column."""
    return (model.transform(df).withColumn("class_probability", vector_to_array(F.col("_cprob")))
            .drop("_cprob", "_craw", "_cpred"))
