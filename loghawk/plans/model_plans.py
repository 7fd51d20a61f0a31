"""Model queries for the catalog.

Operators whose inputs are model outputs are checked on fixed model outputs
(F5, F6, F2) against SQL; the fitted models themselves run on the whole
cleaned F1 table and return what must hold of their results, as one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.functions import round_half_even, severity_bucket, severity_weight
from loghawk.operators import anomaly as AN
from loghawk.operators import detect as D
from loghawk.operators.prepare import FEATURE_COLUMNS, cut_lineage, feature_vector
from loghawk.plans.clean_plans import clean_fixture
from loghawk.plans.pipeline import SCORED_COLUMNS, run_pipeline
from loghawk.plans.scan_models import as_pipeline, load_scan_models, score_with_models
from loghawk.session import scratch_path
from loghawk.sources import fixtures

F6_NAMES = ["Botnet", "DDoS", "Malware", "Port Scan"]


def _preds(spark, sf_dir):
    f5 = fixtures.detector_outputs(spark, sf_dir)
    return D.ensemble_vote(f5).withColumns({
        "rf_pred": (F.col("p_rf") >= 0.5).cast("int"), "gbt_pred": (F.col("p_gbt") >= 0.5).cast("int")})


def detector_metrics(spark, sf_dir):
    p = _preds(spark, sf_dir)
    return D.classification_metrics(p.where(F.col("is_test")), "y", {"random_forest": "rf_pred", "gbt": "gbt_pred"})


def _features(spark, sf_dir):
    return feature_vector(clean_fixture(spark, sf_dir))


def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stratified_split(D.binary_label(clean_fixture(spark, sf_dir)), "y").select("row_id", "y", "is_test")


def _invariants(rows: DataFrame, score: str, lo: float, hi: float, *more) -> DataFrame:
    """One row: rows, distinct ids, scores outside [lo, hi] or missing, and further aggregates."""
    outside = F.col(score).isNull() | ~F.col(score).between(lo, hi)
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("row_id").alias("id_count"),
                    F.count_if(outside).alias("out_of_range"), *more)


def _split_counts() -> list:
    return [F.count_if(F.col("is_test") & (F.col("y") == k)).alias(f"test_rows_{k}") for k in (0, 1)]


def _beats_majority(pred) -> Column:
    """Whether more test rows are right than by always naming the larger class."""
    test = F.col("is_test")
    right = F.count_if(test & (pred == F.col("y")))
    return (right > F.greatest(*[F.count_if(test & (F.col("y") == k)) for k in (0, 1)])).alias("beats_majority")


def q_detect_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4-M6 fitted on the whole cleaned table: what must hold of every row's ensemble."""
    det = D.detect_attacks(_features(spark, sf_dir))
    mean = F.abs(F.col("attack_probability") - (F.col("p_rf") + F.col("p_gbt")) / 2) < 1e-9
    return _invariants(det.scored, "attack_probability", 0.0, 1.0, *_split_counts(),
                       F.count_if(~mean).alias("not_the_mean"), _beats_majority(F.col("ensemble_pred")))


def _one_detector(spark, sf_dir, which):
    split = cut_lineage(D.stratified_split(D.binary_label(_features(spark, sf_dir)), "y"))
    out = D.fit_detector(split, which).transform(split)
    prob = "rf_prob" if which == "random_forest" else "gbt_prob"
    rows = out.select("row_id", "y", "is_test", D._p1(prob).alias("attack_probability"))
    return _invariants(rows, "attack_probability", 0.0, 1.0, *_split_counts(),
                       _beats_majority((F.col("attack_probability") >= 0.5).cast("int")))


def q_detect_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 alone, fitted: what must hold of the forest's probability on every row."""
    return _one_detector(spark, sf_dir, "random_forest")


def q_detect_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 alone, fitted: what must hold of the boosted trees' probability on every row."""
    return _one_detector(spark, sf_dir, "gbt")


def q_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the model input vector, unpacked (6 dp)."""
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array(F.col("features"))
    return _features(spark, sf_dir).select(
        "row_id", *[round_half_even(v[i], 6).alias(f"f{i}") for i in range(len(FEATURE_COLUMNS))])


def q_detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7-M8 of the fitted detectors: test rows counted, ratios in range, F1 above always naming attacks."""
    m = D.detect_attacks(_features(spark, sf_dir)).metrics
    cells = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    attacks = F.col("fn") + F.col("tp")
    ratios = [F.col(c).between(0.0, 1.0) for c in ("accuracy", "precision", "recall", "f1")]
    return m.select("model", cells.alias("test_rows"), attacks.alias("test_attacks"),
                    (ratios[0] & ratios[1] & ratios[2] & ratios[3]).alias("in_range"),
                    (F.col("f1") > 2 * attacks / (cells + attacks)).alias("beats_constant"))


def q_classify_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10-M12 fitted: class probabilities sum to 1, and every detected row gets a known class."""
    feats = _features(spark, sf_dir)
    cls = D.classify_attacks(feats)
    rows = D.assign_attack_type(D.binary_label(cls.scored).withColumn("ensemble_pred", F.col("y")), cls.class_names)
    total = F.aggregate("class_probability", F.lit(0.0), lambda a, x: a + x)
    known = F.array(*[F.lit(n) for n in cls.class_names])
    expected = F.when(F.col("y") == 1, F.array_contains(known, F.col("attack_type_predicted"))) \
        .otherwise(F.col("attack_type_predicted") == "Normal")
    return _invariants(rows, "attack_type_confidence", 0.0, 1.0, F.count_if(F.abs(total - 1) > 1e-6).alias("not_summing"),
                       F.count_if(~expected).alias("unexpected_type"), F.lit(len(cls.class_names)).cast("long").alias("classes"))


def q_classification_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11's held-out accuracy: in range, over the held-out rows of every class, above the largest class's share."""
    feats = _features(spark, sf_dir)
    cls = D.classify_attacks(feats)
    label = F.coalesce("attack_type", F.lit("Unknown"))
    share = feats.where(D.is_attack_label("attack_type")).groupBy(label.alias("label")).count().agg(
        (F.max("count") / F.sum("count")).alias("s")).scalar()
    return cls.accuracy.select((F.col("accuracy").between(0.0, 1.0)).alias("in_range"),
                               F.col("test_rows").cast("long").alias("test_rows"),
                               (F.col("accuracy") > share).alias("beats_majority"))


def q_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13-M15 fitted: scores in (0, 1), normalised to 0 .. 100, the share above the cut flagged."""
    feats = _features(spark, sf_dir)
    model = AN.fit_isolation_forest(feats, FEATURE_COLUMNS)
    scores = cut_lineage(AN.isolation_scores(feats.select("row_id", *FEATURE_COLUMNS), model))
    rows = AN.flag_anomalies(AN.normalise_scores(scores))
    flagged, n = F.count_if(F.col("is_anomaly")), F.count(F.lit(1))
    return _invariants(rows, "iso_score", 0.0, 1.0, F.min("anomaly_score").alias("score_min"),
                       F.max("anomaly_score").alias("score_max"), ((flagged > 0.05 * n) & (flagged <= F.ceil(0.1 * n))).alias("share_flagged"),
                       (F.min(F.when(F.col("is_anomaly"), F.col("iso_score")))
                        > F.max(F.when(~F.col("is_anomaly"), F.col("iso_score")))).alias("flags_highest"))


def q_run_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cleaned row scored once; each row's threat score and severity follow from its own columns and the
    sources' counts, the metrics from the rows, and the labels beat naming the larger class."""
    result = run_pipeline(clean_fixture(spark, sf_dir))
    rows, bands = result.scored, ("Critical", "High", "Medium", "Low")
    counts = rows.groupBy("source_ip").agg(F.count(F.lit(1)).alias("_n"))
    busiest = counts.agg(F.max("_n")).scalar()
    rows = rows.join(counts, "source_ip")  # the filled table has no missing source
    parts = {"attack": 100.0 * F.col("attack_probability"), "anomaly": F.col("anomaly_score"),
             "severity": severity_weight("attack_type_predicted"), "frequency": F.col("_n") / busiest * 100.0}
    expected = round_half_even(sum((F.lit(w) * parts[k] for k, w in C.BLEND_WEIGHTS.items()), F.lit(0.0)), 2)
    attack, true_attack = F.col("predicted_label") == "Attack", D.is_attack_label("attack_type")
    right = F.count_if(attack == true_attack)
    metrics = result.metrics.select(F.struct("total_logs", "attack_count", "critical_count").alias("m")).scalar()
    agree = ((F.count(F.lit(1)) == metrics["total_logs"]) & (F.count_if(attack) == metrics["attack_count"])
             & (F.count_if(F.col("severity") == "Critical") == metrics["critical_count"]))
    return _invariants(rows, "threat_score", 0.0, 100.0,
                       F.count_if(~F.col("severity").isin(*bands)).alias("unknown_severity"),
                       F.count_if((F.col("predicted_label") == "Normal") != (F.col("attack_type_predicted") == "Normal"))
                       .alias("label_conflicts"),
                       F.count_if(~F.col("anomaly_score").between(0.0, 100.0)).alias("anomaly_out_of_range"),
                       F.count_if(F.abs(F.col("threat_score") - expected) > 0.0151).alias("score_differs"),
                       # The bucket is taken before rounding: either side of a rounded score may hold.
                       F.count_if(~F.col("severity").isin(severity_bucket(F.col("threat_score") - 0.006),
                                                          severity_bucket(F.col("threat_score") + 0.006))).alias("severity_differs"),
                       agree.alias("metrics_agree"),
                       (right > F.greatest(F.count_if(true_attack), F.count_if(~true_attack))).alias("beats_majority"))


def q_score_with_saved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of a scan written, read back and applied to its rows give the run's own results.

    Smaller models than a scan's, as it is the storing that is checked; every cleaned row is compared.
    """
    clean = cut_lineage(clean_fixture(spark, sf_dir))
    result = run_pipeline(clean, rf_trees=20, rf_depth=6, gbt_rounds=10, gbt_depth=3, iso_trees=50)
    path = scratch_path(spark, "models")
    as_pipeline(result.models, result.class_names).write().save(path)
    again = score_with_models(clean, load_scan_models(path))
    packed = [d.select("row_id", F.struct(*SCORED_COLUMNS).alias(side)) for d, side in ((result.scored, "a"), (again, "b"))]
    rows = packed[0].join(packed[1], "row_id", "full")
    return rows.agg(F.count("a").alias("row_count"), F.count("b").alias("rescored_count"),
                    F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))


QUERIES = {
    "binary_label": lambda s, d: D.binary_label(clean_fixture(s, d)).select("row_id", "y"),
    "single_class_guard": lambda s, d: D.class_guard(D.binary_label(clean_fixture(s, d))),
    "classifier_guard": lambda s, d: D.classifier_guard(clean_fixture(s, d)),
    "stratified_split": q_stratified_split,
    "ensemble_vote": lambda s, d: _preds(s, d).select("row_id", "attack_probability", "ensemble_pred"),
    "classification_metrics": detector_metrics,
    "confusion_matrix": lambda s, d: D.confusion_matrix(detector_metrics(s, d)),
    "model_comparison": lambda s, d: D.model_comparison(detector_metrics(s, d)),
    "assign_attack_type": lambda s, d: D.assign_attack_type(
        fixtures.class_probabilities(s, d).withColumnRenamed("detected", "ensemble_pred")
        .withColumnRenamed("probability", "class_probability"), F6_NAMES
    ).select("row_id", "attack_type_predicted", "attack_type_confidence"),
    "assign_attack_type_fallback": lambda s, d: D.assign_attack_type(
        fixtures.class_probabilities(s, d).withColumnRenamed("detected", "ensemble_pred"), None
    ).select("row_id", "attack_type_predicted", "attack_type_confidence"),
    "anomaly_normalise": lambda s, d: AN.normalise_scores(
        fixtures.model_outputs(s, d), raw_col="anomaly_score", out_col="anomaly_norm"
    ).select("row_id", round_half_even("anomaly_norm", 6).alias("anomaly_norm")),
    "anomaly_flag": lambda s, d: AN.flag_anomalies(
        fixtures.model_outputs(s, d), raw_col="anomaly_score").select("row_id", "is_anomaly"),
    "detect_rf": q_detect_rf,
    "detect_gbt": q_detect_gbt,
    "feature_matrix": q_feature_matrix,
    "detect_attacks": q_detect_attacks,
    "detection_metrics": q_detection_metrics,
    "classify_attacks": q_classify_attacks,
    "classification_accuracy": q_classification_accuracy,
    "isolation_forest": q_isolation_forest,
    "run_pipeline": q_run_pipeline,
    "score_with_saved_models": q_score_with_saved_models,
}
