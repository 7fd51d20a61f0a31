"""The scan pipeline (M16): clean logs -> detect -> classify -> anomaly -> threat score.

One lazy chain with two lineage cuts in the shared checkpoint folder: after
the model transforms (so the global statistics over the model outputs do not
re-run the models or the Python scorer) and after scoring (so every analyst
query reads the scored table instead of recomputing it).
"""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.operators import anomaly as AN
from loghawk.operators import detect as D
from loghawk.operators import scoring as T
from loghawk.operators.prepare import FEATURE_COLUMNS, cut_lineage, feature_vector
from loghawk.session import run_in_pool

SCORED_COLUMNS = [
    "row_id", "timestamp", "source_ip", "destination_ip", "protocol", "bytes_sent", "bytes_received",
    "connection_duration", "attack_type", "is_outlier", "protocol_encoded",
    *[f"{c}_scaled" for c in C.NUMERIC_COLUMNS],
    "frequency_score", "severity_weight", "threat_score", "severity", "predicted_label",
    "attack_type_predicted", "attack_type_confidence", "attack_probability", "anomaly_score", "is_anomaly",
]


@dataclass
class ScanResult:
    scored: DataFrame
    metrics: DataFrame
    detection_metrics: DataFrame | None
    classification_accuracy: DataFrame | None
    class_names: list[str]
    warnings: list[str] = field(default_factory=list)
    models: dict = field(default_factory=dict)
    predictions: DataFrame | None = None


def run_pipeline(clean: DataFrame, contamination: float = C.DEFAULT_CONTAMINATION,
                 rf_trees: int = C.RF_TREES, rf_depth: int = C.RF_DEPTH, gbt_rounds: int = C.GBT_ROUNDS,
                 gbt_depth: int = C.GBT_DEPTH, iso_trees: int = C.IFOREST_TREES,
                 seed: int = C.MODEL_SEED, checkpoint: bool = True) -> ScanResult:
    """Every model is trained on ``clean`` and applied to all of its rows.

    The feature table is written once at the head: guards, splits and fits read it
    a dozen times.
    """
    warnings: list[str] = []
    feats = cut_lineage(feature_vector(clean), checkpoint)
    # The three model families are independent: fit them concurrently (Spark
    # schedules the jobs of all driver threads on the same executors; each
    # family has its own scheduler pool, used when the cluster runs FAIR).
    # The 100 sequential boosting rounds are the longest chain, so the
    # detector's label/split/checkpoint jobs run first, alone; the classifier
    # and the isolation forest start when its fits start and finish inside
    # the booster's time.
    spark = clean.sparkSession
    fits_started = threading.Event()
    with ThreadPoolExecutor(max_workers=3) as pool:
        det_f = pool.submit(D.detect_attacks, feats, seed=seed, rf_trees=rf_trees, rf_depth=rf_depth,
                            gbt_rounds=gbt_rounds, gbt_depth=gbt_depth, on_fit=fits_started.set)
        while not fits_started.wait(0.5) and not det_f.done():
            pass
        if det_f.done() and det_f.exception() is not None:
            raise det_f.exception()  # failed before fitting: start nothing else
        cls_f = pool.submit(run_in_pool, spark, "classifier", D.classify_attacks, feats, trees=rf_trees,
                            depth=rf_depth, seed=seed)
        iso_f = pool.submit(run_in_pool, spark, "isolation", AN.fit_isolation_forest, feats, FEATURE_COLUMNS,
                            n_trees=iso_trees, seed=seed)
        det, cls, forest = det_f.result(), cls_f.result(), iso_f.result()
    if det.warning:
        warnings.append(det.warning)
    if cls.warning:
        warnings.append(cls.warning)
    rows = det.scored
    if cls.model is not None:
        rows = D.apply_classifier(rows, cls.model)
    rows = D.assign_attack_type(rows, cls.class_names)
    rows = AN.isolation_scores(rows, forest)
    keep = [c for c in rows.columns if c not in ("features", "class_probability", "y", "is_test",
                                                   "p_rf", "p_gbt")]
    predictions = cut_lineage(rows.select(*keep), checkpoint)
    rows = AN.flag_anomalies(AN.normalise_scores(predictions), contamination=contamination)
    scored = T.finalize_scored(T.threat_scores(rows))
    scored = cut_lineage(scored.select(*SCORED_COLUMNS), checkpoint)
    return ScanResult(scored=scored, metrics=T.scan_metrics(scored, cls.class_names), detection_metrics=det.metrics,
                      classification_accuracy=cls.accuracy, class_names=cls.class_names,
                      warnings=warnings, predictions=predictions,
                      models={**det.models, "classifier": cls.model, "isolation_forest": forest})
