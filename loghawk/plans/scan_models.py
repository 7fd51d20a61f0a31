"""A scan's fitted models as one saved ``PipelineModel``, and scoring with it.

The stages are the detector forest, the booster, the type classifier with its labels
(``IndexToString``) and the isolation forest; those that a scan couldn't train are left out.
Scoring rows with the models read back gives the scores of the run that saved them: all
else, the anomaly range and cut and the sources' counts, is computed from the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import IndexToString
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.operators import anomaly as AN
from loghawk.operators import detect as D
from loghawk.operators import scoring as T
from loghawk.operators.boosting import BoostedTreesModel
from loghawk.operators.prepare import cut_lineage, feature_vector


@dataclass
class ScanModels:
    """The models by the names that ``ScanResult.models`` uses, and the classifier's labels."""
    models: dict = field(default_factory=dict)
    class_names: list = field(default_factory=list)


def as_pipeline(models: dict, class_names: list[str]) -> PipelineModel:
    """One ``PipelineModel`` of a scan's models (``ScanResult.models``, ``ScanResult.class_names``)."""
    stages = [models[name] for name in ("random_forest", "gbt") if models.get(name) is not None]
    if models.get("classifier") is not None:
        stages += [models["classifier"], IndexToString(inputCol="_cpred", outputCol="_clabel", labels=list(class_names))]
    return PipelineModel([*stages, models["isolation_forest"]])


def from_pipeline(pipeline: PipelineModel) -> ScanModels:
    """The parts of a pipeline made by :func:`as_pipeline`."""
    found = ScanModels()
    for stage in pipeline.stages:
        if isinstance(stage, RandomForestClassificationModel):
            found.models["random_forest" if stage.getProbabilityCol() == "rf_prob" else "classifier"] = stage
        elif isinstance(stage, BoostedTreesModel):
            found.models["gbt"] = stage
        elif isinstance(stage, AN.IsolationForestModel):
            found.models["isolation_forest"] = stage
        elif isinstance(stage, IndexToString):
            found.class_names = list(stage.getLabels())
    return found


def load_scan_models(path: str) -> ScanModels:
    return from_pipeline(PipelineModel.load(path))


def predict(rows: DataFrame, models: dict, class_names: list[str]) -> DataFrame:
    """Detector, classifier and isolation forest on rows with features, batch or stream.

    Without detectors the labels stand in for their predictions.
    """
    if models.get("random_forest") is not None:
        rows = models["gbt"].transform(models["random_forest"].transform(rows))
        rows = D.ensemble_vote(rows.withColumns({"p_rf": D._p1("rf_prob"), "p_gbt": D._p1("gbt_prob")}))
        rows = rows.drop("rf_prob", "rf_raw", "rf_pred", "gbt_prob", "gbt_pred", "p_rf", "p_gbt")
    else:
        rows = rows.withColumn("ensemble_pred", D.is_attack_label("attack_type").cast("int")) \
                   .withColumn("attack_probability", F.col("ensemble_pred").cast("double"))
    if models.get("classifier") is not None:
        rows = D.apply_classifier(rows, models["classifier"])
    rows = D.assign_attack_type(rows, class_names)
    return AN.isolation_scores(rows, models["isolation_forest"]).drop("features", "class_probability")


def score_with_models(clean: DataFrame, saved: ScanModels, contamination: float = C.DEFAULT_CONTAMINATION,
                      checkpoint: bool = True) -> DataFrame:
    """M16 without the fits: cleaned rows scored by a scan's saved models."""
    from loghawk.plans.pipeline import SCORED_COLUMNS
    rows = cut_lineage(predict(feature_vector(clean), saved.models, saved.class_names), checkpoint)
    rows = AN.flag_anomalies(AN.normalise_scores(rows), contamination=contamination)
    return T.finalize_scored(T.threat_scores(rows)).select(*SCORED_COLUMNS)
