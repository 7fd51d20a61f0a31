"""Threat scoring (T1-T6): frequency, severity weight, blended 0-100 score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.functions import clip, round_half_even, severity_bucket, severity_weight


def frequency_score(df: DataFrame, source_col: str = "source_ip",
                    out_col: str = "frequency_score") -> DataFrame:
    """Rows per source / rows of the busiest source x 100; null source -> 0.

    Per-source counts are a partial-aggregated group-by; the busiest count is a
    scalar subquery over them. Counts join back on the source: AQE broadcasts
    the count table when its measured size is small and otherwise splits the
    partition of a hot source (skew join), so one source with a third of all
    rows does not land in one task.
    """
    counts = (df.where(F.col(source_col).isNotNull())
              .groupBy(source_col).agg(F.count(F.lit(1)).alias("_src_n")))
    busiest = counts.agg(F.max("_src_n")).scalar()
    return (df.join(counts, on=source_col, how="left")
              .withColumn(out_col, F.coalesce(F.col("_src_n") / busiest * F.lit(100.0), F.lit(0.0)))
              .drop("_src_n"))


def threat_scores(df: DataFrame, probability_col: str = "attack_probability",
                  anomaly_col: str = "anomaly_score",
                  type_col: str = "attack_type_predicted") -> DataFrame:
    """Adds frequency_score, severity_weight, threat_score (2 dp), severity.

    Severity buckets the unrounded score.
    """
    return blend(frequency_score(df, out_col="_freq"), "_freq", probability_col, anomaly_col, type_col)


def blend(df: DataFrame, frequency_col: str, probability_col: str = "attack_probability",
          anomaly_col: str = "anomaly_score", type_col: str = "attack_type_predicted") -> DataFrame:
    """T2-T4 on rows that have their frequency; that column is replaced by the published one."""
    w = C.BLEND_WEIGHTS
    sev_w = severity_weight(F.col(type_col))
    raw = (F.lit(w["attack"]) * (clip(probability_col, 0.0, 1.0) * F.lit(100.0))
           + F.lit(w["anomaly"]) * clip(anomaly_col, 0.0, 100.0)
           + F.lit(w["frequency"]) * F.col(frequency_col)
           + F.lit(w["severity"]) * sev_w)
    raw = clip(raw, 0.0, 100.0)
    return (df.withColumns({
        "frequency_score": round_half_even(frequency_col, 2),
        "severity_weight": round_half_even(sev_w, 2),
        "threat_score": round_half_even(raw, 2),
        "severity": severity_bucket(raw),
    }).drop(frequency_col))


def finalize_scored(df: DataFrame, predicted_col: str = "ensemble_pred",
                    confidence_col: str = "attack_type_confidence",
                    probability_col: str = "attack_probability",
                    anomaly_col: str = "anomaly_score") -> DataFrame:
    """T5: label text and the rounding of the published model columns."""
    return df.withColumns({
        "predicted_label": F.when(F.col(predicted_col) == 1, "Attack").otherwise("Normal"),
        "attack_type_confidence": round_half_even(confidence_col, 4),
        "attack_probability": round_half_even(probability_col, 4),
        "anomaly_score": round_half_even(anomaly_col, 2),
    })


def scan_metrics(scored: DataFrame, class_names: list[str] | None = None) -> DataFrame:
    """One row of scan totals; severity counts cover all rows.

    With ``class_names`` (the classifier's label list) the row also carries
    ``classification_classes``.
    """
    def n_if(cond):
        return F.count_if(cond).cast("bigint")
    extra = [] if class_names is None else [
        F.array(*[F.lit(n) for n in class_names]).cast("array<string>").alias("classification_classes")]
    return scored.agg(
        F.count(F.lit(1)).alias("total_logs"),
        n_if(F.col("predicted_label") == "Normal").alias("normal_count"),
        n_if(F.col("predicted_label") == "Attack").alias("attack_count"),
        n_if(F.col("severity") == "Critical").alias("critical_count"),
        n_if(F.col("severity") == "High").alias("high_count"),
        n_if(F.col("severity") == "Medium").alias("medium_count"),
        n_if(F.col("severity") == "Low").alias("low_count"),
        *extra,
    )
