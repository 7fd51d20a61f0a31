"""Scored tables built from the fixtures, shared by the query catalog and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loghawk.functions import round_half_even
from loghawk.operators import scoring
from loghawk.operators.anomaly import flag_anomalies
from loghawk.sources import fixtures


def scored_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 model outputs -> anomaly flags (M15) -> threat scores (T1-T4) -> published rounding (T5)."""
    raw = fixtures.model_outputs(spark, sf_dir)
    flagged = flag_anomalies(raw, raw_col="anomaly_score")
    scored = scoring.threat_scores(flagged)
    return scored.withColumns({
        "attack_type_confidence": round_half_even("attack_type_confidence", 4),
        "attack_probability": round_half_even("attack_probability", 4),
        "anomaly_score": round_half_even("anomaly_score", 2),
    })
