"""Query catalog: name -> (spark, sf_dir) -> DataFrame.

Every query reads the provided tables (through the fixture projections) in
full; parameters are the source application's defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from loghawk.operators import analytics as A
from loghawk.operators import incidents as I
from loghawk.operators import scoring as T
from loghawk.plans import clean_plans, history_plans, io_plans, model_plans
from loghawk.plans.fixture_plans import scored_fixture

Query = Callable[[SparkSession, str], DataFrame]


def _on_scored(op, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(scored_fixture(spark, sf_dir), **kw)
    run.__name__ = op.__name__
    run.__doc__ = op.__doc__
    return run


def _threat_scores(spark, sf_dir):
    return scored_fixture(spark, sf_dir).select(
        "row_id", "source_ip", "frequency_score", "severity_weight", "threat_score", "severity")


QUERIES: dict[str, Query] = {
    "threat_scores": _threat_scores,
    "frequency_score": lambda s, d: T.frequency_score(scored_fixture(s, d).drop("frequency_score"))
        .select("row_id", "source_ip", (F.rint(F.col("frequency_score") * 1e6) / 1e6).alias("frequency_score")),
    "scored_logs": lambda spark, sf_dir: scored_fixture(spark, sf_dir),
    "scan_metrics": _on_scored(T.scan_metrics),
    "kpi_row": _on_scored(A.kpi_row),
    "attack_timeline": _on_scored(A.attack_timeline),
    "severity_distribution": _on_scored(A.severity_distribution),
    "attack_type_breakdown": _on_scored(A.attack_type_breakdown),
    "top_source_ips": _on_scored(A.top_source_ips),
    "top_destination_ips": _on_scored(A.top_destination_ips),
    "attack_heatmap": _on_scored(A.attack_heatmap),
    "attack_heatmap_long": _on_scored(A.attack_heatmap_long),
    "traffic_sample": _on_scored(A.traffic_sample),
    "threat_leaderboard": _on_scored(A.threat_leaderboard),
    "hourly_attack_counts": _on_scored(A.hourly_attack_counts),
    "attack_forecast": _on_scored(A.attack_forecast),
    "average_threat_score": _on_scored(A.average_threat_score),
    "top_scored_events": _on_scored(A.top_scored_events),
    "top_anomalies": _on_scored(A.top_anomalies),
    "anomaly_summary": _on_scored(A.anomaly_summary),
    "anomaly_histogram": _on_scored(A.anomaly_histogram),
    "classified_preview": _on_scored(A.classified_preview),
    "preview_type_counts": _on_scored(A.preview_type_counts),
    "detected_count": _on_scored(A.detected_count),
    "table_preview": _on_scored(A.table_preview),
}
QUERIES.update(clean_plans.QUERIES)


def _incidents(spark, sf_dir):
    return I.incident_records(scored_fixture(spark, sf_dir), scan_id=1, year=2024)


def _incident_records(spark, sf_dir):
    return _incidents(spark, sf_dir).withColumns({
        "affected_assets": F.array_join("affected_assets", ", "),
        "source_ips": F.array_join("source_ips", ", "),
        "recommended_actions": F.to_json("recommended_actions")})


def _incident_summary(spark, sf_dir):
    scored = scored_fixture(spark, sf_dir)
    return I.incident_summary(T.scan_metrics(scored), I.incident_records(scored, scan_id=1, year=2024))


QUERIES.update({
    "flag_incident_rows": lambda s, d: I.flag_incident_rows(scored_fixture(s, d)).select(
        "row_id", "attack_type_predicted", "severity"),
    "incident_records": _incident_records,
    "incident_ids": lambda s, d: _incidents(s, d).select("incident_id", "threat_type", "severity"),
    "recommended_actions": lambda s, d: _incidents(s, d).select(
        "threat_type", F.to_json("recommended_actions").alias("recommended_actions")),
    "incident_order": lambda s, d: _incidents(s, d).select("incident_id", "incident_order"),
    "incident_store_rows": lambda s, d: I.incident_rows_for_store(_incidents(s, d), scan_id=1),
    "executive_summary": lambda s, d: I.executive_summary(T.scan_metrics(scored_fixture(s, d))),
    "incident_summary": _incident_summary,
})
QUERIES.update(model_plans.QUERIES)
QUERIES.update(history_plans.QUERIES)
QUERIES.update(io_plans.QUERIES)
