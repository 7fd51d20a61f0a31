"""A whole scan: CSV file -> validation -> cleaning -> models -> stored results.

The batch flow of the source application's scoring step, with every stage
a Spark job; only validation messages and one-row totals reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghawk.operators import incidents as I
from loghawk.operators import prepare as P
from loghawk.operators import quality as V
from loghawk.plans.pipeline import ScanResult, run_pipeline
from loghawk.plans.scan_models import as_pipeline
from loghawk.sources.logs import land_logs
from loghawk.sources.store import ScanStore


@dataclass
class Scan:
    scan_id: int
    issues: list[str]
    quality: DataFrame | None
    result: ScanResult | None
    incidents: DataFrame | None
    rejects: DataFrame | None = None


def run_scan(spark: SparkSession, path: str, store: ScanStore, scan_id: int | None, user_id: int,
             dataset_name: str, min_severity: str = "High", year: int | None = None,
             scan_date: str | None = None, multi_line: bool = False, **model_params) -> Scan:
    """Land, validate, clean, score, then persist the scan, its rows, models, incidents and an audit entry.

    An invalid file stops after validation (``result`` is None). Without a
    ``scan_id`` the store assigns the next one; running a ``scan_id`` again
    replaces its scan row, events and incidents.
    """
    if scan_id is None:
        scan_id = store.next_id("scans")
    landed = land_logs(spark, path, multi_line=multi_line)
    ok, issues = V.judge(landed.missing, landed.counts)
    if not ok:
        return Scan(scan_id, issues, None, None, None, landed.rejects)
    prepared = P.preprocess(landed.rows)
    result = run_pipeline(prepared.clean, **model_params)
    issues = issues + result.warnings
    incidents = I.incident_records(result.scored, scan_id, min_severity=min_severity, year=year)
    with store.transaction() as tx:
        tx.write_events(scan_id, result.scored)
        tx.write_models(scan_id, as_pipeline(result.models, result.class_names))
        tx.write_incidents(scan_id, I.incident_rows_for_store(incidents, scan_id))
        tx.write_scan(scan_id, user_id, dataset_name, result.metrics, scan_date,
                      detection_metrics=result.detection_metrics,
                      classification_accuracy=result.classification_accuracy)
    audit = result.metrics.select(
        F.lit(store.next_id("audit_log")).cast("bigint").alias("id"), F.lit(user_id).cast("bigint").alias("user_id"),
        F.lit("run_scan").alias("action"),
        F.format_string("Scan #%d on %s", F.lit(scan_id), F.lit(dataset_name)).alias("details"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    store.write_audit(audit)
    return Scan(scan_id, issues, prepared.report, result, incidents, landed.rejects)


__all__ = ["Scan", "run_scan"]
