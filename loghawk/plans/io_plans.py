"""Source/sink round trips for the catalog (S1-S10 write side).

Each query writes a table derived from the provided data into a fresh
folder under the session's checkpoint directory and returns what reading it
back gives; the oracle is the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghawk.operators import incidents as I
from loghawk.operators import scoring as T
from loghawk.plans.fixture_plans import scored_fixture
from loghawk.session import scratch_path
from loghawk.sources import export, fixtures
from loghawk.sources.store import ScanStore


_scratch = scratch_path


def q_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored_fixture(spark, sf_dir)
    path = _scratch(spark, "csv")
    export.export_csv(df, path)
    return export.read_csv_export(spark, path, df.schema)


def q_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored_fixture(spark, sf_dir)
    path = _scratch(spark, "json")
    export.export_json(df, path)
    return export.read_json_export(spark, path, df.schema)


def q_write_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored row of scan 3 stored and read back through the partition."""
    store = ScanStore(spark, _scratch(spark, "store"))
    store.write_events(3, scored_fixture(spark, sf_dir))
    store.write_events(3, scored_fixture(spark, sf_dir))  # re-run replaces, never duplicates
    return store.events().where(F.col("scan_id") == 3)


def q_write_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan row with its JSON report, read back and parsed."""
    store = ScanStore(spark, _scratch(spark, "store"))
    from loghawk.operators.history import scan_report
    from loghawk.plans.model_plans import detector_metrics
    store.write_scan(3, 7, "fixture.csv", T.scan_metrics(scored_fixture(spark, sf_dir)), "2024-02-01 00:00:00",
                     detection_metrics=detector_metrics(spark, sf_dir))
    best = F.filter("detection_metrics", lambda m: m["model"] == "random_forest")[0]
    return scan_report(store.scans()).withColumn("forest_f1", best["f1"]).drop(
        "classification_classes", "classification_accuracy", "detection_metrics")


def q_write_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ScanStore(spark, _scratch(spark, "store"))
    rows = I.incident_rows_for_store(I.incident_records(scored_fixture(spark, sf_dir), 1, year=2024), 1)
    store.write_incidents(1, rows)
    store.write_incidents(1, rows)
    return store.incidents().drop("created_at")


def q_write_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ScanStore(spark, _scratch(spark, "store"))
    store.write_audit(fixtures.audit_log(spark, sf_dir))
    return store.audit()


QUERIES = {
    "export_csv": q_export_csv,
    "export_json": q_export_json,
    "write_scan": q_write_scan,
    "write_events": q_write_events,
    "write_incidents": q_write_incidents,
    "write_audit": q_write_audit,
}
