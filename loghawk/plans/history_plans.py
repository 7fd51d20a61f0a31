"""History queries over fixture store tables (users, scans, audit from
customer/orders; scan events from the scored fixture, one scan per day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghawk.operators import history as H
from loghawk.operators import incidents as I
from loghawk.operators import rollups as R
from loghawk.plans.fixture_plans import scored_fixture
from loghawk.session import scratch_path
from loghawk.sources import fixtures
from loghawk.sources.store import EVENT_COLUMNS, ScanStore

USER_ID = 7
SCAN_ID = 12


def scan_events_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_fixture(spark, sf_dir)
    return scored.select(F.substring("timestamp", 9, 2).cast("bigint").alias("scan_id"), *EVENT_COLUMNS)


def incident_reports_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of two scans; the second one's minimum severity is lower."""
    scored = scored_fixture(spark, sf_dir)
    first = I.incident_rows_for_store(I.incident_records(scored, scan_id=1, year=2024), scan_id=1)
    second = I.incident_records(scored, scan_id=2, year=2024, min_severity="Low")
    return first.unionByName(I.incident_rows_for_store(second, scan_id=2))


def _event_store(spark: SparkSession, sf_dir: str) -> ScanStore:
    store = ScanStore(spark, scratch_path(spark, "events"))
    store.write_event_table(scan_events_fixture(spark, sf_dir))
    return store


def q_events_for_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.events_for_scan(_event_store(spark, sf_dir).events(), SCAN_ID)


def q_delete_scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _event_store(spark, sf_dir)
    store.delete_scans(fixtures.deleted_scans(spark, sf_dir))
    return store.events()


def q_reports_for_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scans' incidents stored, one scan's read back."""
    store = ScanStore(spark, scratch_path(spark, "reports"))
    reports = incident_reports_fixture(spark, sf_dir)
    for scan in (1, 2):
        store.write_incidents(scan, reports.where(F.col("scan_id") == scan))
    return H.reports_for_scan(store.incidents(), 1).drop("created_at")


def _from_rollup(answer, table: str, scan_id: int | None = None):
    """Store every scan's rows, then answer from the rollups of all scans, or of one."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _event_store(spark, sf_dir).read(table)
        return answer(rows if scan_id is None else rows.where(F.col("scan_id") == scan_id))
    run.__name__, run.__doc__ = f"rollup_{answer.__name__}", answer.__doc__
    return run


#: query -> (operator on the rollup, rollup); each equals the query of the same name on the events
ROLLUP_ANSWERS = {
    "kpi_row": (R.kpi_row, "scan_hours"), "attack_timeline": (R.attack_timeline, "scan_hours"),
    "severity_distribution": (R.severity_distribution, "scan_hours"),
    "attack_type_breakdown": (R.attack_type_breakdown, "scan_hours"),
    "top_source_ips": (R.top_source_ips, "scan_addresses"),
    "top_destination_ips": (R.top_destination_ips, "scan_addresses"),
    "attack_heatmap": (R.attack_heatmap, "scan_hours"),
    "hourly_attack_counts": (R.hourly_attack_counts, "scan_hours"),
    "attack_forecast": (R.attack_forecast, "scan_hours"),
    "global_top_sources": (R.top_source_ips, "scan_addresses"),
}

QUERIES = {
    **{f"rollup_{name}": _from_rollup(*how) for name, how in ROLLUP_ANSWERS.items()},
    "scan_dashboard": _from_rollup(R.kpi_row, "scan_hours", SCAN_ID),
    "scans_for_user": lambda s, d: H.scans_for_user(fixtures.scans(s, d), USER_ID),
    "scan_by_id": lambda s, d: H.scan_by_id(fixtures.scans(s, d), SCAN_ID),
    "all_scans": lambda s, d: H.all_scans(fixtures.scans(s, d), fixtures.users(s, d)),
    "delete_scan_scans": lambda s, d: H.without_deleted(fixtures.scans(s, d), fixtures.deleted_scans(s, d), "id"),
    "delete_scan_events": q_delete_scan_events,
    "count_scans": lambda s, d: H.count_rows(fixtures.scans(s, d), "scan_count"),
    "count_users": lambda s, d: H.count_rows(fixtures.users(s, d), "user_count"),
    "sum_threats": lambda s, d: H.sum_threats(fixtures.scans(s, d)),
    "events_for_scan": q_events_for_scan,
    "global_top_sources": lambda s, d: H.global_top_sources(scan_events_fixture(s, d)),
    "reports_for_scan": q_reports_for_scan,
    "recent_audit": lambda s, d: H.recent_audit(fixtures.audit_log(s, d), 200),
    "user_totals": lambda s, d: H.user_totals(fixtures.scans(s, d)),
    "user_recent_scans": lambda s, d: H.user_recent_scans(fixtures.scans(s, d)),
    "list_users": lambda s, d: H.list_users(fixtures.users(s, d)),
    "scan_report": lambda s, d: H.scan_report(fixtures.scans(s, d)).withColumn(
        "classification_classes", F.array_join("classification_classes", ", "))
        .drop("detection_metrics", "classification_accuracy"),
}
