"""Scan history queries (H1-H13) over the store tables.

Tables: ``users``, ``scans``, ``scan_events`` (partitioned by scan_id),
``incident_reports`` (partitioned by scan_id) and ``audit_log``. Every
function is DataFrame -> DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCAN_LIST_COLUMNS = ["id", "username", "dataset_name", "scan_date", "total_logs",
                     "threat_count", "critical_count"]

REPORT_SCHEMA = T.StructType([
    T.StructField("total_logs", T.LongType()), T.StructField("normal_count", T.LongType()),
    T.StructField("attack_count", T.LongType()), T.StructField("critical_count", T.LongType()),
    T.StructField("high_count", T.LongType()), T.StructField("medium_count", T.LongType()),
    T.StructField("low_count", T.LongType()),
    T.StructField("classification_classes", T.ArrayType(T.StringType())),
    T.StructField("detection_metrics", T.ArrayType(T.StructType([
        T.StructField("model", T.StringType()), T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType())]))),
    T.StructField("classification_accuracy", T.DoubleType()),
])


def scans_for_user(scans: DataFrame, user_id: int) -> DataFrame:
    """H1: one user's scans, newest first."""
    return scans.where(F.col("user_id") == F.lit(user_id)).orderBy(F.desc("scan_date"), F.desc("id"))


def scan_by_id(scans: DataFrame, scan_id: int) -> DataFrame:
    """H2: point lookup."""
    return scans.where(F.col("id") == F.lit(scan_id))


def all_scans(scans: DataFrame, users: DataFrame) -> DataFrame:
    """H3: scans with their owner's name (inner join), newest first, the 7 listed columns.

    No broadcast hint: AQE broadcasts ``users`` when its measured size is
    under the threshold and otherwise runs a shuffle join (skew-split).
    """
    u = users.select(F.col("id").alias("_uid"), "username")
    return (scans.join(u, scans["user_id"] == u["_uid"], "inner")
            .select(*SCAN_LIST_COLUMNS).orderBy(F.desc("scan_date"), F.desc("id")))


def without_deleted(df: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """H4: rows whose scan is not among the deleted ones (left anti join)."""
    return df.join(deleted.select(F.col("scan_id").alias(key)).distinct(), key, "left_anti")


def count_rows(df: DataFrame, name: str) -> DataFrame:
    """H5: row count as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(name))


def sum_threats(scans: DataFrame) -> DataFrame:
    """H6: total threats over all scans, 0 when there are none."""
    return scans.agg(F.coalesce(F.sum("threat_count"), F.lit(0)).cast("bigint").alias("total_threats"))


def events_for_scan(events: DataFrame, scan_id: int) -> DataFrame:
    """H7: rows of one scan (a partition filter: only that directory is read)."""
    return events.where(F.col("scan_id") == F.lit(scan_id))


def global_top_sources(events: DataFrame, limit: int = 10) -> DataFrame:
    """H8: sources with most attack rows over all stored scans."""
    return (events.where(F.col("predicted_label") == "Attack").groupBy("source_ip")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("source_ip")).limit(limit))


def reports_for_scan(incidents: DataFrame, scan_id: int) -> DataFrame:
    """H9: incident rows of one scan."""
    return incidents.where(F.col("scan_id") == F.lit(scan_id))


def recent_audit(audit: DataFrame, limit: int = 100) -> DataFrame:
    """Newest audit rows."""
    return audit.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def user_totals(scans: DataFrame) -> DataFrame:
    """Per user: scans run, threats found, critical threats."""
    return scans.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("scans_run"),
        F.coalesce(F.sum("threat_count"), F.lit(0)).cast("bigint").alias("threats_found"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).cast("bigint").alias("critical_total"))


def user_recent_scans(scans: DataFrame, n: int = 5) -> DataFrame:
    """Each user's n newest scans (a per-partition group limit runs before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("scan_date"), F.desc("id")))
    return scans.withColumn("recent_rank", rank).where(F.col("recent_rank") <= n)


def list_users(users: DataFrame) -> DataFrame:
    """Users without secrets, newest first."""
    return users.select("id", "username", "email", "role", "created_at").orderBy(F.desc("created_at"), F.desc("id"))


def scan_report(scans: DataFrame) -> DataFrame:
    """The stored metrics JSON parsed; a missing report parses as an empty one."""
    parsed = F.from_json(F.coalesce(F.col("report_json"), F.lit("{}")), REPORT_SCHEMA)
    return scans.select("id", parsed.alias("report")).select("id", "report.*")
