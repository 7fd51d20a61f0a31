"""Incident records and summaries (I1-I7, S9 projection)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.functions import round_half_even, severity_rank

GROUP_KEYS = ["attack_type_predicted", "severity"]


def flag_incident_rows(scored: DataFrame, min_severity: str = "High") -> DataFrame:
    """Attack rows at or above ``min_severity`` (unknown minimum -> High)."""
    threshold = C.SEVERITY_RANK.get(min_severity, C.SEVERITY_RANK["High"])
    return scored.where((F.col("predicted_label") == "Attack") & (severity_rank("severity") >= threshold))


def smallest_distinct(rows: DataFrame, keys: list[str], lists: dict[str, tuple[str, str]], n: int) -> DataFrame:
    """Per group of ``keys`` and column: the ``n`` smallest distinct values, sorted, and the number of all.

    ``lists`` names the (list, count) outputs of each column. Each row gives its value of every
    column; a group-by makes them distinct. ``row_number() <= n`` is planned with a group limit
    before its shuffle, so at most groups x columns x n rows a task are sent for the lists,
    however many distinct values there are.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).alias("value")) for k, c in enumerate(lists)])
    pairs = rows.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*").distinct()
    rank = F.row_number().over(Window.partitionBy(*keys, "which").orderBy(F.asc_nulls_last("value")))
    # A missing value comes last and isn't listed; a filter for it would part this from the counts' shuffle.
    few = (pairs.withColumn("_rk", rank).where(F.col("_rk") <= n)
           .groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("which") == k, F.col("value")))).alias(names[0])
                                 for k, names in enumerate(lists.values())]))
    counts = pairs.groupBy(*keys).agg(*[F.count(F.when(F.col("which") == k, F.col("value"))).alias(names[1])
                                        for k, names in enumerate(lists.values())])
    return counts.join(few, keys).select(*keys, *[name for names in lists.values() for name in names])


def actions_for(threat_type: Column) -> Column:
    """I4: recommended actions of a type; unknown types get the fallback list."""
    m = F.create_map(*[x for k, acts in C.RECOMMENDED_ACTIONS.items()
                       for x in (F.lit(k), F.array(*[F.lit(a) for a in acts]))])
    return F.coalesce(m[threat_type], m[F.lit(C.FALLBACK_ACTION_TYPE)])


def incident_records(scored: DataFrame, scan_id: int, min_severity: str = "High",
                     year: int | None = None, listed: int = C.LISTED_ADDRESSES) -> DataFrame:
    """One record per (predicted type, severity) of the flagged rows.

    Columns: incident_id, threat_type, severity, event_count, affected_assets,
    source_ips (first ``listed`` sorted distinct each), asset_count, source_count (all
    distinct ones), avg_threat_score (2 dp), recommended_actions, first_seen, last_seen,
    incident_order. Totals are one aggregate; sources and assets are made distinct apart,
    never their pairs, and nothing is stored.
    Incident numbers follow the (type, severity) order; records are ordered
    by severity descending, then number.
    """
    flagged = flag_incident_rows(scored, min_severity)
    stats = flagged.groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("event_count"), F.avg("threat_score").alias("_avg"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    lists = smallest_distinct(flagged, GROUP_KEYS, {"destination_ip": ("affected_assets", "asset_count"),
                                                    "source_ip": ("source_ips", "source_count")}, listed)
    groups = stats.join(lists, GROUP_KEYS)
    # Few rows (one per type x severity): numbering them needs no partitioning.
    number = F.row_number().over(Window.orderBy(*GROUP_KEYS))
    yr = F.lit(year) if year is not None else F.year(F.current_date())
    numbered = groups.withColumn("_n", number)
    ordered = numbered.withColumn(
        "incident_order",
        F.row_number().over(Window.orderBy(F.desc(severity_rank("severity")), F.asc("_n"))))
    return ordered.select(
        F.format_string("INC-%d-%04d-%03d", yr, F.lit(scan_id), F.col("_n")).alias("incident_id"),
        F.col("attack_type_predicted").alias("threat_type"), "severity",
        F.col("event_count").cast("bigint").alias("event_count"),
        "affected_assets", "source_ips", "asset_count", "source_count",
        round_half_even("_avg", 2).alias("avg_threat_score"),
        actions_for(F.col("attack_type_predicted")).alias("recommended_actions"),
        "first_seen", "last_seen", "incident_order")


def incident_rows_for_store(incidents: DataFrame, scan_id: int) -> DataFrame:
    """S9 projection: assets joined by ", ", actions as JSON text."""
    return incidents.select(
        F.lit(scan_id).cast("bigint").alias("scan_id"), "incident_id", "threat_type", "severity",
        F.array_join("affected_assets", ", ").alias("affected_assets"),
        F.to_json("recommended_actions").alias("recommended_actions"))


def executive_summary(metrics: DataFrame) -> DataFrame:
    """metric/value rows from a T6 metrics row; attack share in % (1 dp, 0 if empty)."""
    pct = F.when(F.col("total_logs") > 0,
                 round_half_even(F.col("attack_count") / F.col("total_logs") * F.lit(100.0), 1)).otherwise(F.lit(0.0))
    m = metrics.withColumn("attack_pct", pct)
    items = C.SUMMARY_ITEMS
    parts = ", ".join(f"{i}, '{label}', CAST(`{c}` AS DOUBLE)" for i, (label, c) in enumerate(items))
    return m.selectExpr(f"stack({len(items)}, {parts}) AS (position, metric, value)") \
            .withColumn("position", F.col("position").cast("int"))


def incident_summary(metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Totals for the incident report: logs, attacks, critical, high, incidents."""
    n_inc = incidents.agg(F.count(F.lit(1))).scalar()
    m = metrics.withColumn("incident_count", n_inc)
    items = C.INCIDENT_SUMMARY_ITEMS
    parts = ", ".join(f"{i}, '{label}', CAST(`{c}` AS BIGINT)" for i, (label, c) in enumerate(items))
    return m.selectExpr(f"stack({len(items)}, {parts}) AS (position, metric, value)") \
            .withColumn("position", F.col("position").cast("int"))
