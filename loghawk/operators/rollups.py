"""Per-scan rollups, and the analyst queries answered from them.

A scan's rows are summed up once, when they are stored, in two mergeable tables:

- ``scan_hours``: rows per (hour, predicted label, predicted type, severity), and how many of
  them have a threat score. Rows without a parsable timestamp have a null hour. Its size
  follows from the scan's time span, not from its rows.
- ``scan_addresses``: attack rows per source and per destination, null addresses included.

Counts of any set of scans are sums of theirs, so a dashboard over the whole history, or over
one scan, reads these tables and no events. Each query gives what its namesake in ``analytics``
or ``history`` gives on the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.functions import parse_timestamp
from loghawk.operators import analytics as A

HOUR_KEYS = ["hour", "predicted_label", "attack_type_predicted", "severity"]
ADDRESS_SIDES = {"source": "source_ip", "destination": "destination_ip"}


def hour_rollup(scored: DataFrame, *scan: str) -> DataFrame:
    """Rows per hour, label, type and severity, and per ``scan`` columns if there are any."""
    hour = F.date_trunc("hour", parse_timestamp("timestamp")).cast("timestamp_ntz")
    return (scored.withColumn("hour", hour).groupBy(*scan, *HOUR_KEYS)
            .agg(F.count(F.lit(1)).alias("events"), F.count("threat_score").alias("scored_events")))


def address_rollup(scored: DataFrame, *scan: str) -> DataFrame:
    """Attack rows per address and side; both sides come from one pass over the rows."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("address"))
                      for side, c in ADDRESS_SIDES.items()])
    return (A._attacks(scored).select(*scan, F.explode(sides).alias("a"))
            .groupBy(*scan, "a.side", "a.address").agg(F.count(F.lit(1)).alias("attacks")))


def _events(where: Column | None = None, column: str = "events") -> Column:
    counted = F.col(column) if where is None else F.when(where, F.col(column))
    return F.coalesce(F.sum(counted), F.lit(0))


def _attack_hours(hours: DataFrame) -> DataFrame:
    return (A._attacks(hours).where(F.col("hour").isNotNull())
            .groupBy("hour").agg(F.sum("events").alias("_n")))


def kpi_row(hours: DataFrame) -> DataFrame:
    """A1 from ``scan_hours``."""
    return A.with_attack_rate(hours.agg(
        _events().alias("total_logs"),
        _events(F.col("predicted_label") == "Normal").alias("normal_count"),
        _events(A._is_attack()).alias("attack_count"),
        _events(F.col("severity") == "Critical").alias("critical_count")))


def attack_timeline(hours: DataFrame) -> DataFrame:
    """A2 from ``scan_hours``."""
    return (hours.where(F.col("hour").isNotNull()).groupBy(F.col("hour").alias("hour_bucket"), "predicted_label")
            .agg(F.sum("events").alias("count")))


def severity_distribution(hours: DataFrame) -> DataFrame:
    """A3 from ``scan_hours``."""
    return A.stack_severities(hours, lambda s: _events(F.col("severity") == s))


def attack_type_breakdown(hours: DataFrame) -> DataFrame:
    """A4 from ``scan_hours``."""
    return (A._attacks(hours).groupBy(F.col("attack_type_predicted").alias("attack_type"))
            .agg(F.sum("events").alias("count")).orderBy(F.desc("count"), F.asc("attack_type")))


def _top_addresses(addresses: DataFrame, side: str, n: int) -> DataFrame:
    key = ADDRESS_SIDES[side]
    return (addresses.where(F.col("side") == side).groupBy(F.col("address").alias(key))
            .agg(F.sum("attacks").alias("count")).orderBy(F.desc("count"), F.asc(key)).limit(n))


def top_source_ips(addresses: DataFrame, n: int = 10) -> DataFrame:
    """A5, and H8 over all scans, from ``scan_addresses``."""
    return _top_addresses(addresses, "source", n)


def top_destination_ips(addresses: DataFrame, n: int = 10) -> DataFrame:
    """A6 from ``scan_addresses``."""
    return _top_addresses(addresses, "destination", n)


def attack_heatmap(hours: DataFrame) -> DataFrame:
    """A7 from ``scan_hours``: day name x hour of day, 24 hour columns."""
    rows = A._attacks(hours).where(F.col("hour").isNotNull())
    cells = [_events(F.hour("hour") == h, "scored_events").alias(f"h{h:02d}") for h in range(24)]
    day_index = F.array_position(F.array(*[F.lit(d) for d in C.DAY_ORDER]), F.col("day")).cast("int")
    return (rows.groupBy(F.date_format("hour", "EEEE").alias("day")).agg(*cells)
            .withColumn("day_order", day_index).orderBy("day_order"))


def hourly_attack_counts(hours: DataFrame) -> DataFrame:
    """A10 from ``scan_hours``."""
    return A.fill_hours(_attack_hours(hours))


def attack_forecast(hours: DataFrame, **parameters) -> DataFrame:
    """A11 from ``scan_hours``."""
    return A.forecast_hours(_attack_hours(hours), **parameters)
