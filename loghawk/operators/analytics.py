"""Analyst queries over scored logs.

Each takes the scored table and returns a small result frame. Filters and
column lists are declared before aggregation so Catalyst prunes the scan and
pushes predicates; top-k queries compile to TakeOrderedAndProject (a bounded
heap per task), never a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.functions import parse_timestamp, portable_hash, round_half_even

def _is_attack():
    return F.col("predicted_label") == "Attack"


def _attacks(df: DataFrame) -> DataFrame:
    return df.where(_is_attack())


def _with_ts(df: DataFrame) -> DataFrame:
    """Rows whose timestamp text parses; adds ``ts`` (bad values dropped)."""
    return df.withColumn("ts", parse_timestamp("timestamp")).where(F.col("ts").isNotNull())


def _hour(ts="ts"):
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def kpi_row(scored: DataFrame) -> DataFrame:
    """A1: total, normal, attacks, critical and attack rate (%, 1 dp; 0 if empty)."""
    agg = scored.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(F.col("predicted_label") == "Normal").alias("normal_count"),
        F.count_if(_is_attack()).alias("attack_count"),
        F.count_if(F.col("severity") == "Critical").alias("critical_count"))
    return with_attack_rate(agg)


def with_attack_rate(totals: DataFrame) -> DataFrame:
    """Attacks as a share of all rows (%, 1 dp; 0 if there are none)."""
    rate = F.when(F.col("total_logs") > 0,
                  F.col("attack_count") / F.col("total_logs") * F.lit(100.0)).otherwise(F.lit(0.0))
    return totals.withColumn("attack_rate", round_half_even(rate, 1))


def attack_timeline(scored: DataFrame) -> DataFrame:
    """A2: rows per hour and predicted label (unparsable timestamps dropped)."""
    return (_with_ts(scored.select("timestamp", "predicted_label"))
            .groupBy(_hour().alias("hour_bucket"), "predicted_label")
            .agg(F.count(F.lit(1)).alias("count")))


def severity_distribution(scored: DataFrame) -> DataFrame:
    """A3: counts for Critical, High, Medium, Low (0 when absent), with their order.

    One pass of conditional counts unpivoted by ``stack``: no dimension join.
    """
    return stack_severities(scored, lambda s: F.count_if(F.col("severity") == s))


def stack_severities(rows: DataFrame, count_of) -> DataFrame:
    """(display_order, severity, count) with ``count_of(severity)`` as the aggregate."""
    names = C.SEVERITY_DISPLAY_ORDER
    wide = rows.agg(*[count_of(s).alias(f"_{i}") for i, s in enumerate(names)])
    parts = ", ".join(f"{i}, '{s}', _{i}" for i, s in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {parts}) AS (display_order, severity, count)") \
               .withColumn("display_order", F.col("display_order").cast("int"))


def attack_type_breakdown(scored: DataFrame) -> DataFrame:
    """A4: attack rows per predicted type, most common first."""
    return (_attacks(scored).groupBy(F.col("attack_type_predicted").alias("attack_type"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("attack_type")))


def _top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc(key)).limit(n))


def top_source_ips(scored: DataFrame, n: int = 10) -> DataFrame:
    """A5: the n sources with most attack rows (ties by address)."""
    return _top_counts(_attacks(scored), "source_ip", n)


def top_destination_ips(scored: DataFrame, n: int = 10) -> DataFrame:
    """The n most targeted destinations of attack rows."""
    return _top_counts(_attacks(scored), "destination_ip", n)


def attack_heatmap(scored: DataFrame) -> DataFrame:
    """Attack rows by day name x hour of day; 24 fixed hour columns h00..h23.

    Only days present appear; ``day_order`` sorts Monday..Sunday. Counts are
    of non-null threat scores, as the source's pivot counts that column.
    """
    rows = _with_ts(_attacks(scored).select("timestamp", "threat_score", "predicted_label"))
    rows = rows.withColumns({"day": F.date_format("ts", "EEEE"), "hour": F.hour("ts")})
    cells = [F.count(F.when(F.col("hour") == h, F.col("threat_score"))).alias(f"h{h:02d}")
             for h in range(24)]
    day_index = F.array_position(F.array(*[F.lit(d) for d in C.DAY_ORDER]), F.col("day")).cast("int")
    return rows.groupBy("day").agg(*cells).withColumn("day_order", day_index).orderBy("day_order")


def attack_heatmap_long(scored: DataFrame) -> DataFrame:
    """A7, long form: (day, hour, count) for the non-empty cells."""
    rows = _with_ts(_attacks(scored).select("timestamp", "threat_score", "predicted_label"))
    return (rows.groupBy(F.date_format("ts", "EEEE").alias("day"), F.hour("ts").alias("hour"))
                .agg(F.count("threat_score").alias("count")))


SAMPLE_COLUMNS = ["bytes_sent", "bytes_received", "predicted_label", "connection_duration",
                  "source_ip", "destination_ip", "attack_type_predicted"]


def traffic_sample(scored: DataFrame, n: int = C.TRAFFIC_SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """Uniform sample of min(n, rows) rows without replacement, 7 columns.

    The random key is a portable hash of (row_id, seed), so the sample does
    not depend on partitioning; top-n on it is a bounded heap per task.
    """
    key = portable_hash("row_id", seed)
    return scored.orderBy(key, F.col("row_id")).limit(n).select(*SAMPLE_COLUMNS)


def threat_leaderboard(scored: DataFrame, top_n: int = 10) -> DataFrame:
    """Riskiest attack sources by mean threat score, rank 1..n, 1 dp.

    Mean compared at 9 decimals so float summation order cannot reorder ties;
    remaining ties by address.
    """
    per_src = (_attacks(scored).groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("events"),
        F.avg("threat_score").alias("_avg"),
        F.max("threat_score").alias("_max")))
    top = per_src.orderBy(F.desc(round_half_even("_avg", 9)), F.asc("source_ip")).limit(top_n)
    rank = F.row_number().over(Window.orderBy(F.desc(round_half_even("_avg", 9)), F.asc("source_ip")))
    return top.select(
        rank.alias("rank"), "source_ip", "events",
        round_half_even("_avg", 1).alias("avg_threat_score"),
        round_half_even("_max", 1).alias("max_threat_score"))


def hourly_attack_counts(scored: DataFrame) -> DataFrame:
    """A10: attack rows per hour from the first to the last attack hour, gaps as 0."""
    return fill_hours(_attack_hours(scored))


def _attack_hours(scored: DataFrame) -> DataFrame:
    return (_with_ts(_attacks(scored).select("timestamp", "predicted_label"))
            .groupBy(_hour().alias("hour")).agg(F.count(F.lit(1)).alias("_n")))


def fill_hours(counts: DataFrame) -> DataFrame:
    """Hours (hour, _n) from the first to the last, numbered, gaps as 0.

    The hour grid depends on the time span alone, which ``parse_timestamp`` bounds;
    it is expanded by day first, then by hour, and left-joined to the counts.
    """
    grid = (counts.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
            .where(F.col("lo").isNotNull())
            .select("lo", "hi", F.explode(F.sequence(F.date_trunc("day", "lo"), F.date_trunc("day", "hi"),
                                                     F.expr("INTERVAL 1 DAY"))).alias("day"))
            .select("lo", "hi", F.explode(F.transform(
                F.sequence(F.lit(0), F.lit(23)),
                lambda h: F.col("day") + F.make_dt_interval(F.lit(0), h))).alias("hour"))
            .where(F.col("hour").between(F.col("lo"), F.col("hi"))).drop("hi"))
    idx = F.timestamp_diff("HOUR", F.col("lo"), F.col("hour")).cast("bigint")
    return (grid.join(counts, "hour", "left")
            .select(idx.alias("hour_index"), F.col("hour").cast("timestamp_ntz").alias("hour"),
                    F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("count")))


def attack_forecast(scored: DataFrame, horizon: int = 6, min_attacks: int = 5,
                    min_hours: int = 3) -> DataFrame:
    """Least-squares line over the gap-filled hourly counts, next ``horizon`` hours.

    Empty when there are fewer than ``min_attacks`` attacks (with a valid
    timestamp) or fewer than ``min_hours`` hours; negative forecasts clip to 0.
    """
    return forecast_hours(_attack_hours(scored), horizon, min_attacks, min_hours)


def forecast_hours(counts: DataFrame, horizon: int = 6, min_attacks: int = 5, min_hours: int = 3) -> DataFrame:
    """A11 on hourly counts (hour, _n)."""
    counts = counts.select("hour", F.col("_n").cast("double").alias("y"))
    first = counts.agg(F.min("hour")).scalar()
    x = F.timestamp_diff("HOUR", first, F.col("hour")).cast("double")
    sums = counts.agg(F.sum("y").alias("n_attacks"), F.max("hour").cast("timestamp_ntz").alias("last_hour"),
                      (F.max(x) + 1).alias("n_hours"), F.sum(x * F.col("y")).alias("xy"))
    # Empty hours add nothing to the sums with y; the sums of x and x * x have a closed form.
    n, total = F.col("n_hours"), F.col("n_attacks")
    sum_x, sum_xx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    slope = F.try_divide(n * F.col("xy") - sum_x * total, n * sum_xx - sum_x * sum_x)
    fit = sums.withColumn("slope", slope).withColumn("intercept", (total - F.col("slope") * sum_x) / n)
    steps = fit.where((F.col("n_attacks") >= min_attacks) & (F.col("n_hours") >= min_hours)) \
               .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    x = (F.col("n_hours") - 1 + F.col("step")).cast("double")
    return steps.select(
        F.col("step").cast("int").alias("step"),
        (F.col("last_hour") + F.make_dt_interval(F.lit(0), F.col("step"))).cast("timestamp_ntz").alias("forecast_hour"),
        round_half_even(F.greatest(F.col("intercept") + F.col("slope") * x, F.lit(0.0)), 6).alias("forecast"))


def average_threat_score(scored: DataFrame) -> DataFrame:
    """Mean threat score, 1 dp."""
    return scored.agg(round_half_even(F.avg("threat_score"), 1).alias("average_threat_score"))


TOP_EVENT_COLUMNS = ["timestamp", "source_ip", "destination_ip", "attack_type_predicted",
                     "attack_probability", "anomaly_score", "frequency_score", "severity_weight",
                     "threat_score", "severity"]


def top_scored_events(scored: DataFrame, n: int = 50) -> DataFrame:
    """The n highest threat scores (ties by row_id)."""
    return (scored.orderBy(F.desc("threat_score"), F.asc("row_id")).limit(n)
                  .select("row_id", *TOP_EVENT_COLUMNS))


ANOMALY_COLUMNS = ["timestamp", "source_ip", "destination_ip", "protocol", "bytes_sent",
                   "bytes_received", "connection_duration", "anomaly_score"]


def top_anomalies(scored: DataFrame, n: int = 20) -> DataFrame:
    """Flagged anomalies with the highest anomaly scores."""
    return (scored.where(F.col("is_anomaly")).orderBy(F.desc("anomaly_score"), F.asc("row_id"))
                  .limit(n).select("row_id", *ANOMALY_COLUMNS))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Anomalies flagged and mean anomaly score (1 dp)."""
    return scored.agg(F.count_if(F.col("is_anomaly")).alias("anomalies_flagged"),
                      round_half_even(F.avg("anomaly_score"), 1).alias("avg_anomaly_score"))


def anomaly_histogram(scored: DataFrame, bins: int = 40, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Counts of anomaly scores in ``bins`` equal bins over [lo, hi]; top edge in the last bin."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("anomaly_score") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (scored.where(F.col("anomaly_score").isNotNull())
            .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"), "count"))


def classified_preview(scored: DataFrame, n: int = 200) -> DataFrame:
    """First n detected rows (row order): addresses, type, confidence 3 dp."""
    return (_attacks(scored).orderBy("row_id").limit(n).select(
        "row_id", "source_ip", "destination_ip",
        F.col("attack_type_predicted").alias("predicted_attack_type"),
        round_half_even("attack_type_confidence", 3).alias("confidence")))


def preview_type_counts(scored: DataFrame) -> DataFrame:
    """Predicted type counts over all detected rows."""
    return (_attacks(scored).groupBy(F.col("attack_type_predicted").alias("attack_type"))
            .agg(F.count(F.lit(1)).alias("count")))


def detected_count(scored: DataFrame) -> DataFrame:
    """Rows flagged as attacks out of all rows."""
    return scored.agg(F.count_if(_is_attack()).alias("attacks_flagged"), F.count(F.lit(1)).alias("total_rows"))


def table_preview(df: DataFrame, n: int = 20) -> DataFrame:
    """First n rows in row order."""
    return df.orderBy("row_id").limit(n)
