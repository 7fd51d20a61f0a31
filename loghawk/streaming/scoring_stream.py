"""Incremental scoring of arriving log files with Structured Streaming.

A batch scan fits the models and a *profile* of global statistics (medians,
quartiles, scaling, protocol codes, per-source counts, anomaly range and
cut). New CSV files are then scored as a stream against that profile:

* ``readStream`` over a folder of CSV text, all columns read as strings;
* first-wins deduplication per event time with a watermark
  (``dropDuplicatesWithinWatermark``), so state stays bounded;
* the batch operators' column expressions with the profile's scalars as
  literals, the fitted ``pyspark.ml`` models' ``transform`` and the
  isolation-forest pandas UDF;
* the protocol code and the source frequency through stream-static joins
  with the profile's code table and per-source counts (no state);
* hourly attack counts with a one-hour event-time window and watermark.

Forward fill has no meaning on an unordered stream: rows without a parsable
timestamp have no event time to deduplicate or window by. ``undated_rows`` is the
stream of them, to be stored and filled by the next batch scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk import constants as C
from loghawk.functions import null_na_tokens, parse_timestamp
from loghawk.operators import scoring as S
from loghawk.functions.stats import quantiles
from loghawk.operators.prepare import coerce_numeric, cut_lineage, feature_vector, protocol_codes
from loghawk.plans.scan_models import ScanModels, predict

LOG_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in C.REQUIRED_COLUMNS + ["attack_type"]])


@dataclass
class StreamProfile:
    medians: dict
    quartiles: dict
    means: dict
    stds: dict
    protocol_codes: DataFrame     # (protocol, protocol_encoded), static side of a join
    n_protocols: int
    source_counts: DataFrame      # (source_ip, _src_n), the static side of a join
    busiest: int
    iso_lo: float
    iso_hi: float
    iso_cut: float
    models: dict
    class_names: list


def fit_profile(clean: DataFrame, result, contamination: float = C.DEFAULT_CONTAMINATION,
                saved: ScanModels | None = None) -> StreamProfile:
    """Profile from a batch scan: one aggregate over the clean table, one over predictions.

    ``result`` is the scan's result; with ``saved`` models (``load_scan_models``) only the
    predictions are taken from it, or made by these models if it is None. Only scalars and the
    (bounded) protocol list reach the driver; the per-source counts stay a DataFrame,
    persisted in the checkpoint folder.
    """
    source = saved or ScanModels(result.models, result.class_names)
    predictions = result.predictions if result is not None else cut_lineage(
        predict(feature_vector(clean), source.models, source.class_names).select("iso_score"))
    nums = C.NUMERIC_COLUMNS
    st = clean.agg(*[F.avg(c).alias(f"m_{c}") for c in nums],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in nums]).first()
    cuts = quantiles(clean, nums, [0.25, 0.5, 0.75])
    codes = protocol_codes(clean).checkpoint(eager=True)
    counts = clean.groupBy("source_ip").agg(F.count(F.lit(1)).alias("_src_n")).checkpoint(eager=True)
    busiest = counts.agg(F.max("_src_n")).first()[0]
    iso = predictions.agg(F.min("iso_score"), F.max("iso_score")).first()
    iso_cut = quantiles(predictions, ["iso_score"], [1.0 - contamination])["iso_score"][0]
    return StreamProfile(
        medians={c: cuts[c][1] for c in nums}, quartiles={c: (cuts[c][0], cuts[c][2]) for c in nums},
        means={c: st[f"m_{c}"] for c in nums}, stds={c: st[f"s_{c}"] for c in nums},
        protocol_codes=codes, n_protocols=codes.count(), source_counts=counts, busiest=int(busiest),
        iso_lo=iso[0], iso_hi=iso[1], iso_cut=iso_cut, models=source.models, class_names=source.class_names)


def read_log_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA).option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(folder)
    return raw.select(*[null_na_tokens(c).alias(c) for c in raw.columns])


def undated_rows(stream: DataFrame) -> DataFrame:
    """The rows that ``clean_stream`` can't take: no parsable timestamp."""
    return stream.where(parse_timestamp("timestamp").isNull())


def clean_stream(stream: DataFrame, profile: StreamProfile, watermark: str = "1 hour") -> DataFrame:
    """Stream form of P1-P9 with the profile's statistics."""
    df = coerce_numeric(stream)
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(profile.medians[c]), F.lit(0.0)) for c in C.NUMERIC_COLUMNS})
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in C.TEXT_FILL_COLUMNS})
    df = df.withColumn("attack_type", F.coalesce(F.col("attack_type"), F.lit("Unknown")))
    df = df.withColumn("event_time", parse_timestamp("timestamp").cast("timestamp")).where(F.col("event_time").isNotNull())
    df = df.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(C.REQUIRED_COLUMNS)
    outlier = F.lit(False)
    scaled = {}
    for c in C.NUMERIC_COLUMNS:
        q1, q3 = profile.quartiles[c]
        outlier = outlier | (F.col(c) < F.lit(q1 - 1.5 * (q3 - q1))) | (F.col(c) > F.lit(q3 + 1.5 * (q3 - q1)))
        sd = profile.stds[c] or 1.0
        scaled[f"{c}_scaled"] = (F.col(c) - F.lit(profile.means[c])) / F.lit(sd)
    coded = df.join(profile.protocol_codes, "protocol", "left")
    return (coded.withColumn("is_outlier", outlier)
            .withColumn("protocol_encoded", F.coalesce(F.col("protocol_encoded"), F.lit(profile.n_protocols)))
            .withColumns(scaled)
            .withColumn("row_id", F.xxhash64(*C.REQUIRED_COLUMNS)))


def score_stream(stream: DataFrame, profile: StreamProfile) -> DataFrame:
    """Models and threat score on a cleaned stream (no stateful operator besides dedup)."""
    rows = predict(feature_vector(stream), profile.models, profile.class_names)
    span = profile.iso_hi - profile.iso_lo
    rows = rows.withColumns({
        "anomaly_score": F.lit(0.0) if span < 1e-9 else
        F.least(F.greatest((F.col("iso_score") - F.lit(profile.iso_lo)) / F.lit(span) * 100.0, F.lit(0.0)), F.lit(100.0)),
        "is_anomaly": F.col("iso_score") > F.lit(profile.iso_cut)})
    freq = rows.join(profile.source_counts, "source_ip", "left").withColumn(
        "_freq", F.coalesce(F.col("_src_n") / F.lit(float(profile.busiest)) * 100.0, F.lit(0.0)))
    return S.finalize_scored(S.blend(freq, "_freq")).drop("_src_n")


def hourly_attacks(scored: DataFrame) -> DataFrame:
    """A2 on a stream: attack rows per event-time hour (append mode after the watermark)."""
    return (scored.where(F.col("predicted_label") == "Attack")
            .groupBy(F.window("event_time", "1 hour").alias("hour"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("hour.start").alias("hour_bucket"), "count"))
