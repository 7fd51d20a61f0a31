"""Cleaning queries over the F1 fixture, one per step, for the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.functions import round_half_even
from loghawk.operators import prepare as P
from loghawk.operators import quality as V
from loghawk.session import scratch_path
from loghawk.sources import fixtures
from loghawk.sources.logs import land_logs, read_logs

NUMS = C.NUMERIC_COLUMNS


def _coerced(spark, sf_dir):
    return P.coerce_numeric(fixtures.security_logs(spark, sf_dir))


def _filled(spark, sf_dir):
    return P.fill_label(P.fill_unknown(P.fill_median(_coerced(spark, sf_dir))))


def _tsfilled(spark, sf_dir):
    return P.forward_back_fill(_filled(spark, sf_dir), "timestamp")


def _dedup(spark, sf_dir):
    return P.dedup_first(_tsfilled(spark, sf_dir))


def _outl(spark, sf_dir):
    return P.flag_outliers(P.cut_lineage(_dedup(spark, sf_dir)))


def clean_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clean_logs(fixtures.security_logs(spark, sf_dir))


def _scaled_out():
    return [round_half_even(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in NUMS]


def q_read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 round trip: the F1 logs written as CSV text in order, read back as strings, numbered by file order."""
    path = scratch_path(spark, "csv")
    logs = fixtures.security_logs(spark, sf_dir).withColumnRenamed("row_id", "source_row")
    logs.orderBy("source_row").write.option("header", True).csv(path)
    return read_logs(spark, path)


def _landed(spark: SparkSession, sf_dir: str):
    path = scratch_path(spark, "csv")
    lines = fixtures.log_lines(spark, sf_dir).select(F.col("line").alias(fixtures.LOG_HEADER))
    lines.write.option("header", True).option("sep", "\x01").csv(path)  # each line is one cell
    return land_logs(spark, path, order_col="source_row")


def q_read_logs_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1's quarantine: every record whose cells don't match the header, as it stands in the file."""
    return _landed(spark, sf_dir).rejects


def q_landed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2-V4 of the good rows as validation gets them, beside the number of rows that are read on."""
    landed = _landed(spark, sf_dir)
    counts = spark.createDataFrame([(k, v) for k, v in landed.counts.items()], "name string, count long")
    stored = landed.rows.agg(F.count(F.lit(1)).alias("count")).select(F.lit("stored").alias("name"), "count")
    return counts.unionByName(stored)


def q_validate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 on the whole F1 table and without two of its columns: missing names, rows looked at."""
    logs = fixtures.security_logs(spark, sf_dir)
    cut = logs.drop("protocol", "bytes_sent")
    out = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), F.lit(", ".join(V.missing_columns(df))).alias("missing"), "row_count")
        for name, df in (("all", logs), ("cut", cut))]
    return out[0].unionByName(out[1])


QUERIES = {
    "read_logs": q_read_logs,
    "read_logs_rejects": q_read_logs_rejects,
    "landed_counts": q_landed_counts,
    "validation_counts": lambda s, d: V.validation_counts(fixtures.security_logs(s, d)),
    "non_numeric_counts": lambda s, d: V.validation_counts(fixtures.security_logs(s, d))
        .where("check = 'non_numeric'").drop("check"),
    "null_counts": lambda s, d: V.validation_counts(fixtures.security_logs(s, d))
        .where("check = 'nulls' AND count > 0").drop("check"),
    "is_empty": lambda s, d: V.validation_counts(fixtures.security_logs(s, d))
        .where("check = 'rows'").select((F.col("count") == 0).alias("is_empty")),
    "validate_columns": q_validate_columns,
    "coerce_numeric": lambda s, d: _coerced(s, d).select("row_id", *NUMS),
    "fill_median": lambda s, d: P.fill_median(_coerced(s, d)).select("row_id", *NUMS),
    "fill_unknown": lambda s, d: P.fill_unknown(_coerced(s, d)).select("row_id", *C.TEXT_FILL_COLUMNS),
    "fill_timestamp": lambda s, d: _tsfilled(s, d).select("row_id", "timestamp"),
    "fill_label": lambda s, d: P.fill_label(fixtures.security_logs(s, d)).select("row_id", "attack_type"),
    "dedup_first": _dedup,
    "flag_outliers": lambda s, d: _outl(s, d).select("row_id", "is_outlier"),
    "encode_protocol": lambda s, d: P.encode_protocol(P.cut_lineage(_dedup(s, d))).select("row_id", "protocol", "protocol_encoded"),
    "scale_features": lambda s, d: clean_fixture(s, d).select("row_id", *_scaled_out()),
    "clean_logs": lambda s, d: clean_fixture(s, d).select(
        "row_id", *C.REQUIRED_COLUMNS, "attack_type", "is_outlier", "protocol_encoded", *_scaled_out()),
    "quality_report": lambda s, d: P.quality_report(fixtures.security_logs(s, d), clean_fixture(s, d)).drop("columns"),
}
