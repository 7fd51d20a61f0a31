"""Result exports (S5, S6): parallel writers, one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON records, one object per line (splittable; nulls kept as null)."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_csv_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
