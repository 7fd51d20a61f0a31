"""Security-log source.

``read_logs`` is lazy. ``land_logs`` parses the files once: rows and rejected records go to
Parquet in one job; what validation (V1-V4) asks for, row ids, cleaning and reports then read
the Parquet copy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk import constants as C
from loghawk.functions import null_na_tokens, parse_number
from loghawk.session import scratch_path


def with_file_order_ids(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Dense 0-based ids in file order (file path, split start, position in split).

    A file split is read by one task in order, so within a split the
    monotonically increasing id is consecutive. A per-split count table (one
    row per split, tiny) gives each split its starting offset; no global sort
    and no single-task window over the rows.
    """
    return _dense_ids(df.withColumns(_places()), id_col)


def _places() -> dict[str, Column]:
    """A row's file, split and place in the split; taken while the file is scanned."""
    return {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
            "_mono": F.monotonically_increasing_id()}


def _dense_ids(keyed: DataFrame, id_col: str) -> DataFrame:
    splits = keyed.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    offsets = splits.select(
        "_file", "_start", "_first",
        (F.sum("_n").over(Window.orderBy("_file", "_start")
                          .rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    # One row per split: AQE broadcasts it when its measured size allows.
    return (keyed.join(offsets, ["_file", "_start"])
            .withColumn(id_col, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_mono") - F.col("_first"))
            .drop("_file", "_start", "_mono", "_first", "_before"))


def read_logs(spark: SparkSession, path: str, order_col: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header; every column read as text, missing tokens -> null.

    A file whose header differs from the first one's, also in order, is an error.
    ``multi_line`` reads quoted cells with line breaks; a file is then one split.

    Rows get ``row_id`` in file order, or from ``order_col`` when the file
    carries its own ordering column. Types are coerced later (P1), so a bad
    cell never fails the read.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False) \
        .option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    cols = [c for c in raw.columns]
    cleaned = raw.select(*[null_na_tokens(F.col(f"`{c}`")).alias(c) for c in cols], "_metadata")
    if order_col is not None:
        return cleaned.drop("_metadata").withColumn("row_id", F.col(order_col).cast("bigint"))
    return with_file_order_ids(cleaned).drop("_metadata")


@dataclass
class Landed:
    rows: DataFrame                 # good rows with row_id, in Parquet
    rejects: DataFrame              # (row_id, record, reason): records that aren't rows of the table
    counts: dict[str, int]          # rows, rejects, non_numeric__<column>, nulls__<column>
    missing: list[str] = field(default_factory=list)


#: Why a record is rejected, by its number of cells against the header's.
SURPLUS, SHORT = "more cells than the header", "fewer cells than the header"


def _reader(spark: SparkSession, multi_line: bool):
    return spark.read.option("header", True).option("enforceSchema", False).option("multiLine", multi_line) \
        .option("escape", '"').option("mode", "PERMISSIVE")


def land_logs(spark: SparkSession, path: str, order_col: str | None = None, multi_line: bool = False) -> Landed:
    """S1, parsed once: good rows and rejected records land as Parquet, with the counts of V2-V4.

    A record is rejected if it has more or fewer cells than the header; nothing of it is
    guessed. Ids count all records in file order, or come from ``order_col``. Required columns
    that the header lacks are listed; then nothing is parsed.
    """
    header = _reader(spark, multi_line).option("inferSchema", False).csv(path).columns
    missing = [c for c in C.REQUIRED_COLUMNS if c not in header]
    rejected = "row_id long, record string, reason string"
    if missing:
        return Landed(spark.createDataFrame([], "row_id long"), spark.createDataFrame([], rejected), {}, missing)
    corrupt = "_corrupt"
    while corrupt in header:
        corrupt += "_"
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in header], T.StructField(corrupt, T.StringType())])
    raw = _reader(spark, multi_line).schema(schema).option("columnNameOfCorruptRecord", corrupt).csv(path)
    cells = [null_na_tokens(F.col(f"`{c}`")).alias(c) for c in header]
    good = F.col(corrupt).isNull()
    keyed = raw.select(*cells, F.col(corrupt), *[v.alias(k) for k, v in _places().items()])
    seen = {"rows": F.count_if(good), "rejects": F.count_if(~good)}
    for c in C.NUMERIC_COLUMNS:
        seen[f"non_numeric__{c}"] = F.count_if(good & F.col(c).isNotNull() & parse_number(c).isNull())
    for c in C.REQUIRED_COLUMNS:
        seen[f"nulls__{c}"] = F.count_if(good & F.col(c).isNull())
    target = scratch_path(spark, "landed")
    keyed.write.parquet(target)
    landed = spark.read.schema(keyed.schema).parquet(target)
    # One aggregate of the Parquet copy. An Observation of the write would save it, but a session that has
    # used one can no longer apply a fitted Spark forest: the model's summary holds the session, whose
    # observation manager can't be serialised (Spark 4.1).
    counts = landed.agg(*[v.alias(k) for k, v in seen.items()]).first().asDict()
    if order_col is not None:
        landed = landed.drop("_file", "_start", "_mono").withColumn("row_id", F.col(f"`{order_col}`").try_cast("bigint"))
    else:
        landed = _dense_ids(landed, "row_id")
    # One cell more than the header, read with a null mark that no cell has: it is there, if only empty.
    names = ", ".join(f"c{k} string" for k in range(len(header) + 1))
    surplus = F.from_csv(F.col(corrupt), names, {"nullValue": "\x01", "escape": '"'})[f"c{len(header)}"].isNotNull()
    rejects = landed.where(~good).select("row_id", F.col(corrupt).alias("record"),
                                         F.when(surplus, SURPLUS).otherwise(SHORT).alias("reason"))
    return Landed(landed.where(good).drop(corrupt), rejects, counts)
