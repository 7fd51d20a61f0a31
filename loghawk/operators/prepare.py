"""Cleaning and feature preparation.

Order as in the source application: coerce numbers, fill gaps (median,
"unknown", forward/backward fill in row order, label), drop exact repeats
keeping the first, flag IQR outliers, encode the protocol, z-score.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk import constants as C
from loghawk.functions import parse_number
from loghawk.functions.stats import describe, quantiles

FEATURE_COLUMNS = [f"{c}_scaled" for c in C.NUMERIC_COLUMNS] + ["protocol_encoded"]


def coerce_numeric(df: DataFrame, cols=C.NUMERIC_COLUMNS) -> DataFrame:
    """Text -> double, unparsable -> null."""
    return df.withColumns({c: parse_number(c) for c in cols})


def fill_median(df: DataFrame, cols=C.NUMERIC_COLUMNS) -> DataFrame:
    """Nulls -> the column median of the non-null values; all-null column -> 0."""
    found = quantiles(df, cols, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(found[c][0] if found[c][0] is not None else 0.0)) for c in cols})


def fill_unknown(df: DataFrame, cols=C.TEXT_FILL_COLUMNS) -> DataFrame:
    """Missing addresses / protocol -> "unknown"."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in cols})


def forward_back_fill(df: DataFrame, col: str, order_col: str = "row_id") -> DataFrame:
    """Forward fill ``col`` in ``order_col`` order, then back fill the leading gap.

    A prefix scan that asks nothing of the ids:
      1. rows are range-partitioned and sorted by id; each task passes over its rows with the
         last value in hand, and the result is stored, as partitions must not change between readings;
      2. what a partition's leading gap takes over is the last value of the partitions before it,
         from a table of one row a partition; where there is none, the first value of all.
    """
    carry = fill_carry(stored := _filled_inside(df, col, order_col), col, order_col)
    first = F.coalesce(F.col(col), F.col("_carry"))
    return stored.join(F.broadcast(carry), "_part").withColumn(col, first).select(*df.columns)


def _filled_inside(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """Rows by range of ``order_col``, ``col`` filled within each partition, stored with the partition's number."""
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])
    at = df.columns.index(col)

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            filled = pc.fill_null_forward(batch.column(at))
            if last is not None and last.is_valid:
                filled = pc.fill_null(filled, last)
            last = filled[-1]
            cols = [filled if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * batch.num_rows, pa.int32())], names=schema.names)

    ranged = df.repartitionByRange(F.asc_nulls_first(order_col)).sortWithinPartitions(F.asc_nulls_first(order_col))
    return cut_lineage(ranged.mapInArrow(run, schema))


def fill_carry(stored: DataFrame, col: str, order_col: str) -> DataFrame:
    """(_part, _carry): the value that comes into each partition; one row a partition."""
    present = F.when(F.col(col).isNotNull(), F.col(order_col))
    ends = stored.groupBy("_part").agg(F.max_by(col, present).alias("_last"), F.min_by(col, present).alias("_first"))
    ordered = Window.orderBy("_part")
    before = F.last("_last", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    anything = F.first("_first", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ends.select("_part", F.coalesce(before, anything).alias("_carry"))


def fill_label(df: DataFrame, label_col: str = "attack_type") -> DataFrame:
    """P5: absent or null label -> "Unknown"."""
    if label_col not in df.columns:
        return df.withColumn(label_col, F.lit("Unknown"))
    return df.withColumn(label_col, F.coalesce(F.col(label_col), F.lit("Unknown")))


def dedup_first(df: DataFrame, keys=C.REQUIRED_COLUMNS, order_col: str = "row_id") -> DataFrame:
    """Exact repeats over ``keys`` (nulls equal) -> the first row in order.

    A group-by with ``min_by`` instead of a row_number window: map-side
    partial aggregation collapses repeats before the shuffle, so a key copied
    a billion times costs one row per task, not one huge sorted group.
    """
    rest = [c for c in df.columns if c not in keys and c != order_col]
    agg = [F.min(order_col).alias(order_col)]
    if rest:
        agg.append(F.min_by(F.struct(*rest), F.col(order_col)).alias("_first"))
    out = df.groupBy(*keys).agg(*agg)
    if rest:
        out = out.select(*keys, order_col, "_first.*")
    return out.select(*df.columns)


def outlier_condition(found: dict[str, list[float | None]], cols=C.NUMERIC_COLUMNS) -> Column:
    """P7's condition from the quartiles; columns without values have no outliers."""
    cond = F.lit(False)
    for c in cols:
        q1, q3 = found[c][0], found[c][-1]
        if q1 is not None:
            reach = 1.5 * (q3 - q1)
            cond = cond | (F.col(c) < F.lit(q1 - reach)) | (F.col(c) > F.lit(q3 + reach))
    return F.coalesce(cond, F.lit(False))


def flag_outliers(df: DataFrame, cols=C.NUMERIC_COLUMNS, out_col: str = "is_outlier") -> DataFrame:
    """Outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] in any column (strict)."""
    return df.withColumn(out_col, outlier_condition(quantiles(df, cols, [0.25, 0.75]), cols))


def protocol_codes(df: DataFrame, col: str = "protocol") -> DataFrame:
    """P8 (fit): (value, ``<col>_encoded``): the distinct values numbered 0..k-1 in order.

    The values are free text, so their number is unbounded: they are sorted by
    range, numbered within a partition, and shifted by the sizes of the partitions
    before it (one row a partition).
    """
    part = F.spark_partition_id()
    ranged = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col) \
        .select(col, part.alias("_part"), F.monotonically_increasing_id().alias("_id"))
    ranged = cut_lineage(ranged)  # the partitions must not change between the two readings
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(starts, "_part").select(
        col, (F.col("_before") + F.col("_id") - F.col("_first")).cast("int").alias(f"{col}_encoded"))


def encode_protocol(df: DataFrame, codes: DataFrame | None = None, col: str = "protocol") -> DataFrame:
    """Label-encode ``col`` into ``<col>_encoded`` (int); a value without a code stays null."""
    return df.join(codes if codes is not None else protocol_codes(df, col), col, "left")


def scale_features(df: DataFrame, cols=C.NUMERIC_COLUMNS) -> DataFrame:
    """Z-score with the population std; a zero std divides by 1."""
    st = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).first()
    return _scaled(df, {c: st[c]["m"] for c in cols}, {c: st[c]["s"] for c in cols})


def _scaled(df: DataFrame, means: dict[str, float | None], stds: dict[str, float | None]) -> DataFrame:
    return df.withColumns({f"{c}_scaled": (F.col(c) - F.lit(means[c]).cast("double")) / F.lit(stds[c] or 1.0) for c in means})


def feature_vector(df: DataFrame, out_col: str = "features") -> DataFrame:
    """P10: the 3 scaled columns and the protocol code, in that order."""
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol=out_col).transform(df)


@dataclass
class Prepared:
    clean: DataFrame
    report: DataFrame
    codes: DataFrame


def missing_after_coercion(df: DataFrame) -> DataFrame:
    """Nulls over the required columns after numeric coercion (one-row frame)."""
    total = None
    for c in C.REQUIRED_COLUMNS:
        term = F.count_if(F.col(c).isNull())
        total = term if total is None else total + term
    return df.agg(total.cast("bigint").alias("missing_values_filled"),
                  F.count(F.lit(1)).alias("original_rows"))


def outlier_and_scale(df: DataFrame, cols=C.NUMERIC_COLUMNS) -> DataFrame:
    """P7 + P9, from the same passes."""
    st = describe(df, cols, [0.25, 0.75])
    return _scaled(df.withColumn("is_outlier", outlier_condition(st.quantiles, cols)), st.means, st.stds)


def fill_and_dedup(raw: DataFrame) -> DataFrame:
    """P1-P6 (ends in the dedup shuffle)."""
    df = coerce_numeric(raw)
    df = fill_median(df)
    df = fill_unknown(df)
    df = forward_back_fill(df, "timestamp")
    df = fill_label(df)
    return dedup_first(df)


def cut_lineage(df: DataFrame, checkpoint: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The copy survives lost executors, and later reads prune columns and push filters.
    ``loghawk.session.drop_scratch`` removes the copies of a session.
    """
    if not checkpoint:
        return df
    from loghawk.session import scratch_path
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_logs(raw: DataFrame, checkpoint: bool = True, codes: DataFrame | None = None) -> DataFrame:
    """The cleaned table.

    The deduplicated table is checkpointed: the outlier/scaling statistics
    and the final projection then read it instead of re-running the fills
    and the dedup shuffle.
    """
    dd = cut_lineage(fill_and_dedup(raw), checkpoint)
    return outlier_and_scale(encode_protocol(dd, codes))


def quality_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """V5: original/cleaned rows, repeats removed, cells filled, outliers, columns."""
    before = missing_after_coercion(coerce_numeric(raw)).select(
        F.struct("missing_values_filled", "original_rows")).scalar()
    return clean.agg(
        before["original_rows"].alias("original_rows"),
        F.count(F.lit(1)).alias("cleaned_rows"),
        (before["original_rows"] - F.count(F.lit(1))).alias("duplicates_removed"),
        before["missing_values_filled"].alias("missing_values_filled"),
        F.count_if(F.col("is_outlier")).alias("outliers_flagged"),
    ).withColumn("columns", F.lit(", ".join(clean.columns)))


def preprocess(raw: DataFrame, checkpoint: bool = True) -> Prepared:
    """The whole cleaning step: cleaned table, quality report and protocol codes."""
    dd = cut_lineage(fill_and_dedup(raw), checkpoint)
    codes = protocol_codes(dd)
    clean = cut_lineage(outlier_and_scale(encode_protocol(dd, codes)), checkpoint)
    return Prepared(clean=clean, report=quality_report(raw, clean), codes=codes)
