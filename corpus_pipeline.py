"""Corpus pipeline: quality rules, near-duplicates, benchmark leaks, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before it kept,
and is written as Parquet into the shared folder and read again before the next.
All but the last return the columns of ``documents``; the last returns the training
order: one row per pass over a document, sorted by position.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghawk.llm import decontaminate, mixing, quality_rules, secret_scan, simhash
from loghawk.llm.text import free_name
from loghawk.session import ensure_checkpoint_dir, ship_package
from loghawk.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, fitted on this stage's distinct texts.

    A text's copies aren't held against it. A null or wordless text is rejected; repeated
    rows stay or go together; labels without a document, and null ids, add nothing; an
    empty table gives none.
    """
    ship_package(spark)
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return quality_rules.apply_quality_rules(docs, quality_rules.fit_distinct(docs, trusted))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Null ids come last; texts without words are one group; of rows with equal id and text
    one stays; an empty table gives none.
    """
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts stay, as do all documents if the benchmark is empty; repeated rows
    stay or go together; an empty table gives none.
    """
    ship_package(spark)
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows a text that was masked.

    Null and empty texts and texts without a secret stay as they are; an empty table gives none.
    """
    before = free_name("before", docs.columns)
    masked = secret_scan.redact(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col(before))
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
                                   .cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training order of the mixed sources.

    Documents without words aren't taken; a null source is a source of its own; repeated rows
    are taken each; an empty table gives no rows.
    """
    ensure_checkpoint_dir(spark)
    return mixing.training_order(mixing.mix_plan(docs))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the fingerprints, the likelihood ratio or the windowed entropy;
#: tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
