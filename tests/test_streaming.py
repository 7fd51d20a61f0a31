"""Streaming scoring against a batch profile (availableNow trigger)."""

import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from loghawk.operators import prepare as P
from loghawk.plans.pipeline import run_pipeline
from loghawk.sources.synthetic import synthetic_logs
from loghawk.streaming.scoring_stream import clean_stream, fit_profile, read_log_stream, score_stream


def test_stream_scores_new_files(spark):
    logs = synthetic_logs(spark, 1200, seed=3, start=datetime(2024, 5, 1))
    as_text = logs.select("row_id", *[F.col(c).cast("string") for c in logs.columns if c != "row_id"])
    clean = P.clean_logs(as_text.where("row_id < 800")).checkpoint(eager=True)
    result = run_pipeline(clean, rf_trees=10, rf_depth=5, gbt_rounds=5, gbt_depth=3, iso_trees=20)
    profile = fit_profile(clean, result)

    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    incoming = os.path.join(base, "in")
    new_rows = as_text.where("row_id >= 800").drop("row_id")
    new_rows.unionByName(new_rows.limit(10)).write.option("header", True).csv(incoming)  # 10 repeats
    out = os.path.join(base, "out")
    stream = score_stream(clean_stream(read_log_stream(spark, incoming), profile), profile)
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(base, "chk")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == 400
    st = got.agg(F.min("threat_score"), F.max("threat_score"), F.count_if(F.col("severity").isNull())).first()
    assert 0 <= st[0] <= st[1] <= 100 and st[2] == 0
