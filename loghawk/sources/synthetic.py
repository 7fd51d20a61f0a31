"""Labelled synthetic security logs (S3) and the sample file.

One row per input id; every random draw is a hash of (id, seed, stream),
so the table does not depend on partitioning and a recomputed partition
reproduces the same rows. Distributions follow the per-label traffic
profiles: normal draws for bytes and duration (floored at 1, 1, 0.01), a
protocol from the label's list, attacks reusing a small "noisy" source pool
with probability 0.6, and attack times in bursts (sigma 600 s) within 24 h.
"""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.functions import round_half_even

_TWO53 = float(1 << 53)
DAY_SECONDS = 86400


def _uniform(id_col: Column, seed: int, stream: int) -> Column:
    """U[0, 1) from a hash of (id, seed, stream)."""
    h = F.xxhash64(id_col, F.lit(seed), F.lit(stream))
    return h.bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(_TWO53)


def _normal(id_col: Column, seed: int, stream: int) -> Column:
    """N(0, 1) by Box-Muller from two hashed uniforms."""
    u1 = F.greatest(_uniform(id_col, seed, stream), F.lit(1e-300))
    u2 = _uniform(id_col, seed, stream + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def _octet(id_col: Column, seed: int, stream: int, lo: int, hi: int) -> Column:
    """Integer in [lo, hi) as text."""
    return (F.lit(lo) + F.floor(_uniform(id_col, seed, stream) * F.lit(hi - lo))).cast("int").cast("string")


def _external_ip(id_col: Column, seed: int, stream: int) -> Column:
    return F.concat_ws(".", _octet(id_col, seed, stream, 1, 223), _octet(id_col, seed, stream + 1, 0, 255),
                       _octet(id_col, seed, stream + 2, 0, 255), _octet(id_col, seed, stream + 3, 1, 255))


def _profile_map(key: str, part: int) -> Column:
    return F.create_map(*[x for label, prof in C.TRAFFIC_PROFILES.items()
                          for x in (F.lit(label), F.lit(float(prof[key][part])))])


def synthetic_from_ids(ids: DataFrame, n_rows: int, attack_ratio: float = C.DEFAULT_ATTACK_RATIO,
                       seed: int | None = None, start: datetime | None = None,
                       id_col: str = "id") -> DataFrame:
    """S3 over a frame of ``n_rows`` distinct ids 0..n_rows-1 (from ``spark.range`` or a table)."""
    seed = random.randrange(1 << 30) if seed is None else int(seed)
    start = start or (datetime.now() - timedelta(hours=24))
    n_attacks = int(n_rows * attack_ratio)
    n_normal = n_rows - n_attacks
    pool = max(3, n_attacks // 40)
    bursts = max(1, n_attacks // 50)
    i = F.col(id_col)
    is_attack = i >= F.lit(n_normal)
    types = F.array(*[F.lit(t) for t in C.ATTACK_TYPES])
    label = F.when(is_attack, F.element_at(types, (F.floor(_uniform(i, seed, 1) * len(C.ATTACK_TYPES)) + 1).cast("int"))) \
             .otherwise(F.lit("Normal"))
    protos = F.create_map(*[x for lab, prof in C.TRAFFIC_PROFILES.items()
                            for x in (F.lit(lab), F.array(*[F.lit(p) for p in prof["proto"]]))])
    df = ids.select(i.cast("bigint").alias("row_id"), label.alias("attack_type"), is_attack.alias("_atk"))
    r = F.col("row_id")
    lab = F.col("attack_type")

    def draw(key, floor_at, stream):
        return F.greatest(F.lit(floor_at), _profile_map(key, 0)[lab] + _profile_map(key, 1)[lab] * _normal(r, seed, stream))

    plist = protos[lab]
    proto = F.element_at(plist, (F.floor(_uniform(r, seed, 10) * F.size(plist)) + 1).cast("int"))
    noisy_k = F.floor(_uniform(r, seed, 11) * F.lit(pool)).cast("bigint")
    noisy_ip = _external_ip(noisy_k, seed, 100)
    use_pool = F.col("_atk") & (_uniform(r, seed, 12) < F.lit(0.6))
    src = F.when(use_pool, noisy_ip).otherwise(_external_ip(r, seed, 20))
    dst = F.concat_ws(".", F.lit("10"), F.lit("0"), _octet(r, seed, 30, 0, 255), _octet(r, seed, 31, 1, 255))
    burst = (r - F.lit(n_normal)) % F.lit(bursts)
    center = _uniform(burst, seed, 200) * F.lit(float(DAY_SECONDS))
    attack_off = F.least(F.greatest(center + F.lit(600.0) * _normal(r, seed, 40), F.lit(0.0)), F.lit(float(DAY_SECONDS)))
    normal_off = _uniform(r, seed, 42) * F.lit(float(DAY_SECONDS))
    offset = F.floor(F.when(F.col("_atk"), attack_off).otherwise(normal_off)).cast("bigint")
    # Wall-clock arithmetic on timestamp_ntz: independent of the session time zone.
    base = F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    ts = base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset.cast("decimal(18,6)"))
    return df.select(
        "row_id",
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        src.alias("source_ip"), dst.alias("destination_ip"), proto.alias("protocol"),
        round_half_even(draw("bs", 1.0, 2), 2).alias("bytes_sent"),
        round_half_even(draw("br", 1.0, 4), 2).alias("bytes_received"),
        round_half_even(draw("dur", 0.01, 6), 3).alias("connection_duration"),
        "attack_type")


def synthetic_logs(spark: SparkSession, n_rows: int = 2000, attack_ratio: float = C.DEFAULT_ATTACK_RATIO,
                   seed: int | None = None, start: datetime | None = None) -> DataFrame:
    """S3: ``n_rows`` labelled logs generated in parallel from ``spark.range``."""
    return synthetic_from_ids(spark.range(n_rows), n_rows, attack_ratio, seed, start)


def write_sample_logs(spark: SparkSession, path: str, n_rows: int = 500, seed: int = 42,
                      start: datetime | None = None) -> None:
    """The seeded sample as CSV text files in timestamp order (a range-partitioned sort)."""
    logs = synthetic_logs(spark, n_rows, seed=seed, start=start)
    (logs.orderBy("timestamp", "row_id").drop("row_id")
     .write.mode("overwrite").option("header", True).csv(path))
