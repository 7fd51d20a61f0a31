"""Column-level helpers: JVM-side expressions only (no Python UDFs)."""

from loghawk.functions.columns import (  # noqa: F401
    clip, map_lookup, parse_number, portable_hash, parse_timestamp, round_half_even,
    severity_bucket, severity_rank, severity_weight, null_na_tokens,
)
from loghawk.functions.stats import quantiles  # noqa: F401
