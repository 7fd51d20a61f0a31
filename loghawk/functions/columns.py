"""Scalar expressions shared by the operators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from loghawk import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, dp: int) -> Column:
    """Round to ``dp`` decimals, half to even on the scaled value (numpy's rule)."""
    scale = float(10 ** dp)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def clip(c, lo=None, hi=None) -> Column:
    out = _col(c)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return out


def null_na_tokens(c) -> Column:
    """Missing-value tokens of a CSV cell become null (pandas reader's default list)."""
    col = _col(c)
    return F.when(col.isin(C.NA_TOKENS), F.lit(None).cast("string")).otherwise(col)


def parse_number(c) -> Column:
    """String -> double; unparsable, NaN and Java-only suffix forms ('1d', '5f') -> null."""
    s = F.trim(_col(c).cast("string"))
    v = s.try_cast("double")
    bad_suffix = s.rlike(r"(?i)[0-9.][df]$")
    return F.when(bad_suffix | F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def parse_timestamp(c) -> Column:
    """String -> timestamp_ntz; unparsable or outside the range of 64-bit nanoseconds -> null."""
    ts = _col(c).cast("string").try_cast("timestamp_ntz")
    first, last = (F.lit(x).cast("timestamp_ntz") for x in C.TIME_RANGE)
    return F.when(ts.between(first, last), ts)


def map_lookup(mapping: dict, key, default=None) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    out = m[_col(key)]
    return out if default is None else F.coalesce(out, F.lit(default))


def severity_weight(predicted_type) -> Column:
    """Weight (0-100) of a predicted type; types outside the table weigh 50."""
    return map_lookup(C.SEVERITY_WEIGHTS, predicted_type, C.DEFAULT_SEVERITY_WEIGHT) * F.lit(100.0)


def severity_bucket(score) -> Column:
    s = _col(score)
    expr = None
    for upper, name in C.SEVERITY_BANDS:
        expr = F.when(s <= upper, name) if expr is None else expr.when(s <= upper, name)
    return expr.otherwise(C.TOP_SEVERITY)


def severity_rank(severity) -> Column:
    """Low 0 < Medium 1 < High 2 < Critical 3; anything else 0."""
    return map_lookup(C.SEVERITY_RANK, severity, 0)


def portable_hash(id_col, seed: int) -> Column:
    """Uniform 60-bit key of (id, seed): the first 15 hex digits of md5("id:seed").

    JVM-side and partition-independent like ``xxhash64``, and also computable
    in plain SQL elsewhere, so orders that depend on it can be checked by an
    oracle.
    """
    text = F.concat(_col(id_col).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
