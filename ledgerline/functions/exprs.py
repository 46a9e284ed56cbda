"""Small column-expression helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.columns import is_temporal


def as_timestamp(df: DataFrame, col: str) -> Column:
    """A timestamp view of ``col``: temporal as is, strings parsed leniently."""
    dt = df.schema[col].dataType
    if is_temporal(dt):
        return F.col(col).cast(T.TimestampNTZType()) if isinstance(dt, T.DateType) else F.col(col)
    if isinstance(dt, T.StringType):
        return F.expr(f"try_to_timestamp(`{col}`)").cast(T.TimestampNTZType())
    raise TypeError(f"column {col!r} of type {dt.simpleString()} is not a date")


def ts_literal(value) -> Column:
    """A timestamp literal typed as TIMESTAMP_NTZ, so range filters reach the scan."""
    return F.lit(str(value)).cast(T.TimestampNTZType())


def skewness_adjusted(col: str) -> Column:
    """pandas ``Series.skew()``: Spark's population skewness × √(n(n−1))/(n−2)."""
    n = F.count(F.col(col)).cast("double")
    return F.when(n > 2, F.skewness(F.col(col)) * F.sqrt(n * (n - 1)) / (n - 2))


def stable_split_bucket(key: Column, buckets: int = 100) -> Column:
    """Deterministic pseudo-random bucket of an integer key (MINSTD step).

    Stable across partitionings and runs, and expressible in plain SQL.
    """
    m = 2147483647
    return F.pmod(F.pmod(key.cast("long"), F.lit(m)) * F.lit(48271) % F.lit(m), F.lit(buckets))


def kolmogorov_sf(z: Column, terms: int = 100) -> Column:
    """Survival function of the limiting Kolmogorov distribution (two-sided KS).

    Q(z) = 2 Σ_{k≥1} (−1)^{k−1} exp(−2 k² z²), evaluated with a higher-order
    ``aggregate`` so it stays one JVM expression.
    """
    seq = F.sequence(F.lit(1), F.lit(terms))
    total = F.aggregate(
        seq, F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), (k - 1).cast("double")) * F.exp(F.lit(-2.0) * k * k * z * z),
    )
    return F.when(z <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * total)))


def half_up(v, digits: int):
    """Round a driver-side float like SQL ``round``: half away from zero on its decimal form."""
    if v is None:
        return None
    import decimal
    import math as _m
    if isinstance(v, float) and (_m.isnan(v) or _m.isinf(v)):
        return v
    q = decimal.Decimal(1).scaleb(-digits)
    return float(decimal.Decimal(repr(float(v))).quantize(q, rounding=decimal.ROUND_HALF_UP))
