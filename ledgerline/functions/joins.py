"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dimension side is broadcast only when it has at most this many rows and bytes.
DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    """Measured size of a row: whole strings and nested values, 8 bytes for any other value, 16 for the row."""
    size = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) + 8
        else:
            size = size + 8
    return size.cast("long")


def fits(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes (reading stops early)."""
    row = df.select(_row_bytes(df).alias("b")).limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return row["n"] <= max_rows and row["b"] <= max_bytes


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner",
               max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Join with ``right`` broadcast when it is proven small, else a shuffle join."""
    side = F.broadcast(right) if fits(right, max_rows) else right
    return left.join(side, on=on, how=how)
