"""Schema-level helpers: column selection and keyword resolution.

These read ``df.schema`` only, so they cost nothing on the cluster.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keyword lists that must equal the reference's for the same
# column choices.
SALES_KEYWORDS = ["sales", "revenue", "turnover", "purchase amount", "amount", "price"]
PROFIT_KEYWORDS = ["profit", "margin", "gain"]
REGION_KEYWORDS = ["region", "state", "country", "city", "location", "loc", "geography"]
PRODUCT_KEYWORDS = ["product", "item", "sku", "category", "type", "name"]
DATE_KEYWORDS = ["date", "month", "year", "timestamp"]
ID_LIKE_KEYWORDS = ["id", "index", "key"]
VALIDITY_KEYWORDS = ["sales", "price", "revenue", "profit", "quantity", "amount"]
KPI_KEYWORDS = ["sales", "profit", "amount", "spend", "revenue", "value"]
ROOT_CAUSE_METRIC_KEYWORDS = ["sales", "profit", "revenue", "spend"]
ROOT_CAUSE_DATE_KEYWORDS = ["date", "time", "month", "year", "timestamp"]


def is_numeric(dt: T.DataType) -> bool:
    """pandas ``np.number`` selection: ints, floats, decimals; not booleans."""
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def find_column(columns: list[str], keywords: list[str], default: str | None = None) -> str | None:
    """First column, in schema order, containing any keyword (case-insensitive)."""
    named = re.compile("|".join(map(re.escape, keywords)), re.IGNORECASE)
    return next(filter(named.search, columns), default) if keywords else default


def resolve_name(columns: list[str], wanted: str | None) -> str | None:
    """Match a requested column name ignoring case and outer blanks."""
    if wanted is None:
        return None
    key = wanted.strip().lower()
    for col in columns:
        if col.strip().lower() == key:
            return col
    return None


def business_columns(df: DataFrame) -> dict[str, str | None]:
    """The five roles the question operators look up by keyword."""
    cols = df.columns
    return {
        "sales": find_column(cols, SALES_KEYWORDS),
        "profit": find_column(cols, PROFIT_KEYWORDS),
        "region": find_column(cols, REGION_KEYWORDS),
        "product": find_column(cols, PRODUCT_KEYWORDS),
        "date": find_column(cols, DATE_KEYWORDS),
    }


def feature_columns(df: DataFrame, exclude_id_like: bool = True) -> list[str]:
    """Numeric columns, optionally without id/index/key-like names (substring rule)."""
    cols = numeric_columns(df)
    if exclude_id_like:
        cols = [c for c in cols if not any(k in c.lower() for k in ID_LIKE_KEYWORDS)]
    return cols


def align_features(df: DataFrame, features: list[str], missing_value: float | None = 0.0) -> DataFrame:
    """Select ``features`` in order; absent ones become a constant (or raise)."""
    present = set(df.columns)
    exprs = []
    for name in features:
        if name in present:
            exprs.append(F.col(name))
        elif missing_value is None:
            raise KeyError(f"feature column {name!r} is missing")
        else:
            exprs.append(F.lit(float(missing_value)).alias(name))
    return df.select(*exprs)


def lenient_double(col: str):
    """Numeric cast where bad values become null (ANSI-safe)."""
    return F.expr(f"try_cast(`{col}` AS DOUBLE)")


def constant_as(value, dt: T.DataType):
    """``value`` as a constant of type ``dt``; null where the type cannot hold it."""
    return F.expr(f"try_cast({_sql_literal(value)} AS {dt.simpleString()})")


def overlay_constants(df: DataFrame, changes: dict) -> DataFrame:
    """Set columns to constants of the column's type (what-if overlay); a value it cannot hold gives null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = df
    for name, value in changes.items():
        if name not in types:
            continue
        out = out.withColumn(name, constant_as(value, types[name]))
    return out


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
