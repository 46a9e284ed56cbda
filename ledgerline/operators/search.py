"""Keyword search across tables (SET1): case-insensitive regex, union of hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(tables: dict[str, tuple[DataFrame, str | list[str], list[str]]], pattern: str) -> DataFrame:
    """Rows whose fields match ``pattern`` (ignoring case), one hit per (table, row, field).

    ``tables`` maps a source name to (DataFrame, one or two id columns,
    searchable string columns). Hits carry the first id as ``id`` and the
    second as ``part`` (null where a table has one). Each table is filtered
    where it lives (one scan for all its fields, no shuffle) and the hits are
    stacked with ``unionByName``.
    """
    rx = "(?i)" + pattern
    parts = []
    for name, (df, ids, fields) in tables.items():
        ids = [ids] if isinstance(ids, str) else ids
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(f).rlike(rx), F.lit(False)) for f in fields])
        matched = F.array_compact(F.array(*[F.when(F.col(f).rlike(rx), F.lit(f)) for f in fields]))
        part = F.col(ids[1]) if len(ids) > 1 else F.lit(None)
        parts.append(df.where(hit).select(
            F.lit(name).alias("source"), F.col(ids[0]).cast("bigint").alias("id"), part.cast("bigint").alias("part"),
            F.explode(matched).alias("field")))
    if not parts:
        raise ValueError("nothing to search")
    return reduce(lambda a, b: a.unionByName(b), parts)
