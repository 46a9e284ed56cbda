"""Catalog-style table operations: versions, latest rows, lineage, purge (DQ14–DQ16, SRC5, JN4)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.session import create_once

LINEAGE_SCHEMA = "dataset_id string, operation string, details string, timestamp timestamp_ntz"


def latest_per_key(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """Rows ranked ≤ ``n`` per key by ``order`` (e.g. newest first).

    The rank filter sits right on the window, so Spark applies a partial
    top-n per partition before the shuffle (window group limit).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def next_version(existing: DataFrame | None, keys: dict) -> int:
    """max(version) + 1 among rows matching ``keys`` (1 when none)."""
    if existing is None:
        return 1
    cond = F.lit(True)
    for k, v in keys.items():
        cond = cond & (F.col(k) == F.lit(v))
    row = existing.where(cond).agg(F.max("version").alias("v")).first()
    return 1 if row["v"] is None else int(row["v"]) + 1


def write_version(df: DataFrame, root: str, dataset: str) -> int:
    """Write ``df`` as the next version of ``dataset`` under a partitioned Parquet root; returns its number.

    Writers may run at the same time: each number is reserved by one exclusive
    file under ``_versions`` before anything is written, and a writer that
    comes second takes the next one. Each version is written as a job of its
    own folder, so one writer's commit leaves the others' files alone. A
    writer that fails leaves its number unused.
    """
    spark = df.sparkSession
    existing = spark.read.parquet(root).select("dataset", "version") if _has_versions(spark, root) else None
    version = next_version(existing, {"dataset": dataset})
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(dataset)
    while not create_once(spark, f"{root}/_versions/{name}/{version}"):
        version += 1
    df.drop("dataset", "version").write.parquet(f"{root}/dataset={name}/version={version}")
    return version


def _has_versions(spark: SparkSession, root: str) -> bool:
    """Whether a version has been written whole (reservations and running writers do not count)."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/dataset=*/version=*/[!_.]*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return found is not None and len(found) > 0


def read_version(spark: SparkSession, root: str, dataset: str, version: int | None = None) -> DataFrame:
    """One version (partition-pruned); the latest when ``version`` is None."""
    all_rows = spark.read.parquet(root).where(F.col("dataset") == dataset)
    if version is None:
        version = all_rows.agg(F.max("version")).first()[0]
    return all_rows.where(F.col("version") == version).drop("dataset", "version")


def lineage_rows(spark: SparkSession, events: list[tuple]) -> DataFrame:
    """Typed lineage rows: (dataset_id, operation, details, timestamp)."""
    rows = [(d, op, det, ts or _dt.datetime.utcnow()) for d, op, det, ts in events]
    return spark.createDataFrame(rows, LINEAGE_SCHEMA)


def append_lineage(lineage: DataFrame, path: str) -> None:
    lineage.write.mode("append").parquet(path)


def lineage_history(lineage: DataFrame, dataset_id: str | None = None) -> DataFrame:
    out = lineage if dataset_id is None else lineage.where(F.col("dataset_id") == dataset_id)
    return out.orderBy("timestamp", "operation")


def purge(table_df: DataFrame, removed: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of ``table_df`` whose keys are not in ``removed`` (cascade delete)."""
    return table_df.join(removed, on=on, how="left_anti")


def mark_read(alerts: DataFrame, alert_id=None, project_id=None) -> DataFrame:
    """RP2: flag one alert, or every alert of a project, as read."""
    if alert_id is not None:
        hit = F.col("alert_id") == F.lit(alert_id)
    elif project_id is not None:
        hit = F.col("project_id") == F.lit(project_id)
    else:
        return alerts
    return alerts.withColumn("is_read", F.when(hit, F.lit(True)).otherwise(F.col("is_read")))
