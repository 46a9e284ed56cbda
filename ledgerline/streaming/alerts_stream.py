"""Alert rules on arriving rows (ST2) with Structured Streaming.

Two forms. ``window_metrics`` and ``stream_alerts`` apply the anomaly-share
rule (AL4) to closed event-time windows inside the stream. ``watch`` applies
AL1 to AL4: the stream keeps one mergeable state, the counts of equal cells
per (project, window, column), which the watermark closes and drops; each
micro-batch of closed windows then goes through the batch rules, since
quality (AL1), the series to forecast (AL2), the distance to the training
values (AL3) and the share above a threshold (AL4) all follow from those
counts. Both keep one alert per (project, event, metric) and skip those that
already have an unread alert in the table (the batch scan's rule, AL5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import columns as C
from ledgerline.operators import alerts as rules
from ledgerline.operators import drift, forecast, profile
from ledgerline.operators.alerts import ANOMALY_ACTION, ANOMALY_EVENT, ANOMALY_METRIC
from ledgerline.session import cut_lineage, folder_exists

MIN_POINTS = 5  # a shorter series is not forecast


def window_metrics(stream: DataFrame, ts: str, key: str, value: str, threshold: float,
                   window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Per (key, window): rows, rows above ``threshold`` and their share (%)."""
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.col(key).alias("project_id"), F.window(ts, window).alias("w"))
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value) > threshold).alias("anomaly_count"))
            .select("project_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "rows", "anomaly_count",
                    F.round(F.col("anomaly_count") / F.col("rows") * 100, 2).alias("anomaly_percentage")))


def stream_alerts(metrics: DataFrame, pct_threshold: float = 8.0) -> DataFrame:
    """AL4 on each closed window."""
    hits = metrics.where(F.col("anomaly_percentage") > pct_threshold)
    alerts = hits.select(
        "project_id", "window_start", "window_end", F.lit(ANOMALY_EVENT).alias("event"), F.lit("HIGH").alias("severity"),
        F.lit(ANOMALY_METRIC).alias("metric"), "anomaly_count", "anomaly_percentage",
        F.lit(ANOMALY_ACTION).alias("action_recommended"))
    return alerts


def run_to_table(alerts: DataFrame, table_path: str, checkpoint: str) -> None:
    """Drain the available input once (availableNow) and append every batch to ``table_path``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = ["project_id", "event", "metric"]
        first = Window.partitionBy(*key).orderBy("window_end")
        new = batch.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
        rows = new.withColumn("is_read", F.lit(False)).withColumn("batch_id", F.lit(batch_id))
        if folder_exists(spark, table_path):  # not yet there at the first batch
            stored = spark.read.schema(rows.schema).parquet(table_path)
            rows = rows.join(stored.where(~F.col("is_read")).select(*key), key, "left_anti")
        rows.write.mode("append").parquet(table_path)

    q = (alerts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()


# ---------------------------------------------------------------- AL1–AL4 on arriving rows
def cell_counts(stream: DataFrame, ts: str, project: str, columns: list[str], window: str = "1 day",
                watermark: str = "1 day") -> DataFrame:
    """(project_id, window_start, window_end, position, value, h1, h2, bad, n) per closed window.

    The state holds one number per different cell of an open window. Rows
    later than the watermark are dropped by Spark; rows without a time belong
    to no window; rows without a project form a project of their own (null).
    """
    fields = [stream.schema[c] for c in columns]
    timed = stream.withWatermark(ts, watermark).withColumns(
        {"project_id": F.col(project).cast("string"), "_w": F.window(ts, window)})
    cells = profile.unpivot(timed, fields, "project_id", "_w")
    return (cells.groupBy("project_id", "_w", "position", "value", "h1", "h2", "bad")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("project_id", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                    "position", "value", "h1", "h2", "bad", "n"))


_GROUP = ["project_id", "window_start", "window_end"]


def _label():
    return F.concat_ws(" ", F.coalesce("project_id", F.lit("-")), F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def window_quality(closed: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """AL1's input: one quality row per closed window (``quality`` without the forest's term)."""
    scores = profile.group_scores(profile.column_totals(closed, fields, *_GROUP), fields, *_GROUP)
    return scores.select("project_id", _label().alias("dataset_id"), _label().alias("filename"), "score",
                         F.col("window_end").alias("created_at"))


def _numbers(closed: DataFrame, fields: list[T.StructField], names: list[str]) -> DataFrame:
    """The closed windows' counted values of some numeric columns: groups, feature, value, n."""
    at = {f.name: i for i, f in enumerate(fields) if f.name in names and C.is_numeric(f.dataType)}
    feature = F.element_at(F.create_map(*[F.lit(x) for n, i in at.items() for x in (i, n)]), F.col("position"))
    return (closed.where(F.col("position").isin(list(at.values())) & F.col("value").isNotNull())
            .select(*_GROUP, feature.alias("feature"), F.col("value").cast("double").alias("value"), "n"))


def training_counts(train: DataFrame, features: list[str]) -> DataFrame:
    """What AL3 compares with: the counted values of the training rows (feature, value, n)."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    return (train.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
            .where(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))


def window_drift(closed: DataFrame, fields: list[T.StructField], training: DataFrame, features: list[str],
                 model_id: str) -> DataFrame:
    """AL3's input: health of one model per closed window, by drift of its features from ``training_counts``."""
    found = drift.ks_by_group(training, _numbers(closed, fields, features), _GROUP)
    return drift.model_health(found, by=_GROUP).select(
        "project_id", F.lit(model_id).alias("model_id"), "drift_percentage", "status",
        F.col("window_end").alias("created_at"))


def window_anomalies(closed: DataFrame, fields: list[T.StructField], column: str, threshold: float) -> DataFrame:
    """AL4's input: rows of each closed window whose value is above the threshold, and their share."""
    rows = closed.where("position = -1").groupBy(*_GROUP).agg(F.sum("n").alias("rows"))
    above = (_numbers(closed, fields, [column]).where(F.col("value") > threshold)
             .groupBy(*_GROUP).agg(F.sum("n").alias("anomaly_count")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in _GROUP]
    return rows.alias("r").join(above.alias("a"), same).select(
        "r.project_id", F.date_format("r.window_start", "yyyy-MM-dd HH:mm").alias("run_id"), "anomaly_count",
        F.round(F.col("anomaly_count") / F.col("rows") * 100, 2).alias("anomaly_percentage"),
        F.col("r.window_end").alias("created_at"))


def window_series(closed: DataFrame, fields: list[T.StructField], column: str) -> DataFrame:
    """AL2's history: the sum of a column per closed window."""
    return (_numbers(closed, fields, [column]).groupBy(*_GROUP)
            .agg(F.sum(F.col("value") * F.col("n")).alias("value")))


def series_forecasts(history: DataFrame, target: str, periods: int = 6) -> DataFrame:
    """AL2's input: the last six windows against a forecast of the next ones, per project.

    ``history``: window_series of all closed windows. Windows without rows
    count as 0; projects with under ``MIN_POINTS`` windows, and rows without a
    project, are not forecast.
    """
    known = history.where(F.col("project_id").isNotNull())
    length = F.unix_seconds("window_end") - F.unix_seconds("window_start")
    spans = known.groupBy("project_id").agg(F.min(F.unix_seconds("window_start")).alias("lo"),
                                            F.max(F.unix_seconds("window_start")).alias("hi"),
                                            F.max(length).alias("step"))
    grid = spans.where(F.col("hi") - F.col("lo") >= (MIN_POINTS - 1) * F.col("step")).select(
        "project_id", F.posexplode(F.sequence("lo", "hi", F.col("step"))).alias("t", "at"))
    series = grid.join(known.select("project_id", F.unix_seconds("window_start").alias("at"), "value"),
                       ["project_id", "at"], "left").select(
        F.col("project_id").alias("series"), F.timestamp_seconds("at").cast("date").alias("period"), "t",
        F.coalesce("value", F.lit(0.0)).alias("value"))
    change = forecast.forecast_change(series, forecast.fourier_forecast(series, periods, "D"))
    return change.select(F.col("series").alias("project_id"), F.lit(target).alias("target"), "hist_avg", "fore_avg")


def watch(stream: DataFrame, ts: str, project: str, columns: list[str], folder: str, *, target: str,
          threshold: float, training: DataFrame | None = None, features: tuple = (), model_id: str = "",
          window: str = "1 day", watermark: str = "1 day") -> None:
    """Drain the input at hand and append the alerts of every micro-batch to ``<folder>/alerts``.

    A micro-batch writes its own sub-folder (series and alerts), overwritten
    if Spark repeats the batch, and reads only those of earlier batches, so a
    repeat after a failure gives the same alerts once.
    """
    fields = [stream.schema[c] for c in columns]

    def earlier(spark, name, batch_id, schema):
        path = f"{folder}/{name}"
        if not folder_exists(spark, path):
            return spark.createDataFrame([], schema)
        stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
        return stored.where(F.col("batch_id") < batch_id).drop("batch_id")

    def sink(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        closed = cut_lineage(batch)
        news = cut_lineage(window_series(closed, fields, target))
        news.write.mode("overwrite").parquet(f"{folder}/series/batch_id={batch_id}")
        touched = news.select("project_id").distinct()
        history = earlier(spark, "series", batch_id, news.schema).join(touched, "project_id", "left_semi")
        hits = rules.scan_alerts(
            quality=window_quality(closed, fields),
            forecasts=series_forecasts(history.unionByName(news), target),
            monitoring=window_drift(closed, fields, training, list(features), model_id) if features else None,
            anomalies=window_anomalies(closed, fields, target, threshold))
        key = ["project_id", "event", "metric"]
        unread = earlier(spark, "alerts", batch_id, hits.schema).where(~F.col("is_read")).select(*key)
        same = [F.col(f"h.{c}").eqNullSafe(F.col(f"u.{c}")) for c in key]
        (hits.alias("h").join(unread.alias("u"), same, "left_anti")
         .write.mode("overwrite").parquet(f"{folder}/alerts/batch_id={batch_id}"))

    query = (cell_counts(stream, ts, project, columns, window, watermark).writeStream.outputMode("append")
             .option("checkpointLocation", f"{folder}/progress").foreachBatch(sink)
             .trigger(availableNow=True).start())
    query.awaitTermination()
