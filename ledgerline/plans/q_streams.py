"""Rate-limit and streaming-alert queries (ST1, ST2)."""

from __future__ import annotations

from ledgerline.plans.registry import register
from ledgerline.session import folder_exists, scratch_path
from ledgerline.sources.tables import table
from ledgerline.streaming import alerts_stream, rate_limit

# The test events are sparse (about two per user per day), so the limit
# window is one day with five requests, instead of one minute with 100.
WINDOW_S = 86400
LIMIT = 5


@register("ST1", sql=f"""
SELECT event_id, user_id, ts,
       count(*) OVER (PARTITION BY user_id ORDER BY ts
                      RANGE BETWEEN INTERVAL '{WINDOW_S * 1_000_000 - 1} microseconds' PRECEDING AND CURRENT ROW) - 1
         AS prior_requests,
       count(*) OVER (PARTITION BY user_id ORDER BY ts
                      RANGE BETWEEN INTERVAL '{WINDOW_S * 1_000_000 - 1} microseconds' PRECEDING AND CURRENT ROW) - 1
         >= {LIMIT} AS breach
FROM events
""")
def st1(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return rate_limit.offered_load(ev, "user_id", "ts", WINDOW_S, LIMIT)


@register("ST1_EXACT", note="sequential accept/reject per client, cut at idle gaps; rows-only")
def st1_exact(spark, sf):
    return rate_limit.decide(table(spark, sf, "events"), "user_id", "ts", "event_id", WINDOW_S, LIMIT)


def _event_stream(spark, sf):
    from pyspark.sql import functions as F
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf.rstrip('/')}/events*.parquet")
    # Watermarks need TIMESTAMP; with the session in UTC the wall-clock values are unchanged.
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@register("ST1_STREAM", note="stateful streaming accept/reject (applyInPandasWithState); rows-only")
def st1_stream(spark, sf):
    decided = rate_limit.decide_stream(_event_stream(spark, sf), "user_id", "ts", "event_id", WINDOW_S, LIMIT)
    out, ckpt = scratch_path(spark, "st1-out"), scratch_path(spark, "st1-ckpt")
    q = (decided.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@register("ST2", note="windowed anomaly share per event type with watermark and alert de-dup; rows-only")
def st2(spark, sf):
    metrics = alerts_stream.window_metrics(_event_stream(spark, sf), "ts", "event_type", "value", threshold=110.0)
    out, ckpt = scratch_path(spark, "st2-out"), scratch_path(spark, "st2-ckpt")
    alerts_stream.run_to_table(alerts_stream.stream_alerts(metrics), out, ckpt)
    if folder_exists(spark, out):
        return spark.read.parquet(out)
    # No batch came: an empty result with the alert schema.
    return spark.createDataFrame([], "project_id string, window_start timestamp, window_end timestamp, "
                                         "event string, severity string, metric string, anomaly_count bigint, "
                                         "anomaly_percentage double, action_recommended string, is_read boolean, "
                                         "batch_id int")


@register("ST2_RULES", note="AL1-AL4 on closed 30-day windows of arriving events; rows-only, tests against the batch rules")
def st2_rules(spark, sf):
    """Events by type, compared with those of the table's first 30 days."""
    from pyspark.sql import functions as F
    first = table(spark, sf, "events").agg(F.min("ts")).first()[0]
    folder = scratch_path(spark, "st2-rules")
    if first is not None:
        known = table(spark, sf, "events").where(F.col("ts") < F.lit(first) + F.expr("INTERVAL 30 DAYS"))
        features = ["value", "user_id"]
        alerts_stream.watch(
            _event_stream(spark, sf), "ts", "event_type", ["event_id", "user_id", "value", "props"], folder,
            target="value", threshold=110.0, training=alerts_stream.training_counts(known, features),
            features=tuple(features), model_id="event-value-model", window="30 days")
    if folder_exists(spark, f"{folder}/alerts"):
        return spark.read.parquet(f"{folder}/alerts").drop("batch_id")
    return spark.createDataFrame([], "project_id string, event string, severity string, metric string, "
                                     "explanation string, action_recommended string, source_id string, "
                                     "priority int, is_read boolean")
