"""Alert rules on arriving rows against the batch rules on the same rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import alerts, drift, profile
from ledgerline.streaming import alerts_stream as stream

DAY0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "rid long, shop string, ts timestamp, sales double, units int, note string, ship_date string"
COLUMNS = ["rid", "sales", "units", "note", "ship_date"]


def _rows(days, seed):
    """Shop a is fine; b has gaps, copies and bad dates; c drifts and falls from day to day."""
    rng = np.random.default_rng(seed)
    out = []
    for d in days:
        for i in range(40):
            ts = DAY0 + dt.timedelta(days=d, minutes=int(rng.integers(1440)))
            out.append((d * 1000 + i, "a", ts, float(rng.integers(100, 120)), int(rng.integers(1, 9)), f"n{i}", "2024-01-02"))
            gap = (None, "b", ts, None, -1, None, "2024-13-77" if i % 9 == 0 else "2024-01-02")
            out += [gap] if i % 3 else [gap, gap]
            out.append((d * 1000 + i, "c", ts, float(rng.integers(1, 5)) + 1000 - 90 * d, 50 + i, "x", None))
    return out


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("watch")
    train = spark.createDataFrame(_rows(range(3), 1), SCHEMA).where("shop = 'a'")
    training = stream.training_counts(train, ["sales", "units"])
    parts = [_rows(range(0, 4), 2), _rows(range(4, 8), 3), _rows([30], 4)]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(root / "in"))
        src = spark.readStream.schema(SCHEMA).parquet(str(root / "in"))
        stream.watch(src, "ts", "shop", COLUMNS, str(root / "out"), target="sales", threshold=115.0, training=training,
                     features=("sales", "units"), model_id="model-one-two", watermark="1 hour")
    df = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    return str(root / "out"), df, train, training


def _closed(df):
    return (stream.cell_counts(df, "ts", "shop", COLUMNS)).where("window_end <= '2024-01-09'")


def test_quality_and_drift_of_windows_equal_the_batch_operators(spark, ran):
    _, df, train, training = ran
    fields = [df.schema[c] for c in COLUMNS]
    closed = _closed(df)
    got = {r["dataset_id"]: r["score"] for r in stream.window_quality(closed, fields).collect()}
    health = {(r["project_id"], r["created_at"].day): r for r in
              stream.window_drift(closed, fields, training, ["sales", "units"], "m").collect()}
    assert len(got) == len(health) == 24
    for shop, day in [("a", 1), ("b", 1), ("b", 6), ("c", 3), ("c", 8)]:
        one = df.where((F.col("shop") == shop) & (F.dayofmonth("ts") == day) & (F.col("ts") < "2024-01-20"))
        assert got[f"{shop} 2024-01-{day:02d} 00:00"] == profile.quality(one.select(*COLUMNS), with_outliers=False).first()["score"]
        want = drift.model_health(drift.drift(train, one, ["sales", "units"])).first()
        mine = health[(shop, day + 1)]
        assert (mine["drift_percentage"], mine["status"]) == (want["drift_percentage"], want["status"])


def test_grouped_distance_equals_the_plain_one(spark, ran):
    _, df, train, training = ran
    fields = [df.schema[c] for c in COLUMNS]
    got = {(r["project_id"], r["window_start"].day, r["feature"]): r for r in drift.ks_by_group(
        training, stream._numbers(_closed(df), fields, ["sales", "units"]), stream._GROUP, buckets=4).collect()}
    for shop, day in [("a", 2), ("c", 5), ("c", 8)]:
        one = df.where((F.col("shop") == shop) & (F.dayofmonth("ts") == day) & (F.col("ts") < "2024-01-20"))
        for w in drift.drift(train, one, ["sales", "units"]).collect():
            g = got[(shop, day, w["feature"])]
            assert tuple(g[c] for c in ("n_train", "n_current", "ks_statistic", "p_value")) == \
                (w["n_train"], w["n_current"], w["ks_statistic"], w["p_value"])


def test_alerts_of_the_stream(spark, ran):
    out, df, _, training = ran
    stored = spark.read.parquet(f"{out}/alerts").collect()
    keys = [(r["project_id"], r["event"], r["metric"]) for r in stored]
    assert len(keys) == len(set(keys))  # unread alerts are not repeated
    fields = [df.schema[c] for c in COLUMNS]
    closed = _closed(df)
    want = alerts.scan_alerts(
        quality=stream.window_quality(closed, fields),
        forecasts=stream.series_forecasts(stream.window_series(closed, fields, "sales"), "sales"),
        monitoring=stream.window_drift(closed, fields, training, ["sales", "units"], "model-one-two"),
        anomalies=stream.window_anomalies(closed, fields, "sales", 115.0)).collect()
    assert set(keys) == {(r["project_id"], r["event"], r["metric"]) for r in want}
    assert {e for _, e, _ in keys} == {alerts.QUALITY_EVENT, alerts.FORECAST_EVENT, alerts.DRIFT_EVENT, alerts.ANOMALY_EVENT}
    assert ("b", alerts.QUALITY_EVENT, alerts.QUALITY_METRIC) in keys and ("a", alerts.QUALITY_EVENT, alerts.QUALITY_METRIC) not in keys


def test_projects_without_name_and_short_series(spark):
    df = spark.createDataFrame([(1, None, DAY0, 120.0, 1, "a", None), (2, "s", DAY0, None, None, None, None)], SCHEMA)
    fields = [df.schema[c] for c in COLUMNS]
    closed = stream.cell_counts(df, "ts", "shop", COLUMNS)
    assert {r["dataset_id"] for r in stream.window_quality(closed, fields).collect()} == {"- 2024-01-01 00:00", "s 2024-01-01 00:00"}
    [hit] = stream.window_anomalies(closed, fields, "sales", 115.0).collect()
    assert (hit["project_id"], hit["anomaly_percentage"]) == (None, 100.0)
    assert stream.series_forecasts(stream.window_series(closed, fields, "sales"), "sales").count() == 0
    assert stream.window_quality(stream.cell_counts(df.limit(0), "ts", "shop", COLUMNS), fields).count() == 0
