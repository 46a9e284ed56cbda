"""Behaviour of sources, catalog, encoding, alerts and streaming paths without a SQL oracle."""

import datetime as dt
import os

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.operators import alerts, catalog, features, search
from ledgerline.session import scratch_path
from ledgerline.sources import files
from ledgerline.streaming import rate_limit


def test_check_files_signatures(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    (tmp_path / "bad.csv").write_bytes(b"\xff\xfe\x00\x81binary")
    (tmp_path / "book.xlsx").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "renamed.xlsx").write_bytes(b"not a zip")
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0rest")
    (tmp_path / "notes.txt").write_text("hello")
    out = {r["file_name"]: r["verdict"] for r in files.check_files(spark, str(tmp_path) + "/*").collect()}
    assert out == {"good.csv": "ok", "bad.csv": "binary_csv", "book.xlsx": "ok",
                   "renamed.xlsx": "zip_signature_mismatch", "old.xls": "ok", "notes.txt": "invalid_type"}


def test_versions_increment_and_read_latest(spark, sf):
    root = scratch_path(spark, "test-versions")
    region = spark.read.parquet(f"{sf}/region.parquet")
    assert catalog.write_version(region, root, "region") == 1
    assert catalog.write_version(region.limit(2), root, "region") == 2
    assert catalog.read_version(spark, root, "region").count() == 2
    assert catalog.read_version(spark, root, "region", 1).count() == region.count()


def test_unseen_labels_map_to_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    mapping = features.label_map(train, "k")
    df = spark.createDataFrame([(1, "a"), (2, "c"), (3, "zzz")], "id int, k string")
    got = {r["id"]: r["k"] for r in features.encode_with_map(df, "k", mapping).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: 0.0}


def test_category_codes_null_is_minus_one(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, k string")
    got = {r["id"]: r["k"] for r in features.category_codes(df, ["k"]).collect()}
    assert got == {1: 1, 2: -1, 3: 0}


def test_scan_alerts_dedup_against_unread(spark):
    q = spark.createDataFrame([("p1", "d1", "a.csv", 70.0), ("p1", "d2", "b.csv", 50.0), ("p2", "d3", "c.csv", 90.0)],
                              "project_id string, dataset_id string, filename string, score double")
    first = alerts.scan_alerts(quality=q).collect()
    assert len(first) == 1 and first[0]["project_id"] == "p1"  # one per (project, event, metric)
    existing = spark.createDataFrame([("p1", alerts.QUALITY_EVENT, alerts.QUALITY_METRIC, False)],
                                     "project_id string, event string, metric string, is_read boolean")
    assert alerts.scan_alerts(quality=q, existing=existing).count() == 0
    read = existing.withColumn("is_read", F.lit(True))
    assert alerts.scan_alerts(quality=q, existing=read).count() == 1


def test_search_is_case_insensitive_over_whole_text(spark):
    long_text = "x" * 50000 + " Secret here"
    docs = spark.createDataFrame([(1, long_text), (2, "nothing")], "id long, text string")
    hits = search.search({"docs": (docs, "id", ["text"])}, "secret").collect()
    assert [r["id"] for r in hits] == [1]


def test_stream_decisions_equal_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, base + dt.timedelta(seconds=7 * i + (i % 5))) for i in range(300)]
    pdf = pd.DataFrame(rows, columns=["rid", "user", "ts"])
    src = tmp_path / "events"
    os.makedirs(src)
    spark.createDataFrame(pdf).write.parquet(str(src / "part"))
    batch = {r["rid"]: r["accepted"] for r in
             rate_limit.decide(spark.read.parquet(str(src / "part")), "user", "ts", "rid", 60, 3).collect()}
    stream_in = spark.readStream.schema(spark.read.parquet(str(src / "part")).schema).parquet(str(src / "part"))
    stream_in = stream_in.withColumn("ts", F.col("ts").cast("timestamp"))
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    q = (rate_limit.decide_stream(stream_in, "user", "ts", "rid", 60, 3).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    streamed = {r["rid"]: r["accepted"] for r in spark.read.parquet(out).collect()}
    assert streamed == batch
    assert not all(batch.values())


def test_clean_summary_before_after(spark):
    from ledgerline.operators import clean
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, "b"), (3.0, None)], "x double, k string")
    out = {r["metric"]: (r["before"], r["after"]) for r in clean.clean_summary(df, clean.clean(df)).collect()}
    assert out["rows"] == (4, 3)
    assert out["missing_cells"] == (2, 0)
    assert out["duplicate_rows"] == (1, 0)


def test_lineage_append_and_history(spark):
    path = scratch_path(spark, "t-lineage")
    first = catalog.lineage_rows(spark, [("d1", "UPLOAD", "raw", dt.datetime(2026, 1, 1)),
                                         ("d1", "CLEAN", "cleaned", dt.datetime(2026, 1, 2))])
    catalog.append_lineage(first, path)
    catalog.append_lineage(catalog.lineage_rows(spark, [("d2", "UPLOAD", "raw", dt.datetime(2025, 12, 31))]), path)
    hist = catalog.lineage_history(spark.read.parquet(path)).collect()
    assert [r["operation"] for r in hist] == ["UPLOAD", "UPLOAD", "CLEAN"]
    assert [r["operation"] for r in catalog.lineage_history(spark.read.parquet(path), "d1").collect()] == \
        ["UPLOAD", "CLEAN"]
