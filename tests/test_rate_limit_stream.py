"""The rate limiter's stream: equal to the batch rule in order of time, late rows, state that ends."""

import datetime as dt

import numpy as np

from ledgerline.streaming import rate_limit

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _rows(spark, cells):
    rows = [(i, u, START + dt.timedelta(seconds=s)) for i, u, s in cells]
    return spark.createDataFrame(rows, "rid long, user string, ts timestamp")


def _run(spark, tmp_path, batches, window_s, limit, watermark, **more):
    """Decide the batches one after another; (accepted by request, state rows after the last)."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for cells in batches:
        _rows(spark, cells).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("rid long, user string, ts timestamp").parquet(src)
        q = (rate_limit.decide_stream(stream, "user", "ts", "rid", window_s, limit, watermark, **more)
             .writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
        q.awaitTermination()
    progress = [p for p in q.recentProgress if p["stateOperators"]]
    got = {r["rid"]: r["accepted"] for r in spark.read.parquet(out).collect()}
    return got, progress[-1]["stateOperators"][0]["numRowsTotal"]


def test_stream_in_order_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    cells = [(i, "hot" if rng.random() < 0.5 else f"u{rng.integers(4)}", s / 2)
             for i, s in enumerate(np.sort(rng.integers(0, 600, 900)).tolist())] + [(1000, None, 301.0)]
    want = {r["rid"]: r["accepted"] for r in
            rate_limit.decide(_rows(spark, cells).fillna("none"), "user", "ts", "rid", 10, 4).collect()}
    parts = [cells[:500], cells[500:][::-1]]  # within a batch the order of arrival is free
    got, _ = _run(spark, tmp_path, parts, 10, 4, "1 minute", rows_out=7)
    assert got == want and not all(got.values())


def test_late_requests(spark, tmp_path):
    batches = [[(1, "a", 100), (2, "a", 103)],
               [(3, "a", 101), (4, "a", 99)],       # older than request 2, above the watermark of 93 s
               [(5, "b", 500)], [(6, "a", 480), (7, "a", 491)]]  # 480 s is below the watermark of 490 s
    got, _ = _run(spark, tmp_path, batches, 10, 2, "10 seconds")
    # Request 4 sees nothing before it; request 3 sees those at 99 s and 100 s, not the one at 103 s.
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 7: True}


def test_state_of_idle_clients_ends(spark, tmp_path):
    busy = [(i, f"u{i % 50}", i / 10) for i in range(500)]
    got, left = _run(spark, tmp_path, [busy, [(1000, "last", 5000)]], 60, 100, "30 seconds")
    assert len(got) == 501 and left == 1
    got, left = _run(spark, tmp_path, [[(1001, "next", 9000)], [(1002, "next", 9001)]], 60, 100, "30 seconds")
    assert len(got) == 503 and left == 1
