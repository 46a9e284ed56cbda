"""How often and in what form operators pass over their rows; results against plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerline.operators import drift, personas
from ledgerline.streaming import rate_limit


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_segment_sums_equal_row_by_row_ones():
    rng = np.random.default_rng(1)
    rows, centres = rng.integers(0, 5, (500, 3)).astype(float), rng.integers(0, 5, (4, 3, 3)).astype(float)
    x = np.vstack([np.ones(len(rows)), rows.T])
    got = personas._sums(x, centres)
    for r in range(4):
        label = ((rows[:, None] - centres[r][None]) ** 2).sum(axis=2).argmin(axis=1)    # ties to the first
        for c in range(3):
            assert np.allclose(got[r, c], x[:, label == c].sum(axis=1))


def test_many_short_pieces_are_decided_without_a_group_each(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"u{rng.integers(40)}", float(rng.integers(0, 4000))) for i in range(3000)]
    df = spark.createDataFrame(rows, "rid long, user string, s double").select(
        "rid", "user", F.timestamp_seconds("s").alias("ts"))
    out = rate_limit.decide(df, "user", "ts", "rid", 10, 2)
    assert "MapInArrow" in _plan(out) and "FlatMapGroups" not in _plan(out)
    want = {}
    for user in {r[1] for r in rows}:
        taken = []
        for s, rid in sorted((r[2], r[0]) for r in rows if r[1] == user):
            want[rid] = sum(s - t < 10 for t in taken) < 2
            if want[rid]:
                taken.append(s)
    assert {r["rid"]: r["accepted"] for r in out.collect()} == want and not all(want.values())


def test_drift_reads_its_samples_once(spark, tmp_path):
    spark.range(4000).selectExpr("cast(id % 97 as double) as a").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    out = drift.drift(t.where("a < 60"), t.where("a >= 30"), ["a"])
    assert "FileScan" not in _plan(out) and out.first()["drift_detected"]


def test_farthest_neighbours_come_with_the_neighbours(spark):
    from ledgerline.operators import neighbours
    rng = np.random.default_rng(5)
    xs = np.unique(rng.integers(0, 1000, 300)).astype(float)
    rows = [(i, int(rng.integers(1, 9)), float(x)) for i, x in enumerate(xs)]
    near = neighbours.weighted_neighbours(spark.createDataFrame(rows, "id long, w long, x double"), ["x"], 5, cell=40).toPandas()
    top = near.groupby("id")["d2"].max()
    marked = near[near["far"].notna()].set_index("id")["far"]
    assert len(marked) == len(rows) and (marked.sort_index() == top.sort_index()).all()
    assert near.groupby("id")["take"].sum().eq(5).all()


def test_a_second_scan_makes_no_results_again(spark, monkeypatch):
    from ledgerline.plans import q_alerts
    made = []

    def result(name, rows, schema):
        def run(session, sf):
            made.append(name)
            return session.createDataFrame(rows, schema)
        monkeypatch.setattr(q_alerts, name, run)
    result("quality_results", [("p", "d", "f", 50.0), ("project-1", "e", "g", 70.0)],
           "project_id string, dataset_id string, filename string, score double")
    result("forecast_results", [("p", "sales", 10.0, 5.0)], "project_id string, target string, hist_avg double, fore_avg double")
    result("monitoring_results", [("p", "m", 50.0, "critical")],
           "project_id string, model_id string, drift_percentage double, status string")
    result("anomaly_results", [("p", "r", 9, 9.0)], "project_id string, run_id string, anomaly_count long, anomaly_percentage double")
    assert [r["source_id"] for r in q_alerts.al5(spark, "").collect()] == ["e"] and len(made) == 4
