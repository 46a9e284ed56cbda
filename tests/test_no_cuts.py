"""Every row, series and class is answered: no caps, size switches or neighbours that change a result."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from ledgerline.functions.ordering import consecutive_index
from ledgerline.operators import charts, forecast, summary
from ledgerline.operators.alerts import retrain_targets
from ledgerline.operators.catalog import read_version, write_version
from ledgerline.sources.files import _verdicts


def _series(spark):
    rows = [("a", dt.date(2024, m, 3), float(10 + m)) for m in range(1, 13)]
    rows += [("b", dt.date(2024, 12, d), float(d)) for d in range(1, 8)]
    rows += [("c", dt.date(2024, 12, d), 1.0) for d in (1, 2)]
    return spark.createDataFrame(rows, "k string, d date, v double")


def test_each_series_has_its_own_frequency(spark):
    got = forecast.forecast(_series(spark), "d", "v", periods=3, series="k").collect()
    by = {}
    for r in got:
        by.setdefault(r.series, []).append(r)
    assert sorted(r.period for r in by["a"]) == ["2025-01-01", "2025-02-01", "2025-03-01"]
    assert sorted(r.period for r in by["b"]) == ["2024-12-08", "2024-12-09", "2024-12-10"]
    assert [(r.step, r.model) for r in by["c"]] == [(0, "too_few_points")]


def test_chart_series_has_no_limit(spark):
    df = spark.range(3000).selectExpr("id % 3 AS x", "id AS s", "1.5 AS y")
    assert charts.chart_series(df, "x", "s", "y").count() == 3000


def test_whole_numbers_get_bins_of_one(spark):
    df = spark.range(8).selectExpr("CAST(id AS int) AS v", "CAST(id AS double) AS w")
    for column, kind in (("v", int), ("w", float)):
        counts = [r["count"] for r in summary.histogram(df, column).orderBy("bin").collect()]
        assert counts == np.histogram(np.arange(8, dtype=kind), bins="auto")[0].tolist()


def test_nan_cells_are_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "id int, v double")
    assert [(r.row, r.cols) for r in summary.missing_map(df, "id").collect()] == [(0, "1"), (2, "1")]


def test_consecutive_index_is_complete_with_ties(spark):
    df = spark.range(500).selectExpr("id % 3 AS v", "id")
    got = consecutive_index(df, "v").collect()
    assert sorted(r["_idx"] for r in got) == list(range(500))
    assert [r.v for r in sorted(got, key=lambda r: r["_idx"])] == sorted(r.v for r in got)


def test_retrain_reason_is_the_first_rule(spark):
    quality = spark.createDataFrame([(1, 7, 40.0)], "project_id int, dataset_id int, score double")
    monitoring = spark.createDataFrame([(1, 3, "critical")], "project_id int, model_id int, status string")
    models = spark.createDataFrame([(3, 1, 7, "t")], "model_id int, project_id int, dataset_id int, target_column string")
    projects = spark.createDataFrame([(1, None)], "project_id int, auto_retrain_enabled boolean")
    assert [r.reason for r in retrain_targets(quality, monitoring, models, projects).collect()] == ["critical_quality"]


def test_unreadable_files_are_not_ok(tmp_path):
    gone = pd.DataFrame({"path": [f"file://{tmp_path}/gone.csv", f"file://{tmp_path}/gone.txt"], "length": [3, 3]})
    assert next(_verdicts(iter([gone])))["verdict"].tolist() == ["unreadable", "invalid_type"]


def test_versions_count_up_and_other_errors_surface(spark, tmp_path):
    df, root = spark.range(2), str(tmp_path / "versions")
    assert [write_version(df, root, "a"), write_version(df, root, "a"), write_version(df, root, "b")] == [1, 2, 1]
    assert read_version(spark, root, "a").count() == 2
