"""Version numbers under concurrent writers (SRC5), label tables (FE1, FE2, FE6), restarts side by side (ML18)."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerline.operators import catalog, features, personas
from ledgerline.session import create_once


def test_concurrent_writers_get_versions_of_their_own(spark, tmp_path):
    root = str(tmp_path / "versions")
    frames = [spark.range(i + 1).withColumn("who", F.lit(i)) for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda f: catalog.write_version(f, root, "a/b=c"), frames))
    assert sorted(got) == [1, 2, 3, 4]
    for i, version in enumerate(got):
        rows = catalog.read_version(spark, root, "a/b=c", version).collect()
        assert len(rows) == i + 1 and {r.who for r in rows} == {i}
    assert catalog.read_version(spark, root, "a/b=c").count() == got.index(4) + 1


def test_reserved_number_is_skipped(spark, tmp_path):
    root = str(tmp_path / "versions")
    assert create_once(spark, f"{root}/_versions/x/1") and not create_once(spark, f"{root}/_versions/x/1")
    assert catalog.write_version(spark.range(1), root, "x") == 2  # number 1 belongs to a writer that has not ended
    assert catalog.write_version(spark.range(2), root, "x") == 3
    assert catalog.read_version(spark, root, "x").count() == 2


@pytest.mark.parametrize("limit", [100_000, 10])
def test_labels_by_table_equal_sorted_positions(spark, monkeypatch, limit):
    monkeypatch.setattr(features, "BROADCAST_LABELS", limit)
    rng = np.random.default_rng(2)
    values = [f"é{int(v):04d}" for v in rng.integers(0, 2500, 6000)] + ["hot"] * 3000 + [None] * 5
    df = spark.createDataFrame(list(enumerate(values)), "id long, k string").withColumn("code", F.lit(1)).withColumn("rows", F.lit(2))
    order = {v: i for i, v in enumerate(sorted({v for v in values if v}, key=lambda v: v.encode()))}
    encoded, maps = features.label_encode(df, ["k"])
    assert encoded.columns.count("k") == 1 and set(encoded.columns) == set(df.columns)
    assert {r.id: r.k for r in encoded.collect()} == {i: float(order.get(v, len(order))) for i, v in enumerate(values)}
    assert {r.id: r.k for r in features.category_codes(df, ["k"]).collect()} == {i: order.get(v, -1) for i, v in enumerate(values)}
    fresh = spark.createDataFrame([(1, "hot"), (2, "new"), (3, None), (4, "é0001")], "id long, k string")
    got = {r.id: r.k for r in features.encode_with_map(fresh, "k", maps["k"]).collect()}
    assert got == {1: float(order["hot"]), 2: 0.0, 3: 0.0, 4: float(order.get("é0001", 0))}
    assert features.label_encode(df.where("false"), ["k"])[0].count() == 0


def test_million_labels_encode(spark):
    df = spark.range(1_000_000).select(F.format_string("%08d", "id").alias("k"), F.col("id").cast("double").alias("want"))
    out, _ = features.label_encode(df, ["k"])
    assert out.where("k != want").count() == 0 and out.count() == 1_000_000


def test_restarts_cost_no_more_than_separate_fits(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.6, (150, 2)) for c in [(0, 0), (5, 0), (0, 5), (5, 5), (2.5, 2.5)]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    centres, sizes, cost = personas.kmeans(df, ["a", "b"], 5)
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    best = min(KMeans(k=5, seed=s, tol=1e-6).fit(vec).summary.trainingCost for s in range(3))
    assert cost <= best * (1 + 1e-3) and sum(sizes) == len(x)
    label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [int((label == c).sum()) for c in range(5)] == sizes


def test_personas_fill_nan_and_equal_rows(spark):
    rows = [(float(i % 4) * 10, float(i % 4)) for i in range(40)] + [(float("nan"), 1.0), (None, None)]
    out = personas.personas(spark.createDataFrame(rows, "sales double, visits double")).toPandas()
    assert out["count"].sum() == 42 and all(np.isfinite(v) for c in out["centroid"] for v in c.values())
    same = personas.personas(spark.createDataFrame([(1.0, 2.0)] * 12, "sales double, visits double")).toPandas()
    assert same["count"].sum() == 12
