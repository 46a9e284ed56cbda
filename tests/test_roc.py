"""ROC points against a plain walk over the sorted scores."""

import numpy as np
from pyspark.sql import functions as F

from ledgerline.operators import automl


def _plain(labels, shares):
    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    return {(s, ((shares >= s) & (labels == 0)).sum() / neg, ((shares >= s) & (labels == 1)).sum() / pos)
            for s in np.unique(shares)}


def test_curve_of_tied_and_separated_scores(spark):
    rng = np.random.default_rng(3)
    parts, frames = {}, []
    for name, digits, n in (("tied", 1, 500), ("fine", 6, 800), ("one class", 2, 50)):
        labels = rng.integers(0, 2, n) if name != "one class" else np.ones(n, dtype=int)
        shares = np.round(np.clip(rng.normal(0.4 + 0.2 * labels, 0.2), 0, 1), digits)
        parts[name] = labels, shares
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(labels, shares)], "label double, share double")
        frames.append(automl.score_counts(df).withColumn("model_name", F.lit(name)))
    rows = automl.roc_curve(frames[0].unionByName(frames[1]).unionByName(frames[2]), buckets=8).collect()
    assert {r["model_name"] for r in rows} == {"tied", "fine"}
    for name in ("tied", "fine"):
        got = sorted((r["fpr"], r["tpr"], r["threshold"]) for r in rows if r["model_name"] == name)
        full = _plain(*parts[name])
        assert got[0] == (0.0, 0.0, float("inf")) and got[-1][:2] == (1.0, 1.0)
        assert {(t, f, p) for f, p, t in got[1:]} <= full
        xs, ys = [g[0] for g in got], [g[1] for g in got]
        area = np.trapezoid(ys, xs)
        labels, shares = parts[name]
        a, b = shares[labels == 1][:, None], shares[labels == 0][None, :]
        assert abs(area - ((a > b).mean() + (a == b).mean() / 2)) < 1e-12  # nothing that bends the curve is left out
    assert len(rows) < sum(len(_plain(*parts[n])) for n in ("tied", "fine"))


def test_training_keeps_the_curve_of_every_candidate(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = np.where(x + rng.normal(0, 0.5, 300) > 0, "yes", "no")
    df = spark.createDataFrame([(float(a), str(b)) for a, b in zip(x, y)], "x double, answer string")
    r = automl.train(df, "answer", models=["Linear Regression", "Decision Tree"], cv_folds=2, tune=False)
    names = {m["model_name"]: m["roc_auc"] for m in r.leaderboard.collect()}
    points = r.roc.collect()
    assert {p["model_name"] for p in points} == set(names)
    for name, auc in names.items():
        got = sorted((p["fpr"], p["tpr"]) for p in points if p["model_name"] == name)
        assert abs(np.trapezoid([g[1] for g in got], [g[0] for g in got]) - auc) < 2e-3
