"""Trees, forests and boosting against plain recursive versions; both growing phases; stored models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerline.operators import automl, nets, trees
from ledgerline.session import folder_exists


def _plain(bins, y, w, n_classes, depth):
    """Predictions of a recursively grown tree over all features, first best cut."""
    out = np.zeros((len(y), max(1, n_classes)))

    def score(mask):
        s, _ = trees.statistics(y[mask], w[mask], n_classes)
        return (s.sum(axis=0) ** 2).sum() / w[mask].sum()

    def node(mask, left):
        s, q = trees.statistics(y[mask], w[mask], n_classes)
        out[mask] = s.sum(axis=0) / w[mask].sum()
        if not left or q.sum() - score(mask) < 1e-9:
            return
        best = None
        for f in range(bins.shape[1]):
            for c in np.unique(bins[mask, f])[:-1]:
                a, b = mask & (bins[:, f] <= c), mask & (bins[:, f] > c)
                v = score(a) + score(b)
                if best is None or v > best[0]:
                    best = v, a, b
        if best:
            node(best[1], left - 1)
            node(best[2], left - 1)
    node(np.ones(len(y), bool), depth)
    return out


@pytest.mark.parametrize("n_classes", [0, 3])
@pytest.mark.parametrize("depth", [1, 3, 99])
def test_tree_equals_the_recursive_one(n_classes, depth):
    draw = np.random.default_rng(depth)
    bins = draw.integers(0, 6, (150, 3)).astype(np.uint8)
    y = draw.integers(0, 3, 150).astype(float)
    w = draw.integers(1, 4, 150).astype(float)
    tree = trees.grow(bins, *trees.statistics(y, w, n_classes), w, 3, 1, depth)
    assert np.allclose(tree.predict(bins)[0], _plain(bins, y, w, n_classes, depth))


def test_cut_trees_are_the_limited_ones_and_repeated_rows_end():
    draw = np.random.default_rng(3)
    bins = draw.integers(0, 200, (3000, 6)).astype(np.uint8)
    y, w = draw.integers(0, 4, 3000).astype(float), trees.bootstrap(np.arange(3000), 2, 7).astype(float)
    m = w > 0
    args = (bins[m], *trees.statistics(y[m], w[m], 4), w[m], 2, 9)
    full = trees.grow(*args)
    for d in (0, 5, 10):
        assert np.allclose(full.predict(bins, (d,))[0], trees.grow(*args, max_depth=d).predict(bins)[0])
    assert (full.predict(bins[m])[0].argmax(axis=1) == y[m]).all()
    same = np.zeros((50, 2), np.uint8)
    lone = trees.grow(same, *trees.statistics(np.arange(50.0), np.ones(50), 0), np.ones(50), 2, 1)
    assert len(lone.feature) == 1 and lone.value[0, 0] == 24.5


@pytest.mark.parametrize("n_classes", [0, 4])
def test_rows_are_sorted_once_for_all_lower_levels(monkeypatch, n_classes):
    draw, sort, calls = np.random.default_rng(5), np.sort, []
    bins = draw.integers(0, 200, (4000, 3)).astype(np.uint8)
    y = draw.integers(0, n_classes or 50, 4000).astype(float)
    w = draw.integers(1, 4, 4000).astype(float)
    monkeypatch.setattr(np, "sort", lambda *a, **k: calls.append(1) or sort(*a, **k))
    tree = trees.grow(bins, *trees.statistics(y, w, n_classes), w, 3, 1)
    assert 0 < len(calls) <= 3
    monkeypatch.undo()
    assert np.allclose(tree.predict(bins)[0], _plain(bins, y, w, n_classes, 99))


def _table(spark, n=1500, n_classes=3):
    df = spark.range(n).select(
        *((F.pmod(F.xxhash64("id", F.lit(j)), F.lit(40)) / 7.0).alias(f"x{j}") for j in range(4)), "id")
    label = F.pmod(F.floor(F.col("x0") + F.col("x1") * F.col("x2")), F.lit(n_classes)) if n_classes else F.floor(
        F.col("x0") * 9 + F.col("x1") * F.col("x2"))
    df = df.withColumn("label", label.cast("double"))
    df = VectorAssembler(inputCols=["x0", "x1", "x2", "x3"], outputCol="features").transform(df)
    return df.withColumn("_is_train", F.col("id") % 5 > 0).withColumn("_fold", (F.col("id") % 3).cast("int")).repartition(3, "id")


@pytest.mark.parametrize("n_classes", [0, 3])
def test_both_phases_grow_the_same_forest(spark, n_classes):
    prepared = _table(spark, n_classes=n_classes)
    cuts = trees.quantile_cuts(prepared.select(F.expr("array(x0, x1, x2, x3)").alias("features")), 4)
    rows = trees.binned(prepared, cuts)
    fits = [trees.Fit("Random Forest", "", 0, 6, True, 2), trees.Fit("Decision Tree", "fold", 1, 1, False, 4)]
    depths = (2, 4, trees.NO_LIMIT)
    results = []
    for limit in (10 ** 6, 150):
        made, kept, tops = trees.forests(rows, fits, 4, n_classes, 42, depths, keep=0, limit=limit)
        got = trees.judgements(made, fits, (3, 6), 3, n_classes).orderBy("fit", "setting", "row").collect()
        results.append([(r.fit, r.setting, r.row, r.label, r.prediction, [round(x, 9) for x in r.shares]) for r in got])
        assert (len(tops.nodes[(0, 0)]) > 1) == (limit == 150) and kept.count() >= 6
    assert results[0] == results[1]
    held = [r for r in results[0] if r[0] == 0 and r[1] == 5]
    assert len(held) == prepared.where("not _is_train").count()
    # A forest of three trees of depth 2, grown apart, is setting 0.
    part = {c: np.array(v) for c, v in rows.select("row", "label", "is_train").toPandas().items()}
    bins = np.array([np.frombuffer(bytes(b), np.uint8) for b in rows.toPandas()["bins"]])
    by = np.argsort(part["row"])
    part, bins = {c: v[by] for c, v in part.items()}, bins[by]
    total = 0
    for t in range(3):
        w = trees.bootstrap(part["row"], t, 42) * part["is_train"]
        m = w > 0
        total = total + trees.grow(bins[m], *trees.statistics(part["label"][m], w[m].astype(float), n_classes),
                                   w[m].astype(float), 2, 42 + t, 2).predict(bins[~part["is_train"]])[0] / 3
    assert np.allclose(total, [r[5] for r in results[0] if r[0] == 0 and r[1] == 0])


def _plain_boost(bins, y, k, rounds, depth, rate, judged):
    """Softmax boosting over the recursive tree, leaf by leaf."""
    prior = np.log(np.bincount(y.astype(int), minlength=k) / len(y))
    f, hot = np.tile(prior, (len(y), 1)), np.eye(k)[y.astype(int)]
    both = np.concatenate([bins, judged])
    g = np.tile(prior, (len(judged), 1))
    for _ in range(rounds):
        e = np.exp(f - f.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        for j in range(k):
            r = hot[:, j] - p[:, j]
            tree = trees.grow(bins, r[:, None], r * r, np.ones(len(y)), bins.shape[1], 0, depth)
            leaf = tree.leaves(both)
            for q in np.unique(leaf):
                own = np.flatnonzero(leaf[:len(y)] == q)
                a = r[own]
                v = (k - 1) / k * a.sum() / (np.abs(a) * (1 - np.abs(a))).sum()
                f[own, j] += rate * v
                g[leaf[len(y):] == q, j] += rate * v
    return g


def test_softmax_boosting_equals_a_plain_version():
    draw = np.random.default_rng(8)
    bins = draw.integers(0, 30, (300, 3)).astype(np.uint8)
    y = ((bins[:, 0] > 14).astype(int) + (bins[:, 1] > 20)).astype(float)
    y[:20] = draw.integers(0, 3, 20)
    judged = draw.integers(0, 30, (40, 3)).astype(np.uint8)
    got, _, made = trees.boost(bins, y, 3, 8, 2, 0.1, judged)
    assert np.allclose(got, _plain_boost(bins, y, 3, 8, 2, 0.1, judged)) and len(made) == 24


@pytest.mark.parametrize("model", ["Random Forest", "Decision Tree", "Gradient Boosting", "Neural Network"])
def test_trained_models_score_store_and_load(spark, tmp_path, model):
    df = _table(spark, 600).select("x0", "x1", "x2", "x3", F.concat(F.lit("c"), F.col("label").cast("int")).alias("kind"))
    small = automl.Budget(trees=7, boosting_rounds=10, net_iterations=15, grid_trees=(3, 7))
    result = automl.train(df, "kind", models=[model], cv_folds=3, budget=small)
    board = result.leaderboard.first()
    assert board.status == "ok" and board.cv_score is not None and board.tuned == (model == "Random Forest")
    scored = automl.score(result, df)
    assert scored.columns == [*df.columns, "predicted_kind"] and scored.count() == 600
    right = scored.where("kind = predicted_kind").count()
    assert right > {"Gradient Boosting": 250, "Neural Network": 200}.get(model, 400)
    automl.save_model(result, str(tmp_path / "m"))
    loaded = automl.load_model(str(tmp_path / "m"), spark)
    assert loaded.transform(df).where("kind = predicted_label").count() == right
    assert (loaded.about["target"], loaded.about["problem"], list(loaded.about["labels"])) == ("kind", "classification", ["c0", "c1", "c2"])


def test_net_learns_a_curve():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(800, 2))
    y = ((x ** 2).sum(axis=1) > 1.4).astype(float)
    layers = nets.fit_net(x, y, 2, 150, 3)
    assert (nets.shares(x, layers).argmax(axis=1) == y).mean() > 0.95


@pytest.mark.parametrize("n_classes", [0, 2, 3])
def test_boosting_in_spark_equals_the_one_of_a_task(spark, n_classes, monkeypatch):
    monkeypatch.setattr(trees, "PACK", 100)          # several blocks, also on the driver's side
    prepared = _table(spark, 900, n_classes)
    fits = [trees.Fit("Gradient Boosting", by, v, 1, False, 4) for by, v in (("", 0), ("fold", 0), ("fold", 2))]
    cuts = trees.quantile_cuts(prepared.where("_is_train").select(vector_to_array("features").alias("features")), 4)
    rows = trees.binned(prepared, cuts)
    rounds = trees.KEEP + 2                           # the scores are written once on the way
    (a, model_a), (b, model_b) = (trees.boosted(rows, fits, 4, n_classes, rounds, 3, limit=limit)
                                  for limit in (trees.LIMIT, 100))
    key = ["fit", "setting", "row"]
    x, y = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (a, b))
    assert len(x) and x[[*key, "label"]].equals(y[[*key, "label"]])
    assert np.allclose(np.stack(x["shares"]), np.stack(y["shares"])) and np.allclose(x["prediction"], y["prediction"])
    x, y = (d.orderBy("setting").collect() for d in (model_a, model_b))
    assert len(x) == len(y) == rounds * (3 if n_classes == 3 else 1)
    assert np.allclose(np.frombuffer(x[0]["gains"]), np.frombuffer(y[0]["gains"]))
    assert np.allclose(x[0]["shares"], y[0]["shares"])
    for r, s in zip(x, y):
        t, u = trees.Tree.unpack(bytes(r["data"])), trees.Tree.unpack(bytes(s["data"]))
        assert (t.feature == u.feature).all() and np.allclose(t.value, u.value)


def test_small_trees_are_followed_like_large_ones(monkeypatch):
    draw = np.random.default_rng(5)
    bins, y = draw.integers(0, 256, (2000, 3)).astype(np.uint8), draw.random(2000)
    tree = trees.grow(bins, *trees.statistics(y, np.ones(2000), 0), np.ones(2000), 3, 1, 4)
    fast = tree.leaves(bins)
    monkeypatch.setattr(trees, "SMALL_TREE", 0)
    assert len(tree.feature) > 20 and (fast == tree.leaves(bins)).all()


def test_boosting_of_many_rows_is_not_left_to_one_job_per_fold(spark, monkeypatch):
    """Above the limit of a task, boosting had one Spark model per fold and class; now all advance together."""
    monkeypatch.setattr(trees, "LIMIT", 200)
    monkeypatch.setattr(trees.boosted, "__defaults__", (0.1, 200))
    prepared = _table(spark, 900, 3)
    data = prepared.select(*[vector_to_array("features")[j].alias(f"x{j}") for j in range(4)], F.col("label").alias("y"))
    made = automl.train(data, "y", problem="classification", models=["Gradient Boosting"], tune=False,
                        budget=automl.Budget(boosting_rounds=3))
    assert isinstance(made.model, automl.FittedTrees) and isinstance(made.model.model, trees.BoostedModel)
    assert made.leaderboard.first()["status"] == "ok" and made.leaderboard.first()["cv_score"] is not None


def test_boosting_in_spark_keeps_one_table_of_scores(spark, monkeypatch):
    """Each rewriting of the rows' scores left the table before on the disk, 25 of them in 100 rounds."""
    paths, made = [], trees.scratch_path
    monkeypatch.setattr(trees, "scratch_path", lambda *a: paths.append(made(*a)) or paths[-1])
    prepared = _table(spark, 600, 0)
    rows = trees.binned(prepared, trees.quantile_cuts(prepared.select(F.expr("array(x0, x1, x2, x3)").alias("features")), 4))
    said, _ = trees.boosted(rows, [trees.Fit("Gradient Boosting", "", 0, 1, False, 4)], 4, 0, trees.KEEP + 1, 2, limit=100)
    assert len(paths) == 2 and said.count() == 120
    assert not any(folder_exists(spark, p) for p in paths)


def test_rows_are_routed_through_eight_trees_at_once():
    draw = np.random.default_rng(3)
    widths = [256, 3, 40, 1, 7]
    bins = np.stack([draw.integers(0, w, 3000) for w in widths]).astype(np.uint8)
    made = [trees.grow(bins.T, *trees.statistics(y, np.ones(3000), 0), np.ones(3000), 5, 1, depth)
            for y, depth in ((draw.random(3000), d) for d in (0, 1, 2, 3, 3, 3, 5, 3, 3, 2, 3))]
    shared = trees._joint(widths)
    assert sorted(q for own, _ in shared for q in own) == list(range(5)) and len(shared) == 2
    pick = trees._Routes(made, shared, widths).of([trees._cells_of(bins, own, widths) for own, _ in shared], bins)
    for k, tree in enumerate(made):
        assert (pick(k, np.arange(len(tree.feature))) == tree.leaves(bins.T)).all()
    sums = {q: x for own, cells in shared for q, x in trees._by_feature(
        np.bincount(trees._cells_of(bins, own, widths), minlength=cells)[None], own, widths).items()}
    assert all((sums[q][0] == np.bincount(bins[q], minlength=w)).all() for q, w in enumerate(widths))
