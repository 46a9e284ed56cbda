"""Model training with a leaderboard, scoring, what-if and explanations (ML1–ML15, ML19).

Linear models and the neural net are Spark ML fits; forests, trees and boosting
are grown by ``operators.trees``. Features go through one fitted
pipeline (impute → date parts → label codes → assemble → standardise) that
is fitted on the training split only and stored with the model, so scoring
data takes exactly the same steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator)
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import columns as C
from ledgerline.functions.ordering import running_totals
from ledgerline.operators import nets, trees
from ledgerline.operators.features import feature_pipeline
from ledgerline.session import cut_lineage

# Candidate model names, as shown on the leaderboard.
CLASSIFIERS = ["Random Forest", "Decision Tree", "Gradient Boosting", "Logistic Regression", "Neural Network"]
REGRESSORS = ["Random Forest", "Decision Tree", "Gradient Boosting", "Linear Regression"]


@dataclass(frozen=True)
class Budget:
    """Size of the fits. The defaults are the reference's; a depth of None is unlimited."""

    trees: int = 100
    tree_depth: int | None = None
    boosting_rounds: int = 100
    boosting_depth: int = 3
    net_iterations: int = 500
    grid_depths: tuple[int | None, ...] = (5, 10, None)
    grid_trees: tuple[int, ...] = (50, 100)


def _estimator(name: str, problem: str, n_features: int, n_classes: int, seed: int, budget: Budget = Budget()):
    cls = problem == "classification"
    if name == "Gradient Boosting":
        boosted = (GBTClassifier if cls else GBTRegressor)(
            maxIter=budget.boosting_rounds, maxDepth=budget.boosting_depth, seed=seed)
        # Spark's own boosting, for callers; ``train`` grows it in ``trees``. It knows two classes; more go one against the rest.
        return OneVsRest(classifier=boosted, parallelism=4) if cls and n_classes > 2 else boosted
    if name == "Logistic Regression":
        return LogisticRegression(maxIter=1000)
    if name == "Linear Regression":
        return LinearRegression()
    if name == "Neural Network":
        return MultilayerPerceptronClassifier(layers=[n_features, 100, 50, n_classes],
                                              maxIter=budget.net_iterations, tol=1e-4, seed=seed)
    raise ValueError(f"unknown model {name!r}")


def problem_type(df: DataFrame, target: str) -> str:
    """ML1: numerical target with more than 15 distinct values → regression."""
    dt = df.schema[target].dataType
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(target).alias("d")).first()
    numeric = C.is_numeric(dt) or isinstance(dt, T.BooleanType)
    numerical = numeric and (row["d"] > 10 or (row["n"] > 0 and row["d"] / row["n"] > 0.05))
    return "regression" if numerical and row["d"] > 15 else "classification"


def problem_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """ML1 for several candidate targets in one aggregation."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_distinct(c).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        dt = df.schema[c].dataType
        d, n = row[c], row["__n"]
        numeric = C.is_numeric(dt) or isinstance(dt, T.BooleanType)
        numerical = numeric and (d > 10 or (n > 0 and d / n > 0.05))
        sem = "numerical" if numerical else ("categorical/ordinal" if numeric else "categorical")
        out.append((c, sem, int(d), "regression" if numerical and d > 15 else "classification"))
    return df.sparkSession.createDataFrame(out, "column string, semantic_type string, distinct_count bigint, "
                                                "problem_type string")


def select_models(problem: str, selected: list[str] | None) -> list[str]:
    """ML5: user subset (case-insensitive; linear ↔ logistic alias); no match → all."""
    pool = CLASSIFIERS if problem == "classification" else REGRESSORS
    if not selected:
        return list(pool)
    want = {m.lower().strip() for m in selected}
    if problem == "classification" and "linear regression" in want:
        want.add("logistic regression")
    if problem == "regression" and "logistic regression" in want:
        want.add("linear regression")
    chosen = [m for m in pool if m.lower() in want]
    return chosen or list(pool)


def split_column(df: DataFrame, key: str | None = None, seed: int = 42, folds: int = 5) -> DataFrame:
    """ML2: stable 80/20 split by a hash of the key (or of the whole row), and folds for cross-validation."""
    cols = [key] if key else df.columns
    h = F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(seed)), F.lit(100))
    return df.withColumn("_is_train", h < 80).withColumn("_fold", F.pmod(F.xxhash64(*[F.col(c) for c in cols],
                                                                                  F.lit(seed + 1)), F.lit(folds)).cast("int"))


@dataclass
class TrainResult:
    problem: str
    target: str
    leaderboard: DataFrame
    model: PipelineModel
    best_name: str
    best_metrics: dict
    importance: DataFrame
    feature_names: list[str]
    labels: list[str] = field(default_factory=list)
    raw_columns: list[str] = field(default_factory=list)
    roc: DataFrame | None = None


def score_counts(scored: DataFrame) -> DataFrame:
    """(value, positives, negatives) per different score of (label, share) rows, as ``roc_curve`` takes them."""
    return scored.groupBy((-F.col("share")).alias("value")).agg(  # descending scores: negated, they ascend
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def roc_curve(counts: DataFrame, buckets: int = 32) -> DataFrame:
    """ML6: model_name, threshold, fpr, tpr of every different score, from (0, 0) at an infinite threshold.

    ``counts``: model_name and ``score_counts``. Ties are one point; a point
    that lies on the straight line between its neighbours in its range of scores is left
    out (the curve stays the same). Models whose rows have one class only get no points.
    """
    at = running_totals(counts, ["model_name"], ["positives", "negatives"], buckets, keep_range=True)
    near = Window.partitionBy("model_name", "_range").orderBy("value")
    after = [F.lead(c).over(near) for c in ("positives", "negatives")]
    straight = F.col("positives") * after[1] == F.col("negatives") * after[0]
    points = at.where("positives_all > 0 AND negatives_all > 0").withColumn("_in", F.coalesce(straight, F.lit(False)))
    start = points.select("model_name").distinct().select(
        "model_name", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points.where(~F.col("_in")).select(
        "model_name", (-F.col("value")).alias("threshold"),
        (F.col("negatives_upto") / F.col("negatives_all")).alias("fpr"),
        (F.col("positives_upto") / F.col("positives_all")).alias("tpr")))


def _metrics(pred: DataFrame, problem: str, n_classes: int) -> dict:
    if problem == "classification":
        ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
        m = {k: round(ev.setMetricName(name).evaluate(pred), 4) for k, name in
             (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"),
              ("f1_score", "f1"))}
        cm = pred.groupBy("label", "prediction").count().collect()
        k = n_classes
        matrix = [[0] * k for _ in range(k)]
        for r in cm:
            if int(r["label"]) < k and int(r["prediction"]) < k:
                matrix[int(r["label"])][int(r["prediction"])] = int(r["count"])
        m["confusion_matrix"] = ";".join(",".join(str(v) for v in row) for row in matrix)
        if n_classes == 2 and "probability" in pred.columns:
            m["roc_auc"] = round(BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability",
                                                               metricName="areaUnderROC").evaluate(pred), 4)
            m["scores"] = cut_lineage(score_counts(
                pred.select("label", vector_to_array("probability")[1].alias("share"))))
        m["score"] = m["accuracy"]
    else:
        ev = RegressionEvaluator(labelCol="label", predictionCol="prediction")
        m = {"r2_score": round(ev.setMetricName("r2").evaluate(pred), 4),
             "mse": round(ev.setMetricName("mse").evaluate(pred), 4),
             "mae": round(ev.setMetricName("mae").evaluate(pred), 4)}
        m["score"] = m["r2_score"]
    return m


def _from_counts(counts: dict, n_classes: int) -> dict:
    """Class metrics from {(label, prediction): rows}."""
    total = sum(counts.values())
    matrix = [[counts.get((a, b), 0) for b in range(n_classes)] for a in range(n_classes)]
    real, said = [sum(r) for r in matrix], [sum(r[j] for r in matrix) for j in range(n_classes)]
    right = [matrix[j][j] for j in range(n_classes)]
    precision = [right[j] / said[j] if said[j] else 0.0 for j in range(n_classes)]
    recall = [right[j] / real[j] if real[j] else 0.0 for j in range(n_classes)]
    f1 = [2 * p * r / (p + r) if p + r else 0.0 for p, r in zip(precision, recall)]

    def weighted(x):
        return sum(n * v for n, v in zip(real, x)) / total
    return {"accuracy": sum(right) / total, "precision": weighted(precision), "recall": weighted(recall),
            "f1_score": weighted(f1), "confusion_matrix": ";".join(",".join(map(str, r)) for r in matrix)}


def _judged(predictions: DataFrame, problem: str, n_classes: int) -> dict:
    """{(fit, setting): metrics} of all fits in one pass over (fit, setting, label, prediction)."""
    out: dict = {}
    if problem == "classification":
        for r in predictions.groupBy("fit", "setting", "label", "prediction").count().collect():
            out.setdefault((r["fit"], r["setting"]), {})[int(r["label"]), int(r["prediction"])] = r["count"]
        return {k: (lambda m: {**m, "score": m["accuracy"]})(_from_counts(c, n_classes)) for k, c in out.items()}
    e = F.col("label") - F.col("prediction")
    for r in predictions.groupBy("fit", "setting").agg(
            F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("label").alias("v")).collect():
        r2 = 1 - r["mse"] / r["v"] if r["v"] else 0.0
        out[r["fit"], r["setting"]] = {"r2_score": r2, "mse": r["mse"], "mae": r["mae"], "score": r2}
    return out


def _rounded(m: dict) -> dict:
    return {k: round(float(v), 4) if isinstance(v, float) else v for k, v in m.items()}


class FittedTrees:
    """Feature steps and a tree model, with the parts of a pipeline model that scoring uses."""

    def __init__(self, stages: list, model, labels: list[str]):
        self.stages, self.model, self.labels = stages, model, labels

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(PipelineModel(stages=self.stages).transform(df))
        if not self.labels:
            return out
        names = F.array(*map(F.lit, self.labels))
        return out.withColumn("predicted_label", F.element_at(names, F.col("prediction").cast("int") + 1))


class TreeFits:
    """The models of one training run that are grown inside tasks, over one binned table."""

    def __init__(self, prepared: DataFrame, problem: str, n_features: int, n_classes: int, seed: int, cv_folds: int,
                 budget: Budget):
        self.n_classes = n_classes if problem == "classification" else 0
        self.problem, self.n_features, self.seed, self.budget = problem, n_features, seed, budget
        self.folds = range(cv_folds)
        train = prepared.where("_is_train").select(vector_to_array("features").alias("features"))
        self.cuts = trees.quantile_cuts(train, n_features)
        self.rows = trees.binned(prepared, self.cuts)
        self.spark = prepared.sparkSession
        self.fits: list[trees.Fit] = []

    def _depth(self, depth: int | None) -> int:
        return trees.NO_LIMIT if depth is None else depth

    def _fit(self, name: str, by: str = "", value: int = 0) -> trees.Fit:
        forest = name == "Random Forest"
        # As many features per node as the reference's forests: the root of their number for classes, all for numbers.
        k = max(1, int(self.n_features ** 0.5)) if forest and self.n_classes else self.n_features
        return trees.Fit(name, by, value, self.budget.trees if forest else 1, forest, k)

    def _metrics(self, predictions: DataFrame, first: int = 0) -> dict:
        """Holdout metrics of fit ``first`` and the mean score of the following folds."""
        found = _judged(predictions, self.problem, self.n_classes)
        out = dict(found[first, 0])
        folds = [found[first + 1 + i, 0]["score"] for i in self.folds if (first + 1 + i, 0) in found]
        out["cv_score"] = sum(folds) / len(folds) if folds else None
        if self.n_classes == 2:
            held = predictions.where((F.col("fit") == first) & (F.col("setting") == 0))
            held = held.select("label", F.col("shares")[1].alias("share"))
            out["roc_auc"] = BinaryClassificationEvaluator(rawPredictionCol="share").evaluate(held)
            return {**_rounded(out), "scores": cut_lineage(score_counts(held))}
        return _rounded(out)

    def forest(self, name: str):
        """(metrics, model) of a forest or a single tree, holdout and folds in one job."""
        fits = [self._fit(name), *(self._fit(name, "fold", i) for i in self.folds)]
        depth = self._depth(self.budget.tree_depth)
        made, kept, tops = trees.forests(self.rows, fits, self.n_features, self.n_classes, self.seed, (depth,), keep=0)
        said = trees.judgements(made, fits, (fits[0].n_trees,), 1, self.n_classes)
        return self._metrics(said), self._model(kept, tops, fits[0].n_trees, depth)

    def _model(self, kept: DataFrame, tops, n_trees: int, depth: int) -> trees.ForestModel:
        import numpy as np
        # One row of as many sums as features for each tree.
        own = kept.where(F.col("tree") < n_trees).select("gains").collect()
        gains = sum((np.frombuffer(bytes(r["gains"])) for r in own), np.zeros(self.n_features))
        for t in range(n_trees):
            for node in tops.nodes[(0, t)]:
                if node["feature"] >= 0:
                    gains[node["feature"]] += node["gain"]
        return trees.ForestModel(self.spark, kept.inputFiles()[0].rsplit("/", 1)[0], tops, self.cuts, self.n_classes,
                                 n_trees, depth, gains)

    def tuned(self, model: trees.ForestModel):
        """(holdout metrics, model) of the best grid setting; one fit for each of three folds judges all settings.

        The chosen forest is the fitted one, cut to the setting's depth and trees.
        """
        fits = [self._fit("Random Forest", "grid_fold", i) for i in range(3)]
        depths = tuple(map(self._depth, self.budget.grid_depths))
        prefixes = self.budget.grid_trees
        made, _, _ = trees.forests(self.rows, fits, self.n_features, self.n_classes, self.seed, depths)
        found = _judged(trees.judgements(made, fits, prefixes, len(depths), self.n_classes), self.problem, self.n_classes)
        means = {s: sum(found[i, s]["score"] for i in range(3)) / 3 for s in range(len(depths) * len(prefixes))}
        best = max(means, key=lambda s: (means[s], -s))
        depth, upto = depths[best // len(prefixes)], min(prefixes[best % len(prefixes)], self.budget.trees)
        chosen = trees.ForestModel(self.spark, model.path, model.tops, self.cuts, self.n_classes, upto, depth, model.gains)
        return chosen, {"max_depth": None if depth == trees.NO_LIMIT else depth, "n_estimators": upto}

    def net(self, prepared: DataFrame):
        fits = [self._fit("Neural Network"), *(self._fit("Neural Network", "fold", i) for i in self.folds)]
        said, model = nets.nets(prepared, fits, self.n_features, self.n_classes, self.budget.net_iterations, self.seed)
        return self._metrics(said), model

    def boosting(self):
        fits = [self._fit("Gradient Boosting"), *(self._fit("Gradient Boosting", "fold", i) for i in self.folds)]
        said, stored = trees.boosted(self.rows, fits, self.n_features, self.n_classes, self.budget.boosting_rounds,
                                     self.budget.boosting_depth)
        import numpy as np
        rows = stored.orderBy("setting").collect()          # the trees: as many as rounds times classes
        model = trees.BoostedModel(self.spark, [trees.Tree.unpack(bytes(r["data"])) for r in rows],
                                   np.array(rows[0]["shares"]), self.cuts, self.n_classes,
                                   np.frombuffer(bytes(rows[0]["gains"])).copy())
        return self._metrics(said), model


def _importance(model, names: list[str]) -> list[tuple[str, float]]:
    if hasattr(model, "gains"):
        total = model.gains.sum()
        vals = model.gains / total if total else model.gains
    elif hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        vals = abs(model.coefficientMatrix.toArray()[0])
    elif hasattr(model, "coefficients"):
        vals = abs(model.coefficients.toArray())
    else:
        return []
    return [(n, round(float(v), 4)) for n, v in zip(names, vals)]


def _cross_validated(est, train_part: DataFrame, evaluator, folds: int) -> float:
    """Mean score of one fit per value of _fold, judged on the rows left out; the folds are filters of the one cached table."""
    rows = {r["_fold"]: r["count"] for r in train_part.groupBy("_fold").count().collect()}
    total, scores = sum(rows.values()), []
    for i in range(folds):
        for what, n in (("training", total - rows.get(i, 0)), ("validation", rows.get(i, 0))):
            if not n:
                raise ValueError(f"The {what} data at fold {i} is empty.")
        model = est.fit(train_part.where(F.col("_fold") != i))
        scores.append(evaluator.evaluate(model.transform(train_part.where(F.col("_fold") == i))))
    return float(sum(scores) / folds)


LEADERBOARD_SCHEMA = ("rank int, model_name string, score double, accuracy double, precision double, recall double, "
                      "f1_score double, roc_auc double, r2_score double, mse double, mae double, cv_score double, "
                      "confusion_matrix string, status string, tuned boolean, error string")


def train(df: DataFrame, target: str, problem: str | None = None, models: list[str] | None = None,
          cv_folds: int = 5, tune: bool = True, seed: int = 42, key: str | None = None,
          budget: Budget = Budget()) -> TrainResult:
    """ML2–ML11: split, fit every candidate, score on the holdout, CV, tune the winner.

    The fits have the reference's budgets unless the caller gives a smaller ``budget``.
    """
    spark = df.sparkSession
    problem = problem or problem_type(df, target)
    data = df.where(F.col(target).isNotNull())
    raw_cols = [c for c in data.columns if c != target]
    feats_pipe, names = feature_pipeline(data.select(*raw_cols), target=None)
    labels: list[str] = []
    stages = list(feats_pipe.getStages())
    if problem == "classification":
        stages.append(StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc"))
    split = split_column(data, key, seed, cv_folds)
    train_part = split.where("_is_train")
    if problem == "classification":
        # The label list is that of all rows: a class that only the holdout has is scored (wrong), not thrown.
        stages[-1] = stages[-1].fit(split)
    prep = Pipeline(stages=stages).fit(train_part)
    if problem == "classification":
        labels = list(prep.stages[-1].labels)
    n_classes = max(len(labels), 2)
    prepared = prep.transform(split)
    if problem == "regression":
        prepared = prepared.withColumn("label", F.col(target).cast("double"))
    prepared = cut_lineage(prepared.select("features", "label", "_is_train", "_fold"))
    tr, te = prepared.where("_is_train"), prepared.where(~F.col("_is_train"))
    evaluator = (MulticlassClassificationEvaluator(metricName="accuracy") if problem == "classification"
                 else RegressionEvaluator(metricName="r2"))
    tr, te = tr.cache(), te.cache()
    names_to_fit = select_models(problem, models)
    small = tr.count() <= trees.LIMIT
    grown = [n for n in names_to_fit if n in ("Random Forest", "Decision Tree", "Gradient Boosting")
             or small and n == "Neural Network"]
    fits = TreeFits(prepared, problem, len(names), n_classes, seed, cv_folds, budget) if grown else None

    def run(name):
        try:
            if name in grown:
                m, model = (fits.boosting() if name == "Gradient Boosting" else fits.net(prepared)
                            if name == "Neural Network" else fits.forest(name))
                return name, m, "ok", model
            est = _estimator(name, problem, len(names), n_classes, seed, budget)
            model = est.fit(tr)
            m = _metrics(model.transform(te), problem, n_classes)
            m["cv_score"] = round(_cross_validated(est, tr, evaluator, cv_folds), 4)
            return name, m, "ok", model
        except Exception as ex:  # noqa: BLE001 - a candidate that fails is skipped
            return name, {"score": None, "error": str(ex)[:200]}, "failed", None

    try:
        # Candidates are independent Spark jobs; submitting them from threads lets
        # the scheduler run them side by side instead of one after another.
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=len(names_to_fit)) as pool:
            results = list(pool.map(run, names_to_fit))
        board = [(n, m, st) for n, m, st, _ in results]
        fitted = {n: f for n, _, st, f in results if st == "ok"}
        ok = [(n, m) for n, m, s in board if s == "ok" and m["score"] is not None and m["score"] > -1.0]
        if not ok:
            raise RuntimeError("no candidate model could be trained")
        best_name, best_metrics = max(ok, key=lambda t: t[1]["score"])
        best_metrics = {k: v for k, v in best_metrics.items() if k != "scores"}
        best_model = fitted[best_name]
        tuned = False
        if tune and best_name == "Random Forest":
            best_model, setting = fits.tuned(best_model)
            found = _metrics(best_model.transform(te), problem, n_classes)
            found.pop("scores", None)
            best_metrics = {**best_metrics, **found, **setting}
            tuned = True
    finally:
        tr.unpersist()
        te.unpersist()
    rows = []
    ranked = sorted(board, key=lambda t: (t[1]["score"] is None, -(t[1]["score"] or 0.0)))
    for i, (name, m, status) in enumerate(ranked):
        rows.append((i + 1, name, m.get("score"), m.get("accuracy"), m.get("precision"), m.get("recall"),
                     m.get("f1_score"), m.get("roc_auc"), m.get("r2_score"), m.get("mse"), m.get("mae"),
                     m.get("cv_score"), m.get("confusion_matrix"), status, tuned and name == best_name, m.get("error")))
    leaderboard = spark.createDataFrame(rows, LEADERBOARD_SCHEMA)
    scores = [m["scores"].withColumn("model_name", F.lit(n)) for n, m, _ in board if "scores" in m]
    roc = roc_curve(reduce(DataFrame.unionByName, scores)) if scores else None
    feature_model = PipelineModel(stages=[s for s in prep.stages if not (
        problem == "classification" and s is prep.stages[-1])])
    if best_name in grown:
        final = FittedTrees(list(feature_model.stages), best_model, labels)
    else:
        final = PipelineModel(stages=[*feature_model.stages, best_model, *(
            [IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels)] if labels else [])])
    importance = spark.createDataFrame(_importance(best_model, names), "feature string, importance double")
    return TrainResult(problem, target, leaderboard, final, best_name, best_metrics,
                       importance, names, labels, raw_cols, roc)


# ---------------------------------------------------------------- ML12 / SRC7 / SRC8
def score(result: TrainResult, df: DataFrame) -> DataFrame:
    """Input rows plus ``predicted_<target>`` (decoded label for classification)."""
    missing = [c for c in result.raw_columns if c not in df.columns]
    if missing:
        raise KeyError(f"scoring data lacks feature columns {missing}")
    out = result.model.transform(df)
    pred = F.col("predicted_label") if result.problem == "classification" else F.col("prediction")
    return out.select(*df.columns, pred.alias(f"predicted_{result.target}"))


def save_model(result: TrainResult, path: str) -> None:
    """The model package: steps and model, with target, problem type, feature order and labels."""
    spark = result.leaderboard.sparkSession
    own = isinstance(result.model, FittedTrees)
    steps = PipelineModel(stages=result.model.stages) if own else result.model
    steps.write().overwrite().save(f"{path}/steps")
    if own:
        (nets if isinstance(result.model.model, nets.NetModel) else trees).save(result.model.model, f"{path}/model")
    about = [(result.problem, result.target, result.best_name, result.feature_names, result.raw_columns, result.labels, own)]
    spark.createDataFrame(about, "problem string, target string, model_name string, features array<string>, "
                                 "columns array<string>, labels array<string>, own boolean").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/about")


def load_model(path: str, spark=None):
    """The saved model with ``transform`` and, as ``about``, the row saved beside it."""
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    about = spark.read.parquet(f"{path}/about").first()
    model = PipelineModel.load(f"{path}/steps")
    if about["own"]:
        kind = nets if about["model_name"] == "Neural Network" else trees
        model = FittedTrees(model.stages, kind.load(spark, f"{path}/model"), list(about["labels"]))
    model.about = about
    return model


# ---------------------------------------------------------------- ML13
def contributions(result: TrainResult, df: DataFrame, key: str) -> DataFrame:
    """Importance × (assembled, unscaled) feature value per row, long form."""
    imp = {r["feature"]: r["importance"] for r in result.importance.collect()}
    stages = result.model.stages
    upto = next(i for i, s in enumerate(stages) if s.__class__.__name__ == "VectorAssemblerModel"
                or s.__class__.__name__ == "VectorAssembler")
    assembled = PipelineModel(stages=stages[: upto + 1]).transform(df)
    raw_col = stages[upto].getOutputCol()
    arr = vector_to_array(F.col(raw_col))
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), (arr[i] * F.lit(imp.get(n, 0.0))).alias("contribution"))
                      for i, n in enumerate(result.feature_names)])
    return assembled.select(key, F.explode(pairs).alias("p")).select(key, "p.feature", F.round("p.contribution", 4)
                                                                      .alias("contribution"))


# ---------------------------------------------------------------- ML14
def what_if(result: TrainResult, df: DataFrame, changes: dict) -> DataFrame:
    """Baseline vs. overlaid predictions in one pass (each row twice, tagged by scenario)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    both = df.withColumn("_scenario", F.explode(F.array(F.lit(0), F.lit(1))))
    for c, v in changes.items():
        if c in types:
            both = both.withColumn(c, F.when(F.col("_scenario") == 1, C.constant_as(v, types[c])).otherwise(F.col(c)))
    scored = result.model.transform(both)
    if result.problem == "regression":
        g = scored.groupBy("_scenario").agg(F.avg("prediction").alias("avg"), F.stddev_pop("prediction").alias("sd"),
                                            F.count(F.lit(1)).alias("n")).collect()
        by = {r["_scenario"]: r for r in g}
        base, sim = by[0]["avg"], by[1]["avg"]
        diff = sim - base
        pct = diff / base * 100 if base else 0.0
        se = (by[1]["sd"] or 0.0) / (by[1]["n"] ** 0.5)
        row = (round(base, 2), round(sim, 2), round(diff, 2), round(pct, 2), round(max(0.0, sim - 1.96 * se), 2),
               round(sim + 1.96 * se, 2))
        return df.sparkSession.createDataFrame(
            [row], "base_avg double, simulated_avg double, difference double, percentage_change double, "
                   "lower_bound double, upper_bound double")
    dist = scored.groupBy("_scenario", F.col("predicted_label").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("_scenario"))
    return dist.select(F.when(F.col("_scenario") == 0, "baseline").otherwise("simulated").alias("scenario"), "class",
                       "count", F.round(F.col("count") / total * 100, 2).alias("percentage"))


# ---------------------------------------------------------------- ML15
def explain(result: TrainResult, df: DataFrame, key: str, stats: dict | None = None) -> DataFrame:
    """Local perturbation per row: each feature moved by +1 std (numeric) or to the next
    label (categorical), one model pass over rows × (features + 1); the prediction
    change per feature as a signed share of the total absolute change (%)."""
    raw = result.raw_columns
    types = {f.name: f.dataType for f in df.schema.fields}
    nums = [c for c in raw if C.is_numeric(types[c])]
    cats = [c for c in raw if isinstance(types[c], T.StringType)]
    if stats is None:
        row = df.agg(*[F.stddev_samp(c).alias(c) for c in nums]).first() if nums else {}
        stats = {c: row[c] for c in nums}
    labels = {}
    for st in result.model.stages:
        if st.__class__.__name__ == "StringIndexerModel" and st.isDefined(st.inputCols):
            for c, labs in zip(st.getInputCols(), st.labelsArray):
                labels[c] = labs
    perturbable = nums + [c for c in cats if c in labels]
    variants = F.explode(F.sequence(F.lit(0), F.lit(len(perturbable)))).alias("_v")
    wide = df.select(key, *raw, variants)
    for i, c in enumerate(perturbable, start=1):
        if c in nums:
            sd = stats.get(c) or 1.0
            new = F.col(c) + F.lit(float(sd))
        else:
            labs = F.array(*[F.lit(x) for x in labels[c]])
            pos = F.array_position(labs, F.col(c))
            k = len(labels[c])
            new = F.when(pos > 0, F.element_at(labs, (F.pmod(pos, F.lit(k)) + 1).cast("int"))).otherwise(F.col(c)) \
                if k > 1 else F.col(c)
        wide = wide.withColumn(c, F.when(F.col("_v") == i, new).otherwise(F.col(c)))
    scored = result.model.transform(wide)
    if result.problem == "classification":
        prob = vector_to_array("probability")
        base_w = Window.partitionBy(key)
        base_cls = F.max(F.when(F.col("_v") == 0, F.col("prediction"))).over(base_w)
        scored = scored.withColumn("_bc", base_cls.cast("int"))
        val = F.element_at(prob, F.col("_bc") + 1)
    else:
        val = F.col("prediction")
    v = scored.select(key, "_v", val.alias("_p"))
    w = Window.partitionBy(key)
    base = F.max(F.when(F.col("_v") == 0, F.col("_p"))).over(w)
    deltas = v.withColumn("_base", base).where(F.col("_v") > 0).withColumn("delta", F.col("_base") - F.col("_p"))
    total = F.sum(F.abs("delta")).over(w)
    names = F.element_at(F.array(*[F.lit(c) for c in perturbable]), F.col("_v"))
    return deltas.select(key, names.alias("feature"), F.round("_base", 6).alias("prediction_value"),
                         F.round(F.when(total > 0, F.col("delta") / total * 100).otherwise(F.lit(0.0)), 2)
                         .alias("impact"))


def drivers(explained: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Top-k positive and negative drivers per row from ``explain`` output."""
    w_pos = Window.partitionBy(key).orderBy(F.desc("impact"), "feature")
    w_neg = Window.partitionBy(key).orderBy(F.asc("impact"), "feature")
    pos = explained.where("impact >= 0").withColumn("rank", F.row_number().over(w_pos)).where(F.col("rank") <= k) \
        .withColumn("direction", F.lit("positive"))
    neg = explained.where("impact < 0").withColumn("rank", F.row_number().over(w_neg)).where(F.col("rank") <= k) \
        .withColumn("direction", F.lit("negative")).withColumn("impact", F.abs("impact"))
    return pos.unionByName(neg)


# ---------------------------------------------------------------- ML19
# The advisor's summary and entries per problem type (model, display name, badge, recommended flag,
# advice, impact, when it is best).
ADVICE_SUMMARY = {
    "classification": (
        "Predicting Category Column ('{target}'): You are predicting discrete groups or outcomes ({classes} distinct "
        "classes found). Tree Ensembles (XGBoost, Random Forest) are recommended because they discover hidden decision "
        "rules between customer attributes without requiring complex data transformations."),
    "regression": (
        "Predicting Numerical Metric ('{target}'): You are forecasting continuous numeric numbers (e.g. Sales, Revenue, "
        "Prices). Random Forest & XGBoost Regressors are recommended because they average predictions smoothly without "
        "being thrown off by unusual data spikes or outliers."),
}
ADVICE = {
    "classification": [
        ("XGBoost", "XGBoost (Gradient Boosted Decision Trees)", "🏆 Best Overall Accuracy", True,
         "Top recommendation for predicting business categories. It builds successive smart decision trees to achieve "
         "maximum predictive accuracy.",
         "Reduces false prediction errors by up to 25% on complex dataset patterns.",
         "When accuracy is your #1 priority."),
        ("Random Forest", "Random Forest (Ensemble Averaging)", "🛡️ Most Reliable & Explainable", True,
         "Combines hundreds of independent decision trees to produce reliable, trustworthy predictions resistant to "
         "data errors.",
         "Extremely stable; provides clear reports on which features drive outcomes most.",
         "When you need clean explanations for business stakeholders."),
        ("LightGBM", "LightGBM (High-Speed Gradient Booster)", "🚀 Ultra Fast Training", False,
         "Optimized high-speed boosting algorithm built for very large business datasets.",
         "Trains in seconds even on large datasets with hundreds of thousands of records.",
         "When processing massive datasets quickly."),
        ("Neural Network", "Neural Network (Multi-Layer Perceptron)", "🧠 Deep Pattern Matcher", False,
         "Deep artificial neural network that learns multi-layered complex interactions.",
         "Captures intricate non-linear relationships across many columns.",
         "When you have large datasets with complex relationships."),
    ],
    "regression": [
        ("Random Forest", "Random Forest Regressor", "🎯 Top Recommendation for Numbers", True,
         "Averages predictions across multiple decision trees to produce smooth, realistic numeric estimates.",
         "Handles outliers gracefully without over-reacting to temporary price spikes.",
         "When estimating financial amounts or sales numbers."),
        ("XGBoost", "XGBoost Regressor", "🏆 Precision Numerical Forecasting", True,
         "State-of-the-art numerical prediction engine that fine-tunes error margins iteratively.",
         "Delivers tight confidence bounds and high predictive precision.",
         "When minimizing dollar-value prediction errors."),
        ("Linear Regression", "Linear Regression Baseline", "⚡ Simple Linear Trend", False,
         "Simple straight-line mathematical baseline.",
         "Extremely fast baseline comparison.",
         "When target varies strictly proportionally with inputs."),
        ("LightGBM", "LightGBM Regressor", "🚀 High Speed Regressor", False,
         "High-performance leaf-wise regression booster.",
         "Accelerates model training on large numerical datasets.",
         "When speed is paramount."),
    ],
}
# End of the fixed values.


def _stars(k: int) -> str:
    return "★" * k + "☆" * (5 - k)


def advise(df: DataFrame, target: str, problem: str | None = None) -> DataFrame:
    """ML19: per candidate model its rating by row count, badge, advice, impact and use; a summary of the task (one count pass)."""
    problem = problem or problem_type(df, target)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(target).alias("k")).first()
    n, k = agg["n"], agg["k"]
    rows = []
    about = ADVICE_SUMMARY[problem].format(target=target, classes=k)
    for model, display, badge, rec, advice, impact, when in ADVICE[problem]:
        if problem == "classification":
            stars = {"XGBoost": 5, "Random Forest": 5 if n < 10000 else 4, "LightGBM": 5 if n > 2000 else 3,
                     "Neural Network": 4 if n > 5000 else 2}[model]
        else:
            stars = {"Random Forest": 5, "XGBoost": 5, "Linear Regression": 3, "LightGBM": 4}[model]
        rows.append((problem, target, int(n), int(k), model, display, badge, rec, _stars(stars), advice, impact, when,
                     about))
    return df.sparkSession.createDataFrame(
        rows, "problem_type string, target string, row_count bigint, distinct_target bigint, model_name string, "
              "display_name string, badge string, recommended_for_user boolean, suitability string, "
              "plain_english_advice string, business_impact string, best_when string, business_summary string")
