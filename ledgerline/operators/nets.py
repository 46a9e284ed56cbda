"""A multi-layer perceptron for tables whose training rows fit a task; each fit (holdout, folds) is one task.

Two hidden layers with rectifiers, softmax output, mini-batches of 200 with Adam,
an L2 penalty of 1e-4, and an end when the loss has not fallen by ``tolerance``
for ten epochs. Larger tables use Spark's own perceptron (``automl``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.trees import Fit, _with_prediction
from ledgerline.session import scratch_path

HIDDEN = (100, 50)
BATCH, RATE, PENALTY, PATIENCE = 200, 1e-3, 1e-4, 10


def _forward(x: np.ndarray, layers: list) -> list[np.ndarray]:
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0) if i < len(layers) - 1 else z)
    return out


def shares(x: np.ndarray, layers: list) -> np.ndarray:
    z = _forward(x, layers)[-1]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _views(flat: np.ndarray, sizes: list[int]) -> list[list[np.ndarray]]:
    """The layers' weights and biases as parts of one vector."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append([flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]])
        at += a * b + b
    return out


def fit_net(x: np.ndarray, y: np.ndarray, n_classes: int, epochs: int, seed: int, tolerance: float = 1e-4) -> list:
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *HIDDEN, n_classes]
    count = sum(a * b + b for a, b in zip(sizes, sizes[1:]))
    flat, grad, penalty = (np.zeros(count, np.float32) for _ in range(3))
    layers, slopes = _views(flat, sizes), _views(grad, sizes)
    for (w, b), (shrink, _) in zip(layers, _views(penalty, sizes)):
        bound = np.sqrt(6 / sum(w.shape))
        w[:], b[:], shrink[:] = rng.uniform(-bound, bound, w.shape), rng.uniform(-bound, bound, b.shape), PENALTY
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    x, hot = x.astype(np.float32), np.eye(n_classes, dtype=np.float32)[y.astype(int)]
    step, best, waited = 0, np.inf, 0
    for _ in range(epochs):
        order, loss = rng.permutation(len(x)), 0.0
        u, t = x[order], hot[order]
        for at in range(0, len(x), BATCH):
            a, target = _forward(u[at:at + BATCH], layers), t[at:at + BATCH]
            p = np.exp(a[-1] - a[-1].max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            loss -= float(np.log(np.maximum((p * target).sum(axis=1), 1e-30)).sum())
            back = (p - target) / len(target)
            step += 1
            for i in range(len(layers) - 1, -1, -1):
                np.matmul(a[i].T, back, out=slopes[i][0])
                back.sum(axis=0, out=slopes[i][1])
                if i:
                    back = (back @ layers[i][0].T) * (a[i] > 0)
            grad += penalty * flat / len(target)
            first += np.float32(0.1) * (grad - first)
            second += np.float32(0.001) * (grad * grad - second)
            scale = np.float32(RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step))
            flat -= scale * first / (np.sqrt(second) + np.float32(1e-8))
        loss /= len(x)
        waited = 0 if loss < best - tolerance else waited + 1
        best = min(best, loss)
        if waited > PATIENCE:
            break
    return [[w.astype(float), b.astype(float)] for w, b in layers]


class NetModel:
    """Fitted layers as a model; their size is fixed by the number of features and classes."""

    def __init__(self, spark, layers: list, n_classes: int):
        self.spark, self.layers, self.n_classes = spark, layers, n_classes

    def transform(self, df: DataFrame) -> DataFrame:
        held = self.spark.sparkContext.broadcast(self.layers)

        @F.pandas_udf("array<double>")
        def judge(features: pd.Series) -> pd.Series:
            return pd.Series(list(shares(np.array(features.tolist(), dtype=float).reshape(len(features), -1), held.value)))

        return _with_prediction(df.withColumn("shares", judge(vector_to_array("features"))), self.n_classes)


def nets(prepared: DataFrame, fits: list[Fit], n_features: int, n_classes: int, epochs: int, seed: int):
    """((fit, setting, row, label, prediction, shares) of the judged rows, model of the first fit)."""
    spark = prepared.sparkSession
    source = prepared.select(F.monotonically_increasing_id().alias("row"), F.col("label").cast("double").alias("label"),
                             vector_to_array("features").alias("features"), F.col("_is_train").alias("is_train"),
                             F.col("_fold").alias("fold"))

    def send(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "label", "is_train", "fold")}
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            for i, fit in enumerate(fits):
                for flag, mask in zip((False, True), fit.masks(part)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([flag]), pa.array([x[mask].tobytes()], pa.binary()),
                         pa.array([part["label"][mask].tobytes()], pa.binary()),
                         pa.array([part["row"][mask].tobytes()], pa.binary())], ["fit", "judged", "x", "y", "ids"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["fit"].iloc[0])

        def side(flag):
            own = pdf[pdf["judged"] == flag]
            x, y, ids = (np.frombuffer(b"".join(own[c]), k) for c, k in (("x", float), ("y", float), ("ids", np.int64)))
            by = np.argsort(ids)
            return x.reshape(-1, n_features)[by], y[by], ids[by]
        x, y, _ = side(False)
        layers = fit_net(x, y, n_classes, epochs, seed)
        z, label, ids = side(True)
        p = shares(z, layers)
        out = pd.DataFrame({"fit": i, "setting": 0, "row": ids, "label": label, "shares": list(p), "layer": b"",
                            "prediction": p.argmax(axis=1).astype(float)})
        if i == 0:
            flat = [q.astype(float).tobytes() for layer in layers for q in layer]
            out = pd.concat([out, pd.DataFrame({"fit": 0, "setting": np.arange(len(flat)), "row": -1, "label": 0.0,
                                                "shares": [[]] * len(flat), "layer": flat, "prediction": 0.0})])
        return out

    path = scratch_path(spark, "nets")
    (source.mapInArrow(send, "fit int, judged boolean, x binary, y binary, ids binary").groupBy("fit").applyInPandas(
        finish, "fit int, setting int, row long, label double, shares array<double>, layer binary, prediction double")
     .write.parquet(path))
    made = spark.read.parquet(path)
    sizes = [n_features, *HIDDEN, n_classes]
    flat = [np.frombuffer(bytes(r["layer"])) for r in made.where("row < 0").orderBy("setting").collect()]
    layers = [[flat[2 * i].reshape(sizes[i], sizes[i + 1]).copy(), flat[2 * i + 1].copy()] for i in range(len(sizes) - 1)]
    return made.where("row >= 0").drop("layer"), NetModel(spark, layers, n_classes)


def save(model: NetModel, path: str) -> None:
    rows = [(i, w.shape[0], w.ravel().tolist(), b.tolist()) for i, (w, b) in enumerate(model.layers)]
    model.spark.createDataFrame(rows, "layer int, inputs int, weights array<double>, bias array<double>").coalesce(
        1).write.parquet(path)


def load(spark, path: str) -> NetModel:
    rows = spark.read.parquet(path).orderBy("layer").collect()
    layers = [[np.array(r["weights"]).reshape(r["inputs"], -1), np.array(r["bias"])] for r in rows]
    return NetModel(spark, layers, len(layers[-1][1]))
