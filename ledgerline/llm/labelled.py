"""Labelled training rows shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import fold


def training_rows(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, limit: int) -> DataFrame:
    """(label, other columns of docs) of at most ``limit`` labelled rows outside the held-out fold.

    The sample is the labelled ids with the smallest hashes, so it does not
    depend on partitioning; being bounded, it is broadcast. An id with several
    rows is learned from once, by the row whose text has the smallest hash (of
    equal texts any). Null labels and ids, and ids with contradicting labels,
    are left out.
    """
    known = (labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min(target).alias("label"), F.max(target).alias("other"))
             .where("label = other").drop("other").where(fold(F.col("doc_id"), folds) != held))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.join(F.broadcast(sample.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id"))
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns))
    return found.groupBy("label_id", "label").agg(one.alias("row")).select("label", "row.*")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (bias last) of a small dense logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
