"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise
part is computed in linear time as half of sum_f ((sum v_if x_i)^2 - sum
v_if^2 x_i^2). Features: lower-cased words hashed to ``BUCKETS`` (log counts,
unit length), statistics of the whole text, and its recorded length. It is
fitted with AdaGrad on at most ``FIT_ROWS`` labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import words as W
from ledgerline.llm.common import bound_batches, fold
from ledgerline.llm.labelled import training_rows

FIT_ROWS, BUCKETS, RANK, EPOCHS = 10_000, 1 << 13, 8, 8
_STATS = 16


def _kind(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


_KINDS = [_kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789"), _kind(".,;:"), _kind("!?"), _kind("\n"),
          _kind("|"), _kind("#$%&*+<=>@^_~\\/{}[]"), np.arange(256) >= 128]


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of the hashed words and the n x _STATS statistics."""
    n = len(texts)
    words = W.split(texts, W.SPACE, W.ASCII_LOWER)
    raw, off = W.string_bytes(texts)
    doc = words.doc_of_word()
    count = np.diff(words.first).astype(float)
    size = np.maximum(np.diff(off), 1).astype(float)
    stats = np.zeros((n, _STATS))
    stats[:, 0] = np.log1p(count)
    stats[:, 1] = np.log1p(size)
    length = (words.end - words.start).astype(float)
    stats[:, 2] = np.bincount(doc, weights=length, minlength=n) / np.maximum(count, 1)
    edges = np.minimum(off, len(raw))
    for j, kind in enumerate(_KINDS):
        seen = np.concatenate([[0], np.cumsum(kind[raw])])
        stats[:, 3 + j] = (seen[edges[1:]] - seen[edges[:-1]]) / size
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (words.hash >> np.uint64(24)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(key)))
    owner = (key[begin] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    stats[:, 11] = distinct / np.maximum(count, 1)
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    stats[:, 12] = most / np.maximum(count, 1)
    same = np.zeros(len(doc))
    if len(doc) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    stats[:, 13] = np.bincount(doc, weights=same, minlength=n) / np.maximum(count, 1)
    long_words = np.bincount(doc, weights=length > 20, minlength=n)
    stats[:, 14] = long_words / np.maximum(count, 1)
    stats[:, 15] = np.log1p(np.maximum(n_chars, 0))
    bucket = (key[begin] % np.uint64(BUCKETS)).astype(np.int64)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(owner, weights=value ** 2, minlength=n))
    return owner, bucket, value / np.maximum(norm, 1e-12)[owner], stats


class Machine:
    """Factorisation machine; statistics are standardised and follow the buckets as further features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w0 = 0.0
        self.w = np.zeros(BUCKETS + _STATS)
        self.v = rng.normal(0, 0.02, (BUCKETS + _STATS, RANK))

    def rows(self, owner, bucket, value, stats):
        """One sparse matrix (document, feature, value) sorted by document."""
        n = len(stats)
        z = np.clip((stats - self.mean) / self.spread, -5, 5)
        doc = np.concatenate([owner, np.repeat(np.arange(n), _STATS)])
        feature = np.concatenate([bucket, np.tile(np.arange(_STATS) + BUCKETS, n)])
        x = np.concatenate([value, z.ravel()])
        return doc, feature, x

    def margin(self, doc, feature, x, n):
        linear = np.bincount(doc, weights=self.w[feature] * x, minlength=n)
        pair, sums = np.zeros(n), np.zeros((n, RANK))
        for f in range(RANK):
            t = self.v[feature, f] * x
            sums[:, f] = np.bincount(doc, weights=t, minlength=n)
            pair += sums[:, f] ** 2 - np.bincount(doc, weights=t * t, minlength=n)
        return self.w0 + linear + 0.5 * pair, sums

    def fit(self, doc, feature, x, y, epochs: int = EPOCHS, rate: float = 0.1, ridge: float = 1e-4, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = len(y)
        by = np.argsort(doc, kind="stable")
        doc, feature, x = doc[by], feature[by], x[by]
        first = np.searchsorted(doc, np.arange(n + 1))
        gw0, gw, gv = 1e-6, np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, 128):
                rows = order[at:at + 128]
                size = first[rows + 1] - first[rows]
                pick = np.repeat(first[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                d, j, v = np.repeat(np.arange(len(rows)), size), feature[pick], x[pick]
                z, sums = self.margin(d, j, v, len(rows))
                err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[rows]) / len(rows)
                used, inner = np.unique(j, return_inverse=True)
                g = np.bincount(inner, weights=err[d] * v) + ridge * self.w[used]
                gw[used] += g * g
                self.w[used] -= rate * g / np.sqrt(gw[used])
                e = err[d] * v
                for f in range(RANK):
                    h = np.bincount(inner, weights=e * (sums[d, f] - self.v[j, f] * v)) + ridge * self.v[used, f]
                    gv[used, f] += h * h
                    self.v[used, f] -= 0.3 * rate * h / np.sqrt(gv[used, f])
                g0 = err.sum()
                gw0 += g0 * g0
                self.w0 -= rate * g0 / np.sqrt(gw0)
        return self


def learn(train: DataFrame) -> Machine:
    """Fit on (label, text, n_chars) rows; without both labels the machine answers their smoothed share."""
    def collect(batches):
        for batch in batches:
            chars = batch.column("n_chars").to_numpy(zero_copy_only=False)
            for lo, hi in W.slices(batch.column("text")):
                owner, bucket, value, stats = features(batch.column("text").slice(lo, hi - lo), chars[lo:hi])
                cut = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(lo, hi - lo).cast(pa.int32()),
                     batch.column("doc_id").slice(lo, hi - lo),
                     pa.ListArray.from_arrays(cut, pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(cut, pa.array(value.astype(np.float32))),
                     pa.array(list(stats), pa.list_(pa.float64()))], ["label", "doc_id", "bucket", "value", "stats"])

    # Sparse features of the bounded sample; sorted, so that the fit does not depend on partitioning.
    table = train.select("label", "doc_id", "text", "n_chars").mapInArrow(collect, T.StructType([
        T.StructField("label", T.IntegerType()), train.schema["doc_id"],
        T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType())),
        T.StructField("stats", T.ArrayType(T.DoubleType()))])).toArrow().sort_by("doc_id")
    y = table["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        machine = Machine(np.zeros(_STATS), np.ones(_STATS))
        machine.v[:] = 0
        machine.w0 = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return machine
    stats = np.array(table["stats"].to_pylist())
    machine = Machine(stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6))
    size = pc.list_value_length(table["bucket"]).to_numpy()
    rows = machine.rows(np.repeat(np.arange(len(y)), size),
                        pc.list_flatten(table["bucket"]).to_numpy().astype(np.int64),
                        pc.list_flatten(table["value"]).to_numpy().astype(np.float64), stats)
    return machine.fit(*rows, y)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text, n_chars).

    Defined cases: a null text counts as empty and a null n_chars as 0; a null
    id is in no fold (held_out false, not learned from); repeated rows are
    answered one by one; without labels of both kinds every score is the
    smoothed share of label 1; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n_chars"))
    model = spark.sparkContext.broadcast(learn(training_rows(docs, labels, "quality", folds, held, FIT_ROWS)))

    def predict(batches):
        m = model.value
        for batch in batches:
            chars = batch.column("n_chars").to_numpy(zero_copy_only=False)
            for lo, hi in W.slices(batch.column("text")):
                rows = m.rows(*features(batch.column("text").slice(lo, hi - lo), chars[lo:hi]))
                z, _ = m.margin(*rows, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))],
                    ["doc_id", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(predict, schema).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"))
