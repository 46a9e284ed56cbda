"""Decision trees without a depth limit, forests of them, and gradient boosting, over binned features.

Features are cut into at most 256 bins at quantiles of the training rows. A
forest grows in two phases. While a node has more than ``LIMIT`` rows, its split
is found in Spark: tasks sum histograms per (tree, node), one row per node comes
back. Then a node's rows are sent to one task, packed, which grows the whole
rest of its subtree. The rows to be judged (the holdout, or a fold) travel with
them and are predicted where the subtree is grown, so cross-validation keeps no
trees.

Evaluation is nested: every node keeps its own prediction, and a node's random
feature order depends on its path alone, so a tree cut at depth 5 is the tree
that a limit of 5 would have grown, and the first 50 of 100 trees are a forest of
50. All settings of a grid are scored from one fit per fold.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage, drop_folder, scratch_path

LIMIT = 200_000      # rows of a node that one task finishes
BINS = 256
BLOCK = 1 << 16      # judged rows whose predictions one task adds up
NO_LIMIT = 1 << 20   # a depth that no tree reaches
SMALL_TREE = 64      # nodes up to which a tree is followed split by split, over whole columns
PACK = 1 << 11       # rows of one packed block of boosting; Spark copies small values much faster than large ones
GATHER = 8           # blocks whose training rows are counted together
KEEP = 4             # boosting rounds after which the rows' scores are written
JOINT = 4096         # cells of the histogram that features of few bins share
STATE_FILE = 96 << 20        # bytes of boosting state that one task reads


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: well spread numbers from counters."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bootstrap(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1), from a hash of row and tree."""
    u = mix(rows.astype(np.uint64) ^ mix(np.uint64(tree * 1_000_003 + seed))) >> np.uint64(11)
    return np.searchsorted(_POISSON, u.astype(np.float64) / 2.0 ** 53, side="right").astype(np.uint8)


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


@dataclass
class Tree:
    """Nodes in growing order; feature -1 is a leaf. Rows with a bin up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray      # (nodes, outputs): mean of the target, or class shares
    gain: np.ndarray
    weight: np.ndarray

    def predict(self, bins: np.ndarray, depths: tuple[int, ...] = (NO_LIMIT,), start: int = 0) -> np.ndarray:
        """(depths, rows, outputs); the root is at depth ``start``."""
        at = np.zeros(len(bins), dtype=np.int64)
        row = np.arange(len(bins))
        out = np.empty((len(depths), len(bins), self.value.shape[1]))
        depth = start
        open_ = set(range(len(depths)))
        while open_:
            inner = self.feature[at] >= 0
            for k in [k for k in open_ if depths[k] <= depth or not inner.any()]:
                out[k] = self.value[at]
                open_.discard(k)
            f = np.maximum(self.feature[at], 0)
            to = np.where(bins[row, f] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, to, at)
            depth += 1
        return out

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        if len(self.feature) <= SMALL_TREE:
            return self.small_leaves(np.asfortranarray(bins)).astype(np.int64)
        at, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while (self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            to = np.where(bins[row, f] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(self.feature[at] >= 0, to, at)
        return at

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """``leaves`` of bins by column, of the smallest type at hand."""
        return self.small_leaves(bins) if len(self.feature) <= SMALL_TREE else self.leaves(bins)

    def small_leaves(self, bins: np.ndarray) -> np.ndarray:
        """``leaves`` of a tree of up to 256 nodes: each split is one comparison of a whole column, its sides are blended."""
        def below(i):
            if self.feature[i] < 0:
                return np.uint8(i)
            right = np.negative((bins[:, self.feature[i]] > self.cut[i]).view(np.uint8))     # 0 or 255
            a, b = below(self.left[i]), below(self.right[i])
            return a ^ ((a ^ b) & right)
        return below(0) if self.feature[0] >= 0 else np.zeros(len(bins), dtype=np.uint8)

    def pack(self) -> bytes:
        import io
        out = io.BytesIO()
        np.savez_compressed(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Tree:
        import io
        return cls(**np.load(io.BytesIO(raw)))


def statistics(y: np.ndarray, w: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, outputs) weighted targets and the weighted squares; n_classes 0 is regression."""
    if not n_classes:
        return (w * y)[:, None], w * y * y
    one = np.zeros((len(y), n_classes))
    one[np.arange(len(y)), y.astype(np.int64)] = w
    return one, w.astype(np.float64)


def _from_histogram(weight: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score and cut per node; weight (nodes, bins), stats (outputs, nodes, bins)."""
    cw, cs = np.cumsum(weight, axis=1), np.cumsum(stats, axis=2)
    rest = cw[:, -1:] - cw
    ok = (cw > 0) & (rest > 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (cs ** 2).sum(axis=0) / cw + ((cs[:, :, -1:] - cs) ** 2).sum(axis=0) / rest
    score = np.where(ok, score, -np.inf)
    cut = score.argmax(axis=1)
    return score[np.arange(len(cut)), cut], cut


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers as integers, if their sums stay exact as such; others unchanged."""
    if len(x) and np.isfinite(x).all() and np.abs(x).max() * len(x) < 1 << 52 and (x == np.rint(x)).all():
        return x.astype(np.int64)
    return x


def _sums(x: np.ndarray) -> np.ndarray:
    """0, then the running sums."""
    out = np.zeros(len(x) + 1, dtype=x.dtype)
    np.cumsum(x, out=out[1:])
    return out


class _Sorted:
    """The rows of all nodes of a level, by node, bin and row, for each feature.

    Rows are sorted once; from then on a level's orders are the parent level's, split by side.
    """

    def __init__(self, slot, bins, w, stats, nodes: int):
        self.at = np.arange(len(slot))                      # the rows still open, of those sorted
        self.bins = np.ascontiguousarray(bins.T)
        # Whole numbers add up to the same sums as integers, and faster.
        self.w, self.stats = _whole(w), [_whole(np.ascontiguousarray(x)) for x in stats.T]
        self.counts = np.bincount(slot, minlength=nodes)
        place = slot << 40 | self.at
        self.orders = [np.sort(place | b.astype(np.int64) << 32) & 0xFFFFFFFF for b in self.bins]
        self._level()

    def _level(self) -> None:
        self.node = np.repeat(np.arange(len(self.counts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        self.same = self.node[1:] == self.node[:-1]

    def best(self, f: int, total_w, total_s) -> tuple[np.ndarray, np.ndarray]:
        """Best score and cut per node, as ``_from_histogram``."""
        nodes, order = len(self.counts), self.orders[f]
        best, cut = np.full(nodes, -np.inf), np.zeros(nodes, dtype=np.int64)
        b = self.bins[f].take(order)
        at = np.flatnonzero((b[1:] != b[:-1]) & self.same)
        if not len(at):
            return best, cut
        mine = self.node.take(at)
        after, first = at + 1, self.first
        total = _sums(self.w.take(order))
        lw = total.take(after) - total.take(first).take(mine)
        rw = total_w.take(mine) - lw
        left = right = 0.0
        for k, x in enumerate(self.stats):
            total = _sums(x.take(order))
            ls = total.take(after) - total.take(first).take(mine)
            rs = total_s[:, k].take(mine) - ls
            left, right = left + np.square(ls, dtype=float), right + rs * rs
        score = left / lw + right / rw
        begin = np.flatnonzero(mine[1:] != mine[:-1]) + 1
        begin = np.concatenate([[0], begin])
        owner = mine.take(begin)
        size = np.diff(begin, append=len(mine))
        top, many = score.take(begin), np.flatnonzero(size > 1)
        if len(many) == len(begin):
            top = np.maximum.reduceat(score, begin)
        elif len(many):
            ends = np.stack([begin.take(many), begin.take(many) + size.take(many)], axis=1).ravel()
            ends = ends[:-1] if ends[-1] == len(score) else ends
            top[many] = np.maximum.reduceat(score, ends)[::2]
        best[owner] = top
        equal = np.flatnonzero(score == best.take(mine))    # of equal scores the first
        its = mine.take(equal)
        equal = equal.take(np.concatenate([[0], np.flatnonzero(its[1:] != its[:-1]) + 1]))
        cut[owner] = b.take(at.take(equal))
        return best, cut

    def split(self, splits: np.ndarray, keep: np.ndarray, side: np.ndarray, parent: np.ndarray) -> None:
        """Go on to the children of the nodes that split; ``keep``: places of the open rows in such nodes, with side and parent."""
        self.at = self.at.take(keep)
        right = np.zeros(len(self.w), dtype=bool)
        right[self.at] = side
        here = None if len(side) == len(self.node) else np.flatnonzero(splits.take(self.node))
        rows = self.counts[splits]
        below = np.bincount(parent[side], minlength=len(rows))
        self.counts = np.stack([rows - below, below], axis=1).ravel()
        # All left sides, then all right ones, each by parent; ``turn`` brings a parent's sides together.
        begin = np.stack([np.cumsum(rows - below) - (rows - below),
                          len(side) - below.sum() + np.cumsum(below) - below], axis=1).ravel()
        turn = np.repeat(begin - (np.cumsum(self.counts) - self.counts), self.counts) + np.arange(len(side))
        number = None
        if 2 * len(self.at) < len(self.w):
            number = np.zeros(len(self.w), dtype=np.int64)
            number[self.at] = np.arange(len(self.at))
        for f, order in enumerate(self.orders):
            if here is not None:
                order = order.take(here)
            s = right.take(order)
            order = np.concatenate([order.take(np.flatnonzero(~s)), order.take(np.flatnonzero(s))]).take(turn)
            self.orders[f] = order if number is None else number.take(order)
        if number is not None:
            self.bins, self.w = self.bins.take(self.at, axis=1), self.w.take(self.at)
            self.stats = [x.take(self.at) for x in self.stats]
            self.at = np.arange(len(self.at))
        self._level()


def _choose(score: np.ndarray, cut: np.ndarray, path: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node the feature and cut of the best score among its first k usable features in random order; -1: none."""
    nodes, n_features = score.shape
    usable = np.isfinite(score)
    if k < n_features:
        draw = mix(path[:, None] ^ mix(np.arange(n_features, dtype=np.uint64)[None, :] + np.uint64(seed)))
        draw = np.where(usable, draw >> np.uint64(1), np.uint64(1) << np.uint64(63))
        turn = draw.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
        usable &= turn < k
    masked = np.where(usable, score, -np.inf)
    f = masked.argmax(axis=1)
    f = np.where(np.isfinite(masked[np.arange(nodes), f]), f, -1)
    return f, cut[np.arange(nodes), np.maximum(f, 0)]


def child_path(path: np.ndarray, side) -> np.ndarray:
    return mix((path << np.uint64(1)) ^ np.asarray(side, dtype=np.uint64))


def grow(bins: np.ndarray, stats: np.ndarray, square: np.ndarray, w: np.ndarray, k: int, seed: int,
         max_depth: int = NO_LIMIT, path: int = 1, depth: int = 0) -> Tree:
    """A whole (sub)tree, level by level over all its nodes at once."""
    n_features, outputs = bins.shape[1], stats.shape[1]
    width = [int(x) + 1 for x in bins.max(axis=0)]      # no bin of a feature lies beyond
    slot = np.zeros(len(bins), dtype=np.int64)
    paths = np.array([path], dtype=np.uint64)
    ids = np.zeros(1, dtype=np.int64)
    feature, cuts, left, right, value, gain, weight = [], [], [], [], [], [], []
    made, held = 1, None
    while len(ids):
        m = len(ids)
        tw = np.bincount(slot, w, m)
        ts = np.stack([np.bincount(slot, stats[:, j], m) for j in range(outputs)], axis=1)
        tq = np.bincount(slot, square, m)
        own = (ts ** 2).sum(axis=1) / tw
        impure = (tq - own > 1e-12 * np.maximum(np.abs(tq), 1e-300)) & (depth < max_depth)
        score, cut = np.full((m, n_features), -np.inf), np.zeros((m, n_features), dtype=np.int64)
        if not impure.any() or m * BINS <= 4 * len(slot):
            held = None
        elif held is None:
            held = _Sorted(slot, bins, w, stats, m)
        if impure.any():
            for f in range(n_features):
                if held is None:
                    cell, cells = slot * width[f] + bins[:, f], (m, width[f])
                    hw = np.bincount(cell, w, m * width[f]).reshape(cells)
                    hs = np.stack([np.bincount(cell, stats[:, j], m * width[f]).reshape(cells) for j in range(outputs)])
                    score[:, f], cut[:, f] = _from_histogram(hw, hs)
                else:
                    score[:, f], cut[:, f] = held.best(f, tw, ts)
        f, c = _choose(score, cut, paths, k, seed)
        f = np.where(impure, f, -1)
        split = f >= 0
        number = np.cumsum(split) - 1
        below = made + 2 * number
        feature.append(f)
        cuts.append(c)
        left.append(np.where(split, below, -1))
        right.append(np.where(split, below + 1, -1))
        value.append(ts / tw[:, None])
        gain.append(np.where(split, score[np.arange(m), np.maximum(f, 0)] - own, 0.0))
        weight.append(tw)
        keep = np.flatnonzero(split.take(slot))
        if len(keep) < len(slot):
            bins, stats, square, w, slot = (x.take(keep, axis=0) for x in (bins, stats, square, w, slot))
        parent = number.take(slot)
        side = bins[np.arange(len(slot)), f.take(slot)] > c.take(slot)
        if held is not None:
            held.split(split, keep, side, parent)
        slot = 2 * parent + side
        paths = np.stack([child_path(paths[split], 0), child_path(paths[split], 1)], axis=1).ravel()
        ids = np.arange(made, made + 2 * int(split.sum()))
        made += len(ids)
        depth += 1
    return Tree(*(np.concatenate(x) for x in (feature, cuts, left, right, value, gain, weight)))


# ---------------------------------------------------------------- boosting
def boost(bins: np.ndarray, y: np.ndarray, n_classes: int, rounds: int, depth: int, rate: float, judged: np.ndarray):
    """Gradient boosting; (scores of the judged rows, start, trees).

    Regression fits residuals. Two classes use the logistic loss with one tree a
    round, more use softmax with one tree per class and round; leaves take one
    Newton step.
    """
    one = np.ones(len(y))
    if not n_classes:
        start = np.array([y.mean()])
    else:
        share = np.clip(np.bincount(y.astype(int), minlength=n_classes) / len(y), 1e-9, 1)
        start = np.log(share[1:] / share[:1]) if n_classes == 2 else np.log(share)
    f, g = np.tile(start, (len(y), 1)), np.tile(start, (len(judged), 1))
    hot = np.eye(n_classes)[y.astype(int)] if n_classes else None
    trees = []
    for _ in range(rounds):
        if not n_classes:
            residual, hessian = y[:, None] - f, np.ones_like(f)
        else:
            p = class_shares(f)
            p, target = (p[:, 1:], hot[:, 1:]) if n_classes == 2 else (p, hot)
            residual, hessian = target - p, p * (1 - p)
        for j in range(f.shape[1]):
            r = residual[:, j]
            tree = grow(bins, r[:, None], r * r, one, bins.shape[1], 0, depth)
            leaf = tree.leaves(bins)
            top, low = (np.bincount(leaf, x, len(tree.feature)) for x in (r, hessian[:, j]))
            scale = (n_classes - 1) / n_classes if n_classes > 2 else 1.0
            tree.value = (rate * scale * np.where(low > 1e-150, top / np.maximum(low, 1e-150), 0.0))[:, None]
            f[:, j] += tree.value[leaf, 0]
            g[:, j] += tree.value[tree.leaves(judged), 0]
            trees.append(tree)
    return g, start, trees


def class_shares(f: np.ndarray) -> np.ndarray:
    """Probabilities from boosting scores: one column is the log odds of the second class."""
    if f.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(f[:, 0], -500, 500)))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------- tables
def quantile_cuts(rows: DataFrame, n_features: int) -> list[np.ndarray]:
    """Thresholds of each feature (column features, array<double>): at most BINS - 1 distinct quantiles."""
    share = [float(x) for x in np.arange(1, BINS) / BINS]
    cells = [F.percentile_approx(F.col("features")[j], F.array(*map(F.lit, share)), 10_000).alias(f"q{j}")
             for j in range(n_features)]
    row = rows.agg(*cells).first()
    return [np.unique(np.array(row[f"q{j}"] if row[f"q{j}"] else [], dtype=float)) for j in range(n_features)]


def to_bins(features: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(features.shape, dtype=np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, features[:, j], side="left")
    return out


def binned(prepared: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(row, label, bins, is_train, fold, grid_fold) of (features vector, label, _is_train, _fold), checkpointed."""
    source = prepared.select(
        F.monotonically_increasing_id().alias("row"), F.col("label").cast("double").alias("label"),
        vector_to_array("features").alias("features"), F.col("_is_train").alias("is_train"), F.col("_fold").alias("fold"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(3)), F.lit(3)).cast("int").alias("grid_fold"))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
            b = to_bins(x, cuts) if n else x
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("label"), pa.array([r.tobytes() for r in b], pa.binary()),
                 *(batch.column(c) for c in ("is_train", "fold", "grid_fold"))],
                ["row", "label", "bins", "is_train", "fold", "grid_fold"])

    return cut_lineage(source.mapInArrow(
        run, "row long, label double, bins binary, is_train boolean, fold int, grid_fold int"))


@dataclass(frozen=True)
class Fit:
    """One forest to grow: by, value: train on the rows whose fold column has another value and judge those with it
    ('' trains on all training rows and judges the others)."""

    model: str
    by: str
    value: int
    n_trees: int
    draws: bool           # bootstrap rows
    k: int                # features per node

    def masks(self, part: dict) -> tuple[np.ndarray, np.ndarray]:
        train = part["is_train"]
        if not self.by:
            return train, ~train
        inside = part[self.by] == self.value
        return train & ~inside, train & inside


class Tops:
    """The upper parts of all trees, grown in Spark: {(fit, tree): Tree with ``open`` leaves}."""

    def __init__(self, fits: list[Fit]):
        self.nodes = {(i, t): [dict(feature=-1, cut=0, left=-1, right=-1, path=1, depth=0, open=True, value=None, up=-1)]
                      for i, f in enumerate(fits) for t in range(f.n_trees)}

    def route(self, key, bins: np.ndarray) -> np.ndarray:
        nodes = self.nodes[key]
        if len(nodes) == 1:
            return np.zeros(len(bins), dtype=np.int64)
        feature, cut, left, right = (np.array([n[c] for n in nodes]) for c in ("feature", "cut", "left", "right"))
        at, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while (feature[at] >= 0).any():
            to = np.where(bins[row, np.maximum(feature[at], 0)] <= cut[at], left[at], right[at])
            at = np.where(feature[at] >= 0, to, at)
        return at

    def values(self, key, node: int) -> list:
        """Values of the nodes from the root to ``node``."""
        out = []
        while node >= 0:
            out.append(self.nodes[key][node]["value"])
            node = self.nodes[key][node]["up"]
        return out[::-1]


def _part(batch: pa.RecordBatch) -> dict:
    n = batch.num_rows
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "bins"}
    out["bins"] = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)
    return out


def _grow_tops(rows: DataFrame, fits: list[Fit], n_features: int, n_classes: int, seed: int, limit: int) -> Tops:
    """Split every node of more than ``limit`` rows; the driver sees one row per such node and level."""
    tops = Tops(fits)
    outputs = max(1, n_classes)
    if rows.where("is_train").count() <= limit:
        return tops
    pending = {key: [0] for key in tops.nodes}
    while pending:
        held = rows.sparkSession.sparkContext.broadcast((tops, pending))

        def histograms(batches):
            state, todo = held.value
            total: dict[tuple, np.ndarray] = {}
            for batch in batches:
                part = _part(batch)
                for (i, t), nodes in todo.items():
                    fit = fits[i]
                    w = fit.masks(part)[0].astype(np.float64)
                    if fit.draws:
                        w = w * bootstrap(part["row"], t, seed)
                    here = w > 0
                    if not here.any():
                        continue
                    b, w = part["bins"][here], w[here]
                    stats, square = statistics(part["label"][here], w, n_classes)
                    at = state.route((i, t), b)
                    for node in nodes:
                        mine = np.flatnonzero(at == node)
                        own = b.take(mine, axis=0)
                        sums = [(0, w.take(mine)), *((3 + q, stats[:, q].take(mine)) for q in range(outputs))]
                        cells = total.setdefault((i, t, node), np.zeros((n_features, outputs + 3, BINS)))
                        for f in range(n_features):
                            column = own[:, f].astype(np.intp)
                            if not f:            # the node's own squares and rows are the same by any feature
                                cells[f, 1] += np.bincount(column, square.take(mine), BINS)
                                cells[f, 2] += np.bincount(column, minlength=BINS)
                            for j, x in sums:
                                cells[f, j] += np.bincount(column, x, BINS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[j] for k in total], pa.int32()) for j in range(3)]
                + [pa.array([v.tobytes() for v in total.values()], pa.binary())], ["fit", "tree", "node", "cells"])

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            i, t, node = (int(pdf[c].iloc[0]) for c in ("fit", "tree", "node"))
            cells = sum(np.frombuffer(x).reshape(n_features, outputs + 3, BINS) for x in pdf["cells"])
            info = held.value[0].nodes[(i, t)][node]
            tw, tq, n = cells[0, 0].sum(), cells[0, 1].sum(), cells[0, 2].sum()
            ts = cells[0, 3:].sum(axis=1)
            own = (ts ** 2).sum() / tw
            f, c = -1, 0
            if n > limit and tq - own > 1e-12 * max(abs(tq), 1e-300):
                found = [_from_histogram(cells[j, :1], cells[j, 3:, None, :]) for j in range(n_features)]
                score, cut = (np.array([[x[q][0] for x in found]]) for q in (0, 1))
                f, c = (int(x[0]) for x in _choose(score, cut, np.array([info["path"]], np.uint64), fits[i].k, seed + t))
            gain = score[0, f] - own if f >= 0 else 0.0
            return pd.DataFrame({"fit": [i], "tree": [t], "node": [node], "feature": [f], "cut": [c],
                                 "value": [(ts / tw).tolist()], "gain": [gain], "weight": [tw]})

        found = (rows.mapInArrow(histograms, "fit int, tree int, node int, cells binary")
                 .groupBy("fit", "tree", "node").applyInPandas(
            best, "fit int, tree int, node int, feature int, cut int, value array<double>, gain double, weight double")
            .collect())
        pending = {}
        for r in found:
            key = (r.fit, r.tree)
            nodes = tops.nodes[key]
            node = nodes[r.node]
            node["value"] = list(r.value)
            if r.feature < 0:
                continue
            node.update(feature=r.feature, cut=r.cut, left=len(nodes), right=len(nodes) + 1, open=False,
                        gain=r.gain, weight=r.weight)
            path = np.array([node["path"]], dtype=np.uint64)
            for side in (0, 1):
                pending.setdefault(key, []).append(len(nodes))
                nodes.append(dict(feature=-1, cut=0, left=-1, right=-1, path=int(child_path(path, side)[0]),
                                  depth=node["depth"] + 1, open=True, value=None, up=r.node))
    return tops


_SENT = "fit int, tree int, node int, judged boolean, n int, bins binary, y binary, w binary, ids binary"
_MADE = "fit int, tree int, node int, block long, ids binary, y binary, data binary, gains binary"


def _send(rows: DataFrame, fits: list[Fit], tops, seed: int) -> DataFrame:
    """Every row packed for each subtree that learns from it or judges it."""
    def run(batches):
        state = tops.value
        for batch in batches:
            part = _part(batch)
            for i, fit in enumerate(fits):
                train, judge = fit.masks(part)
                for t in range(fit.n_trees):
                    w = bootstrap(part["row"], t, seed) if fit.draws else np.ones(batch.num_rows, np.uint8)
                    out = []
                    for flag, mask in ((False, train & (w > 0)), (True, judge)):
                        at = np.flatnonzero(mask)
                        node = state.route((i, t), part["bins"][at])
                        for q in np.unique(node).tolist():
                            x = at[node == q]
                            out.append((i, t, q, flag, len(x), part["bins"][x].tobytes(), part["label"][x].tobytes(),
                                        w[x].tobytes(), part["row"][x].tobytes() if flag else b""))
                    if out:
                        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 4]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                            ["fit", "tree", "node", "judged", "n", "bins", "y", "w", "ids"])
    return rows.mapInArrow(run, _SENT)


def _joined(pdf: pd.DataFrame, n_features: int):
    bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, n_features)
    return (bins, np.frombuffer(b"".join(pdf["y"]), np.float64), np.frombuffer(b"".join(pdf["w"]), np.uint8),
            np.frombuffer(b"".join(pdf["ids"]), np.int64))


def _blocks(fit, tree, node, ids, y, predictions: np.ndarray) -> list[tuple]:
    """Packed predictions (depths, rows, outputs) by block of row numbers."""
    out = []
    block = ids // BLOCK
    for b in np.unique(block).tolist():
        mine = block == b
        out.append((fit, tree, node, b, ids[mine].tobytes(), y[mine].tobytes(),
                    predictions[:, mine].astype(np.float64).tobytes(), b""))
    return out


def forests(rows: DataFrame, fits: list[Fit], n_features: int, n_classes: int, seed: int, depths: tuple[int, ...],
            keep: int | None = None, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None, Tops]:
    """Grow all fits; (predictions, kept subtrees, tops).

    predictions: packed, for ``judgements``. keep: the fit whose subtrees are
    returned too, as (tree, node, data, gains).
    """
    spark = rows.sparkSession
    outputs = max(1, n_classes)
    tops = _grow_tops(rows, fits, n_features, n_classes, seed, limit)
    held = spark.sparkContext.broadcast(tops)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        i, t, node = (int(pdf[c].iloc[0]) for c in ("fit", "tree", "node"))
        info = held.value.nodes[(i, t)][node]
        learn = pdf[~pdf["judged"]].sort_values("ids")
        bins, y, w, _ = _joined(learn, n_features)
        out = []
        above = held.value.values((i, t), node)[:-1]
        if len(bins):
            w = w.astype(np.float64)
            tree = grow(bins, *statistics(y, w, n_classes), w, fits[i].k, seed + t, path=info["path"], depth=info["depth"])
        else:      # a side without drawn rows cannot be: a split leaves weight on both sides; a tree may draw none at all
            tree = Tree(*(np.full(1, -1) for _ in range(4)), np.zeros((1, outputs)), np.zeros(1), np.zeros(1))
        if i == keep:
            gains = np.bincount(np.maximum(tree.feature, 0), tree.gain, n_features)
            out.append((i, t, node, -1, b"", b"", tree.pack(), gains.tobytes()))
        bins, y, _, ids = _joined(pdf[pdf["judged"]], n_features)
        if len(ids):
            found = tree.predict(bins, depths, info["depth"])
            for q, d in enumerate(depths):
                if d < info["depth"]:
                    found[q] = above[d]
            out += _blocks(i, t, node, ids, y, found)
        return pd.DataFrame(out, columns=["fit", "tree", "node", "block", "ids", "y", "data", "gains"])

    path = scratch_path(spark, "forest")
    _send(rows, fits, held, seed).groupBy("fit", "tree", "node").applyInPandas(finish, _MADE).write.parquet(path)
    made = spark.read.parquet(path)
    return made.where("block >= 0"), made.where("block < 0"), tops


def judgements(made: DataFrame, fits: list[Fit], prefixes: tuple[int, ...], n_depths: int, n_classes: int) -> DataFrame:
    """(fit, setting, row, label, prediction, shares): setting numbers depth * len(prefixes) + prefix."""
    outputs = max(1, n_classes)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["fit"].iloc[0])
        ids = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]]))
        label = np.zeros(len(ids))
        total = np.zeros((n_depths, len(prefixes), len(ids), outputs))
        for t, raw, y, data in zip(pdf["tree"], pdf["ids"], pdf["y"], pdf["data"]):
            at = np.searchsorted(ids, np.frombuffer(raw, np.int64))
            label[at] = np.frombuffer(y)
            p = np.frombuffer(data).reshape(n_depths, len(at), outputs)
            for q, upto in enumerate(prefixes):
                if t < upto:
                    total[:, q, at] += p
        frames = []
        for d in range(n_depths):
            for q, upto in enumerate(prefixes):
                mean = total[d, q] / min(upto, fits[i].n_trees)
                frames.append(pd.DataFrame({
                    "fit": i, "setting": d * len(prefixes) + q, "row": ids, "label": label,
                    "prediction": mean.argmax(axis=1).astype(float) if n_classes else mean[:, 0],
                    "shares": list(mean)}))
        return pd.concat(frames)

    return made.groupBy("fit", "block").applyInPandas(
        add, "fit int, setting int, row long, label double, prediction double, shares array<double>")


def _start(y_sum: np.ndarray, n: float, n_classes: int) -> np.ndarray:
    """Start scores from the sum of the targets (regression) or the rows per class."""
    if not n_classes:
        return np.array([y_sum[0] / n])
    share = np.clip(y_sum / n, 1e-9, 1)
    return np.log(share[1:] / share[:1]) if n_classes == 2 else np.log(share)


def _residuals(f: np.ndarray, y: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """What a round's trees fit, and the second derivatives of the loss; (outputs, rows) each, like the scores."""
    if not n_classes:
        return y - f, np.ones_like(f)
    if n_classes == 2:
        p = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        return (y == 1) - p, p * (1 - p)
    p = np.exp(f - f.max(axis=0))
    p /= p.sum(axis=0)
    return (y == np.arange(n_classes)[:, None]) - p, p * (1 - p)


class _Growing:
    """A boosting tree while its levels are found: node dicts in growing order, and those still open."""

    def __init__(self):
        self.nodes, self.open = [], []
        self.open = [self._add()]

    def _add(self, top: float = 0.0, low: float = 0.0, weight: float = 0.0) -> int:
        self.nodes.append(dict(feature=-1, cut=0, left=-1, right=-1, top=top, low=low, gain=0.0, weight=weight))
        return len(self.nodes) - 1

    def take(self, found: dict, last: bool) -> None:
        """One level: ``found`` has a row per open node; the children of the ``last`` level are leaves."""
        nodes, self.open = self.open, []
        for at in nodes:
            r = found[at]
            self.nodes[at].update(top=r["top"], low=r["low"], weight=r["weight"])
            if r["feature"] < 0:
                continue
            left = self._add(*(r[f"left_{c}"] for c in ("top", "low", "weight")))
            right = self._add(*(r[c] - r[f"left_{c}"] for c in ("top", "low", "weight")))
            self.nodes[at].update(feature=r["feature"], cut=r["cut"], left=left, right=right, gain=r["gain"])
            if not last:
                self.open += [left, right]

    def tree(self, scale: float) -> Tree:
        feature, cut, left, right, top, low, gain, weight = (
            np.array([n[c] for n in self.nodes]) for c in ("feature", "cut", "left", "right", "top", "low", "gain", "weight"))
        value = scale * np.where(low > 1e-150, top / np.maximum(low, 1e-150), 0.0)
        return Tree(feature, cut, left, right, np.where(feature < 0, value, 0.0)[:, None], gain, weight)


_STATE = "n int, bins binary, y binary, is_train binary, fold binary, grid_fold binary, ids binary, f binary"
# Scores do not compress; small row groups are read with little memory.
_STATE_OPTIONS = {"compression": "uncompressed", "parquet.block.size": 16 << 20}
_LEVEL = ("fit int, output int, node int, feature int, cut int, gain double, weight double, top double, low double, "
          "left_weight double, left_top double, left_low double")


def _packed(rows: DataFrame, starts: np.ndarray) -> DataFrame:
    """Blocks of rows with their scores, (fits, outputs, rows), all at the fits' start; training rows lead, bins lie by feature."""
    def packed(parts):
        part = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        for at in range(0, len(part["row"]), PACK):
            cut = {c: v[at:at + PACK] for c, v in part.items()}
            order = np.argsort(~cut["is_train"].astype(np.bool_), kind="stable")
            cut = {c: v[order] for c, v in cut.items()}
            n = len(order)
            columns = [np.ascontiguousarray(cut["bins"].T).tobytes(), cut["label"].tobytes(),
                       cut["is_train"].astype(np.bool_).tobytes(), cut["fold"].astype(np.int32).tobytes(),
                       cut["grid_fold"].astype(np.int32).tobytes(), cut["row"].tobytes(),
                       np.repeat(starts[:, :, None], n, axis=2).tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)],
                ["n", "bins", "y", "is_train", "fold", "grid_fold", "ids", "f"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(_part(batch))
                n += batch.num_rows
            if n >= PACK:
                yield from packed(parts)
                parts, n = [], 0
        if parts:
            yield from packed(parts)
    return rows.mapInArrow(run, _STATE)


def _blocks_of(batches, n_features: int, shape: tuple[int, int]):
    """(raw values, part, bins by feature, scores) of each packed block."""
    kinds = {"y": float, "is_train": np.bool_, "fold": np.int32, "grid_fold": np.int32, "ids": np.int64}
    for batch in batches:
        for i in range(batch.num_rows):
            raw = {c: batch.column(c)[i].as_buffer() for c in batch.schema.names if c != "n"}
            yield (raw, {c: np.frombuffer(raw[c], k) for c, k in kinds.items() if c in raw},
                   np.frombuffer(raw["bins"], np.uint8).reshape(n_features, -1), np.frombuffer(raw["f"]).reshape(*shape, -1))


def _learned(batches, n_features: int, shape: tuple[int, int]):
    """(part, bins, scores) of the training rows, GATHER blocks together."""
    held: list[tuple] = []

    def joined():
        return ({c: np.concatenate([p[c] for p, _, _ in held]) for c in held[0][0]},
                *(np.concatenate([h[k] for h in held], axis=-1) for k in (1, 2)))
    for _, part, bins, f in _blocks_of(batches, n_features, shape):
        n = int(np.count_nonzero(part["is_train"]))     # they lead
        if n:
            held.append(({c: v[:n] for c, v in part.items()}, bins[:, :n], f[..., :n]))
        if len(held) == GATHER:
            yield joined()
            held = []
    if held:
        yield joined()


class _Routes:
    """Where rows end in many small trees. A tree's splits are the bits of a byte, and a row's cells give those of eight trees."""

    def __init__(self, trees: list[Tree], shared: list[tuple[list[int], int]], widths: list[int]):
        self.trees, self.place, self.leaf = trees, {}, {}
        for k, tree in enumerate(trees):
            inner = np.flatnonzero(tree.feature >= 0)
            if len(inner) > 8:
                continue
            bit = np.zeros(len(tree.feature), dtype=np.int64)
            bit[inner] = np.arange(len(inner))
            at, sides = np.zeros(256, dtype=np.int64), np.arange(256)
            for _ in inner:                              # a path has at most as many splits
                to = np.where(sides >> bit[at] & 1, tree.right[at], tree.left[at])
                at = np.where(tree.feature[at] >= 0, to, at)
            self.place[k], self.leaf[k] = divmod(len(self.place), 8), at
        self.words = [[np.zeros(cells, np.uint64) for _, cells in shared] for _ in range(-(-len(self.place) // 8))]
        for k, (word, byte) in self.place.items():
            tree = trees[k]
            for q, node in enumerate(np.flatnonzero(tree.feature >= 0).tolist()):
                for (own, cells), to in zip(shared, self.words[word]):
                    if tree.feature[node] in own:
                        below = int(np.prod([widths[x] for x in own[own.index(tree.feature[node]) + 1:]], initial=1))
                        bins = np.arange(cells) // below % widths[tree.feature[node]]
                        to |= (bins > tree.cut[node]).astype(np.uint64) << np.uint64(8 * byte + q)

    def of(self, codes: list[np.ndarray], bins: np.ndarray):
        """A function of (tree, values by node) that gives each row the value of its leaf."""
        sides = []
        for tables in self.words:
            word = tables[0].take(codes[0])
            for table, code in zip(tables[1:], codes[1:]):
                word |= table.take(code)
            sides.append(word.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8))

        def pick(k: int, values: np.ndarray) -> np.ndarray:
            if k not in self.place:
                return values.take(self.trees[k].leaf_of(bins.T))
            word, byte = self.place[k]
            return values.take(self.leaf[k]).take(sides[word][:, byte])
        return pick


def _softmax_residuals(f: np.ndarray, hot: np.ndarray, p: np.ndarray, h: np.ndarray) -> None:
    """``_residuals`` of several classes into ``p`` and ``h``."""
    np.subtract(f, f.max(axis=0), out=p)
    np.exp(p, out=p)
    np.divide(p, p.sum(axis=0), out=p)
    np.subtract(1, p, out=h)
    np.multiply(p, h, out=h)
    np.subtract(hot, p, out=p)


def _joint(widths: list[int]) -> list[tuple[list[int], int]]:
    """(features, cells) of the histograms that are summed together: features of few bins share one, of up to JOINT cells."""
    out: list[tuple[list[int], int]] = []
    for q in sorted(range(len(widths)), key=lambda q: (-widths[q], q)):
        at = next((k for k, (_, cells) in enumerate(out) if cells * widths[q] <= JOINT), None)
        if at is None:
            out.append(([q], widths[q]))
        else:
            out[at] = ([*out[at][0], q], out[at][1] * widths[q])
    return out


def _cells_of(bins: np.ndarray, features: list[int], widths: list[int]) -> np.ndarray:
    """A row's cell in the histogram that ``features`` share."""
    cell = bins[features[0]].astype(np.intp)
    for q in features[1:]:
        cell *= widths[q]
        cell += bins[q]
    return cell


def _by_feature(sums: np.ndarray, features: list[int], widths: list[int]) -> dict[int, np.ndarray]:
    """{feature: (nodes, bins)} of shared sums (nodes, cells)."""
    cells = sums.reshape(len(sums), *(widths[q] for q in features))
    return {q: cells.sum(axis=tuple(a for a in range(1, cells.ndim) if a != k + 1)) for k, q in enumerate(features)}


def _boosted_in_spark(rows: DataFrame, fits: list[Fit], n_features: int, n_classes: int, rounds: int, depth: int,
                      rate: float) -> tuple[DataFrame, DataFrame]:
    """``boosted`` for any number of rows: all fits and classes advance together, one job for each level of a round.

    Tasks sum histograms of the residuals per (fit, class, node); a row per node comes back. The
    rows' scores are written every KEEP rounds, the trees since then are added on reading.
    """
    spark = rows.sparkSession
    slots = spark.sparkContext.defaultParallelism
    outputs = 1 if n_classes <= 2 else n_classes
    sums = rows.where("is_train").groupBy("fold", "grid_fold", F.col("label").alias("y") if n_classes else
                                          F.lit(0.0).alias("y")).agg(F.count("*").alias("n"), F.sum("label").alias("s")).collect()
    starts = []
    for fit in fits:
        own = [r for r in sums if not fit.by or r[fit.by] != fit.value]
        per = (np.bincount([int(r["y"]) for r in own], [r["n"] for r in own], n_classes) if n_classes
               else np.array([sum(r["s"] for r in own)]))
        starts.append(_start(per, sum(r["n"] for r in own), n_classes))
    shape = (len(fits), outputs)
    # Every job reads the rows' scores: a file is a task's share of them, and each slot has as many files.
    size = rows.count() * (n_features + 25 + 8 * len(fits) * outputs)
    files = slots * max(1, -(-size // (slots * STATE_FILE)))
    path = scratch_path(spark, "boosting")
    few = rows.rdd.getNumPartitions() < files
    _packed(rows.repartition(files) if few else rows, np.array(starts)).write.options(**_STATE_OPTIONS).parquet(path)
    # The blocks' schema is given: Spark need not read it from the files in every round.
    state, later, done = spark.read.schema(_STATE).parquet(path), [], []

    def widest(batches):
        top = np.zeros(n_features, np.uint8)
        for batch in batches:
            for raw in batch.column("bins"):
                bins = np.frombuffer(raw.as_buffer(), np.uint8).reshape(n_features, -1)
                top = np.maximum(top, bins.max(axis=1, initial=0))
        yield pa.RecordBatch.from_arrays([pa.array([q for q in range(n_features)], pa.int32()), pa.array(top.astype(np.int32))],
                                         ["feature", "bin"])
    found = state.select("bins").mapInArrow(widest, "feature int, bin int").groupBy("feature").agg(F.max("bin").alias("bin"))
    widths = [1] * n_features
    for r in found.collect():
        widths[r["feature"]] = r["bin"] + 1
    shared = _joint(widths)
    scale = rate * ((n_classes - 1) / n_classes if n_classes > 2 else 1.0)
    by_grid = any(f.by == "grid_fold" for f in fits)

    def later_routes(later):
        trees = [(at, tree) for one in later for at, tree in one.items()]
        return [(at, tree.value[:, 0]) for at, tree in trees], _Routes([tree for _, tree in trees], shared, widths)

    def add_later(done, codes, bins, f):
        """The scores ``f`` with the trees of later rounds."""
        values, routes = done
        pick = routes.of(codes, bins)
        for k, (at, value) in enumerate(values):
            f[at] += pick(k, value)

    def histograms_of(held, last):
        def run(batches):
            later, growing = held.value
            total: dict[tuple, tuple] = {}
            done, now = later_routes(later), list(growing)
            routes = _Routes([growing[k][0] for k in now], shared, widths)
            for part, bins, f in _learned(batches, n_features, shape):
                codes = [_cells_of(bins, own, widths) for own, _ in shared]
                add_later(done, codes, bins, f)
                pick = routes.of(codes, bins)
                spare = np.empty_like(codes[0])
                if n_classes > 2:
                    hot = (part["y"] == np.arange(n_classes)[:, None]).astype(float)
                    residual, hessian = np.empty_like(hot), np.empty_like(hot)
                for i, fit in enumerate(fits):
                    mine = fit.masks(part)[0]
                    others = np.flatnonzero(~mine)
                    if n_classes > 2:
                        _softmax_residuals(f[i], hot, residual, hessian)
                    else:
                        residual, hessian = _residuals(f[i], part["y"], n_classes)
                    counts = None
                    for j in range(outputs):
                        if (i, j) not in growing:
                            continue
                        tree, nodes = growing[i, j]
                        m = len(nodes)
                        r, h = residual[j], hessian[j]
                        if (i, j) not in total:
                            total[i, j] = [np.zeros((3, m, cells)) for _, cells in shared], np.zeros((2, m))
                        sums, own = total[i, j]
                        if len(tree.feature) == 1:       # the root: the classes of a fit have the same rows
                            r[others] = h[others] = 0.0
                            if counts is None:
                                learned = np.flatnonzero(mine)
                                counts = [np.bincount(code.take(learned), minlength=cells)
                                          for code, (_, cells) in zip(codes, shared)]
                            own[0, 0] += (r * r).sum()
                            own[1, 0] += h.sum()
                            for code, (_, cells), to, n in zip(codes, shared, sums, counts):
                                to[0, 0] += n
                                to[1, 0] += np.bincount(code, r, cells)
                                if last:
                                    to[2, 0] += np.bincount(code, h, cells)
                            continue
                        # Rows of closed nodes, and those the fit does not learn from, fall behind the open nodes.
                        place = np.full(len(tree.feature), m, dtype=np.intp)
                        place[nodes] = np.arange(m)
                        slot = pick(now.index((i, j)), place)
                        slot[others] = m
                        own[0] += np.bincount(slot, r * r, m + 1)[:m]
                        own[1] += np.bincount(slot, h, m + 1)[:m]
                        for code, (_, cells), to in zip(codes, shared, sums):
                            np.multiply(slot, cells, out=spare)
                            np.add(spare, code, out=spare)
                            # Without a split below, the second derivatives are needed by node only.
                            for s, x in enumerate((None, r, h) if last else (None, r)):
                                to[s] += np.bincount(spare, x, (m + 1) * cells)[:m * cells].reshape(m, cells)
            cells = []
            for sums, own in total.values():
                full: dict = {}
                for to, (features, _) in zip(sums, shared):
                    for s in range(3):
                        full |= {(q, s): x for q, x in _by_feature(to[s], features, widths).items()}
                cells.append((np.concatenate([full[q, s].ravel() for q in range(n_features) for s in range(3)]), own))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()),
                 pa.array([full.tobytes() for full, _ in cells], pa.binary()),
                 pa.array([own.tobytes() for _, own in cells], pa.binary())], ["fit", "output", "cells", "own"])
        return run

    def best_of(held):
        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            i, j = int(pdf["fit"].iloc[0]), int(pdf["output"].iloc[0])
            nodes = held.value[1][i, j][1]
            m = len(nodes)
            flat, ends = sum(np.frombuffer(x) for x in pdf["cells"]), np.cumsum([3 * m * w for w in widths])
            cells = [x.reshape(3, m, -1) for x in np.split(flat, ends[:-1])]
            square, low = sum(np.frombuffer(x).reshape(2, m) for x in pdf["own"])
            weight, top = (cells[0][s].sum(axis=1) for s in range(2))
            own = top ** 2 / weight
            found = [_from_histogram(cells[q][0], cells[q][1][None]) for q in range(n_features)]
            score, cut = (np.stack([x[s] for x in found], axis=1) for s in (0, 1))
            f, c = _choose(score, cut, np.zeros(m, np.uint64), n_features, 0)
            f = np.where(square - own > 1e-12 * np.maximum(np.abs(square), 1e-300), f, -1)
            side = [[cells[max(f[a], 0)][s, a, :c[a] + 1].sum() for a in range(m)] for s in range(3)]
            return pd.DataFrame({"fit": i, "output": j, "node": nodes, "feature": f, "cut": c,
                                 "gain": np.where(f >= 0, score[np.arange(m), np.maximum(f, 0)] - own, 0.0),
                                 "weight": weight, "top": top, "low": low, "left_weight": side[0], "left_top": side[1],
                                 "left_low": side[2]})
        return best

    def scored(batches, later):
        """(raw values, part, present scores) of each packed block."""
        done = later_routes(later)
        for raw, part, bins, f in _blocks_of(batches, n_features, shape):
            f = f.copy()
            add_later(done, [_cells_of(bins, own, widths) for own, _ in shared], bins, f)
            yield raw, part, f

    def written(held):
        def run(batches):
            for raw, _, f in scored(batches, held.value):
                kept = [raw[c] for c in ("bins", "y", "is_train", "fold", "grid_fold", "ids")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.shape[-1]], pa.int32()), *(pa.array([x.to_pybytes()], pa.binary()) for x in kept),
                     pa.array([f.tobytes()], pa.binary())],
                    ["n", "bins", "y", "is_train", "fold", "grid_fold", "ids", "f"])
        return run

    for _ in range(rounds):
        if len(later) == KEEP:
            held = spark.sparkContext.broadcast(later)
            before, path = path, scratch_path(spark, "boosting")
            state.mapInArrow(written(held), _STATE).write.options(**_STATE_OPTIONS).parquet(path)
            state, later = spark.read.schema(_STATE).parquet(path), []
            drop_folder(spark, before)              # one state at a time is on the disk
        learning = state.select("n", "bins", "y", "is_train", "fold", "f", *(["grid_fold"] if by_grid else []))
        growing = {(i, j): _Growing() for i in range(len(fits)) for j in range(outputs)}
        for level in range(depth):
            todo = {k: (g.tree(scale), g.open) for k, g in growing.items() if g.open}
            if not todo:
                break
            held = spark.sparkContext.broadcast((later, todo))
            found: dict = {}
            for r in (learning.mapInArrow(histograms_of(held, level == depth - 1),
                                       "fit int, output int, cells binary, own binary")
                      .groupBy("fit", "output").applyInPandas(best_of(held), _LEVEL).collect()):
                found.setdefault((r["fit"], r["output"]), {})[r["node"]] = r
            for k in todo:
                growing[k].take(found[k], level == depth - 1)
            held.unpersist()
        done.append({k: g.tree(scale) for k, g in growing.items()})
        later = [*later, done[-1]]

    held = spark.sparkContext.broadcast(later)

    def judge(batches):
        for _, part, f in scored(batches, held.value):
            for i, fit in enumerate(fits):
                mine = fit.masks(part)[1]
                g = f[i][:, mine].T
                shares = class_shares(g) if n_classes else g
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(g), i), pa.int32()), pa.array(np.zeros(len(g)), pa.int32()),
                     pa.array(part["ids"][mine]), pa.array(part["y"][mine]),
                     pa.array(shares.argmax(axis=1).astype(float) if n_classes else g[:, 0]),
                     pa.array(list(shares), pa.list_(pa.float64()))],
                    ["fit", "setting", "row", "label", "prediction", "shares"])

    said = cut_lineage(state.mapInArrow(
        judge, "fit int, setting int, row long, label double, prediction double, shares array<double>"))
    drop_folder(spark, path)
    first = [d[0, j] for d in done for j in range(outputs)]
    gains = sum(np.bincount(np.maximum(t.feature, 0), t.gain, n_features) for t in first)
    return said, spark.createDataFrame(
        [(s, starts[0].tolist(), bytearray(t.pack()), bytearray(gains.tobytes())) for s, t in enumerate(first)],
        "setting int, shares array<double>, data binary, gains binary")


def boosted(rows: DataFrame, fits: list[Fit], n_features: int, n_classes: int, rounds: int, depth: int,
            rate: float = 0.1, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(predictions like ``judgements``, model of the first fit) of boosting.

    A fit's rows go to one task up to ``limit`` training rows; above, the same trees are found level by level in Spark.
    """
    if rows.where("is_train").count() > limit:
        return _boosted_in_spark(rows, fits, n_features, n_classes, rounds, depth, rate)
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(Tops([Fit(f.model, f.by, f.value, 1, False, 0) for f in fits]))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["fit"].iloc[0])
        bins, y, _, _ = _joined(pdf[~pdf["judged"]], n_features)
        other, z, _, ids = _joined(pdf[pdf["judged"]], n_features)
        f, start, trees = boost(bins, y, n_classes, rounds, depth, rate, other)
        shares = class_shares(f) if n_classes else f
        out = pd.DataFrame({"fit": i, "setting": 0, "row": ids, "label": z, "shares": list(shares), "data": b"", "gains": b"",
                            "prediction": shares.argmax(axis=1).astype(float) if n_classes else f[:, 0]})
        if i == 0:
            gains = sum(np.bincount(np.maximum(t.feature, 0), t.gain, n_features) for t in trees)
            model = pd.DataFrame({"fit": i, "setting": np.arange(len(trees)), "row": -1, "label": 0.0, "prediction": 0.0,
                                  "shares": [start] * len(trees), "data": [t.pack() for t in trees], "gains": gains.tobytes()})
            out = pd.concat([out, model])
        return out

    path = scratch_path(spark, "boosted")
    one = [Fit(f.model, f.by, f.value, 1, False, 0) for f in fits]
    (_send(rows, one, held, 0).groupBy("fit").applyInPandas(
        finish, "fit int, setting int, row long, label double, prediction double, shares array<double>, data binary, "
                "gains binary").write.parquet(path))
    made = spark.read.parquet(path)
    return made.where("row >= 0").drop("data", "gains"), made.where("row < 0")


# ---------------------------------------------------------------- stored models
class ForestModel:
    """A stored forest as a model: ``transform`` adds prediction (and probability) to rows with a features vector.

    The trees stay a table. Rows and trees are sorted out by subtree, and a
    row's predictions are added up; nothing of the forest's size is broadcast but
    its tops, which have at most one node for each LIMIT rows learned from.
    """

    def __init__(self, spark: SparkSession, path: str, tops: Tops, cuts: list[np.ndarray], n_classes: int, n_trees: int,
                 depth: int, gains: np.ndarray, fit: int = 0):
        self.spark, self.path, self.tops, self.cuts, self.fit = spark, path, tops, cuts, fit
        self.n_classes, self.n_trees, self.depth, self.gains = n_classes, n_trees, depth, gains

    def transform(self, df: DataFrame) -> DataFrame:
        keyed = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        n_features, outputs, cuts, depth = len(self.cuts), max(1, self.n_classes), self.cuts, self.depth
        number = self.fit
        trees = [t for t in range(self.n_trees)]
        tops = self.spark.sparkContext.broadcast(self.tops)

        def send(batches):
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                b, ids = to_bins(x, cuts), batch.column("_row").to_numpy()
                for t in trees:
                    node = tops.value.route((number, t), b)
                    for q in np.unique(node).tolist():
                        mine = node == q
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t], pa.int32()), pa.array([q], pa.int32()), pa.array([ids[mine].tobytes()], pa.binary()),
                             pa.array([b[mine].tobytes()], pa.binary())], ["tree", "node", "ids", "bins"])

        def judge(key, sent: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            t, node = int(key[0]), int(key[1])
            if not len(sent) or not len(stored):
                return pd.DataFrame({"block": [], "ids": [], "data": []})
            tree = Tree.unpack(stored["data"].iloc[0])
            info = tops.value.nodes[(number, t)][node]
            ids = np.frombuffer(b"".join(sent["ids"]), np.int64)
            found = tree.predict(np.frombuffer(b"".join(sent["bins"]), np.uint8).reshape(-1, n_features), (depth,), info["depth"])
            if depth < info["depth"]:
                found[0] = tops.value.values((number, t), node)[depth]
            return pd.DataFrame([(b[3], b[4], b[6]) for b in _blocks(0, t, node, ids, np.zeros(len(ids)), found)],
                                columns=["block", "ids", "data"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]]))
            total = np.zeros((len(ids), outputs))
            for raw, data in zip(pdf["ids"], pdf["data"]):
                total[np.searchsorted(ids, np.frombuffer(raw, np.int64))] += np.frombuffer(data).reshape(-1, outputs)
            return pd.DataFrame({"_row": ids, "shares": list(total / len(trees))})

        packed = keyed.select("_row", vector_to_array("features").alias("features")).mapInArrow(
            send, "tree int, node int, ids binary, bins binary")
        stored = self.spark.read.parquet(self.path).where(f"block < 0 and fit = {number}").select("tree", "node", "data")
        shares = (packed.groupBy("tree", "node").cogroup(stored.groupBy("tree", "node"))
                  .applyInPandas(judge, "block long, ids binary, data binary")
                  .groupBy("block").applyInPandas(add, "_row long, shares array<double>"))
        return _with_prediction(keyed.join(shares, "_row").drop("_row"), self.n_classes)


class BoostedModel:
    """Boosted trees of bounded depth and number, as a model."""

    def __init__(self, spark, trees: list[Tree], start: np.ndarray, cuts, n_classes: int, gains: np.ndarray):
        self.spark, self.trees, self.start, self.cuts = spark, trees, start, cuts
        self.n_classes, self.gains = n_classes, gains

    def transform(self, df: DataFrame) -> DataFrame:
        # rounds * classes trees of 2 ** depth leaves: bounded by the budget, not by the data.
        held = self.spark.sparkContext.broadcast((self.trees, self.start, self.cuts))
        n_classes = self.n_classes

        @F.pandas_udf("array<double>")
        def shares(features: pd.Series) -> pd.Series:
            trees, start, cuts = held.value
            b = np.asfortranarray(to_bins(np.array(features.tolist(), dtype=float).reshape(len(features), -1), cuts))
            f = np.tile(start, (len(b), 1))
            for i, t in enumerate(trees):
                f[:, i % len(start)] += t.value[t.leaf_of(b), 0]
            return pd.Series(list(class_shares(f) if n_classes else f))

        return _with_prediction(df.withColumn("shares", shares(vector_to_array("features"))), n_classes)


def _with_prediction(df: DataFrame, n_classes: int) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    if not n_classes:
        return df.withColumn("prediction", F.col("shares")[0]).drop("shares")
    return (df.withColumn("prediction", (F.array_position("shares", F.array_max("shares")) - 1).cast("double"))
            .withColumn("probability", array_to_vector("shares")).drop("shares"))


# ---------------------------------------------------------------- store and load
def save(model: ForestModel | BoostedModel, path: str) -> None:
    """The model as a table of trees beside one row of settings."""
    spark = model.spark
    if isinstance(model, ForestModel):
        stored = spark.read.parquet(model.path).where(f"block < 0 and fit = {model.fit} and tree < {model.n_trees}")
        stored.write.parquet(f"{path}/trees")
        settings = dict(kind="forest", n_trees=model.n_trees, depth=model.depth, fit=model.fit,
                        tops={f"{t}": model.tops.nodes[(model.fit, t)] for t in range(model.n_trees)})
    else:
        rows = [(i, bytearray(t.pack())) for i, t in enumerate(model.trees)]
        spark.createDataFrame(rows, "tree int, data binary").write.parquet(f"{path}/trees")
        settings = dict(kind="boosted", start=model.start.tolist())
    settings |= dict(n_classes=model.n_classes, cuts=[c.tolist() for c in model.cuts], gains=model.gains.tolist())
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> ForestModel | BoostedModel:
    settings = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    cuts, gains = [np.array(c) for c in settings["cuts"]], np.array(settings["gains"])
    if settings["kind"] == "forest":
        tops = Tops([])
        tops.nodes = {(settings["fit"], int(t)): nodes for t, nodes in settings["tops"].items()}
        return ForestModel(spark, f"{path}/trees", tops, cuts, settings["n_classes"], settings["n_trees"],
                           settings["depth"], gains, settings["fit"])
    rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
    return BoostedModel(spark, [Tree.unpack(bytes(r["data"])) for r in rows], np.array(settings["start"]), cuts,
                        settings["n_classes"], gains)
