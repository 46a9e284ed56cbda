"""Customer segments with k-means (ML18): all restarts advance together, one pass over the rows per step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import columns as C
from ledgerline.functions.quantiles import medians

# Persona names in KPI order.
PERSONA_NAMES = ["High-Value Champions", "Loyal Mainstreamers", "Emerging/Budget Group", "Declining/At-Risk Segment"]
#: Rows from which the restarts draw their first centres (the steps themselves read all rows).
START_ROWS = 10_000


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(centres)))
    for f in range(x.shape[1]):
        out += (x[:, f, None] - centres[None, :, f]) ** 2
    return out


def first_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of ``x``, each drawn with a chance that grows with its squared distance to those before."""
    chosen = [x[rng.integers(len(x))]]
    near = _squares(x, np.array(chosen))[:, 0]
    for _ in range(k - 1):
        total = near.sum()
        pick = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        chosen.append(x[pick])
        near = np.minimum(near, _squares(x, x[pick:pick + 1])[:, 0])
    return np.array(chosen)


def _packed(rows: DataFrame, features: list[str]) -> DataFrame:
    """Blocks of rows as bytes, features by rows under a line of ones, so that a step only multiplies them."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns)])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["x"])
    from ledgerline.session import cut_lineage
    return cut_lineage(rows.select(*[F.col(f).cast("double") for f in features]).mapInArrow(run, "x binary"))


def _sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per (restart, cluster) the count and the sums of the columns of ``x`` nearest to its centre (ties: the first)."""
    runs, k, _ = centres.shape
    # Half the squared distance, less the part that all centres share.
    to = np.concatenate([(centres ** 2).sum(axis=2, keepdims=True) / 2, -centres], axis=2)
    near = (to.reshape(runs * k, -1) @ x).reshape(runs, k, -1)
    least, label = near[:, 0].copy(), np.zeros((runs, x.shape[1]), dtype=np.int16)
    for c in range(1, k):
        np.putmask(label, near[:, c] < least, c)
        np.minimum(least, near[:, c], out=least)
    mine = np.equal(label[:, None], np.arange(k, dtype=np.int16)[:, None], out=near, casting="unsafe")
    return (mine.reshape(runs * k, -1) @ x.T).reshape(runs, k, -1)


def _step(packed: DataFrame, centres: np.ndarray, runs: list[int]):
    """One pass: per restart and cluster the count and the sums of the rows nearest to its centre."""
    k, d = centres.shape[1:]

    def partial(batches):
        total = np.zeros((len(runs), k, d + 1))
        for batch in batches:
            for block in batch.column("x"):
                total += _sums(np.frombuffer(block.as_buffer()).reshape(d + 1, -1), centres[runs])
        names = [(run, c) for run in runs for c in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n[0] for n in names], pa.int32()), pa.array([n[1] for n in names], pa.int32()),
             *(pa.array(column) for column in total.reshape(-1, d + 1).T)],
            ["run", "cluster", *(f"s{i}" for i in range(d + 1))])

    schema = "run int, cluster int, " + ", ".join(f"s{i} double" for i in range(d + 1))
    sums = (packed.mapInArrow(partial, schema).groupBy("run", "cluster")
            .agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(d + 1)]).collect())  # restarts x clusters rows
    return {(r[0], r[1]): np.array(r[2:]) for r in sums}


def kmeans(rows: DataFrame, features: list[str], k: int, restarts: int = 10, seed: int = 42, steps: int = 300,
           tolerance: float = 1e-4) -> tuple[np.ndarray, list[int], float]:
    """(centres, sizes, cost) of the best of ``restarts`` Lloyd runs over numeric ``features`` without nulls.

    A restart is done once its centres move by no more than ``tolerance``
    times the mean variance of the features (squared, summed) in a step.
    """
    mark = F.xxhash64(*features, F.lit(seed))
    sample = rows.select(*features).orderBy(mark, *features).limit(START_ROWS).toPandas().to_numpy(dtype=np.float64)
    spread = rows.agg(*[F.var_pop(f) for f in features], *[F.sum(F.col(f) * F.col(f)) for f in features]).first()
    least = tolerance * float(np.mean([v or 0.0 for v in spread[:len(features)]]))
    squares = float(sum(v or 0.0 for v in spread[len(features):]))
    packed = _packed(rows, features)
    centres = np.stack([first_centres(sample, k, np.random.default_rng(seed + r)) for r in range(restarts)])
    live, sizes, cost = list(range(restarts)), np.zeros((restarts, k)), np.full(restarts, np.inf)
    for step in range(steps):
        sums = _step(packed, centres, live)
        still = []
        for run in live:
            found = np.stack([sums[run, c] for c in range(k)])
            sizes[run] = found[:, 0]
            # All rows' squared distances to their centres, from the sums alone.
            cost[run] = squares + ((centres[run] ** 2).sum(axis=1) * found[:, 0]).sum() - 2 * (centres[run] * found[:, 1:]).sum()
            new = np.where(found[:, :1] > 0, found[:, 1:] / np.maximum(found[:, :1], 1), centres[run])
            moved = ((new - centres[run]) ** 2).sum()
            if moved > least and step < steps - 1:
                centres[run] = new
                still.append(run)
        live = still
        if not live:
            break
    best = int(cost.argmin())
    return centres[best], [int(n) for n in sizes[best]], float(cost[best])


def personas(df: DataFrame, k: int = 4, seed: int = 42, restarts: int = 10, exact: bool = True) -> DataFrame:
    """k-means on standardised numeric (non-id) columns, best of ``restarts`` runs by cost.

    Nulls and NaN take the median, a column without any value takes 0.
    Clusters are ranked by their KPI centroid (first column named like
    sales/profit/amount/spend/revenue/value, else the first feature) in
    original units, then named. Output: rank, cluster, persona, size, share
    and centroid per feature.
    """
    from ledgerline.session import cut_lineage
    feats = C.feature_columns(df)
    n = df.count()
    if len(feats) < 2 or n < 10:
        raise ValueError("Dataset does not contain enough numerical features or rows for clustering.")
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in feats])
    med = medians(numbers, feats, exact)
    filled = numbers.select(*[F.coalesce(c, F.lit(med[c]), F.lit(0.0)).alias(c) for c in feats])
    st = filled.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in feats]).first()
    scaled = filled.select(*[((F.col(c) - F.lit(st[c]["m"])) / F.lit(st[c]["s"] or 1.0)).alias(c) for c in feats])
    found, sizes, _ = kmeans(cut_lineage(scaled), feats, min(k, n), restarts, seed)
    centers = [[float(v) * (st[c]["s"] or 1.0) + st[c]["m"] for v, c in zip(center, feats)] for center in found]
    kpi = C.find_column(feats, C.KPI_KEYWORDS) or feats[0]
    ki = feats.index(kpi)
    order = sorted(range(len(centers)), key=lambda i: -centers[i][ki])
    rows = []
    for rank, ci in enumerate(order):
        name = PERSONA_NAMES[min(rank, len(PERSONA_NAMES) - 1)]
        cnt = sizes[ci]
        rows.append((rank + 1, ci, name, kpi, cnt, round(cnt / n * 100, 2),
                     {c: round(centers[ci][j], 2) for j, c in enumerate(feats)}))
    return df.sparkSession.createDataFrame(
        rows, "rank int, cluster int, persona string, kpi string, count bigint, percentage double, "
              "centroid map<string,double>")
