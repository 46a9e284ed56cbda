"""Anomaly scoring: isolation forest, local outlier factor, PCA reconstruction error, ensemble (AN1–AN5, DQ6).

Isolation forest on Spark:
  1. Every row joins a random number of distinct trees, so that a tree draws
     about 512 rows (all rows of a smaller table) and keeps 256 of them: one
     rule at every table size, with a bounded sample. Trees are grown per
     tree id with ``applyInPandas`` (numpy), in parallel on executors.
  2. The flat trees (``trees × ≤ 511`` nodes: a fixed bound) are collected
     and broadcast; every partition is scored by a pandas UDF that walks all
     trees with vectorised numpy.
  3. Thresholds are exact quantiles of the score (distributed helper).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import columns as C
from ledgerline.functions.quantiles import exact_quantiles, medians
from ledgerline.operators.neighbours import local_outlier_factor

SAMPLE_SIZE = 256


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Grow one isolation tree; returns flat arrays (feature, threshold, left, right, size)."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        me = len(feat)
        feat.append(-1)
        thr.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return me
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        feat[me], thr[me] = f, t
        left[me] = node(idx[go_left], depth + 1)
        right[me] = node(idx[~go_left], depth + 1)
        return me

    node(np.arange(x.shape[0]), 0)
    return feat, thr, left, right, size


def _path_lengths(x: np.ndarray, tree) -> np.ndarray:
    """Depth reached in one tree plus the c(size) correction at the leaf, vectorised."""
    feat, thr, left, right, leaf_c = tree
    pos = np.zeros(x.shape[0], dtype=np.int64)
    depth = np.zeros(x.shape[0], dtype=np.float64)
    rows = np.arange(x.shape[0])
    while rows.size:
        f = feat[pos[rows]]
        inner = f >= 0
        rows, f = rows[inner], f[inner]
        if not rows.size:
            break
        go_left = x[rows, f] < thr[pos[rows]]
        pos[rows] = np.where(go_left, left[pos[rows]], right[pos[rows]])
        depth[rows] += 1.0
    return depth + leaf_c[pos]


def _as_arrays(tree):
    feat, thr, left, right, size = tree
    return (np.asarray(feat, dtype=np.int64), np.asarray(thr, dtype=np.float64), np.asarray(left, dtype=np.int64),
            np.asarray(right, dtype=np.int64), np.array([_c(s) for s in size], dtype=np.float64))


def fit_isolation_forest(df: DataFrame, features: list[str], trees: int = 100, seed: int = 42,
                         sample_size: int = SAMPLE_SIZE) -> dict:
    """Fit the forest on a bounded sample; returns broadcastable flat trees."""
    n = df.count()
    psi = min(sample_size, n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    # Trees a row joins: `joins` on average, its fraction settled by chance; rows beyond psi per tree go by rank.
    joins = min(float(trees), 2.0 * psi * trees / max(n, 1))
    whole = math.floor(joins)
    drawn = (df.select(*features, (F.lit(whole) + (F.rand(seed) < joins - whole).cast("int")).alias("_k"))
             .where("_k > 0"))
    mixed = F.shuffle(F.sequence(F.lit(0), F.lit(trees - 1)), seed + 1)
    tagged = (drawn.withColumn("_tree", F.explode(F.slice(mixed, 1, F.col("_k")))).drop("_k")
              .withColumn("_u", F.rand(seed + 2)))
    w = Window.partitionBy("_tree").orderBy("_u")
    per_tree = tagged.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r", "_u")
    d = len(features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["_tree"].iloc[0])
        x = pdf[features].to_numpy(dtype=np.float64)
        rng = np.random.default_rng(seed * 100003 + tree_id)
        feat, thr, left, right, size = _grow(x, rng, max_depth)
        return pd.DataFrame({"tree": [tree_id], "feat": [feat], "thr": [thr], "left": [left], "right": [right],
                             "size": [size]})

    schema = "tree int, feat array<int>, thr array<double>, left array<int>, right array<int>, size array<int>"
    rows = per_tree.groupBy("_tree").applyInPandas(build, schema).collect()
    forest = [(r["feat"], r["thr"], r["left"], r["right"], r["size"]) for r in sorted(rows, key=lambda r: r["tree"])]
    arrays = [_as_arrays(t) for t in forest]
    return {"trees": forest, "arrays": arrays, "psi": psi, "features": features, "dims": d}


def score_isolation_forest(df: DataFrame, model: dict, out_col: str = "iso_score") -> DataFrame:
    """Add ``out_col`` = 2^(−E[h]/c(ψ)) (higher = more anomalous) with a pandas UDF."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(model)
    feats = model["features"]

    @F.pandas_udf(T.DoubleType())
    def score(batch: pd.DataFrame) -> pd.Series:
        m = bc.value
        x = batch.to_numpy(dtype=np.float64)
        total = np.zeros(x.shape[0])
        for tree in m["arrays"]:
            total += _path_lengths(x, tree)
        return pd.Series(np.power(2.0, -(total / len(m["arrays"])) / _c(m["psi"])))

    return spread_for_python(df).withColumn(out_col, score(F.struct(*[F.col(c) for c in feats])))


def spread_for_python(df: DataFrame) -> DataFrame:
    """Round-robin repartition before CPU-heavy Python work, only when the input has
    fewer partitions than the cluster can run at once (e.g. one large file split).
    Large inputs already arrive in many partitions and are left as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def _prepared(df: DataFrame, features: list[str], scale: bool) -> tuple[DataFrame, list[str]]:
    """Median-fill (and optionally standardise) features into ``__f{i}`` columns."""
    # One pass: nulls per feature, plus mean/std (valid as is when nothing needs filling).
    probe = df.agg(*[F.struct(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("z"),
                              F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features]).first()
    holes = [c for c in features if probe[c]["z"] > 0]
    med = medians(df, holes) if holes else {}
    exprs = [(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(med[c])) if c in med
              else F.col(c).cast("double")).alias(f"__f{i}") for i, c in enumerate(features)]
    out = df.select("*", *exprs)
    names = [f"__f{i}" for i in range(len(features))]
    if scale:
        if holes:
            st = out.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in names]).first()
            moments = {c: (st[c]["m"], st[c]["s"]) for c in names}
        else:
            moments = {f"__f{i}": (probe[c]["m"], probe[c]["s"]) for i, c in enumerate(features)}
        for c in names:
            m, sd = moments[c]
            out = out.withColumn(c, (F.col(c) - F.lit(m)) / F.lit(sd or 1.0))
    return out, names


def isolation_forest_flags(df: DataFrame, features: list[str], trees: int = 100, contamination: float | None = 0.05,
                           seed: int = 42, scale: bool = False) -> DataFrame:
    """Rows with ``iso_score`` and ``is_outlier``.

    ``contamination=None`` is the default rule (score > 0.5); otherwise the
    top ``contamination`` share by score is flagged (exact quantile).
    """
    prepared, names = _prepared(df, features, scale)
    model = fit_isolation_forest(prepared, names, trees=trees, seed=seed)
    from ledgerline.session import cut_lineage
    scored = cut_lineage(score_isolation_forest(prepared, model))  # scored once, read by every pass
    if contamination is None:
        cut = 0.5
        flagged = scored.withColumn("is_outlier", F.col("iso_score") > F.lit(cut))
    else:
        cut = exact_quantiles(scored, "iso_score", [1.0 - contamination])[0]
        flagged = scored.withColumn("is_outlier", F.col("iso_score") > F.lit(cut))
    return flagged.drop(*names)


def risk_scores(df: DataFrame, score_col: str = "iso_score") -> DataFrame:
    """AN2: 0–100 risk = inverted min-max of the normality score; all equal → 50.

    The forest score here grows with anomaly, so risk = (s − min)/(max − min)·100.
    """
    st = df.agg(F.min(score_col).alias("lo"), F.max(score_col).alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    if lo is None or hi - lo <= 0:
        return df.withColumn("risk_score", F.lit(50.0))
    return df.withColumn("risk_score", F.round((F.col(score_col) - F.lit(lo)) / F.lit(hi - lo) * 100, 2))


def local_outliers(df: DataFrame, features: list[str], contamination: float = 0.05, neighbours: int = 20) -> DataFrame:
    """AN3: rows with ``lof`` (over median-filled, standardised features) and ``is_outlier``.

    The top ``contamination`` share by factor is flagged (exact quantile).
    Nulls and NaN take the median, a column without any value takes 0.
    """
    prepared, names = _prepared(df, features, scale=True)
    scored = local_outlier_factor(prepared.fillna(0.0, subset=names), names, neighbours)
    from ledgerline.session import cut_lineage
    scored = cut_lineage(scored.drop(*names))
    cut = exact_quantiles(scored, "lof", [1.0 - contamination])[0]
    return scored.withColumn("is_outlier", F.col("lof") > F.lit(cut))


def reconstruction_errors(df: DataFrame, features: list[str], seed: int = 42) -> tuple[DataFrame, list[str]]:
    """AN4: PCA with k = min(max(2, d//2), d−1) on standardised features.

    Adds ``recon_error`` (mean squared residual) and per-feature squared
    residuals ``__e{i}``. The d×k loading matrix is tiny and folded into
    column expressions, so scoring stays inside whole-stage codegen.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    prepared, names = _prepared(df, features, scale=True)
    d = len(names)
    if d < 2:
        raise ValueError("reconstruction error needs at least 2 features")
    k = min(max(2, d // 2), d - 1)
    vec = VectorAssembler(inputCols=names, outputCol="__v").transform(prepared)
    pc = PCA(k=k, inputCol="__v", outputCol="__p").fit(vec).pc.toArray()  # d × k
    proj = [sum(F.col(names[j]) * float(pc[j, i]) for j in range(d)) for i in range(k)]
    out = prepared
    for i in range(k):
        out = out.withColumn(f"__z{i}", proj[i])
    errs = []
    for j in range(d):
        recon = sum(F.col(f"__z{i}") * float(pc[j, i]) for i in range(k))
        out = out.withColumn(f"__e{j}", F.pow(F.col(names[j]) - recon, 2))
        errs.append(F.col(f"__e{j}"))
    out = out.withColumn("recon_error", sum(errs) / float(d)).drop(*[f"__z{i}" for i in range(k)])
    return out, names


def anomalies(df: DataFrame, features: list[str], key: str, contamination: float = 0.05, trees: int = 100,
              seed: int = 42, top: int | None = 100) -> DataFrame:
    """AN5 ensemble: forest flag OR local-outlier flag OR reconstruction-error flag; keep flagged or risk > 70.

    Output per kept row: key, risk score, reconstruction error, flags and the
    three features with the largest squared residual. ``top`` keeps the
    highest-risk rows (a top-k report); ``None`` keeps all.
    """
    feats = [c for c in features if c in df.columns and C.is_numeric(df.schema[c].dataType)]
    n = df.count()
    if not feats or n < 5:
        raise ValueError("Insufficient numerical data points for anomaly detection.")
    base = df.select(key, *feats)
    if len(feats) >= 2:
        recon, names = reconstruction_errors(base, feats, seed)
    else:
        recon, names = _prepared(base, feats, scale=True)
        recon = recon.withColumn("__e0", F.lit(0.0)).withColumn("recon_error", F.lit(0.0))
    model = fit_isolation_forest(recon, names, trees=trees, seed=seed)
    scored = score_isolation_forest(recon, model)
    scored = local_outlier_factor(scored.fillna(0.0, subset=names), names, 20)
    from ledgerline.session import cut_lineage
    scored = cut_lineage(scored)  # scores feed several passes below
    iso_cut = exact_quantiles(scored, "iso_score", [1.0 - contamination])[0]
    lof_cut = exact_quantiles(scored, "lof", [1.0 - contamination])[0]
    err_cut = exact_quantiles(scored, "recon_error", [1.0 - contamination])[0]
    flagged = (scored.withColumn("iso_flag", F.col("iso_score") > F.lit(iso_cut))
               .withColumn("lof_flag", F.col("lof") > F.lit(lof_cut))
               .withColumn("recon_flag", F.col("recon_error") >= F.lit(err_cut))
               .withColumn("is_anomaly", F.col("iso_flag") | F.col("lof_flag") | F.col("recon_flag")))
    flagged = risk_scores(flagged)
    factors = F.array(*[F.struct(F.col(f"__e{i}").alias("e"), F.lit(f).alias("feature"))
                        for i, f in enumerate(feats)])
    top3 = F.slice(F.sort_array(factors, asc=False), 1, 3)
    kept = flagged.where(F.col("is_anomaly") | (F.col("risk_score") > 70)).select(
        key, "risk_score", F.round("recon_error", 4).alias("reconstruction_error"), "iso_flag", "lof_flag",
        "recon_flag", "is_anomaly",
        F.transform(top3, lambda s: F.concat(s["feature"], F.lit(" (Error: "),
                                             F.format_number(s["e"], 3), F.lit(")"))).alias("contributing_factors"))
    if top is not None:
        kept = kept.orderBy(F.desc("risk_score"), F.asc(key)).limit(top)
    return kept


def anomaly_summary(df: DataFrame, features: list[str], key: str, contamination: float = 0.05, trees: int = 100,
                    seed: int = 42) -> DataFrame:
    """Counts of the ensemble: rows analysed, anomalies, anomaly %."""
    all_rows = anomalies(df, features, key, contamination, trees, seed, top=None)
    n = df.count()
    k = all_rows.where("is_anomaly").count()
    return df.sparkSession.createDataFrame(
        [(n, k, round(k / n * 100, 2) if n else 0.0, ",".join(features), contamination)],
        "total_rows_analyzed bigint, anomaly_count bigint, anomaly_percentage double, features_used string, "
        "contamination_parameter double")
