"""Summary statistics, correlations, missing map and histograms (AGG1–AGG8, AGG15)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import columns as C
from ledgerline.functions.exprs import half_up, skewness_adjusted
from ledgerline.functions.quantiles import column_quantiles, medians
from ledgerline.operators.profile import _is_missing, value_counts_long


def _clean_num(c: str):
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


# ---------------------------------------------------------------- AGG1
def numeric_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per numeric column: mean, std (sample), min, max, median, skew, q25, q75 (2 dp)."""
    cols = C.numeric_columns(df)
    spark = df.sparkSession
    schema = ("column string, mean double, std double, min double, max double, median double, "
              "skewness double, q25 double, q75 double")
    if not cols:
        return spark.createDataFrame([], schema)
    clean = df.select(*[_clean_num(c).alias(c) for c in cols])
    moments = [F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
                        F.max(c).alias("max"), skewness_adjusted(c).alias("skew"),
                        F.count(c).alias("n")).alias(f"__m_{c}") for c in cols]
    if exact:  # the moments ride along in the quantiles' first pass
        qs = column_quantiles(clean, cols, [0.25, 0.5, 0.75], exact, extra=moments)
        first = qs.pop("__extra__")
        row = {c: first[f"__m_{c}"] for c in cols}
    else:
        first = clean.agg(*moments).first()
        row = {c: first[f"__m_{c}"] for c in cols}
        qs = column_quantiles(clean, cols, [0.25, 0.5, 0.75], exact)
    r2 = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else half_up(float(v), 2)
    out = []
    for c in cols:
        s = row[c]
        q25, med, q75 = qs[c]
        skew = 0.0 if s["n"] == 0 else r2(s["skew"])
        out.append((c, r2(s["mean"]), r2(s["std"]), r2(s["min"]), r2(s["max"]), r2(med), skew, r2(q25), r2(q75)))
    return spark.createDataFrame(out, schema)


# ---------------------------------------------------------------- AGG2 / AGG8
def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Top-k values per column by count (ties: lower value first), with rank."""
    vc = value_counts_long(df, columns)
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def categorical_summary(df: DataFrame, k: int = 10) -> DataFrame:
    """Per non-numeric column: distinct count, mode and the top-k value counts."""
    cols = C.non_numeric_columns(df)
    vc = value_counts_long(df, cols)
    per_col = vc.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.min(F.struct((-F.col("count")).alias("neg"), F.col("value"))).getField("value").alias("most_frequent"))
    top = top_values(df, cols, k)
    return top.join(per_col, "column").select("column", "unique_count", "most_frequent", "value", "count", "rank")


def category_distribution(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """AGG8: top-k categories by count."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("label")).limit(k))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """AGG15: count and share (%) per class."""
    g = df.groupBy(F.col(column).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = df.count()  # one number; no single-task window over the classes
    return g.select("class", "count", F.round(F.col("count") / F.lit(total) * 100, 2).alias("percentage"))


# ---------------------------------------------------------------- AGG3 / AGG4
def _corr_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations from plain sums (two cheap passes).

    Values are shifted by their column mean first, so sums of products stay
    small and the closed form is numerically stable; each pair only counts
    rows where both values are present.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    sh = {c: F.col(c).cast("double") - F.lit(means[c] or 0.0) for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, sh[a]), F.when(both, sh[b])
        aggs.append(F.struct(F.count_if(both).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                             F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
                    .alias(f"p{i}"))
    row = df.agg(*aggs).first()
    out = []
    for i, (a, b) in enumerate(pairs):
        r = row[f"p{i}"]
        n = r["n"]
        v = None
        if n and n > 1:
            vx = n * r["sxx"] - r["sx"] ** 2
            vy = n * r["syy"] - r["sy"] ** 2
            if vx > 0 and vy > 0:
                v = (n * r["sxy"] - r["sx"] * r["sy"]) / math.sqrt(vx * vy)
                v = max(-1.0, min(1.0, v))
        v = 0.0 if v is None else half_up(float(v), 3)
        out.append((a, b, v))
        if a != b:
            out.append((b, a, v))
    return df.sparkSession.createDataFrame(out, "column_x string, column_y string, correlation double")


def correlation(df: DataFrame, fill: str | None = "median", exact: bool = True) -> DataFrame:
    """Pearson matrix (long form) after median fill; NaN → 0; needs ≥ 2 numeric columns."""
    cols = C.numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column_x string, column_y string, correlation double")
    base = df.select(*[_clean_num(c).alias(c) for c in cols])
    if fill == "median":
        med = medians(base, cols, exact)
        base = base.select(*[F.coalesce(F.col(c), F.lit(med[c])).alias(c) if med[c] is not None else F.col(c)
                             for c in cols])
    return _corr_long(base, cols)


def correlation_pairwise(df: DataFrame) -> DataFrame:
    """AGG4 heat map: pairwise-complete correlations, no fill."""
    return correlation(df, fill=None)


# ---------------------------------------------------------------- AGG5
def missing_map(df: DataFrame, key: str, max_rows: int = 500) -> DataFrame:
    """For the first ``max_rows`` rows in key order: row position and null column indices."""
    cols = df.columns
    flags = F.array(*[F.when(_is_missing(df, c), F.lit(i)) for i, c in enumerate(cols)])
    head = df.orderBy(key).limit(max_rows)  # top-k: bounded per partition
    w = Window.orderBy(key)
    return (head.select(F.col(key), F.filter(flags, lambda x: x.isNotNull()).alias("_cols"))
            .withColumn("row", F.row_number().over(w) - 1)
            .where(F.size("_cols") > 0)
            .select("row", F.array_join("_cols", ",").alias("cols")))


# ---------------------------------------------------------------- AGG6 / AGG7
def histogram_plan(df: DataFrame, column: str, bins="auto", exact: bool = True) -> dict | None:
    """Bin count and edges following NumPy's ``histogram`` rules."""
    x = _clean_num(column)
    st = df.select(x.alias("v")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, lo, hi = st["n"], st["lo"], st["hi"]
    if not n:
        return None
    first, last = float(lo), float(hi)
    if first == last:
        first, last = first - 0.5, last + 0.5
    if bins == "auto":
        ptp = float(hi) - float(lo)
        sturges = ptp / (math.log2(n) + 1.0)
        q25, q75 = column_quantiles(df.select(x.alias(column)), [column], [0.25, 0.75], exact)[column]
        fd = 2.0 * (q75 - q25) * n ** (-1.0 / 3.0)
        sqrt_w = ptp / math.sqrt(n)
        # NumPy 'auto': Sturges vs. Freedman–Diaconis floored at half the sqrt rule.
        width = min(max(fd, sqrt_w / 2), sturges)
        if width < 1 and isinstance(df.schema[column].dataType, T.IntegralType):
            width = 1.0 if width else width  # whole numbers get bins of at least one
        nbins = int(math.ceil((last - first) / width)) if width else 1
    else:
        nbins = int(bins)
    return {"n": n, "first": first, "last": last, "bins": nbins}


def histogram(df: DataFrame, column: str, bins="auto", exact: bool = True) -> DataFrame:
    """Counts per equal-width bin (empty bins included): bin, bin_lo, bin_hi, count."""
    spark = df.sparkSession
    plan = histogram_plan(df, column, bins, exact)
    schema = "bin int, bin_lo double, bin_hi double, count bigint"
    if plan is None:
        return spark.createDataFrame([], schema)
    nb, first, last = plan["bins"], plan["first"], plan["last"]
    step = (last - first) / nb

    def edge(i):
        return F.when(i == F.lit(nb), F.lit(last)).otherwise(i.cast("double") * F.lit(step) + F.lit(first))

    v = F.col("v")
    idx0 = F.floor((v - F.lit(first)) / F.lit(last - first) * F.lit(nb)).cast("int")
    idx1 = F.when(idx0 == nb, F.lit(nb - 1)).otherwise(idx0)
    idx2 = F.when(v < edge(idx1), idx1 - 1).otherwise(idx1)
    idx3 = F.when((v >= edge(idx2 + 1)) & (idx2 != nb - 1), idx2 + 1).otherwise(idx2)
    counts = (df.select(_clean_num(column).alias("v")).where(v.isNotNull())
              .groupBy(idx3.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    all_bins = spark.range(nb).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(counts, "bin", "left")
            .select("bin", F.round(edge(F.col("bin")), 2).alias("bin_lo"),
                    F.round(edge(F.col("bin") + 1), 2).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def distribution(df: DataFrame, column: str, bins="auto", k: int = 20) -> DataFrame:
    """AGG6/AGG8: histogram for numeric columns, top-k counts for the rest."""
    if C.is_numeric(df.schema[column].dataType):
        return histogram(df, column, bins)
    return category_distribution(df, column, k)
