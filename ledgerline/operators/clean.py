"""Cleaning: imputation, de-duplication, percentile clipping (DQ9–DQ13, FE5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import columns as C
from ledgerline.functions.quantiles import column_quantiles, medians
from ledgerline.operators.profile import _is_missing, value_counts_long

# Feature-engineering suggestion texts.
ACTION_CLIPPED = "Clipped extreme outliers to 1st and 99th percentiles."
SUGGEST_DATETIME = "Extract Year, Month, Day, and Day of Week from '{column}' to capture seasonality."
SUGGEST_ONE_HOT = "One-hot encode categorical feature '{column}' for machine learning algorithms."
SUGGEST_LOG = "Apply log transform to skewed numerical column '{column}' (skewness: {skew})."


def missing_counts(df: DataFrame) -> dict[str, int]:
    row = df.agg(*[F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return {c: int(row[f"m{i}"]) for i, c in enumerate(df.columns)}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value per column, lowest value on ties (pandas ``mode()[0]``).

    Distributed: value counts per (column, value), then a per-column
    ``min(struct(-count, value))`` aggregate, so no column is gathered whole.
    """
    if not columns:
        return {}
    vc = value_counts_long(df, columns)
    best = vc.groupBy("column").agg(F.min(F.struct((-F.col("count")).alias("neg"), F.col("value"))).alias("b"))
    return {r["column"]: r["b"]["value"] for r in best.collect()}


def impute_counts(df: DataFrame) -> DataFrame:
    """Columns that had missing values and how many were filled."""
    counts = missing_counts(df)
    data = [(c, n) for c, n in counts.items() if n > 0]
    return df.sparkSession.createDataFrame(data, "column string, imputed bigint")


def impute(df: DataFrame, exact: bool = True, fallback: str = "Unknown",
           categorical_fill: str | None = None) -> DataFrame:
    """Fill numerics with the median, other columns with the mode (``fallback`` if none).

    Numeric columns that had nulls become double, as pandas loads them.
    ``categorical_fill`` replaces the mode by a constant (scoring fill, FE5).
    """
    counts = missing_counts(df)
    holes = [c for c, n in counts.items() if n > 0]
    if not holes:
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in holes if C.is_numeric(types[c])]
    other = [c for c in holes if c not in num]
    med = medians(df, num, exact) if num else {}
    mode = {} if categorical_fill is not None else modes(df, other)
    out = df
    for c in num:
        v = med.get(c)
        col = F.col(c).cast("double")
        col = F.when(F.isnan(col), F.lit(None)).otherwise(col)
        out = out.withColumn(c, F.coalesce(col, F.lit(v).cast("double")) if v is not None else col)
    for c in other:
        v = categorical_fill if categorical_fill is not None else mode.get(c)
        if v is None:
            v = fallback
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(v)))
        else:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(types[c])))
    return out


def scoring_fill(df: DataFrame, exact: bool = True) -> DataFrame:
    """FE5: numerics → median, every other column → ``Unknown``."""
    return impute(df, exact=exact, categorical_fill="Unknown")


def dedup(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (nulls compare equal)."""
    return df.dropDuplicates()


def dedup_count(df: DataFrame) -> DataFrame:
    before = df.count()
    after = dedup(df).count()
    return df.sparkSession.createDataFrame([(before, after, before - after)],
                                           "rows_before bigint, rows_after bigint, removed bigint")


def clip_bounds(df: DataFrame, lo: float = 0.01, hi: float = 0.99, exact: bool = True) -> dict[str, tuple]:
    num = C.numeric_columns(df)
    qs = column_quantiles(df, num, [lo, hi], exact)
    return {c: (v[0], v[1]) for c, v in qs.items()}


def clip_outliers(df: DataFrame, lo: float = 0.01, hi: float = 0.99, exact: bool = True,
                  min_rows: int = 10) -> DataFrame:
    """Clip every numeric column to its [lo, hi] quantiles (skipped below ``min_rows``)."""
    num = C.numeric_columns(df)
    if not num or df.count() < min_rows:
        return df
    bounds = clip_bounds(df, lo, hi, exact)
    out = df
    for c in num:
        a, b = bounds[c]
        col = F.col(c).cast("double")
        if a is not None and b is not None:
            col = F.when(col.isNull(), col).otherwise(F.least(F.greatest(col, F.lit(a)), F.lit(b)))
        out = out.withColumn(c, col)
    return out


def clean(df: DataFrame, exact: bool = True) -> DataFrame:
    """Full cleaning: de-duplicate → impute → clip to the 1 %/99 % quantiles.

    The de-duplicated table is cut from its lineage (checkpoint in the shared
    folder), so the statistics passes below do not recompute the shuffle.
    """
    from ledgerline.session import cut_lineage
    deduped = cut_lineage(dedup(df))
    filled = impute(deduped, exact)
    return clip_outliers(filled, exact=exact)


def clean_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, missing cells and duplicates before and after cleaning."""
    from ledgerline.operators.profile import Measured

    def facts(d):
        m = Measured(d)
        return m.rows, m.missing, m.duplicates
    b, a = facts(before), facts(after)
    return before.sparkSession.createDataFrame(
        [("rows", b[0], a[0]), ("missing_cells", b[1], a[1]), ("duplicate_rows", b[2], a[2])],
        "metric string, before bigint, after bigint")


def clean_report(df: DataFrame, trees: int = 100, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """One row on a full cleaning: duplicates removed, cells filled per column, outlying rows, quality before and after.

    Outlying rows are those an isolation forest over the standardised numbers
    flags before clipping; below 10 rows, or without numbers, nothing is clipped
    and their count is null.
    """
    from ledgerline.operators import anomaly
    from ledgerline.operators.profile import quality
    from ledgerline.session import cut_lineage
    deduped = cut_lineage(dedup(df))
    rows = deduped.count()
    imputed = {c: n for c, n in missing_counts(deduped).items() if n > 0}
    filled = cut_lineage(impute(deduped))
    num = [c for c in C.numeric_columns(filled) if not filled.where(F.col(c).isNotNull()).isEmpty()]
    outliers = None
    if num and rows >= 10:
        flagged = anomaly.isolation_forest_flags(filled.select(*num), num, trees=trees, contamination=contamination,
                                                 seed=seed, scale=True)
        outliers = flagged.where("is_outlier").count()
    cleaned = cut_lineage(clip_outliers(filled))
    scores = [quality(d, seed=seed).first()["score"] for d in (df, cleaned)]
    return df.sparkSession.createDataFrame(
        [(df.count(), rows, imputed, outliers, ACTION_CLIPPED if outliers is not None else None, *scores)],
        "rows_before bigint, rows_after bigint, imputed map<string, bigint>, outliers_detected bigint, action string, "
        "score_before double, score_after double")


def suggest_features(df: DataFrame, prof: DataFrame | None = None) -> DataFrame:
    """Date extraction, one-hot (2 < distinct < 15) and log (distinct > 100, |skew| > 1.5)."""
    from ledgerline.functions.exprs import half_up, skewness_adjusted
    from ledgerline.operators.profile import profile
    prof = prof if prof is not None else profile(df)
    info = prof.collect()
    skew_cols = [r["column"] for r in info if r["semantic_type"] == "numerical" and r["distinct_count"] > 100]
    skews = df.agg(*[skewness_adjusted(c).alias(c) for c in skew_cols]).first() if skew_cols else {}
    out = []
    for r in info:
        c = r["column"]
        if r["semantic_type"] == "datetime":
            out.append((c, "datetime_extraction",
                        SUGGEST_DATETIME.format(column=c), None))
        elif r["semantic_type"] == "categorical" and 2 < r["distinct_count"] < 15:
            out.append((c, "one_hot_encoding",
                        SUGGEST_ONE_HOT.format(column=c), None))
        elif c in skew_cols and skews[c] is not None and abs(skews[c]) > 1.5:
            s = half_up(skews[c], 2)
            out.append((c, "log_transformation",
                        SUGGEST_LOG.format(column=c, skew=s), s))
    return df.sparkSession.createDataFrame(out, "column string, type string, suggestion string, skewness double")


