"""Chart aggregates: group-by, pivot, scatter points, box summaries (AGG9–AGG12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.quantiles import grouped_quantiles

# Aggregation names accepted by the chart API.
AGGREGATIONS = {"SUM": "sum", "AVG": "mean", "COUNT": "count", "MIN": "min", "MAX": "max", "MEDIAN": "median"}


def _agg_expr(name: str, y):
    kind = AGGREGATIONS.get(name.upper(), "mean")
    if kind == "sum":
        return F.coalesce(F.sum(y), F.lit(0.0))
    if kind == "mean":
        return F.avg(y)
    if kind == "count":
        return F.count(y).cast("double")
    if kind == "min":
        return F.min(y)
    if kind == "max":
        return F.max(y)
    return F.median(y)


def _num(y: str):
    return F.expr(f"try_cast(`{y}` AS DOUBLE)")


def chart(df: DataFrame, x: str, y: str, agg: str = "SUM", limit: int = 50) -> DataFrame:
    """``agg(y) by x``: null keys dropped, 2 dp, key order, first ``limit`` keys.

    MEDIAN uses the distributed exact grouped quantile, so a dominant key is
    not merged in one task.
    """
    if AGGREGATIONS.get(agg.upper(), "mean") == "median":
        base = df.where(F.col(x).isNotNull()).select(x, _num(y).alias("_y"))
        med = grouped_quantiles(base, x, "_y", [0.5]).select(x, F.round("value", 2).alias("value"))
        keys = base.select(x).distinct()
        g = keys.join(med, x, "left")
    else:
        g = (df.where(F.col(x).isNotNull()).groupBy(x)
             .agg(F.round(_agg_expr(agg, _num(y)), 2).alias("value")))
    return g.orderBy(x).limit(limit).select(F.col(x).cast("string").alias("label"), "value")


def chart_series(df: DataFrame, x: str, by: str, y: str, agg: str = "SUM") -> DataFrame:
    """Two-key aggregate in long form (label, series, value; 2 dp), for any number of series; holes have no row."""
    return (df.where(F.col(x).isNotNull() & F.col(by).isNotNull()).groupBy(x, by)
            .agg(F.round(F.coalesce(_agg_expr(agg, _num(y)), F.lit(0.0)), 2).alias("value"))
            .select(F.col(x).cast("string").alias("label"), F.col(by).cast("string").alias("series"), "value"))


def pivot_values(df: DataFrame, by: str) -> list:
    """Distinct series names, sorted: the columns of the wide form."""
    return sorted(r[0] for r in df.where(F.col(by).isNotNull()).select(by).distinct().collect())


def chart_pivot(df: DataFrame, x: str, by: str, y: str, agg: str = "SUM") -> DataFrame:
    """Two-key aggregate, one column per ``by`` value; holes are 0 (2 dp).

    The wide form is for series that fit in a schema; ``chart_series`` has no such bound.
    """
    vals = pivot_values(df, by)
    g = (df.where(F.col(x).isNotNull() & F.col(by).isNotNull())
         .groupBy(x).pivot(by, vals).agg(_agg_expr(agg, _num(y))))
    names = [str(v) for v in vals]
    return g.select(F.col(x).cast("string").alias("label"),
                    *[F.round(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)), 2).alias(n) for n in names])


def scatter(df: DataFrame, x: str, y: str, order_by: str | None = None, limit: int = 500,
            fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Up to ``limit`` non-null (x, y) points: first by key order, or a seeded sample."""
    pts = df.select(*([order_by] if order_by and order_by not in (x, y) else []), x, y).dropna(subset=[x, y])
    if fraction is not None:
        pts = pts.sample(fraction=fraction, seed=seed)
    if order_by:
        pts = pts.orderBy(order_by)
    return pts.limit(limit)


def box_summary(df: DataFrame, x: str, y: str, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Five-number summary of ``y`` per ``x`` group, plus count.

    Exact mode uses the distributed grouped quantile (running counts per
    value range, so a dominant group is spread over many tasks);
    ``exact=False`` uses the bounded-memory sketch in one aggregation.
    """
    base = df.where(F.col(x).isNotNull()).select(x, _num(y).alias("_y"))
    g = base.groupBy(x).agg(F.count("_y").alias("n"), F.min("_y").alias("min"), F.max("_y").alias("max"))
    if exact:
        q = grouped_quantiles(base, x, "_y", [0.25, 0.5, 0.75])
        wide = q.groupBy(x).agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n)
                                  for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
        g = g.join(wide, x, "left")
    else:
        s = base.groupBy(x).agg(F.percentile_approx("_y", [0.25, 0.5, 0.75], accuracy).alias("_q"))
        g = g.join(s.select(x, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                            F.col("_q")[2].alias("q3")), x, "left")
    return g.select(F.col(x).cast("string").alias("label"), "n", F.round("min", 4).alias("min"),
                    F.round("q1", 4).alias("q1"), F.round("median", 4).alias("median"),
                    F.round("q3", 4).alias("q3"), F.round("max", 4).alias("max"))
