"""Business questions: ranking, period change, trend and KPI root cause.

All work is aggregation: the big table is reduced once per question (with
map-side partial aggregation), and anything after that runs on the reduced
table, whose size is bounded by the number of months or segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import columns as C
from ledgerline.functions.exprs import as_timestamp, half_up, ts_literal
from ledgerline.functions.ordering import consecutive_index
from ledgerline.session import cut_lineage


def _metric(df: DataFrame, metric: str):
    return F.col(metric).cast("double")


# ---------------------------------------------------------------- BQ2 / BQ8
def monthly(df: DataFrame, metric: str, date: str, fill_gaps: bool = True) -> DataFrame:
    """Monthly sums labelled by month end; empty months are 0 when ``fill_gaps``.

    ``fill_gaps=False`` gives the period group-by form (months with rows only).
    Columns: ``month`` (first day, date), ``month_end`` (yyyy-MM-dd), ``value``.
    """
    ts = as_timestamp(df, date)
    sums = (df.select(ts.alias("_d"), _metric(df, metric).alias("_m"))
            .where(F.col("_d").isNotNull())
            .groupBy(F.trunc(F.col("_d"), "month").alias("month"))
            .agg(F.coalesce(F.sum("_m"), F.lit(0.0)).alias("value")))
    if fill_gaps:
        sums = cut_lineage(sums)  # one row per month; the grid and the values both come from it
        span = sums.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
        months = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
        sums = (months.join(sums, "month", "left")
                .select("month", F.coalesce("value", F.lit(0.0)).alias("value")))
    return sums.select("month", F.date_format(F.last_day("month"), "yyyy-MM-dd").alias("month_end"), "value")


def month_over_month(df: DataFrame, metric: str, date: str) -> DataFrame:
    """Monthly series with % change to the previous month (null when it was 0)."""
    w = Window.orderBy("month")  # over the monthly table: one row per month
    m = monthly(df, metric, date, fill_gaps=True)
    prev = F.lag("value").over(w)
    return m.select("month", "month_end", "value", prev.alias("prev_value"),
                    F.try_divide((F.col("value") - prev) * 100.0, prev).alias("pct_change"))


# ---------------------------------------------------------------- BQ1
def top_segments(df: DataFrame, metric: str, by: str) -> DataFrame:
    """Totals per segment with share of the grand total, ranked (BQ1 chart).

    The per-segment totals are computed once and checkpointed; the grand
    total is one collected number. Ranks are a distributed consecutive index over
    (total desc, segment), whatever the number of segments.
    """
    g = cut_lineage(df.where(F.col(by).isNotNull()).groupBy(by)
                    .agg(F.coalesce(F.sum(_metric(df, metric)), F.lit(0.0)).alias("total")))
    grand = g.agg(F.sum("total").alias("t")).first()["t"] or 0.0
    keyed = g.withColumn("_k", F.struct((-F.col("total")).alias("a"), F.col(by).alias("b")))
    ranked = consecutive_index(keyed, "_k", "_i")
    share = (F.col("total") / F.lit(grand) * 100) if grand > 0 else F.lit(0.0)
    return ranked.select(
        F.col(by).cast("string").alias("segment"),
        F.round("total", 2).alias("total"),
        F.round(share, 1).alias("share_pct"),
        F.round(F.lit(grand), 2).alias("grand_total"),
        (F.col("_i") + 1).cast("int").alias("rank"),
    )


# ---------------------------------------------------------------- BQ3
def biggest_decline(df: DataFrame, metric: str, date: str) -> DataFrame:
    """The month with the most negative month-over-month % change (one row)."""
    mom = month_over_month(df, metric, date).where(F.col("pct_change") < 0)
    w = Window.orderBy(F.asc("pct_change"), F.asc("month"))
    return (mom.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("month", "month_end",
                    F.round("prev_value", 2).alias("prev_value"),
                    F.round("value", 2).alias("value"),
                    F.round(F.col("prev_value") - F.col("value"), 2).alias("abs_drop"),
                    F.round(F.abs("pct_change"), 1).alias("pct_drop")))


# ---------------------------------------------------------------- BQ4 / JN1
def segment_change(df: DataFrame, metric: str, date: str, by: str, prev_month, curr_month,
                   fill_missing: bool = False) -> DataFrame:
    """Per segment: previous-month sum, current-month sum and drop = prev − curr.

    ``fill_missing=False`` keeps segments present in both months (index
    alignment semantics); ``True`` treats a missing side as 0.
    The month bounds are literals, so the date range reaches the Parquet scan.
    """
    ts = as_timestamp(df, date)
    lo, hi = ts_literal(prev_month), ts_literal(_add_month(curr_month))
    prev_lo, curr_lo = ts_literal(prev_month), ts_literal(curr_month)
    rows = (df.select(ts.alias("_d"), F.col(by).alias("_s"), _metric(df, metric).alias("_m"))
            .where((F.col("_d") >= lo) & (F.col("_d") < hi) & F.col("_s").isNotNull()))
    is_prev = (F.col("_d") >= prev_lo) & (F.col("_d") < curr_lo) if str(prev_month) != str(curr_month) else F.lit(False)
    is_curr = F.col("_d") >= curr_lo
    g = rows.groupBy(F.col("_s").cast("string").alias("segment")).agg(
        F.coalesce(F.sum(F.when(is_prev, F.col("_m"))), F.lit(0.0)).alias("previous_value"),
        F.coalesce(F.sum(F.when(is_curr, F.col("_m"))), F.lit(0.0)).alias("current_value"),
        F.count_if(is_prev).alias("_np"), F.count_if(is_curr).alias("_nc"))
    if not fill_missing:
        g = g.where((F.col("_np") > 0) & (F.col("_nc") > 0))
    return g.select("segment", "previous_value", "current_value",
                    (F.col("previous_value") - F.col("current_value")).alias("drop"))


def _add_month(month_start) -> str:
    import datetime as _dt
    d = month_start if isinstance(month_start, _dt.date) else _dt.date.fromisoformat(str(month_start)[:10])
    y, m = (d.year + 1, 1) if d.month == 12 else (d.year, d.month + 1)
    return _dt.date(y, m, 1).isoformat()


def _sub_month(month_start) -> str:
    import datetime as _dt
    d = month_start if isinstance(month_start, _dt.date) else _dt.date.fromisoformat(str(month_start)[:10])
    y, m = (d.year - 1, 12) if d.month == 1 else (d.year, d.month - 1)
    return _dt.date(y, m, 1).isoformat()


def decline_drilldown(df: DataFrame, metric: str | None = None, date: str | None = None,
                      by: str | None = None) -> DataFrame:
    """BQ4: the segment that lost most in the worst month vs. its predecessor."""
    roles = C.business_columns(df)
    metric = metric or roles["sales"] or roles["profit"]
    date = date or roles["date"]
    by = by or roles["product"] or roles["region"]
    worst = biggest_decline(df, metric, date).select("month").first()
    if worst is None:
        return _empty_drill(df.sparkSession)
    month = worst["month"]
    seg = segment_change(df, metric, date, by, _sub_month(month), month).where(F.col("drop") > 0)
    return (seg.orderBy(F.desc("drop"), F.asc("segment")).limit(1)  # distributed top-1
            .select(F.lit(by).alias("dimension"), "segment", F.round("drop", 2).alias("segment_drop"),
                    F.date_format(F.last_day(F.lit(month)), "yyyy-MM-dd").alias("month_end")))


def _empty_drill(spark):
    schema = "dimension string, segment string, segment_drop double, month_end string"
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- BQ5
def trend_projection(df: DataFrame, metric: str, date: str) -> DataFrame:
    """OLS on the month index of monthly sums; next month ± 1.96·σ (σ population)."""
    return project_months(monthly(df, metric, date, fill_gaps=False))


def project_months(m: DataFrame) -> DataFrame:
    """``trend_projection`` of a ``monthly`` table; no row below three months."""
    w = Window.orderBy("month")
    whole = Window.partitionBy()
    idx = (F.row_number().over(w) - 1).cast("double")
    base = m.select("month", "value", idx.alias("x"))
    fitted = base.select(
        "month", "value", "x",
        F.regr_slope("value", "x").over(whole).alias("slope"),
        F.regr_intercept("value", "x").over(whole).alias("intercept"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.max("month").over(whole).alias("last_month"),
    )
    resid = fitted.withColumn("res", F.col("value") - (F.col("intercept") + F.col("slope") * F.col("x")))
    out = resid.groupBy().agg(
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"),
        F.first("n").alias("n"), F.first("last_month").alias("last_month"),
        F.stddev_pop("res").alias("std_err"))
    pred = F.col("intercept") + F.col("slope") * F.col("n")
    return out.where(F.col("n") >= 3).select(
        F.date_format(F.add_months("last_month", 1), "MMMM yyyy").alias("next_month"),
        F.round(pred, 2).alias("prediction"),
        F.round(F.greatest(F.lit(0.0), pred - 1.96 * F.col("std_err")), 2).alias("lower"),
        F.round(pred + 1.96 * F.col("std_err"), 2).alias("upper"),
        F.round("slope", 4).alias("slope"),
        F.round("intercept", 2).alias("intercept"),
    )


# ---------------------------------------------------------------- BQ6 / BQ7
def bottom_segments(df: DataFrame, metric: str, by: str, k: int = 10) -> DataFrame:
    g = (df.where(F.col(by).isNotNull()).groupBy(by)
         .agg(F.coalesce(F.sum(_metric(df, metric)), F.lit(0.0)).alias("total")))
    return (g.orderBy(F.asc("total"), F.asc(by)).limit(k)
            .select(F.col(by).cast("string").alias("segment"), F.round("total", 2).alias("total")))


def top_products(df: DataFrame, metric: str, by: str, k: int = 5) -> DataFrame:
    g = (df.where(F.col(by).isNotNull()).groupBy(by)
         .agg(F.coalesce(F.sum(_metric(df, metric)), F.lit(0.0)).alias("total")))
    return (g.orderBy(F.desc("total"), F.asc(by)).limit(k)
            .select(F.col(by).cast("string").alias("segment"), F.round("total", 2).alias("total")))


# ---------------------------------------------------------------- BQ8
def last_month_growth(df: DataFrame, metric: str, date: str) -> DataFrame:
    mom = month_over_month(df, metric, date)
    w = Window.orderBy(F.desc("month"))
    last = mom.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return last.where(F.col("prev_value").isNotNull()).select(
        "month_end",
        F.round("pct_change", 1).alias("growth_pct"),
        F.when(F.col("pct_change") > 0, "increase").otherwise("decline").alias("direction"))


# ---------------------------------------------------------------- BQ10
def low_cardinality_columns(df: DataFrame, candidates: list[str], threshold: int = 15) -> dict[str, int]:
    """Exact distinct counts for columns that might have fewer than ``threshold``.

    One sketch pass screens out clearly high-cardinality columns first, so the
    exact distinct counting only runs on columns whose groups are tiny.
    """
    if not candidates:
        return {}
    approx = df.select(*[F.approx_count_distinct(F.col(c), 0.02).alias(c) for c in candidates]).first()
    maybe = [c for c in candidates if approx[c] < threshold * 4]
    if not maybe:
        return {}
    exact = df.select(*[F.count_distinct(F.col(c)).alias(c) for c in maybe]).first()
    return {c: int(exact[c]) for c in maybe}


def choose_dimensions(df: DataFrame, metric: str, date: str, threshold: int = 15) -> list[tuple[str, str]]:
    """String columns, plus other columns with fewer than ``threshold`` distinct values."""
    dims = [(c, "categorical") for c in C.string_columns(df) if c not in (metric, date)]
    taken = {c for c, _ in dims}
    rest = [c for c in df.columns if c not in taken and c not in (metric, date)]
    counts = low_cardinality_columns(df, rest, threshold)
    dims += [(c, "low_cardinality") for c in rest if counts.get(c, threshold) < threshold]
    return dims


def dimension_table(df: DataFrame, metric: str, date: str, threshold: int = 15) -> DataFrame:
    dims = choose_dimensions(df, metric, date, threshold)
    schema = T.StructType([T.StructField("dimension", T.StringType()), T.StructField("kind", T.StringType()),
                           T.StructField("position", T.IntegerType())])
    order = {c: i for i, c in enumerate(df.columns)}
    return df.sparkSession.createDataFrame([(c, k, order[c]) for c, k in dims], schema)


# ---------------------------------------------------------------- BQ9
TOTAL = "__total__"


def worst_segments(df: DataFrame, metric: str | None = None, date: str | None = None,
                   dims: list[str] | None = None, fill_missing: bool = False):
    """(best, period, metric): per dimension the segment with the largest fall of the last month, and the totals.

    ``best`` has dimension, segment, previous_value, current_value and drop;
    the dimension ``TOTAL`` holds both months' sums. None without two months
    of rows or without a dimension.

    Jobs: (1) date span plus a distinct-count screen of candidate dimensions,
    (2) exact distinct counts for the few low-cardinality candidates, (3) the
    answer: the two-month slice (a literal date range, pushed into the scan)
    is unpivoted to (dimension, segment) and aggregated once, map-side
    combined; ranking keeps one row per dimension.
    """
    cols = df.columns
    metric = C.resolve_name(cols, metric) or C.find_column(cols, C.ROOT_CAUSE_METRIC_KEYWORDS) \
        or C.numeric_columns(df)[-1]
    date = C.resolve_name(cols, date) or C.find_column(cols, C.ROOT_CAUSE_DATE_KEYWORDS)
    ts = as_timestamp(df, date)
    strings = [c for c in C.string_columns(df) if c not in (metric, date)]
    others = [c for c in cols if c not in strings and c not in (metric, date)] if dims is None else []
    span = df.select(ts.alias("_d"), *others).agg(
        F.min("_d").alias("lo"), F.max("_d").alias("hi"),
        *[F.approx_count_distinct(F.col(c), 0.02).alias(f"a{i}") for i, c in enumerate(others)]).first()
    if span["hi"] is None:
        return None
    curr = span["hi"].date().replace(day=1)
    if span["lo"].date().replace(day=1) >= curr:
        return None  # fewer than two monthly periods
    prev = _sub_month(curr)
    if dims is None:
        maybe = [c for i, c in enumerate(others) if span[f"a{i}"] < 60]
        exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in maybe]).first() if maybe else {}
        low = {c for c in maybe if exact[c] < 15}
        dims = strings + [c for c in others if c in low]
    if not dims:
        return None
    lo, mid, hi = ts_literal(prev), ts_literal(curr.isoformat()), ts_literal(_add_month(curr))
    sliced = (df.select(ts.alias("_d"), _metric(df, metric).alias("_m"),
                        *[F.col(d).cast("string").alias(f"_dim{i}") for i, d in enumerate(dims)])
              .where((F.col("_d") >= lo) & (F.col("_d") < hi)))
    pairs = [F.struct(F.lit(d).alias("dimension"), F.col(f"_dim{i}").alias("segment")) for i, d in enumerate(dims)]
    pairs.append(F.struct(F.lit(TOTAL).alias("dimension"), F.lit("*").alias("segment")))
    long = sliced.select("_d", "_m", F.explode(F.array(*pairs)).alias("kv"))
    is_prev = F.col("_d") < mid
    g = (long.where(F.col("kv.segment").isNotNull())
         .groupBy(F.col("kv.dimension").alias("dimension"), F.col("kv.segment").alias("segment"))
         .agg(F.coalesce(F.sum(F.when(is_prev, F.col("_m"))), F.lit(0.0)).alias("previous_value"),
              F.coalesce(F.sum(F.when(~is_prev, F.col("_m"))), F.lit(0.0)).alias("current_value"),
              F.count_if(is_prev).alias("_np"), F.count_if(~is_prev).alias("_nc")))
    if not fill_missing:
        g = g.where((F.col("dimension") == TOTAL) | ((F.col("_np") > 0) & (F.col("_nc") > 0)))
    g = g.withColumn("drop", F.col("previous_value") - F.col("current_value"))
    w = Window.partitionBy("dimension").orderBy(F.desc("drop"), F.asc("segment"))
    best = g.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_np", "_nc")
    return best, f"{_month_name(prev)} ➔ {_month_name(curr.isoformat())}", metric


def root_cause(df: DataFrame, metric: str | None = None, date: str | None = None,
               dims: list[str] | None = None, fill_missing: bool = False) -> DataFrame:
    """Why did the KPI fall in the last month? One finding per dimension.

    For every dimension the segment with the largest previous→current drop
    (``worst_segments``), its share of the overall drop, and both values;
    sorted by share. No rows if the KPI did not fall.
    """
    found = worst_segments(df, metric, date, dims, fill_missing)
    if found is None:
        return _empty_root_cause(df.sparkSession)
    best, period, _ = found
    whole = Window.partitionBy()  # at most #dims + 1 rows here
    tot_prev = F.max(F.when(F.col("dimension") == TOTAL, F.col("previous_value"))).over(whole)
    tot_curr = F.max(F.when(F.col("dimension") == TOTAL, F.col("current_value"))).over(whole)
    diff = F.col("_tc") - F.col("_tp")
    out = (best.withColumn("_tp", tot_prev).withColumn("_tc", tot_curr)
           .where((F.col("dimension") != TOTAL) & (F.col("drop") > 0) & (diff < 0))
           .select("dimension", "segment",
                   F.round("drop", 2).alias("segment_drop_value"),
                   F.round(F.col("drop") / F.abs(diff) * 100, 2).alias("contribution_percentage"),
                   F.round("previous_value", 2).alias("previous_value"),
                   F.round("current_value", 2).alias("current_value"),
                   F.lit(period).alias("period"),
                   F.round(diff, 2).alias("overall_change"),
                   F.round(F.when(F.col("_tp") > 0, diff / F.col("_tp") * 100).otherwise(F.lit(0.0)), 2)
                   .alias("percentage_change")))
    return out.orderBy(F.desc("contribution_percentage"), "dimension")


def _month_name(iso: str) -> str:
    import datetime as _dt
    return _dt.date.fromisoformat(iso[:10]).strftime("%B %Y")


def _empty_root_cause(spark):
    schema = ("dimension string, segment string, segment_drop_value double, contribution_percentage double, "
              "previous_value double, current_value double, period string, overall_change double, "
              "percentage_change double")
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- AGG13
def insights(df: DataFrame) -> DataFrame:
    """Summary facts: rows, columns, total/average sales, profit, top segment, growth."""
    roles = C.business_columns(df)
    sales, profit, product, date = roles["sales"], roles["profit"], roles["product"], roles["date"]
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")]
    if sales:
        aggs += [F.round(F.coalesce(F.sum(sales), F.lit(0.0)), 2).alias("total_sales"),
                 F.round(F.avg(sales), 2).alias("avg_sales")]
    else:
        aggs += [F.lit(None).cast("double").alias("total_sales"), F.lit(None).cast("double").alias("avg_sales")]
    aggs.append(F.round(F.coalesce(F.sum(profit), F.lit(0.0)), 2).alias("total_profit") if profit
                else F.lit(None).cast("double").alias("total_profit"))
    base = df.agg(*aggs).first().asDict()
    top_segment = None
    if product and sales:
        row = top_products(df, sales, product, 1).first()
        top_segment = row["segment"] if row else None
    growth = None
    if date and sales:
        row = last_month_growth(df, sales, date).first()
        growth = row["growth_pct"] if row else None
    # Every part above is a bounded one-row aggregate of the table.
    schema = ("n_rows bigint, n_columns int, total_sales double, avg_sales double, total_profit double, "
              "top_segment string, growth_pct double")
    return df.sparkSession.createDataFrame(
        [(base["n_rows"], base["n_columns"], base["total_sales"], base["avg_sales"], base["total_profit"],
          top_segment, growth)], schema)


# ---------------------------------------------------------------- BQ11
# Question keywords and their precedence (first rule wins).
GEO_WORDS = ["region", "location", "where", "state", "city"]
MAX_WORDS = ["max", "highest", "best", "most", "top", "maximum"]
DECLINE_WORDS = ["decrease", "drop", "decline", "why did", "down", "loss", "fall"]
FORECAST_WORDS = ["predict", "forecast", "next month", "future", "projection"]
POOR_WORDS = ["poor", "worst", "lowest", "least", "bottom", "low"]


def _any_contains(c, words):
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(c, F.lit(w))
    return cond


def classify_questions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Route each question to the operator that answers it (substring rules)."""
    q = F.lower(F.trim(F.col(text_col)))
    intent = (F.when(_any_contains(q, GEO_WORDS) & _any_contains(q, MAX_WORDS), "top_region")
              .when(_any_contains(q, DECLINE_WORDS), "decline")
              .when(_any_contains(q, FORECAST_WORDS), "forecast")
              .when(_any_contains(q, POOR_WORDS), "bottom")
              .otherwise("summary"))
    return df.withColumn("intent", intent)


def ask(df: DataFrame, question: str) -> DataFrame:
    """The routed operator's table for one question; ``answers.answer`` gives text and chart.

    Raises ValueError if the table lacks a column that the question needs.
    """
    spark = df.sparkSession
    intent = classify_questions(spark.createDataFrame([(question,)], "text string")).first()["intent"]
    roles = C.business_columns(df)
    metric_top = roles["profit"] or roles["sales"]
    metric = roles["sales"] or roles["profit"]
    if intent == "top_region":
        if not roles["region"] or not metric_top:
            raise ValueError("no region or metric column found")
        return top_segments(df, metric_top, roles["region"])
    if intent in ("decline", "forecast") and not (metric and roles["date"]):
        raise ValueError("no metric or date column found")
    if intent == "decline":
        return biggest_decline(df, metric, roles["date"])
    if intent == "forecast":
        return trend_projection(df, metric, roles["date"])
    if intent == "bottom":
        if not metric or not (roles["product"] or roles["region"]):
            raise ValueError("no segment or metric column found")
        return bottom_segments(df, metric, roles["product"] or roles["region"])
    return insights(df)


# ---------------------------------------------------------------- PRJ7 / PRJ10
def rows_in_month(df: DataFrame, date: str, month: str) -> DataFrame:
    """Rows of one calendar month, as a literal range (pushed into the Parquet scan)."""
    start = str(month)[:7] + "-01"
    ts = as_timestamp(df, date)
    return df.where((ts >= ts_literal(start)) & (ts < ts_literal(_add_month(start))))


def row_at(df: DataFrame, key: str, position: int) -> DataFrame:
    """The row at ``position`` (0-based) in key order; raises when out of range.

    Spark tables have no positional order, so a key column defines it; the
    top-(position+1) limit keeps the work bounded per partition.
    """
    if position < 0:
        raise IndexError("row position must be >= 0")
    head = df.orderBy(key).limit(position + 1)
    w = Window.orderBy(key)
    picked = head.withColumn("_pos", F.row_number().over(w) - 1).where(F.col("_pos") == position).drop("_pos")
    if picked.isEmpty():
        raise IndexError(f"row position {position} out of range")
    return picked
