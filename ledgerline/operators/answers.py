"""Full answers to business questions (BQ11) and the root-cause report (BQ9): the text and the points of its chart.

An answer is a table: position 0 holds the text, the following positions the
chart's points in order. Every number comes from one aggregate of the table
(checkpointed where text and chart share it); only single values of those
reach the driver, where they fill the fixed texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import columns as C
from ledgerline.functions.exprs import half_up
from ledgerline.operators import questions as Q
from ledgerline.session import cut_lineage

ANSWER_SCHEMA = ("intent string, position bigint, text string, chart_type string, chart_label string, label string, "
                 "value double")

# Answer texts.
NO_REGION = ("I couldn't automatically resolve a region, state, or geography column in this dataset. Please verify "
             "if your dataset has a location-related field.")
NO_REGION_METRIC = ("I couldn't identify a numeric sales, revenue, or profit column in this dataset to aggregate "
                    "performance metrics.")
TOP_REGION = ("Based on the aggregate analysis of geographical data, the highest-performing location is "
              "**'{segment}'**, generating a total {metric} of **${total}**. This accounts for **{share}%** of the "
              "total **${grand}** aggregated across all regions in your active dataset.")
NO_TREND_METRIC = "I couldn't find a numeric metric column (like sales or revenue) to calculate trend lines."
NO_TREND_DATE = "A date-time field is required to determine historical month-over-month declines."
FEW_MONTHS = ("The active dataset contains less than two months of historical intervals, which is insufficient to "
              "compute growth/decline rate drops.")
NO_DECLINE = ("Analyzing the historical trend lines, the {metric} did not show any month-over-month decline. The "
              "growth trend remains consistently positive.")
DECLINE = ("The most significant decline in {metric} occurred in **{month}**, where aggregate values dropped from "
           "**${previous}** to **${value}** (representing a decline of **${drop}** or **{pct}%** compared to the "
           "previous period).\n\n")
DECLINE_SEGMENT = ("Further drill-down reveals this drop was primarily driven by the **'{segment}'** segment (under "
                   "column '{column}'), which saw its revenue contract by **${drop}**.")
NO_FORECAST_METRIC = "I couldn't identify a metric column (like sales or profit) to project into future periods."
NO_FORECAST_DATE = "A date-time column is required to build a chronological trend projection model."
FEW_INTERVALS = "Insufficient data intervals (need at least 3 months of history) to train a trend model."
FORECAST = ("Using a linear regression model fit to your monthly historical records, the projected {metric} for "
            "**{month}** is **${prediction}**. The 95% confidence interval spans from a lower limit of **${lower}** "
            "to a maximum of **${upper}**.")
NO_SEGMENT = "I couldn't locate a product name, category, or region column to evaluate bottom performances."
NO_SEGMENT_METRIC = "I couldn't identify a numeric sales or profit column to rank product outputs."
BOTTOM = ("Ranking the data columns in ascending order, the lowest-performing segment under '{column}' is "
          "**'{segment}'**, which generated a total {metric} of only **${total}**.")
SUMMARY_HEAD = "### Business Intelligence Summary Insights:\n\n"
SUMMARY_ROWS = "• Your dataset comprises **{rows}** operational records spanning **{columns}** columns."
SUMMARY_SALES = "• Total aggregated {metric}: **${total}** (average transactions: **${average}**)."
SUMMARY_PROFIT = "• Total net profit: **${total}**."
SUMMARY_TOP = "• Top contributing segment: **'{segment}'** (ranking highest in aggregate revenue)."
SUMMARY_GROWTH = "• Month-over-month growth rate: **{pct}% {direction}** in the final period."
KPI_FEW_MONTHS = "Dataset requires at least 2 monthly periods to analyze growth changes."
KPI_ROSE = "KPI '{metric}' increased by {pct}% in the latest period. No decline detected."
KPI_EXPLANATION = ("The overall drop in {metric} of ${change} (-{pct}%) was primarily driven by the **'{segment}'** "
                   "segment under the **'{dimension}'** dimension. This segment contracted by **${drop}**, explaining "
                   "**{share}%** of the total decline.")
KPI_EVEN = "A general decline was observed, but it was evenly distributed across all segments."
KPI_ADVICE = ["Audit operational performance and customer retention in segment '{segment}'.",
              "Run marketing promotions targeting '{segment}' to stabilize demand contraction.",
              "Review pricing structures or supplier margins for '{segment}' to address profitability drops."]
KPI_EVEN_ADVICE = ["Review macro pricing variables and market seasonal cycles."]
# End of the fixed answer texts.

NO_ROWS = "The dataset holds no rows to answer from."


def _answer(spark, intent: str, text: str, points: DataFrame | None = None, kind: str | None = None,
            title: str | None = None) -> DataFrame:
    """The text, then the points (position, label, value) of its chart."""
    head = spark.createDataFrame([(intent, 0, text, None, None, None, None)], ANSWER_SCHEMA)
    if points is None:
        return head
    return head.unionByName(points.select(
        F.lit(intent).alias("intent"), F.col("position").cast("long").alias("position"),
        F.lit(None).cast("string").alias("text"), F.lit(kind).alias("chart_type"), F.lit(title).alias("chart_label"),
        F.col("label").cast("string").alias("label"), F.col("value").cast("double").alias("value")))


def _points(spark, pairs) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs, 1)],
                                 "position bigint, label string, value double")


def top_region(df: DataFrame, roles: dict) -> DataFrame:
    spark, by, metric = df.sparkSession, roles["region"], roles["profit"] or roles["sales"]
    if not by or not metric:
        return _answer(spark, "top_region", NO_REGION_METRIC if by else NO_REGION)
    ranked = cut_lineage(Q.top_segments(df, metric, by))
    best = ranked.where("rank = 1").first()
    if best is None:
        return _answer(spark, "top_region", NO_ROWS)
    text = TOP_REGION.format(segment=best["segment"], metric=metric, total=best["total"], share=best["share_pct"],
                             grand=best["grand_total"])
    points = ranked.select(F.col("rank").alias("position"), F.col("segment").alias("label"),
                           F.col("total").alias("value"))
    return _answer(spark, "top_region", text, points, "bar", f"Total {metric.capitalize()} by Region")


def decline(df: DataFrame, roles: dict) -> DataFrame:
    spark, metric, date = df.sparkSession, roles["sales"] or roles["profit"], roles["date"]
    if not metric or not date:
        return _answer(spark, "decline", NO_TREND_DATE if metric else NO_TREND_METRIC)
    months = Q.monthly(df, metric, date).orderBy("month").collect()  # one row per calendar month
    if len(months) < 2:
        return _answer(spark, "decline", FEW_MONTHS)
    falls = [((b["value"] - a["value"]) * 100.0 / a["value"], a, b) for a, b in zip(months, months[1:]) if a["value"]]
    falls = [f for f in falls if f[0] < 0]
    if not falls:
        return _answer(spark, "decline", NO_DECLINE.format(metric=metric))
    pct, before, worst = min(falls, key=lambda f: f[0])
    text = DECLINE.format(metric=metric, month=worst["month"].strftime("%B %Y"),
                          previous=half_up(before["value"], 2), value=half_up(worst["value"], 2),
                          drop=half_up(before["value"] - worst["value"], 2), pct=half_up(abs(pct), 1))
    column = roles["product"] or roles["region"]
    if column:
        seg = (Q.segment_change(df, metric, date, column, before["month"], worst["month"]).where(F.col("drop") > 0)
               .orderBy(F.desc("drop"), "segment").first())
        if seg is not None:
            text += DECLINE_SEGMENT.format(segment=seg["segment"], column=column, drop=half_up(seg["drop"], 2))
    points = _points(spark, [(m["month_end"], half_up(m["value"], 2)) for m in months])
    return _answer(spark, "decline", text, points, "line", f"Monthly {metric.capitalize()} Trend")


def projection(df: DataFrame, roles: dict) -> DataFrame:
    spark, metric, date = df.sparkSession, roles["sales"] or roles["profit"], roles["date"]
    if not metric or not date:
        return _answer(spark, "forecast", NO_FORECAST_DATE if metric else NO_FORECAST_METRIC)
    months = cut_lineage(Q.monthly(df, metric, date, fill_gaps=False))
    ahead = Q.project_months(months).first()
    if ahead is None:
        return _answer(spark, "forecast", FEW_INTERVALS)
    text = FORECAST.format(metric=metric, month=ahead["next_month"], prediction=ahead["prediction"],
                           lower=ahead["lower"], upper=ahead["upper"])
    known = [(m["month"].strftime("%b %Y"), half_up(m["value"], 2)) for m in months.orderBy("month").collect()]
    points = _points(spark, [*known, (ahead["next_month"], ahead["prediction"])])
    return _answer(spark, "forecast", text, points, "bar", f"Historical + Predicted {metric.capitalize()}")


def bottom(df: DataFrame, roles: dict) -> DataFrame:
    spark, metric, by = df.sparkSession, roles["sales"] or roles["profit"], roles["product"] or roles["region"]
    if not by or not metric:
        return _answer(spark, "bottom", NO_SEGMENT_METRIC if by else NO_SEGMENT)
    low = Q.bottom_segments(df, metric, by).collect()  # ten rows, the lowest first
    if not low:
        return _answer(spark, "bottom", NO_ROWS)
    text = BOTTOM.format(column=by, segment=low[0]["segment"], metric=metric, total=low[0]["total"])
    return _answer(spark, "bottom", text, _points(spark, [(r["segment"], r["total"]) for r in low]), "bar",
                   f"Bottom Performing {by.capitalize()} ({metric.capitalize()})")


def summary(df: DataFrame, roles: dict) -> DataFrame:
    spark, sales, by = df.sparkSession, roles["sales"], roles["product"]
    facts = Q.insights(df).first()
    lines = [SUMMARY_ROWS.format(rows=facts["n_rows"], columns=facts["n_columns"])]
    if sales and facts["avg_sales"] is not None:
        lines.append(SUMMARY_SALES.format(metric=sales, total=facts["total_sales"], average=facts["avg_sales"]))
    if roles["profit"] and facts["total_profit"] is not None:
        lines.append(SUMMARY_PROFIT.format(total=facts["total_profit"]))
    if facts["top_segment"] is not None:
        lines.append(SUMMARY_TOP.format(segment=facts["top_segment"]))
    if facts["growth_pct"] is not None:
        lines.append(SUMMARY_GROWTH.format(pct=facts["growth_pct"],
                                           direction="increase" if facts["growth_pct"] > 0 else "decline"))
    text = SUMMARY_HEAD + "\n".join(lines)
    if not sales or not by:
        return _answer(spark, "summary", text)
    top = [(r["segment"], r["total"]) for r in Q.top_products(df, sales, by, 5).collect()]
    return _answer(spark, "summary", text, _points(spark, top), "bar", f"Top 5 {by.capitalize()} by Sales")


_ANSWERS = {"top_region": top_region, "decline": decline, "forecast": projection, "bottom": bottom,
            "summary": summary}


def answer(df: DataFrame, question: str | None) -> DataFrame:
    """The full answer to one question, as text and chart points.

    Columns that the question needs and the table lacks, too few months and
    tables without rows give a text that says so; a null or empty question gets
    the summary.
    """
    asked = df.sparkSession.createDataFrame([(question or "",)], "text string")
    intent = Q.classify_questions(asked).first()["intent"]
    numeric = set(C.numeric_columns(df))
    roles = C.business_columns(df)
    roles.update({role: None for role in ("sales", "profit") if roles[role] not in numeric})
    return _ANSWERS[intent](df, roles)


def root_cause_report(df: DataFrame, metric: str | None = None, date: str | None = None,
                      dims: list[str] | None = None, fill_missing: bool = False) -> DataFrame:
    """One row on the last month's fall of a KPI: what happened, the main cause in words, what to do.

    Without two months of rows ``success`` is false and the message says so;
    without a fall there is a message, no explanation and no advice.
    """
    schema = ("success boolean, decline_detected boolean, target_kpi string, period string, overall_change double, "
              "percentage_change double, message string, explanation string, recommendations array<string>")

    def row(*values):
        return df.sparkSession.createDataFrame([values], schema)

    found = Q.worst_segments(df, metric, date, dims, fill_missing)
    if found is None:
        return row(False, False, metric, None, None, None, KPI_FEW_MONTHS, None, [])
    best, period, metric = found
    lines = {r["dimension"]: r for r in best.collect()}  # one row per dimension
    total = lines.pop(Q.TOTAL)
    change = total["current_value"] - total["previous_value"]
    pct = change / total["previous_value"] * 100 if total["previous_value"] > 0 else 0.0
    if change >= 0:
        return row(True, False, metric, period, half_up(change, 2), half_up(pct, 2),
                   KPI_ROSE.format(metric=metric, pct=half_up(pct, 2)), None, [])
    falls = sorted((r for r in lines.values() if r["drop"] > 0),
                   key=lambda r: (-half_up(r["drop"] / abs(change) * 100, 2), r["dimension"]))
    if not falls:
        return row(True, True, metric, period, half_up(change, 2), half_up(pct, 2), None, KPI_EVEN, KPI_EVEN_ADVICE)
    main = falls[0]
    text = KPI_EXPLANATION.format(metric=metric, change=half_up(abs(change), 2), pct=half_up(abs(pct), 1),
                                  segment=main["segment"], dimension=main["dimension"], drop=half_up(main["drop"], 2),
                                  share=half_up(main["drop"] / abs(change) * 100, 2))
    return row(True, True, metric, period, half_up(change, 2), half_up(pct, 2), None, text,
               [a.format(segment=main["segment"]) for a in KPI_ADVICE])
