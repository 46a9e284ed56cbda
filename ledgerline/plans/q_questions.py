"""Business-question queries (BQ1–BQ11, AGG13) over the sales view."""

from __future__ import annotations

from ledgerline.operators import answers
from ledgerline.operators import questions as Q
from ledgerline.plans.registry import register
from ledgerline.sources.tables import SALES_SQL, sales_view, table

S = f"WITH sales AS ({SALES_SQL})\n"

# Monthly series over the sales view with empty months filled with 0.
MONTHLY_SQL = S + """
, m AS (SELECT date_trunc('month', sale_date)::DATE AS month, coalesce(sum(sales), 0.0) AS value
        FROM sales WHERE sale_date IS NOT NULL GROUP BY 1)
, months AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m),
                                           INTERVAL 1 MONTH))::DATE AS month)
, filled AS (SELECT months.month, coalesce(m.value, 0.0) AS value FROM months LEFT JOIN m USING (month))
"""


@register("BQ1", sql=S + """
, g AS (SELECT region, coalesce(sum(sales), 0.0) AS total FROM sales WHERE region IS NOT NULL GROUP BY region)
SELECT CAST(region AS VARCHAR) AS segment, round(total, 2) AS total,
       round(CASE WHEN sum(total) OVER () > 0 THEN total / sum(total) OVER () * 100 ELSE 0.0 END, 1) AS share_pct,
       round(sum(total) OVER (), 2) AS grand_total,
       (row_number() OVER (ORDER BY total DESC, region ASC))::INTEGER AS rank
FROM g
""")
def bq1(spark, sf):
    return Q.top_segments(sales_view(spark, sf), "sales", "region")


@register("BQ2", sql=MONTHLY_SQL + """
SELECT strftime(last_day(month), '%Y-%m-%d') AS month_end, round(value, 2) AS value FROM filled
""")
def bq2(spark, sf):
    from pyspark.sql import functions as F
    m = Q.monthly(sales_view(spark, sf), "sales", "sale_date", fill_gaps=True)
    return m.select("month_end", F.round("value", 2).alias("value"))


@register("BQ3", sql=MONTHLY_SQL + """
, mom AS (SELECT month, value, lag(value) OVER (ORDER BY month) AS prev_value,
                 CASE WHEN lag(value) OVER (ORDER BY month) = 0 THEN NULL
                      ELSE (value - lag(value) OVER (ORDER BY month)) * 100.0 / lag(value) OVER (ORDER BY month) END
                 AS pct_change FROM filled)
SELECT strftime(last_day(month), '%Y-%m-%d') AS month_end, round(prev_value, 2) AS prev_value,
       round(value, 2) AS value, round(prev_value - value, 2) AS abs_drop, round(abs(pct_change), 1) AS pct_drop
FROM mom WHERE pct_change < 0 ORDER BY pct_change ASC, month ASC LIMIT 1
""")
def bq3(spark, sf):
    return Q.biggest_decline(sales_view(spark, sf), "sales", "sale_date").drop("month")


_BQ4_CTES = MONTHLY_SQL + """
, mom AS (SELECT month, value, CASE WHEN lag(value) OVER (ORDER BY month) = 0 THEN NULL
                 ELSE (value - lag(value) OVER (ORDER BY month)) * 100.0 / lag(value) OVER (ORDER BY month) END
                 AS pct_change FROM filled)
, worst AS (SELECT month FROM mom WHERE pct_change < 0 ORDER BY pct_change, month LIMIT 1)
, seg AS (SELECT category AS segment,
                 coalesce(sum(CASE WHEN date_trunc('month', sale_date)::DATE = (SELECT month FROM worst) - INTERVAL 1 MONTH THEN sales END), 0.0) AS prev_v,
                 coalesce(sum(CASE WHEN date_trunc('month', sale_date)::DATE = (SELECT month FROM worst) THEN sales END), 0.0) AS curr_v,
                 count(CASE WHEN date_trunc('month', sale_date)::DATE = (SELECT month FROM worst) - INTERVAL 1 MONTH THEN 1 END) AS np,
                 count(CASE WHEN date_trunc('month', sale_date)::DATE = (SELECT month FROM worst) THEN 1 END) AS nc
          FROM sales WHERE category IS NOT NULL GROUP BY category)
"""


@register("BQ4", sql=_BQ4_CTES + """
SELECT 'category' AS dimension, segment, round(prev_v - curr_v, 2) AS segment_drop,
       strftime(last_day((SELECT month FROM worst)), '%Y-%m-%d') AS month_end
FROM seg WHERE np > 0 AND nc > 0 AND prev_v - curr_v > 0
ORDER BY prev_v - curr_v DESC, segment LIMIT 1
""")
def bq4(spark, sf):
    return Q.decline_drilldown(sales_view(spark, sf))


_BQ5_CTES = S + """
, m AS (SELECT date_trunc('month', sale_date)::DATE AS month, coalesce(sum(sales), 0.0) AS value
        FROM sales WHERE sale_date IS NOT NULL GROUP BY 1)
, x AS (SELECT month, value, (row_number() OVER (ORDER BY month) - 1)::DOUBLE AS x FROM m)
, fit AS (SELECT regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, count(*) AS n,
                 max(month) AS last_month FROM x)
, res AS (SELECT stddev_pop(value - (intercept + slope * x)) AS std_err FROM x, fit)
, ahead AS (
SELECT strftime(last_month + INTERVAL 1 MONTH, '%B %Y') AS next_month,
       round(intercept + slope * n, 2) AS prediction,
       round(greatest(0.0, intercept + slope * n - 1.96 * std_err), 2) AS lower,
       round(intercept + slope * n + 1.96 * std_err, 2) AS upper,
       round(slope, 4) AS slope, round(intercept, 2) AS intercept, n
FROM fit, res WHERE n >= 3
)
"""


@register("BQ5", sql=_BQ5_CTES + """
SELECT next_month, prediction, lower, upper, slope, intercept FROM ahead
""")
def bq5(spark, sf):
    return Q.trend_projection(sales_view(spark, sf), "sales", "sale_date")


@register("BQ6", sql=S + """
SELECT CAST(category AS VARCHAR) AS segment, round(coalesce(sum(sales), 0.0), 2) AS total
FROM sales WHERE category IS NOT NULL GROUP BY category ORDER BY coalesce(sum(sales), 0.0) ASC, category LIMIT 10
""")
def bq6(spark, sf):
    return Q.bottom_segments(sales_view(spark, sf), "sales", "category", 10)


@register("BQ7", sql=S + """
SELECT CAST(category AS VARCHAR) AS segment, round(coalesce(sum(sales), 0.0), 2) AS total
FROM sales WHERE category IS NOT NULL GROUP BY category ORDER BY coalesce(sum(sales), 0.0) DESC, category LIMIT 5
""")
def bq7(spark, sf):
    return Q.top_products(sales_view(spark, sf), "sales", "category", 5)


@register("BQ8", sql=MONTHLY_SQL + """
, mom AS (SELECT month, value, lag(value) OVER (ORDER BY month) AS prev_value FROM filled)
SELECT strftime(last_day(month), '%Y-%m-%d') AS month_end,
       round(CASE WHEN prev_value = 0 THEN NULL ELSE (value - prev_value) * 100.0 / prev_value END, 1) AS growth_pct,
       CASE WHEN (value - prev_value) * 100.0 / nullif(prev_value, 0) > 0 THEN 'increase' ELSE 'decline' END AS direction
FROM mom WHERE prev_value IS NOT NULL ORDER BY month DESC LIMIT 1
""")
def bq8(spark, sf):
    return Q.last_month_growth(sales_view(spark, sf), "sales", "sale_date")


# Dimensions of the sales view: every string column, plus numeric columns with
# fewer than 15 distinct values over the whole table (metric and date excluded).
_DIM_SQL = S + """
, nd AS (SELECT count(DISTINCT quantity) AS n_quantity, count(DISTINCT discount) AS n_discount FROM sales)
, dims AS (
  SELECT 'region' AS dimension, 'categorical' AS kind, 1 AS position UNION ALL
  SELECT 'nation', 'categorical', 2 UNION ALL SELECT 'segment', 'categorical', 3 UNION ALL
  SELECT 'category', 'categorical', 4 UNION ALL SELECT 'brand', 'categorical', 5 UNION ALL
  SELECT 'priority', 'categorical', 6 UNION ALL SELECT 'returnflag', 'categorical', 7 UNION ALL
  SELECT 'linestatus', 'categorical', 8 UNION ALL
  SELECT 'quantity', 'low_cardinality', 9 FROM nd WHERE n_quantity < 15 UNION ALL
  SELECT 'discount', 'low_cardinality', 11 FROM nd WHERE n_discount < 15)
"""


@register("BQ10", sql=_DIM_SQL + "SELECT dimension, kind, position FROM dims")
def bq10(spark, sf):
    return Q.dimension_table(sales_view(spark, sf), "sales", "sale_date")


_BQ9_CTES = _DIM_SQL + """
, span AS (SELECT date_trunc('month', max(sale_date))::DATE AS curr_m,
                  (date_trunc('month', max(sale_date)) - INTERVAL 1 MONTH)::DATE AS prev_m FROM sales)
, two AS (SELECT s.*, date_trunc('month', s.sale_date)::DATE = span.prev_m AS is_prev FROM sales s, span
          WHERE s.sale_date >= span.prev_m AND s.sale_date < span.curr_m + INTERVAL 1 MONTH)
, tot AS (SELECT coalesce(sum(CASE WHEN is_prev THEN sales END), 0.0) AS prev_v,
                 coalesce(sum(CASE WHEN NOT is_prev THEN sales END), 0.0) AS curr_v FROM two)
, long AS (
  SELECT is_prev, sales, 'region' AS dimension, CAST(region AS VARCHAR) AS segment FROM two UNION ALL
  SELECT is_prev, sales, 'nation', CAST(nation AS VARCHAR) FROM two UNION ALL
  SELECT is_prev, sales, 'segment', CAST(segment AS VARCHAR) FROM two UNION ALL
  SELECT is_prev, sales, 'category', CAST(category AS VARCHAR) FROM two UNION ALL
  SELECT is_prev, sales, 'brand', CAST(brand AS VARCHAR) FROM two UNION ALL
  SELECT is_prev, sales, 'priority', CAST(priority AS VARCHAR) FROM two UNION ALL
  SELECT is_prev, sales, 'returnflag', CAST(returnflag AS VARCHAR) FROM two UNION ALL
  SELECT is_prev, sales, 'linestatus', CAST(linestatus AS VARCHAR) FROM two UNION ALL
  SELECT is_prev, sales, 'quantity', CAST(quantity AS VARCHAR) FROM two UNION ALL
  SELECT is_prev, sales, 'discount', CAST(discount AS VARCHAR) FROM two)
, g AS (SELECT dimension, segment,
               coalesce(sum(CASE WHEN is_prev THEN sales END), 0.0) AS previous_value,
               coalesce(sum(CASE WHEN NOT is_prev THEN sales END), 0.0) AS current_value,
               count(CASE WHEN is_prev THEN 1 END) AS np, count(CASE WHEN NOT is_prev THEN 1 END) AS nc
        FROM long WHERE segment IS NOT NULL AND dimension IN (SELECT dimension FROM dims)
        GROUP BY dimension, segment)
, best AS (SELECT *, previous_value - current_value AS drop_v,
                  row_number() OVER (PARTITION BY dimension ORDER BY previous_value - current_value DESC, segment) AS r
           FROM g WHERE np > 0 AND nc > 0 AND previous_value - current_value > 0)
"""


@register("BQ9", sql=_BQ9_CTES + """
SELECT dimension, segment, round(drop_v, 2) AS segment_drop_value,
       round(drop_v / abs(tot.curr_v - tot.prev_v) * 100, 2) AS contribution_percentage,
       round(previous_value, 2) AS previous_value, round(current_value, 2) AS current_value,
       strftime(span.prev_m, '%B %Y') || ' ➔ ' || strftime(span.curr_m, '%B %Y') AS period,
       round(tot.curr_v - tot.prev_v, 2) AS overall_change,
       round(CASE WHEN tot.prev_v > 0 THEN (tot.curr_v - tot.prev_v) / tot.prev_v * 100 ELSE 0.0 END, 2)
         AS percentage_change
FROM best, tot, span WHERE r = 1 AND tot.curr_v < tot.prev_v
""")
def bq9(spark, sf):
    return Q.root_cause(sales_view(spark, sf), "sales", "sale_date")


@register("BQ9_REPORT", sql=_BQ9_CTES + """
, main AS (SELECT *, round(drop_v / abs(tot.curr_v - tot.prev_v) * 100, 2) AS share
           FROM best, tot WHERE r = 1 AND tot.curr_v < tot.prev_v ORDER BY share DESC, dimension LIMIT 1)
, facts AS (SELECT tot.curr_v - tot.prev_v AS diff, tot.prev_v AS prev_v,
                   CASE WHEN tot.prev_v > 0 THEN (tot.curr_v - tot.prev_v) / tot.prev_v * 100 ELSE 0.0 END AS pct,
                   strftime(span.prev_m, '%B %Y') || ' ➔ ' || strftime(span.curr_m, '%B %Y') AS period
            FROM tot, span)
SELECT TRUE AS success, diff < 0 AS decline_detected, 'sales' AS target_kpi, period, round(diff, 2) AS overall_change,
       round(pct, 2) AS percentage_change,
       CASE WHEN diff >= 0 THEN 'KPI ''sales'' increased by ' || round(pct, 2)
                                || '% in the latest period. No decline detected.' END AS message,
       CASE WHEN diff < 0 AND segment IS NULL
            THEN 'A general decline was observed, but it was evenly distributed across all segments.'
            WHEN diff < 0 THEN 'The overall drop in sales of $' || round(abs(diff), 2) || ' (-' || round(abs(pct), 1)
              || '%) was primarily driven by the **''' || segment || '''** segment under the **''' || dimension
              || '''** dimension. This segment contracted by **$' || round(drop_v, 2) || '**, explaining **' || share
              || '%** of the total decline.' END AS explanation,
       CASE WHEN diff >= 0 THEN '' WHEN segment IS NULL
            THEN 'Review macro pricing variables and market seasonal cycles.'
            ELSE 'Audit operational performance and customer retention in segment ''' || segment || '''. | '
              || 'Run marketing promotions targeting ''' || segment || ''' to stabilize demand contraction. | '
              || 'Review pricing structures or supplier margins for ''' || segment
              || ''' to address profitability drops.' END AS recommendations
FROM facts LEFT JOIN main ON TRUE
""")
def bq9_report(spark, sf):
    from pyspark.sql import functions as F
    report = answers.root_cause_report(sales_view(spark, sf), "sales", "sale_date")
    return report.withColumn("recommendations", F.array_join("recommendations", " | "))


def _answer_sql(intent: str, kind: str, title: str, text: str, points: str) -> str:
    """An answer's rows: ``text`` selects the text, ``points`` position, label and value."""
    return f"""
SELECT '{intent}' AS intent, 0::BIGINT AS position, text, CAST(NULL AS VARCHAR) AS chart_type,
       CAST(NULL AS VARCHAR) AS chart_label, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS DOUBLE) AS value
FROM ({text})
UNION ALL
SELECT '{intent}', position::BIGINT, NULL, '{kind}', '{title}', label, round(value, 2) FROM ({points})
"""


@register("BQ11_TOP", sql=S + """
, g AS (SELECT region, coalesce(sum(sales), 0.0) AS total FROM sales WHERE region IS NOT NULL GROUP BY region)
, r AS (SELECT *, row_number() OVER (ORDER BY total DESC, region) AS position, sum(total) OVER () AS grand FROM g)
""" + _answer_sql("top_region", "bar", "Total Sales by Region", """
SELECT 'Based on the aggregate analysis of geographical data, the highest-performing location is **''' || region
       || '''**, generating a total sales of **$' || round(total, 2) || '**. This accounts for **'
       || round(total / grand * 100, 1) || '%** of the total **$' || round(grand, 2)
       || '** aggregated across all regions in your active dataset.' AS text FROM r WHERE position = 1
""", "SELECT position, CAST(region AS VARCHAR) AS label, total AS value FROM r"))
def bq11_top(spark, sf):
    return answers.answer(sales_view(spark, sf), "Which region has the highest sales?")


@register("BQ11_DECLINE", sql=_BQ4_CTES + """
, pair AS (SELECT w.month, f.value, p.value AS prev_value FROM worst w JOIN filled f ON f.month = w.month
           JOIN filled p ON p.month = w.month - INTERVAL 1 MONTH)
, hit AS (SELECT * FROM seg WHERE np > 0 AND nc > 0 AND prev_v - curr_v > 0 ORDER BY prev_v - curr_v DESC, segment LIMIT 1)
""" + _answer_sql("decline", "line", "Monthly Sales Trend", """
SELECT 'The most significant decline in sales occurred in **' || strftime(month, '%B %Y')
       || '**, where aggregate values dropped from **$' || round(prev_value, 2) || '** to **$' || round(value, 2)
       || '** (representing a decline of **$' || round(prev_value - value, 2) || '** or **'
       || round(abs((value - prev_value) * 100.0 / prev_value), 1) || '%** compared to the previous period).'
       || chr(10) || chr(10)
       || coalesce('Further drill-down reveals this drop was primarily driven by the **''' || segment
       || '''** segment (under column ''category''), which saw its revenue contract by **$'
       || round(prev_v - curr_v, 2) || '**.', '') AS text
FROM pair LEFT JOIN hit ON TRUE
""", """
SELECT row_number() OVER (ORDER BY month) AS position, strftime(last_day(month), '%Y-%m-%d') AS label, value FROM filled
"""))
def bq11_decline(spark, sf):
    return answers.answer(sales_view(spark, sf), "Why did sales decrease?")


@register("BQ11_FORECAST", sql=_BQ5_CTES + _answer_sql("forecast", "bar", "Historical + Predicted Sales", """
SELECT 'Using a linear regression model fit to your monthly historical records, the projected sales for **'
       || next_month || '** is **$' || prediction || '**. The 95% confidence interval spans from a lower limit of **$'
       || lower || '** to a maximum of **$' || upper || '**.' AS text FROM ahead
""", """
SELECT x + 1 AS position, strftime(month, '%b %Y') AS label, value FROM x
UNION ALL SELECT n + 1, next_month, prediction FROM ahead
"""))
def bq11_forecast(spark, sf):
    return answers.answer(sales_view(spark, sf), "Predict next month's sales")


@register("BQ11_BOTTOM", sql=S + """
, g AS (SELECT category, coalesce(sum(sales), 0.0) AS total FROM sales WHERE category IS NOT NULL GROUP BY category)
, r AS (SELECT *, row_number() OVER (ORDER BY total, category) AS position FROM g)
""" + _answer_sql("bottom", "bar", "Bottom Performing Category (Sales)", """
SELECT 'Ranking the data columns in ascending order, the lowest-performing segment under ''category'' is **'''
       || category || '''**, which generated a total sales of only **$' || round(total, 2) || '**.' AS text
FROM r WHERE position = 1
""", "SELECT position, CAST(category AS VARCHAR) AS label, total AS value FROM r WHERE position <= 10"))
def bq11_bottom(spark, sf):
    return answers.answer(sales_view(spark, sf), "Which product performs poorly?")


@register("BQ11_SUMMARY", sql=MONTHLY_SQL + """
, mom AS (SELECT month, value, lag(value) OVER (ORDER BY month) AS prev_value FROM filled)
, growth AS (SELECT round((value - prev_value) * 100.0 / nullif(prev_value, 0), 1) AS pct
             FROM mom WHERE prev_value IS NOT NULL ORDER BY month DESC LIMIT 1)
, g AS (SELECT category, coalesce(sum(sales), 0.0) AS total FROM sales WHERE category IS NOT NULL GROUP BY category)
, r AS (SELECT *, row_number() OVER (ORDER BY total DESC, category) AS position FROM g)
, t AS (SELECT count(*) AS n, round(sum(sales), 2) AS total, round(avg(sales), 2) AS average FROM sales)
""" + _answer_sql("summary", "bar", "Top 5 Category by Sales", """
SELECT '### Business Intelligence Summary Insights:' || chr(10) || chr(10)
       || '• Your dataset comprises **' || n || '** operational records spanning **12** columns.' || chr(10)
       || '• Total aggregated sales: **$' || t.total || '** (average transactions: **$' || average || '**).' || chr(10)
       || '• Top contributing segment: **''' || category || '''** (ranking highest in aggregate revenue).'
       || coalesce(chr(10) || '• Month-over-month growth rate: **' || pct || '% '
                   || CASE WHEN pct > 0 THEN 'increase' ELSE 'decline' END || '** in the final period.', '') AS text
FROM t, r LEFT JOIN growth ON TRUE WHERE position = 1
""", "SELECT position, CAST(category AS VARCHAR) AS label, total AS value FROM r WHERE position <= 5"))
def bq11_summary(spark, sf):
    return answers.answer(sales_view(spark, sf), "Give me an overview")


@register("BQ11", sql="""
SELECT conv_id, turn, role, text,
  CASE WHEN (contains(q, 'region') OR contains(q, 'location') OR contains(q, 'where') OR contains(q, 'state')
             OR contains(q, 'city'))
        AND (contains(q, 'max') OR contains(q, 'highest') OR contains(q, 'best') OR contains(q, 'most')
             OR contains(q, 'top') OR contains(q, 'maximum')) THEN 'top_region'
       WHEN contains(q, 'decrease') OR contains(q, 'drop') OR contains(q, 'decline') OR contains(q, 'why did')
             OR contains(q, 'down') OR contains(q, 'loss') OR contains(q, 'fall') THEN 'decline'
       WHEN contains(q, 'predict') OR contains(q, 'forecast') OR contains(q, 'next month')
             OR contains(q, 'future') OR contains(q, 'projection') THEN 'forecast'
       WHEN contains(q, 'poor') OR contains(q, 'worst') OR contains(q, 'lowest') OR contains(q, 'least')
             OR contains(q, 'bottom') OR contains(q, 'low') THEN 'bottom'
       ELSE 'summary' END AS intent
FROM (SELECT *, lower(trim(text)) AS q FROM conversations)
""")
def bq11(spark, sf):
    return Q.classify_questions(table(spark, sf, "conversations"), "text")


@register("AGG13", sql=MONTHLY_SQL + """
, mom AS (SELECT month, value, lag(value) OVER (ORDER BY month) AS prev_value FROM filled)
, growth AS (SELECT round(CASE WHEN prev_value = 0 THEN NULL ELSE (value - prev_value) * 100.0 / prev_value END, 1)
                    AS growth_pct FROM mom WHERE prev_value IS NOT NULL ORDER BY month DESC LIMIT 1)
, top AS (SELECT CAST(category AS VARCHAR) AS top_segment FROM sales WHERE category IS NOT NULL
          GROUP BY category ORDER BY coalesce(sum(sales), 0.0) DESC, category LIMIT 1)
SELECT count(*) AS n_rows, 12 AS n_columns, round(coalesce(sum(sales), 0.0), 2) AS total_sales,
       round(avg(sales), 2) AS avg_sales, CAST(NULL AS DOUBLE) AS total_profit,
       (SELECT top_segment FROM top) AS top_segment, (SELECT growth_pct FROM growth) AS growth_pct
FROM sales
""")
def agg13(spark, sf):
    return Q.insights(sales_view(spark, sf))
