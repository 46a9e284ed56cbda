"""Profile, quality and cleaning queries (DQ1–DQ16 except the forest-based ones)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import catalog, clean, profile
from ledgerline.plans.fixtures import (
    CUSTOMER_DIRTY_SQL, CUSTOMER_NULLS_SQL, ORDERS_TEXT_DATES_SQL, customer_dirty, customer_nulls,
    orders_text_dates)
from ledgerline.plans.registry import register
from ledgerline.sources.tables import table

_CUST_COLS = [("c_custkey", "bigint", "num"), ("c_name", "string", "str"), ("c_nationkey", "int", "num"),
              ("c_acctbal", "double", "num"), ("c_mktsegment", "string", "str")]


def _profile_sql(src: str, cols) -> str:
    parts = []
    for pos, (c, dt, kind) in enumerate(cols):
        if kind == "num":
            sem = (f"CASE WHEN count(DISTINCT {c}) > 10 OR count(DISTINCT {c}) / count(*) > 0.05 "
                   f"THEN 'numerical' ELSE 'categorical/ordinal' END")
        else:
            sem = "'categorical'"
        parts.append(f"""
SELECT '{c}' AS "column", {pos} AS position, '{dt}' AS dtype, {sem} AS semantic_type,
       count(*) - count({c}) AS missing_count,
       round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct,
       count(DISTINCT {c}) AS distinct_count,
       (SELECT string_agg(v, ', ' ORDER BY v) FROM
          (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM t WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS sample_values
FROM t""")
    return f"WITH t AS ({src})\n" + "\nUNION ALL".join(parts)


@register("DQ1", sql=_profile_sql(CUSTOMER_DIRTY_SQL, _CUST_COLS))
def dq1(spark, sf):
    return profile.profile(customer_dirty(spark, sf))


@register("DQ2", sql=f"""
WITH t AS ({CUSTOMER_DIRTY_SQL}),
m AS (SELECT 5 * count(*) AS total_cells,
             (count(*) - count(c_custkey)) + (count(*) - count(c_name)) + (count(*) - count(c_nationkey))
             + (count(*) - count(c_acctbal)) + (count(*) - count(c_mktsegment)) AS missing_cells FROM t)
SELECT total_cells, missing_cells, round((1 - missing_cells / total_cells) * 100, 2) AS completeness FROM m
""")
def dq2(spark, sf):
    return profile.completeness(customer_dirty(spark, sf))


@register("DQ3", sql=f"""
WITH t AS ({CUSTOMER_DIRTY_SQL}), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM t))
SELECT count(*) AS total_rows, count(*) - (SELECT n FROM d) AS duplicate_rows,
       round((1 - (count(*) - (SELECT n FROM d)) / count(*)) * 100, 2) AS uniqueness
FROM t
""")
def dq3(spark, sf):
    return profile.uniqueness(customer_dirty(spark, sf))


@register("DQ4", sql="""
WITH t AS (SELECT c_custkey, c_mktsegment, c_acctbal AS balance_amount FROM customer)
SELECT 3 * count(*) AS total_cells, count_if(balance_amount < 0)::BIGINT AS negative_values,
       round((1 - count_if(balance_amount < 0) / (3.0 * count(*))) * 100, 2) AS validity
FROM t
""")
def dq4(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("balance_amount"))
    return profile.validity(c)


@register("DQ5", sql=f"""
WITH t AS ({ORDERS_TEXT_DATES_SQL})
SELECT 5 * count(*) AS total_cells,
       count_if(order_date IS NOT NULL AND TRY_CAST(order_date AS TIMESTAMP) IS NULL)::BIGINT AS inconsistent_values,
       round((1 - count_if(order_date IS NOT NULL AND TRY_CAST(order_date AS TIMESTAMP) IS NULL)
              / (5.0 * count(*))) * 100, 2) AS consistency
FROM t
""")
def dq5(spark, sf):
    return profile.consistency(orders_text_dates(spark, sf))


_MODE_SEG = ("(SELECT c_mktsegment FROM {t} WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment "
             "ORDER BY count(*) DESC, c_mktsegment LIMIT 1)")


@register("DQ9", sql=f"""
WITH t AS ({CUSTOMER_DIRTY_SQL})
SELECT c_custkey, c_name, c_nationkey,
       round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM t)), 4) AS c_acctbal,
       coalesce(c_mktsegment, {_MODE_SEG.format(t='t')}) AS c_mktsegment
FROM t
""")
def dq9(spark, sf):
    out = clean.impute(customer_dirty(spark, sf))
    return out.withColumn("c_acctbal", F.round("c_acctbal", 4))


@register("DQ9_COUNTS", sql=f"""
WITH t AS ({CUSTOMER_DIRTY_SQL})
SELECT 'c_acctbal' AS "column", count(*) - count(c_acctbal) AS imputed FROM t UNION ALL
SELECT 'c_mktsegment', count(*) - count(c_mktsegment) FROM t
""")
def dq9_counts(spark, sf):
    return clean.impute_counts(customer_dirty(spark, sf))


@register("DQ10", sql=f"""
WITH t AS ({CUSTOMER_DIRTY_SQL})
SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS rows_after,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS removed
FROM t
""")
def dq10(spark, sf):
    return clean.dedup_count(customer_dirty(spark, sf))


def _clip_sql(src: str, num_cols: list[str], other_cols: list[str]) -> str:
    bounds = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in num_cols)
    sel = ", ".join([*other_cols, *[f"round(least(greatest({c}::DOUBLE, lo_{c}), hi_{c}), 4) AS {c}"
                                    for c in num_cols]])
    return f"WITH t AS ({src}), b AS (SELECT {bounds} FROM t) SELECT {sel} FROM t, b"


def _round_cols(df, cols, digits=4):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@register("DQ11", sql=_clip_sql("SELECT * FROM customer", ["c_custkey", "c_nationkey", "c_acctbal"],
                                ["c_name", "c_mktsegment"]))
def dq11(spark, sf):
    out = clean.clip_outliers(table(spark, sf, "customer"))
    return _round_cols(out, ["c_custkey", "c_nationkey", "c_acctbal"])


@register("DQ12", sql="""
WITH p AS (SELECT count(*) AS n, count(DISTINCT event_id) AS d_id, count(DISTINCT user_id) AS d_user,
                  count(DISTINCT value) AS d_value, count(DISTINCT event_type) AS d_type,
                  count(DISTINCT props) AS d_props,
                  skewness(event_id) AS s_id, skewness(user_id) AS s_user, skewness(value) AS s_value
           FROM events)
SELECT 'ts' AS "column", 'datetime_extraction' AS type,
       'Extract Year, Month, Day, and Day of Week from ''ts'' to capture seasonality.' AS suggestion,
       CAST(NULL AS DOUBLE) AS skewness
UNION ALL SELECT 'event_type', 'one_hot_encoding',
       'One-hot encode categorical feature ''event_type'' for machine learning algorithms.', NULL
       FROM p WHERE d_type > 2 AND d_type < 15
UNION ALL SELECT 'props', 'one_hot_encoding',
       'One-hot encode categorical feature ''props'' for machine learning algorithms.', NULL
       FROM p WHERE d_props > 2 AND d_props < 15
UNION ALL SELECT 'event_id', 'log_transformation',
       'Apply log transform to skewed numerical column ''event_id'' (skewness: ' || CAST(round(s_id, 2) AS VARCHAR) || ').',
       round(s_id, 2) FROM p WHERE (d_id > 10 OR d_id / n > 0.05) AND d_id > 100 AND abs(s_id) > 1.5
UNION ALL SELECT 'user_id', 'log_transformation',
       'Apply log transform to skewed numerical column ''user_id'' (skewness: ' || CAST(round(s_user, 2) AS VARCHAR) || ').',
       round(s_user, 2) FROM p WHERE (d_user > 10 OR d_user / n > 0.05) AND d_user > 100 AND abs(s_user) > 1.5
UNION ALL SELECT 'value', 'log_transformation',
       'Apply log transform to skewed numerical column ''value'' (skewness: ' || CAST(round(s_value, 2) AS VARCHAR) || ').',
       round(s_value, 2) FROM p WHERE (d_value > 10 OR d_value / n > 0.05) AND d_value > 100 AND abs(s_value) > 1.5
""")
def dq12(spark, sf):
    return clean.suggest_features(table(spark, sf, "events"))


_CLEAN_SQL = f"""
WITH t AS ({CUSTOMER_DIRTY_SQL}),
d AS (SELECT DISTINCT * FROM t),
f AS (SELECT c_custkey, c_name, c_nationkey,
             coalesce(c_acctbal, (SELECT median(c_acctbal) FROM d)) AS c_acctbal,
             coalesce(c_mktsegment, {_MODE_SEG.format(t='d')}) AS c_mktsegment FROM d),
b AS (SELECT quantile_cont(c_custkey, 0.01) AS lo1, quantile_cont(c_custkey, 0.99) AS hi1,
             quantile_cont(c_nationkey, 0.01) AS lo2, quantile_cont(c_nationkey, 0.99) AS hi2,
             quantile_cont(c_acctbal, 0.01) AS lo3, quantile_cont(c_acctbal, 0.99) AS hi3 FROM f)
SELECT round(least(greatest(c_custkey::DOUBLE, lo1), hi1), 4) AS c_custkey, c_name,
       round(least(greatest(c_nationkey::DOUBLE, lo2), hi2), 4) AS c_nationkey,
       round(least(greatest(c_acctbal, lo3), hi3), 4) AS c_acctbal, c_mktsegment
FROM f, b
"""


@register("DQ13", sql=_CLEAN_SQL)
def dq13(spark, sf):
    out = clean.clean(customer_dirty(spark, sf))
    return _round_cols(out, ["c_custkey", "c_nationkey", "c_acctbal"])


@register("DQ13_SUMMARY", sql=f"""
WITH before_rows AS ({CUSTOMER_DIRTY_SQL}), after_rows AS ({_CLEAN_SQL}),
missing AS (SELECT {{}} FROM before_rows), left_over AS (SELECT {{}} FROM after_rows)
SELECT 'rows' AS metric, (SELECT count(*) FROM before_rows) AS "before", (SELECT count(*) FROM after_rows) AS "after"
UNION ALL SELECT 'missing_cells', (SELECT n FROM missing), (SELECT n FROM left_over)
UNION ALL SELECT 'duplicate_rows',
  (SELECT count(*) FROM before_rows) - (SELECT count(*) FROM (SELECT DISTINCT * FROM before_rows)),
  (SELECT count(*) FROM after_rows) - (SELECT count(*) FROM (SELECT DISTINCT * FROM after_rows))
""".replace("{}", "CAST(" + " + ".join(f"count(*) - count({c})" for c in (
    "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")) + " AS BIGINT) AS n"))
def dq13_summary(spark, sf):
    df = customer_dirty(spark, sf)
    return clean.clean_summary(df, clean.clean(df))


@register("DQ13_REPORT", note="cleaning report with forest outliers and quality before and after; rows-only")
def dq13_report(spark, sf):
    return clean.clean_report(customer_dirty(spark, sf))


@register("DQ14", sql="""
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def dq14(spark, sf):
    ev = table(spark, sf, "events")
    return catalog.latest_per_key(ev, ["user_id"], [F.desc("ts"), F.desc("event_id")])


@register("DQ16", sql="""
SELECT o.* FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = 3)
""")
def dq16(spark, sf):
    removed = (table(spark, sf, "customer").where(F.col("c_nationkey") == 3)
               .select(F.col("c_custkey").alias("o_custkey")))
    return catalog.purge(table(spark, sf, "orders"), removed, "o_custkey")


@register("FE5", sql=f"""
WITH t AS ({CUSTOMER_NULLS_SQL})
SELECT c_custkey, c_name, c_nationkey, round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM t)), 4) AS c_acctbal,
       coalesce(c_mktsegment, 'Unknown') AS c_mktsegment
FROM t
""")
def fe5(spark, sf):
    out = clean.scoring_fill(customer_nulls(spark, sf))
    return out.withColumn("c_acctbal", F.round("c_acctbal", 4))
