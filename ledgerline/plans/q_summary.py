"""Summary, histogram and chart queries (AGG1–AGG12, AGG15)."""

from __future__ import annotations

from ledgerline.operators import charts, summary
from ledgerline.plans.fixtures import CUSTOMER_NULLS_SQL, LINEITEM_NULLS_SQL, customer_nulls, lineitem_nulls
from ledgerline.plans.registry import register
from ledgerline.sources.tables import SALES_SQL, sales_view, table

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]


def _numeric_summary_sql(src: str, cols: list[str]) -> str:
    parts = [f"""
SELECT '{c}' AS "column", round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,
       round(min({c}), 2)::DOUBLE AS min, round(max({c}), 2)::DOUBLE AS max, round(median({c}), 2)::DOUBLE AS median,
       round(skewness({c}), 2) AS skewness, round(quantile_cont({c}, 0.25), 2)::DOUBLE AS q25,
       round(quantile_cont({c}, 0.75), 2)::DOUBLE AS q75
FROM t""" for c in cols]
    return f"WITH t AS ({src})\n" + "\nUNION ALL".join(parts)


@register("AGG1", sql=_numeric_summary_sql(LINEITEM_NULLS_SQL, _LI_NUM))
def agg1(spark, sf):
    return summary.numeric_summary(lineitem_nulls(spark, sf))


@register("AGG2", sql="""
WITH long AS (
  SELECT 'o_orderstatus' AS "column", CAST(o_orderstatus AS VARCHAR) AS value FROM orders UNION ALL
  SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders UNION ALL
  SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR) FROM orders),
vc AS (SELECT "column", value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
pc AS (SELECT "column", count(*) AS unique_count,
              arg_min(value, (-count, value)) AS most_frequent FROM vc GROUP BY 1),
top AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM vc)
SELECT top."column", unique_count, most_frequent, value, count, rank::INTEGER AS rank
FROM top JOIN pc USING ("column") WHERE rank <= 10
""")
def agg2(spark, sf):
    return summary.categorical_summary(table(spark, sf, "orders"), k=10)


def _corr_sql(src: str, cols: list[str], fill: bool) -> str:
    if fill:
        sel = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM t0)) AS {c}" for c in cols)
        head = f"WITH t0 AS ({src}), t AS (SELECT {sel} FROM t0)"
    else:
        head = f"WITH t AS ({src})"
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS column_x, '{b}' AS column_y, "
                         f"coalesce(round(corr({a}, {b}), 3), 0.0) AS correlation FROM t")
    return head + "\n" + "\nUNION ALL ".join(parts)


@register("AGG3", sql=_corr_sql(LINEITEM_NULLS_SQL, _LI_NUM, fill=True))
def agg3(spark, sf):
    return summary.correlation(lineitem_nulls(spark, sf))


@register("AGG4", sql=_corr_sql(LINEITEM_NULLS_SQL, _LI_NUM, fill=False))
def agg4(spark, sf):
    return summary.correlation_pairwise(lineitem_nulls(spark, sf))


@register("AGG5", sql=f"""
WITH t AS ({CUSTOMER_NULLS_SQL}),
h AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS row FROM t ORDER BY c_custkey LIMIT 500),
f AS (SELECT row, list_filter([CASE WHEN c_custkey IS NULL THEN 0 END, CASE WHEN c_name IS NULL THEN 1 END,
                                CASE WHEN c_nationkey IS NULL THEN 2 END, CASE WHEN c_acctbal IS NULL THEN 3 END,
                                CASE WHEN c_mktsegment IS NULL THEN 4 END], lambda x: x IS NOT NULL) AS cols FROM h)
SELECT row::INTEGER AS row, array_to_string(cols, ',') AS cols FROM f WHERE len(cols) > 0
""")
def agg5(spark, sf):
    return summary.missing_map(customer_nulls(spark, sf), "c_custkey", 500)


def _hist_sql(src: str, col: str, bins: str) -> str:
    """NumPy-equivalent histogram in SQL (bins: 'auto' or an integer literal)."""
    if bins == "auto":
        nb = """CASE WHEN least(greatest(fd, sqrt_w / 2), sturges) > 0
                 THEN ceil((last_e - first_e) / least(greatest(fd, sqrt_w / 2), sturges))::BIGINT
                 ELSE 1 END"""
    else:
        nb = f"{int(bins)}"
    return f"""
WITH t AS (SELECT {col}::DOUBLE AS v FROM ({src}) WHERE {col} IS NOT NULL AND NOT isnan({col}::DOUBLE)),
s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi,
             quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM t),
e AS (SELECT n, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS first_e,
             CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS last_e,
             (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * (q75 - q25) * pow(n, -1.0 / 3.0) AS fd,
             (hi - lo) / sqrt(n) AS sqrt_w FROM s),
p AS (SELECT first_e, last_e, {nb} AS nb FROM e),
k AS (SELECT *, (last_e - first_e) / nb AS step FROM p),
i0 AS (SELECT v, k.*, floor((v - first_e) / (last_e - first_e) * nb)::BIGINT AS i FROM t, k),
i1 AS (SELECT v, first_e, last_e, nb, step, CASE WHEN i = nb THEN nb - 1 ELSE i END AS i FROM i0),
i2 AS (SELECT v, first_e, last_e, nb, step,
              CASE WHEN v < (CASE WHEN i = nb THEN last_e ELSE i * step + first_e END) THEN i - 1 ELSE i END AS i
       FROM i1),
i3 AS (SELECT CASE WHEN v >= (CASE WHEN i + 1 = nb THEN last_e ELSE (i + 1) * step + first_e END) AND i <> nb - 1
                   THEN i + 1 ELSE i END AS i FROM i2),
c AS (SELECT i, count(*) AS cnt FROM i3 GROUP BY i),
b AS (SELECT unnest(range(0, (SELECT nb FROM k))) AS bin)
SELECT bin::INTEGER AS bin,
       round(CASE WHEN bin = nb THEN last_e ELSE bin * step + first_e END, 2) AS bin_lo,
       round(CASE WHEN bin + 1 = nb THEN last_e ELSE (bin + 1) * step + first_e END, 2) AS bin_hi,
       coalesce(cnt, 0) AS count
FROM b CROSS JOIN k LEFT JOIN c ON c.i = b.bin
"""


@register("AGG6", sql=_hist_sql("SELECT * FROM lineitem", "l_extendedprice", "auto"))
def agg6(spark, sf):
    return summary.histogram(table(spark, sf, "lineitem"), "l_extendedprice", "auto")


@register("AGG7", sql=_hist_sql("SELECT * FROM orders", "o_totalprice", "15"))
def agg7(spark, sf):
    return summary.histogram(table(spark, sf, "orders"), "o_totalprice", 15)


@register("AGG8", sql="""
SELECT CAST(p_brand AS VARCHAR) AS label, count(*) AS count FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY count(*) DESC, label LIMIT 20
""")
def agg8(spark, sf):
    return summary.category_distribution(table(spark, sf, "part"), "p_brand", 20)


S = f"WITH sales AS ({SALES_SQL})\n"


@register("AGG9", sql=S + """
SELECT CAST(nation AS VARCHAR) AS label, round(coalesce(sum(TRY_CAST(sales AS DOUBLE)), 0.0), 2) AS value
FROM sales WHERE nation IS NOT NULL GROUP BY nation ORDER BY nation LIMIT 50
""")
def agg9(spark, sf):
    return charts.chart(sales_view(spark, sf), "nation", "sales", "SUM")


@register("AGG9_MEDIAN", sql=S + """
SELECT CAST(region AS VARCHAR) AS label, round(median(TRY_CAST(quantity AS DOUBLE)), 2) AS value
FROM sales WHERE region IS NOT NULL GROUP BY region ORDER BY region LIMIT 50
""")
def agg9_median(spark, sf):
    return charts.chart(sales_view(spark, sf), "region", "quantity", "MEDIAN")


@register("AGG10", sql=S + """
SELECT CAST(segment AS VARCHAR) AS label,
  round(coalesce(sum(CASE WHEN region = 'AFRICA' THEN sales END), 0.0), 2) AS "AFRICA",
  round(coalesce(sum(CASE WHEN region = 'AMERICA' THEN sales END), 0.0), 2) AS "AMERICA",
  round(coalesce(sum(CASE WHEN region = 'ASIA' THEN sales END), 0.0), 2) AS "ASIA",
  round(coalesce(sum(CASE WHEN region = 'EUROPE' THEN sales END), 0.0), 2) AS "EUROPE",
  round(coalesce(sum(CASE WHEN region = 'MIDDLE EAST' THEN sales END), 0.0), 2) AS "MIDDLE EAST"
FROM sales WHERE segment IS NOT NULL AND region IS NOT NULL GROUP BY segment
""")
def agg10(spark, sf):
    return charts.chart_pivot(sales_view(spark, sf), "segment", "region", "sales", "SUM")


@register("AGG11", sql="""
SELECT event_id, value, user_id FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL
ORDER BY event_id LIMIT 500
""")
def agg11(spark, sf):
    return charts.scatter(table(spark, sf, "events"), "value", "user_id", order_by="event_id", limit=500)


@register("AGG12", sql="""
SELECT CAST(event_type AS VARCHAR) AS label, count(value) AS n, round(min(value), 4) AS min,
       round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median,
       round(quantile_cont(value, 0.75), 4) AS q3, round(max(value), 4) AS max
FROM events WHERE event_type IS NOT NULL GROUP BY event_type
""")
def agg12(spark, sf):
    return charts.box_summary(table(spark, sf, "events"), "event_type", "value")


@register("AGG15", sql="""
SELECT CAST(o_orderstatus AS VARCHAR) AS class, count(*) AS count,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage
FROM orders GROUP BY o_orderstatus
""")
def agg15(spark, sf):
    return summary.class_distribution(table(spark, sf, "orders"), "o_orderstatus")
