"""Join, sort, top-k, search and scalar-function queries (JN, SRT, SET1, FN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.joins import sized_join
from ledgerline.operators import catalog, questions, search
from ledgerline.plans.fixtures import CUSTOMER_NULLS_SQL, customer_nulls
from ledgerline.plans.registry import register
from ledgerline.sources.tables import SALES_SQL, sales_view, table

S = f"WITH sales AS ({SALES_SQL})\n"


def _jn1_sql(full: bool) -> str:
    cond = "" if full else "WHERE np > 0 AND nc > 0"
    return S + f"""
, g AS (SELECT CAST(brand AS VARCHAR) AS segment,
          coalesce(sum(CASE WHEN sale_date < TIMESTAMP '2001-11-01' THEN sales END), 0.0) AS previous_value,
          coalesce(sum(CASE WHEN sale_date >= TIMESTAMP '2001-11-01' THEN sales END), 0.0) AS current_value,
          count(CASE WHEN sale_date < TIMESTAMP '2001-11-01' THEN 1 END) AS np,
          count(CASE WHEN sale_date >= TIMESTAMP '2001-11-01' THEN 1 END) AS nc
        FROM sales WHERE sale_date >= TIMESTAMP '2001-10-01' AND sale_date < TIMESTAMP '2001-12-01'
          AND brand IS NOT NULL GROUP BY brand)
SELECT segment, round(previous_value, 2) AS previous_value, round(current_value, 2) AS current_value,
       round(previous_value - current_value, 2) AS "drop" FROM g {cond}
"""


def _jn1(spark, sf, full):
    out = questions.segment_change(sales_view(spark, sf), "sales", "sale_date", "brand", "2001-10-01", "2001-11-01",
                                   fill_missing=full)
    return out.select("segment", *[F.round(c, 2).alias(c) for c in ("previous_value", "current_value", "drop")])


@register("JN1", sql=_jn1_sql(False))
def jn1(spark, sf):
    return _jn1(spark, sf, False)


@register("JN1_FULL", sql=_jn1_sql(True))
def jn1_full(spark, sf):
    return _jn1(spark, sf, True)


@register("JN2", sql="""
SELECT l.l_orderkey, l.l_linenumber, s.s_name, n.n_name
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
""")
def jn2(spark, sf):
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    dim = sized_join(sup, nat, "s_nationkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    return sized_join(li, dim, "s_suppkey").select("l_orderkey", "l_linenumber", "s_name", "n_name")


@register("JN3", sql="""
SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
""")
def jn3(spark, sf):
    cust = table(spark, sf, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return cust.join(orders, "c_custkey", "left_anti")


@register("JN4", sql="""
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
WHERE r = 1
""")
def jn4(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return catalog.latest_per_key(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@register("SRT1", sql="SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def srt1(spark, sf):
    return (table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
            .orderBy(F.desc("o_orderdate"), "o_orderkey"))


@register("SRT2", sql="""
SELECT event_id, user_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20
""")
def srt2(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return catalog.latest_per_key(ev, ["user_id"], [F.desc("ts"), F.desc("event_id")], n=20)


@register("SRT2_TOP100", sql="SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def srt2_top(spark, sf):
    return (table(spark, sf, "events").select("event_id", "user_id", "value")
            .orderBy(F.desc("value"), "event_id").limit(100))


_SEARCH_PATTERN = "secret|password|token|api[_ ]?key|licen[cs]e"


@register("SET1", sql=f"""
SELECT 'documents' AS source, doc_id AS id, CAST(NULL AS BIGINT) AS part, 'text' AS field FROM documents
  WHERE regexp_matches(text, '{_SEARCH_PATTERN}', 'i')
UNION ALL SELECT 'documents', doc_id, NULL, 'source' FROM documents WHERE regexp_matches(source, '{_SEARCH_PATTERN}', 'i')
UNION ALL SELECT 'conversations', conv_id, CAST(turn AS BIGINT), 'text' FROM conversations
  WHERE regexp_matches(text, '{_SEARCH_PATTERN}', 'i')
UNION ALL SELECT 'pages', page_id, NULL, 'url' FROM pages WHERE regexp_matches(url, '{_SEARCH_PATTERN}', 'i')
UNION ALL SELECT 'pages', page_id, NULL, 'html' FROM pages WHERE regexp_matches(html, '{_SEARCH_PATTERN}', 'i')
UNION ALL SELECT 'benchmark', item_id, NULL, 'text' FROM benchmark WHERE regexp_matches(text, '{_SEARCH_PATTERN}', 'i')
""")
def set1(spark, sf):
    tables = {
        "documents": (table(spark, sf, "documents"), ["doc_id"], ["text", "source"]),
        "conversations": (table(spark, sf, "conversations"), ["conv_id", "turn"], ["text"]),
        "pages": (table(spark, sf, "pages"), ["page_id"], ["url", "html"]),
        "benchmark": (table(spark, sf, "benchmark"), ["item_id"], ["text"]),
    }
    return search.search(tables, _SEARCH_PATTERN)


@register("FN1", sql="""
SELECT page_id, lower(trim(url)) AS url_lower, regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) AS url_ext,
       replace(replace(url, 'https://', ''), 'http://', '') AS host_path,
       contains(lower(html), '<title>') AS has_title, starts_with(lower(url), 'https') AS is_https,
       regexp_matches(html, 'copyright', 'i') AS mentions_copyright
FROM pages
""")
def fn1(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(
        "page_id", F.lower(F.trim("url")).alias("url_lower"),
        F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1).alias("url_ext"),
        F.replace(F.replace(F.col("url"), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")).alias("host_path"),
        F.contains(F.lower("html"), F.lit("<title>")).alias("has_title"),
        F.startswith(F.lower("url"), F.lit("https")).alias("is_https"),
        F.col("html").rlike("(?i)copyright").alias("mentions_copyright"))


@register("FN2", sql="""
SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d,
       strftime(o_orderdate, '%B %Y') AS month_name,
       strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month_start,
       strftime(make_date(year(o_orderdate), 1, 1), '%Y-%m-%d') AS year_start,
       strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS week_later
FROM orders
""")
def fn2(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    return o.select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"),
        F.date_format(d, "MMMM yyyy").alias("month_name"),
        F.date_format(F.add_months(F.trunc(d, "month"), 1), "yyyy-MM-dd").alias("next_month_start"),
        F.date_format(F.make_date(F.year(d), F.lit(1), F.lit(1)), "yyyy-MM-dd").alias("year_start"),
        F.date_format(F.date_add(d, 7), "yyyy-MM-dd").alias("week_later"))


@register("FN3", sql="""
SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 4) AS root_price,
       round(sin(l_linenumber), 6) AS s, round(cos(l_linenumber), 6) AS c,
       round(abs(l_discount - 0.05), 4) AS disc_gap, least(greatest(l_quantity, 5.0), 45.0) AS qty_clamped,
       round(l_extendedprice * l_discount * 100.0 / l_extendedprice, 4) AS pct,
       round(l_extendedprice + 1.96 * l_tax, 4) AS band_hi
FROM lineitem
""")
def fn3(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.round(F.sqrt("l_extendedprice"), 4).alias("root_price"),
        F.round(F.sin("l_linenumber"), 6).alias("s"), F.round(F.cos("l_linenumber"), 6).alias("c"),
        F.round(F.abs(F.col("l_discount") - 0.05), 4).alias("disc_gap"),
        F.least(F.greatest("l_quantity", F.lit(5.0)), F.lit(45.0)).alias("qty_clamped"),
        F.round(F.try_divide(F.col("l_extendedprice") * F.col("l_discount") * 100.0, F.col("l_extendedprice")), 4)
        .alias("pct"),
        F.round(F.col("l_extendedprice") + 1.96 * F.col("l_tax"), 4).alias("band_hi"))


@register("FN4", sql=f"""
SELECT c_custkey, c_acctbal IS NULL AS acctbal_missing, coalesce(c_acctbal, 0.0) AS acctbal_filled,
       coalesce(c_mktsegment, 'Unknown') AS segment_filled
FROM ({CUSTOMER_NULLS_SQL})
""")
def fn4(spark, sf):
    c = customer_nulls(spark, sf)
    return c.select("c_custkey", F.isnull("c_acctbal").alias("acctbal_missing"),
                    F.coalesce("c_acctbal", F.lit(0.0)).alias("acctbal_filled"),
                    F.coalesce("c_mktsegment", F.lit("Unknown")).alias("segment_filled"))


@register("FN5", sql="""
SELECT r_regionkey, to_json({'r_regionkey': r_regionkey, 'r_name': r_name})::VARCHAR AS payload FROM region
""")
def fn5(spark, sf):
    r = table(spark, sf, "region")
    return r.select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("payload"))


@register("FN6", sql="""
SELECT vec_id, array_to_string(list_transform(list_slice(list_sort(
         list_transform(range(len(embedding)), lambda i: {'nv': -(embedding[i + 1])::DOUBLE, 'ix': i})), 1, 3),
         lambda s: s.ix), ',') AS top3
FROM embeddings
""")
def fn6(spark, sf):
    e = table(spark, sf, "embeddings")
    pairs = F.transform(F.col("embedding"), lambda v, i: F.struct((-v.cast("double")).alias("nv"), i.alias("ix")))
    top = F.slice(F.array_sort(pairs), 1, 3)
    return e.select("vec_id", F.array_join(F.transform(top, lambda s: s["ix"]), ",").alias("top3"))


@register("FN6_MAP", sql="""
SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7.0, 2) AS price_share,
       round(l_quantity / 3.0, 2) AS qty_share
FROM lineitem
""")
def fn6_map(spark, sf):
    li = table(spark, sf, "lineitem")
    m = F.create_map(F.lit("price_share"), F.col("l_extendedprice") / 7.0, F.lit("qty_share"), F.col("l_quantity") / 3.0)
    rounded = F.transform_values(m, lambda k, v: F.round(v, 2))
    return li.select("l_orderkey", "l_linenumber", rounded.alias("m")).select(
        "l_orderkey", "l_linenumber", F.element_at("m", F.lit("price_share")).alias("price_share"),
        F.element_at("m", F.lit("qty_share")).alias("qty_share"))
