"""Defect-injected inputs derived from the test tables, in Spark and in SQL.

Defects follow the sample generator's rule: null a value on every 15th key,
and duplicate every 10th row (a UNION ALL of that slice). Both sides build
the same rows, so operators can be checked against DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.sources.tables import table


def customer_nulls(spark, sf):
    c = table(spark, sf, "customer")
    hole = F.col("c_custkey") % 15 == 0
    return c.select("c_custkey", "c_name", "c_nationkey",
                    F.when(hole, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(hole, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


def customer_dirty(spark, sf):
    base = customer_nulls(spark, sf)
    return base.unionByName(base.where(F.col("c_custkey") % 10 == 0))


CUSTOMER_NULLS_SQL = """
SELECT c_custkey, c_name, c_nationkey,
       CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer
"""

CUSTOMER_DIRTY_SQL = f"""
SELECT * FROM ({CUSTOMER_NULLS_SQL}) UNION ALL SELECT * FROM ({CUSTOMER_NULLS_SQL}) WHERE c_custkey % 10 = 0
"""


def orders_text_dates(spark, sf):
    o = table(spark, sf, "orders")
    bad = F.col("o_orderkey") % 20 == 0
    return o.select("o_orderkey", "o_custkey", "o_totalprice",
                    F.when(bad, F.lit("not a date")).otherwise(F.col("o_orderdate").cast("string"))
                    .alias("order_date"),
                    "o_orderpriority")


ORDERS_TEXT_DATES_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice,
       CASE WHEN o_orderkey % 20 = 0 THEN 'not a date' ELSE CAST(o_orderdate AS VARCHAR) END AS order_date,
       o_orderpriority
FROM orders
"""


def lineitem_nulls(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 15 == 0, F.lit(None))
                         .otherwise(F.col("l_quantity")))


LINEITEM_NULLS_SQL = """
SELECT * REPLACE (CASE WHEN l_orderkey % 15 = 0 THEN NULL ELSE l_quantity END AS l_quantity) FROM lineitem
"""
