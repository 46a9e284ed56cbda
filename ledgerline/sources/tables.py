"""Readers for the generated test tables and the wide "sales" view.

The sales view joins lineitem to its order, customer, nation, region and
part, and renames the columns the business operators look for by keyword.
Catalyst prunes the columns, and the size-checked broadcast threshold (or
AQE at run time) turns the joins against the tiny ``nation`` / ``region``
tables into broadcast joins. Without statistics Catalyst keeps the written
join order, so the order-level chain is built first and line items take
only two shuffle joins (order key, part key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with business-friendly column names."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    p = table(spark, sf_dir, "part")
    # The customer/nation/region chain is joined to orders first, at order
    # grain, so line-item-sized rows are shuffled only for the order and the
    # part joins (not a third time on the customer key).
    # nation and region join on keys with a handful of values: a shuffle join
    # there would pile all orders into a few tasks, so they are broadcast —
    # after sized_join has proven them small.
    from ledgerline.functions.joins import sized_join
    geo = sized_join(n, r, n.n_regionkey == r.r_regionkey)
    order_side = sized_join(o.join(c, o.o_custkey == c.c_custkey), geo, c.c_nationkey == geo.n_nationkey)
    joined = li.join(order_side, li.l_orderkey == order_side.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return joined.select(
        F.col("l_shipdate").alias("sale_date"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("o_orderpriority").alias("priority"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("sales"),
        F.col("l_discount").alias("discount"),
    )


# The same view in SQL, for the DuckDB oracle.
SALES_SQL = """
SELECT l.l_shipdate AS sale_date, r.r_name AS region, n.n_name AS nation,
       c.c_mktsegment AS segment, p.p_type AS category, p.p_brand AS brand,
       o.o_orderpriority AS priority, l.l_returnflag AS returnflag,
       l.l_linestatus AS linestatus, l.l_quantity AS quantity,
       l.l_extendedprice AS sales, l.l_discount AS discount
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
"""


