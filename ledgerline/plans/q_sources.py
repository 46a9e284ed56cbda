"""Source/sink, projection and encoding queries (SRC, PRJ, FE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import columns as C
from ledgerline.operators import catalog, clean, features, questions
from ledgerline.plans.fixtures import CUSTOMER_DIRTY_SQL, CUSTOMER_NULLS_SQL, customer_dirty, customer_nulls
from ledgerline.plans.registry import register
from ledgerline.session import scratch_path
from ledgerline.sources import files
from ledgerline.sources.tables import SALES_SQL, TABLES, sales_view, table


@register("SRC1", sql="""
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def src1(spark, sf):
    path = scratch_path(spark, "csv") + "/customer.csv"
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return files.read_table(spark, path, "csv")


@register("SRC2", sql="""
SELECT regexp_extract(filename, '([^/]+)$', 1) AS file_name,
       lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) AS extension, size,
       left(lower(hex(content)), 16) AS head_hex,
       CASE WHEN lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) NOT IN ('.csv', '.xlsx', '.xls') THEN 'invalid_type'
            ELSE 'ok' END AS verdict
FROM read_blob('/root/testdata/sf0.01/*.parquet')
""")
def src2(spark, sf):
    return files.check_files(spark, f"{sf.rstrip('/')}/*.parquet").drop("path")


_COUNT_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) = 0 AS is_empty FROM {t}" for t in TABLES)


@register("SRC3", sql=_COUNT_SQL)
def src3(spark, sf):
    return files.table_sizes(spark, {t: table(spark, sf, t) for t in TABLES})


@register("SRC4", sql="SELECT * FROM orders LIMIT 15")
def src4(spark, sf):
    return files.preview(table(spark, sf, "orders"), 15)


@register("SRC5", sql="""
SELECT 'region' AS dataset, v AS version, (SELECT count(*) FROM region) AS row_count
FROM (VALUES (1), (2)) AS t(v)
""")
def src5(spark, sf):
    root = scratch_path(spark, "versions")
    region = table(spark, sf, "region")
    catalog.write_version(region, root, "region")
    catalog.write_version(region, root, "region")
    return (spark.read.parquet(root).groupBy("dataset", "version")
            .agg(F.count(F.lit(1)).alias("row_count")))


@register("SRC6", sql=f"""
WITH t AS ({CUSTOMER_DIRTY_SQL}),
d AS (SELECT DISTINCT * FROM t),
f AS (SELECT c_custkey, c_name, c_nationkey,
             coalesce(c_acctbal, (SELECT median(c_acctbal) FROM d)) AS c_acctbal,
             coalesce(c_mktsegment, (SELECT c_mktsegment FROM d WHERE c_mktsegment IS NOT NULL GROUP BY 1
                                     ORDER BY count(*) DESC, c_mktsegment LIMIT 1)) AS c_mktsegment FROM d),
b AS (SELECT quantile_cont(c_custkey, 0.01) AS lo1, quantile_cont(c_custkey, 0.99) AS hi1,
             quantile_cont(c_nationkey, 0.01) AS lo2, quantile_cont(c_nationkey, 0.99) AS hi2,
             quantile_cont(c_acctbal, 0.01) AS lo3, quantile_cont(c_acctbal, 0.99) AS hi3 FROM f)
SELECT round(least(greatest(c_custkey::DOUBLE, lo1), hi1), 4) AS c_custkey, c_name,
       round(least(greatest(c_nationkey::DOUBLE, lo2), hi2), 4) AS c_nationkey,
       round(least(greatest(c_acctbal, lo3), hi3), 4) AS c_acctbal, c_mktsegment
FROM f, b
""")
def src6(spark, sf):
    path = scratch_path(spark, "cleaned")
    clean.clean(customer_dirty(spark, sf)).write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    for c in ["c_custkey", "c_nationkey", "c_acctbal"]:
        out = out.withColumn(c, F.round(c, 4))
    return out


@register("SRC10", note="seeded synthetic rows, one per order; rows-only")
def src10(spark, sf):
    n = table(spark, sf, "orders").count()
    return files.synthetic_sales(spark, n)


# ---------------------------------------------------------------- PRJ
@register("PRJ1", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
""")
def prj1(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*C.numeric_columns(li))


@register("PRJ2", sql="SELECT l_quantity, l_discount, l_tax, 0.0::DOUBLE AS promo_flag FROM lineitem")
def prj2(spark, sf):
    return C.align_features(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "promo_flag"])


@register("PRJ3", sql=f"WITH sales AS ({SALES_SQL}) SELECT sales, region, category, sale_date FROM sales")
def prj3(spark, sf):
    s = sales_view(spark, sf)
    roles = C.business_columns(s)
    return s.select(roles["sales"], roles["region"], roles["product"], roles["date"])


@register("PRJ4", sql="SELECT l_extendedprice FROM lineitem")
def prj4(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(C.resolve_name(li.columns, "  L_ExtendedPrice "))


@register("PRJ5", sql="SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def prj5(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*C.feature_columns(li))


@register("PRJ6", sql="""
SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE)
       AS balance FROM customer
""")
def prj6(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
        .alias("balance"))
    return c.select("c_custkey", C.lenient_double("balance").alias("balance"))


@register("PRJ7", sql="""
SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-03-01' AND l_shipdate < TIMESTAMP '1998-04-01'
""")
def prj7(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return questions.rows_in_month(li, "l_shipdate", "1998-03")


@register("PRJ8", sql=f"SELECT * FROM ({CUSTOMER_NULLS_SQL}) WHERE c_acctbal IS NOT NULL")
def prj8(spark, sf):
    return customer_nulls(spark, sf).dropna(subset=["c_acctbal"])


@register("PRJ9", sql="""
SELECT l_orderkey, l_linenumber, 5.0::DOUBLE AS l_quantity, 0.1::DOUBLE AS l_discount, l_extendedprice FROM lineitem
""")
def prj9(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                             "l_extendedprice")
    return C.overlay_constants(li, {"l_discount": 0.1, "l_quantity": "5", "not_a_column": 1})


@register("PRJ10", sql="SELECT * FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 5")
def prj10(spark, sf):
    return questions.row_at(table(spark, sf, "orders"), "o_orderkey", 5)


# ---------------------------------------------------------------- FE
@register("FE1", sql="""
SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c_mktsegment FROM customer
""")
def fe1(spark, sf):
    out, _ = features.label_encode(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"),
                                   ["c_mktsegment"])
    return out


@register("FE2", sql="""
WITH m AS (SELECT n_name AS label, (row_number() OVER (ORDER BY n_name) - 1)::DOUBLE AS code
           FROM nation WHERE n_regionkey = 0)
SELECT c.c_custkey, coalesce(m.code, 0.0) AS n_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN m ON n.n_name = m.label
""")
def fe2(spark, sf):
    nation = table(spark, sf, "nation")
    mapping = features.label_map(nation.where(F.col("n_regionkey") == 0), "n_name")
    cust = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")) \
        .select("c_custkey", "n_name")
    return features.encode_with_map(cust, "n_name", mapping)


@register("FE3", sql="""
SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, month(o_orderdate)::INTEGER AS o_orderdate_month,
       day(o_orderdate)::INTEGER AS o_orderdate_day FROM orders
""")
def fe3(spark, sf):
    return features.date_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"])


@register("FE4", sql="""
SELECT l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice,
  round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS l_discount
FROM lineitem
""")
def fe4(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    out = features.standard_scale(li, cols)
    for c in cols:
        out = out.withColumn(c, F.round(c, 6))
    return out


@register("FE6", sql=f"""
SELECT c_custkey, CAST(CASE WHEN c_mktsegment IS NULL THEN -1
                            ELSE dense_rank() OVER (ORDER BY c_mktsegment) - 1 END AS INTEGER) AS c_mktsegment
FROM ({CUSTOMER_NULLS_SQL})
""")
def fe6(spark, sf):
    return features.category_codes(customer_nulls(spark, sf).select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


def _src9_sql(bq9: str) -> str:
    """Two appended root-cause runs: the BQ9 oracle twice, tagged by run."""
    return (f"SELECT *, 'root_cause' AS result_kind, 1 AS run_id FROM ({bq9}) "
            f"UNION ALL SELECT *, 'root_cause' AS result_kind, 2 AS run_id FROM ({bq9})")


def src9(spark, sf):
    from ledgerline.operators import questions
    path = scratch_path(spark, "results")
    for run in (1, 2):
        files.append_results(questions.root_cause(sales_view(spark, sf), "sales", "sale_date"), path, "root_cause", run)
    return spark.read.parquet(path)
