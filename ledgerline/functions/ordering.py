"""Positions in a global order without funnelling rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage


def consecutive_index(df: DataFrame, order_col: str, out: str = "_idx") -> DataFrame:
    """0-based position in ``order_col`` order without funnelling rows to one task.

    Range-partitions by the order, counts rows per partition, turns the
    (small) per-partition counts into offsets, and adds each row's local rank.
    """
    # The hash tie-breaker spreads a heavily repeated order value over partitions; equal rows tie for good.
    # The ranges are checkpointed once, so that offsets and local ranks come from the same evaluation.
    ranged = cut_lineage(df.withColumn("_tb", F.xxhash64(*df.columns))
                         .repartitionByRange(order_col, "_tb").withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1))).alias("_off"))
    local = Window.partitionBy("_pid").orderBy(order_col, "_tb")
    return (ranged.withColumn("_local", F.row_number().over(local) - 1)
            .join(F.broadcast(offsets), "_pid")  # one row per partition
            .withColumn(out, F.coalesce("_off", F.lit(0)) + F.col("_local"))
            .drop("_pid", "_local", "_off", "_tb"))


def running_totals(counts: DataFrame, by: list[str], names: list[str], buckets: int,
                   keep_range: bool = False) -> DataFrame:
    """Running sums ``<name>_upto`` over value and totals ``<name>_all``, per group of ``by``.

    A group is cut into value ranges; sums run inside a range and the ranges'
    totals give the offsets, so a large group is spread over many tasks. The
    range stays as ``_range`` with ``keep_range``.
    """
    probs = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy(*by).agg(F.percentile_approx("value", probs, 1000).alias("_cuts"))
    ranged = counts.join(cuts, by).withColumn(
        "_range", F.size(F.filter("_cuts", lambda b: b < F.col("value")))).drop("_cuts")
    inside = (Window.partitionBy(*by, "_range").orderBy("value")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in names]).select(
        *by, "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in names],
        *[F.sum(f"_{n}").over(Window.partitionBy(*by)).alias(f"{n}_all") for n in names])
    local = ranged.withColumns({f"_{n}_in": F.sum(n).over(inside) for n in names})
    return (local.join(offsets, [*by, "_range"])
            .withColumns({f"{n}_upto": F.col(f"_{n}_before") + F.col(f"_{n}_in") for n in names})
            .drop(*([] if keep_range else ["_range"]), *[f"_{n}_{part}" for n in names for part in ("before", "in")]))
