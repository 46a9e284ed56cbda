"""Feature drift: two-sample Kolmogorov–Smirnov per feature, model health (ML16, ML17).

The statistic needs running counts over the sorted values of both samples.
A single window ordered by value would put a whole feature in one task, so
the prefix sums are computed in two levels: values are cut into ~``buckets``
ranges by approximate quantiles, running counts are taken inside each
(feature, bucket), and the small table of bucket totals supplies the
offsets. The p-value uses the limiting Kolmogorov distribution of
√(n₁n₂/(n₁+n₂))·D (asymptotic form).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import columns as C
from ledgerline.functions.exprs import kolmogorov_sf
from ledgerline.functions.ordering import running_totals
from ledgerline.session import cut_lineage


def _long(df: DataFrame, features: list[str], tag: int) -> DataFrame:
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    return (df.select(F.explode(F.array(*pairs)).alias("kv"))
            .select("kv.feature", "kv.value", F.lit(tag).alias("is_cur"))
            .where(F.col("value").isNotNull() & ~F.isnan("value")))


def ks_statistics(train: DataFrame, current: DataFrame, features: list[str], buckets: int = 256,
                  min_size: int = 6) -> DataFrame:
    """Per feature: n_train, n_current, ks_statistic D and asymptotic p-value."""
    feats = [f for f in features if f in train.columns and f in current.columns
             and C.is_numeric(train.schema[f].dataType) and C.is_numeric(current.schema[f].dataType)]
    spark = train.sparkSession
    if not feats:
        return spark.createDataFrame([], "feature string, n_train bigint, n_current bigint, ks_statistic double, "
                                         "p_value double")
    both = _long(train, feats, 0).unionByName(_long(current, feats, 1))
    # Counted once and kept: the ranges, their totals and the running counts all read the counts, not the samples.
    counts = cut_lineage(both.groupBy("feature", "value").agg(
        F.count_if(F.col("is_cur") == 0).alias("c1"), F.count_if(F.col("is_cur") == 1).alias("c2")))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy("feature").agg(F.percentile_approx("value", probs, 10000).alias("cuts"),
                                         F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    # One row per feature: bounded by the feature count.
    with_bucket = counts.join(F.broadcast(cuts), "feature").withColumn(
        "bucket", F.size(F.filter("cuts", lambda b: b < F.col("value"))))
    local_w = (Window.partitionBy("feature", "bucket").orderBy("value")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = with_bucket.select("feature", "bucket", "value", "n1", "n2",
                               F.sum("c1").over(local_w).alias("l1"), F.sum("c2").over(local_w).alias("l2"))
    totals = with_bucket.groupBy("feature", "bucket").agg(F.sum("c1").alias("t1"), F.sum("c2").alias("t2"))
    before = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("feature", "bucket", F.coalesce(F.sum("t1").over(before), F.lit(0)).alias("o1"),
                            F.coalesce(F.sum("t2").over(before), F.lit(0)).alias("o2"))
    # offsets has at most buckets rows per feature.
    gaps = local.join(F.broadcast(offsets), ["feature", "bucket"]).select(
        "feature", "n1", "n2",
        # A feature without a value in one of the samples has no gap, and no line in the result.
        F.abs(F.try_divide(F.col("o1") + F.col("l1"), "n1") - F.try_divide(F.col("o2") + F.col("l2"), "n2")).alias("gap"))
    d = gaps.where("gap IS NOT NULL").groupBy("feature").agg(F.first("n1").alias("n_train"), F.first("n2").alias("n_current"),
                                    F.max("gap").alias("ks_statistic"))
    en = F.col("n_train") * F.col("n_current") / (F.col("n_train") + F.col("n_current"))
    p = kolmogorov_sf(F.sqrt(en) * F.col("ks_statistic"))
    return (d.where((F.col("n_train") >= min_size) & (F.col("n_current") >= min_size))
            .select("feature", F.col("n_train").cast("bigint").alias("n_train"),
                    F.col("n_current").cast("bigint").alias("n_current"), "ks_statistic", p.alias("p_value")))


def ks_by_group(train: DataFrame, current: DataFrame, by: list[str], alpha: float = 0.05, buckets: int = 32,
                min_size: int = 6) -> DataFrame:
    """ML16 of many current samples against one training sample, from counted values.

    ``train``: feature, value, n; ``current``: the ``by`` columns, feature,
    value, n. Between two values of a sample its share is constant and the
    training share only rises, so the largest gap lies at a sample's value or
    just below it: the training share is looked up at those values alone, and
    training values are never multiplied by the number of samples.
    """
    points = (train.select("feature", "value", "n")
              .unionByName(current.select("feature", "value", F.lit(0).cast("long").alias("n")))
              .groupBy("feature", "value").agg(F.sum("n").alias("t")))
    known = running_totals(points, ["feature"], ["t"], buckets)
    mine = running_totals(current.groupBy(*by, "feature", "value").agg(F.sum("n").alias("c")), [*by, "feature"], ["c"],
                    buckets)
    here = F.abs(F.col("t_upto") / F.col("t_all") - F.col("c_upto") / F.col("c_all"))
    below = F.abs((F.col("t_upto") - F.col("t")) / F.col("t_all") - (F.col("c_upto") - F.col("c")) / F.col("c_all"))
    d = (mine.join(known.where("t_all > 0"), ["feature", "value"])
         .groupBy(*by, "feature").agg(F.first("t_all").alias("n_train"), F.first("c_all").alias("n_current"),
                                      F.max(F.greatest(here, below)).alias("ks")))
    en = F.col("n_train") * F.col("n_current") / (F.col("n_train") + F.col("n_current"))
    p = kolmogorov_sf(F.sqrt(en) * F.col("ks"))
    return (d.where((F.col("n_train") >= min_size) & (F.col("n_current") >= min_size))
            .select(*by, "feature", "n_train", "n_current", F.round("ks", 4).alias("ks_statistic"),
                    F.round(p, 4).alias("p_value"), (p < alpha).alias("drift_detected")))


def drift(train: DataFrame, current: DataFrame, features: list[str], alpha: float = 0.05) -> DataFrame:
    """ML16: per feature KS statistic, p-value (4 dp) and drift flag (p < alpha)."""
    ks = ks_statistics(train, current, features)
    return ks.select("feature", "n_train", "n_current", F.round("ks_statistic", 4).alias("ks_statistic"),
                     F.round("p_value", 4).alias("p_value"), (F.col("p_value") < alpha).alias("drift_detected"))


def model_health(drift_df: DataFrame, target_present: bool = True, by: tuple = ()) -> DataFrame:
    """ML17: drift %, estimated model decay (.35 or .25 × drift %) and status; one row, or one per group of ``by``."""
    pct = F.round(F.coalesce(F.avg(F.col("drift_detected").cast("double")) * 100, F.lit(0.0)), 2)
    s = drift_df.groupBy(*by).agg(pct.alias("drift_percentage"), F.count(F.lit(1)).alias("features_tested"))
    factor = 0.35 if target_present else 0.25
    decay = F.round(F.col("drift_percentage") * factor, 2)
    status = (F.when(decay > 25.0, "critical")
              .when((decay > 15.0) | (F.col("drift_percentage") > 25.0), "at_risk").otherwise("healthy"))
    return s.select(*by, "drift_percentage", "features_tested", decay.alias("model_drift_percentage"),
                    status.alias("status"), status.isin("at_risk", "critical").alias("retraining_recommended"))
