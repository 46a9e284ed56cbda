"""Anomaly and forest-based quality queries (AN1–AN5, DQ6–DQ8).

Forest and PCA outputs depend on random trees and fitted loadings, so they
have no SQL oracle; tests check them against brute-force NumPy versions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import anomaly, profile
from ledgerline.plans.fixtures import customer_dirty
from ledgerline.plans.registry import register
from ledgerline.sources.tables import table

_EVENT_FEATURES = ["value", "user_id"]
_LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("DQ6", note="isolation forest share; rows-only")
def dq6(spark, sf):
    df = customer_dirty(spark, sf)
    return spark.createDataFrame([(profile.outlier_share(df),)], "outliers_pct double")


@register("DQ7", note="quality score with forest outlier share; rows-only")
def dq7(spark, sf):
    return profile.quality(customer_dirty(spark, sf))


@register("DQ8", note="issue list incl. forest outliers; rows-only")
def dq8(spark, sf):
    df = customer_dirty(spark, sf)
    return profile.quality_issues(df, outliers_pct=profile.outlier_share(df))


@register("AN1", note="isolation forest scores and flags; rows-only")
def an1(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_LI_FEATURES)
    out = anomaly.isolation_forest_flags(li, _LI_FEATURES, trees=100, contamination=0.05, scale=True)
    return out.select("l_orderkey", "l_linenumber", F.round("iso_score", 6).alias("iso_score"), "is_outlier")


@register("AN2", note="0-100 risk from forest scores; rows-only")
def an2(spark, sf):
    ev = table(spark, sf, "events").select("event_id", *_EVENT_FEATURES)
    flagged = anomaly.isolation_forest_flags(ev, _EVENT_FEATURES, trees=100, contamination=0.05, scale=True)
    return anomaly.risk_scores(flagged).select("event_id", "risk_score")


@register("AN3", note="local outlier factor, 20 neighbours; tests compare it with all pairs")
def an3(spark, sf):
    ev = table(spark, sf, "events").select("event_id", *_EVENT_FEATURES)
    return anomaly.local_outliers(ev, _EVENT_FEATURES).select("event_id", "lof", "is_outlier")


@register("AN4", note="PCA reconstruction error; rows-only")
def an4(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_LI_FEATURES)
    out, _ = anomaly.reconstruction_errors(li, _LI_FEATURES)
    return out.select("l_orderkey", "l_linenumber", F.round("recon_error", 6).alias("recon_error"))


@register("AN5", note="ensemble, top 100 by risk; rows-only")
def an5(spark, sf):
    ev = table(spark, sf, "events")
    return anomaly.anomalies(ev, _EVENT_FEATURES, key="event_id", contamination=0.05)


@register("AN5_SUMMARY", note="ensemble counts; rows-only")
def an5_summary(spark, sf):
    return anomaly.anomaly_summary(table(spark, sf, "events"), _EVENT_FEATURES, key="event_id")
