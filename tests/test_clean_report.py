"""The cleaning report (DQ11, DQ13): duplicates, filled cells, forest outliers, score before and after."""

from ledgerline.operators import clean


def test_report_counts_what_cleaning_did(spark):
    rows = [(float(i % 17), float(i % 5), "a") for i in range(85)] * 2
    rows += [(None, 900.0, "b"), (800.0, None, None), (float("nan"), 3.5, "c")]
    df = spark.createDataFrame(rows, "x double, y double, s string")
    r = clean.clean_report(df, trees=20).first()
    assert (r.rows_before, r.rows_after) == (173, 88)
    assert r.imputed == {"x": 2, "y": 1, "s": 1}
    assert 1 <= r.outliers_detected <= 5 and r.action == clean.ACTION_CLIPPED
    assert r.score_after > r.score_before
    few = clean.clean_report(df.limit(4), trees=5).first()
    assert few.outliers_detected is None and few.action is None
