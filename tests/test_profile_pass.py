"""The one-pass profile against pandas, on cells that are missing, equal, long or odd, and its number of scans."""

import numpy as np
import pandas as pd
import pytest

from ledgerline.operators import clean, profile

SCHEMA = "sales_amount double, units int, order_date string, note string, tags array<string>, m map<string,int>"


def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        rows.append((float(rng.normal(0, 5)), int(rng.integers(-3, 40)), f"2024-01-{i % 28 + 1:02d}",
                     "x" * 300 + str(i % 7), ["a", None], {"k": i % 2}))
    rows += [(float("nan"), None, "not a date", None, None, None)] * 3
    rows += [(0.0, 1, None, "", [], {}), (-0.0, 1, None, "", [], {}), (None, 2, "2024-02-30", "ü", ["a"], {"k": None})]
    rows += rows[:50]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_one_pass_equals_plain_counts(spark):
    df, rows = table(spark)
    count, duplicates, got = profile.measure(df)
    plain = pd.DataFrame([[None if v is None or v != v else repr(v + 0.0 if isinstance(v, float) else v) for v in r]
                          for r in rows], columns=list(got))
    assert count == len(rows) and duplicates == len(rows) - len(plain.fillna("none").drop_duplicates())
    for name in got:
        assert got[name]["missing"] == plain[name].isna().sum(), name
        assert got[name]["distinct"] == plain[name].nunique(), name
    assert got["units"]["negative"] == sum(r[1] is not None and r[1] < 0 for r in rows)
    assert got["sales_amount"]["negative"] == sum(r[0] is not None and r[0] < 0 for r in rows)
    assert got["order_date"]["bad_dates"] == 4
    assert got["note"]["samples"].startswith(", " + "x" * profile.KEY_CHARS)
    assert profile.uniqueness(df).first()["duplicate_rows"] == duplicates


def test_dimensions_and_issues_come_from_the_same_counts(spark):
    df, rows = table(spark)
    q = profile.quality(df, with_outliers=False).first()
    assert q["completeness"] == profile.completeness(df).first()["completeness"]
    assert q["uniqueness"] == profile.uniqueness(df).first()["uniqueness"]
    assert q["validity"] == profile.validity(df).first()["validity"] < 100
    assert q["consistency"] == profile.consistency(df).first()["consistency"] < 100
    assert q["issues"] == [r["issue"] for r in profile.quality_issues(df).collect()]
    after = {r["metric"]: r for r in clean.clean_summary(df, df.dropDuplicates(["units"])).collect()}
    assert after["rows"]["before"] == len(rows) and after["duplicate_rows"]["after"] == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert profile.measure(df)[:2] == (0, 0)
    assert [r["distinct_count"] for r in profile.profile(df).collect()] == [0] * 6
    assert profile.uniqueness(df).first()["uniqueness"] == profile.validity(df).first()["validity"] == 100.0
    assert profile.quality(df).first()["issues"] == ["Dataset is empty."]


@pytest.mark.parametrize("ask", [profile.profile, profile.validity, profile.consistency, profile.quality_issues,
                                 lambda d: profile.quality(d, with_outliers=False)])
def test_the_table_is_read_once(spark, tmp_path, ask):
    path = str(tmp_path / "t")
    table(spark)[0].repartition(3).write.parquet(path)
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    df = spark.read.parquet(path)
    n = df.count()
    ask(df.mapInArrow(seen, df.schema)).collect()
    assert passes.value == n
