"""Full answers on small tables: texts, charts, tables that lack what a question needs, the root-cause report."""

import datetime as dt

import pytest

from ledgerline.operators import answers, forecast, questions


def _sales(spark, rows):
    return spark.createDataFrame([(dt.date(2024, m, d), r, p, v) for m, d, r, p, v in rows],
                                 "Date date, Region string, Product string, Sales double")


ROWS = [(1, 5, "N", "A", 100.0), (1, 9, "S", "B", 50.0), (2, 1, "N", "A", 40.0), (2, 3, "S", "B", 50.0),
        (4, 2, "N", "A", 90.0), (4, 2, "S", "B", 10.0), (4, 3, None, "C", 5.0)]


def _ask(df, question):
    head, *points = answers.answer(df, question).orderBy("position").collect()
    assert head["label"] is None and [p["position"] for p in points] == list(range(1, len(points) + 1))
    return head["intent"], head["text"], [(p["label"], p["value"]) for p in points], points and points[0]["chart_label"]


def test_every_intent(spark):
    df = _sales(spark, ROWS)
    intent, text, points, title = _ask(df, "Which region has maximum sales?")
    assert (intent, points, title) == ("top_region", [("N", 230.0), ("S", 110.0)], "Total Sales by Region")
    assert "**'N'**" in text and "**$230.0**" in text and "**67.6%**" in text and "**$340.0**" in text
    intent, text, points, _ = _ask(df, "Why did sales decrease?")  # March has no rows: a fall to 0
    assert intent == "decline" and points == [("2024-01-31", 150.0), ("2024-02-29", 90.0), ("2024-03-31", 0.0), ("2024-04-30", 105.0)]
    assert "**March 2024**" in text and "**100.0%**" in text and "drill-down" not in text
    intent, text, points, _ = _ask(df, "forecast next month")
    assert intent == "forecast" and [p[0] for p in points] == ["Jan 2024", "Feb 2024", "Apr 2024", "May 2024"]
    assert f"**${points[-1][1]}**" in text
    intent, text, points, _ = _ask(df, "which product is worst")
    assert intent == "bottom" and points[0] == ("C", 5.0) and "'Product'" in text
    intent, text, points, _ = _ask(df, None)
    assert intent == "summary" and points == [("A", 230.0), ("B", 110.0), ("C", 5.0)]
    assert "**7** operational records" in text and "growth" not in text  # the month before the last is 0


def test_drilldown_names_the_segment(spark):
    _, text, _, _ = _ask(_sales(spark, ROWS[:4]), "why did it drop")
    assert "**'A'** segment (under column 'Product')" in text and "**$60.0**" in text


@pytest.mark.parametrize("columns,question,want", [
    (["Sales"], "top region", answers.NO_REGION), (["Region"], "top region", answers.NO_REGION_METRIC),
    (["Sales"], "why did it fall", answers.NO_TREND_DATE), (["Date"], "why did it fall", answers.NO_TREND_METRIC),
    (["Sales"], "predict", answers.NO_FORECAST_DATE), (["Date"], "predict", answers.NO_FORECAST_METRIC),
    (["Sales"], "worst", answers.NO_SEGMENT), (["Product"], "worst", answers.NO_SEGMENT_METRIC)])
def test_missing_columns_are_said(spark, columns, question, want):
    assert _ask(_sales(spark, ROWS).select(*columns), question)[1:3] == (want, [])


def test_few_rows(spark):
    one, none = _sales(spark, ROWS[:1]), _sales(spark, ROWS[:1]).limit(0)
    for df in (one, none):
        assert _ask(df, "why did it fall")[1] == answers.FEW_MONTHS
        assert _ask(df, "predict")[1] == answers.FEW_INTERVALS
        assert _ask(df, "hello")[1].startswith(answers.SUMMARY_HEAD)
        assert answers.root_cause_report(df, "Sales", "Date").first()["message"] == answers.KPI_FEW_MONTHS
    assert _ask(none, "top region")[1] == _ask(none, "worst")[1] == answers.NO_ROWS
    rising = _sales(spark, [(1, 1, "N", "A", 1.0), (2, 1, "N", "A", 2.0)])
    assert _ask(rising, "why did it fall")[1] == answers.NO_DECLINE.format(metric="Sales")
    with pytest.raises(ValueError):
        questions.ask(one.select("Sales"), "why did it fall")


def test_root_cause_report(spark):
    df = _sales(spark, ROWS[:4])
    r = answers.root_cause_report(df, "Sales", "Date").first()
    assert r["success"] and r["decline_detected"] and (r["overall_change"], r["percentage_change"]) == (-60.0, -40.0)
    assert "**$60.0**, explaining **100.0%**" in r["explanation"] and len(r["recommendations"]) == 3
    best = questions.root_cause(df, "Sales", "Date").first()
    assert f"**'{best['segment']}'** segment under the **'{best['dimension']}'**" in r["explanation"]
    moved = _sales(spark, [(1, 1, "N", "A", 9.0), (2, 1, "S", "B", 2.0)])
    r = answers.root_cause_report(moved, "Sales", "Date").first()
    assert r["explanation"] == answers.KPI_EVEN and r["recommendations"] == answers.KPI_EVEN_ADVICE
    up = _sales(spark, [(1, 1, "N", "A", 2.0), (2, 1, "N", "A", 3.0)])
    r = answers.root_cause_report(up, "Sales", "Date").first()
    assert not r["decline_detected"] and "increased by 50.0%" in r["message"]


def test_short_series_are_daily_and_the_table_is_read_once(spark):
    rows = [(dt.date(2024, m, 1), "long", 1.0) for m in range(1, 7)] + [(dt.date(2024, 1, 1), "short", 2.0), (dt.date(2024, 3, 2), "short", 3.0)]
    df = spark.createDataFrame(rows, "d date, s string, v double")
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    got = forecast.prepare_series(df.mapInArrow(seen, df.schema), "d", "v", "M", "s").collect()
    units = {(r["series"], r["unit"]): 0 for r in got}
    assert units.keys() == {("long", "M"), ("short", "D")} and passes.value <= 2 * len(rows)
    short = [r for r in got if r["series"] == "short"]
    assert len(short) == 62 and sum(r["value"] for r in short) == 5.0 and max(r["t"] for r in short) == 61
