from datetime import date

from tidemark.operators import dims


def test_calendar_range_and_attributes(spark):
    days = {r.date_key: r for r in dims.dim_date(spark).collect()}
    assert len(days) == 1825
    assert (min(days), max(days)) == (date(2024, 1, 1), date(2028, 12, 29))
    leap = days[date(2024, 2, 29)]
    assert (leap.year, leap.quarter, leap.month, leap.month_name) == (2024, 1, 2, "February")
    assert (leap.week_of_year, leap.day_of_month, leap.day_of_week) == (9, 29, 4)
    assert (leap.day_name, leap.weekday_name, leap.is_weekend) == ("29", "Thursday", 0)
    sunday = days[date(2027, 1, 3)]
    assert (sunday.week_of_year, sunday.day_of_week, sunday.is_weekend) == (53, 7, 1)


def test_calendar_matches_the_standard_library(spark):
    for r in dims.dim_date(spark).collect():
        _, week, weekday = r.date_key.isocalendar()
        assert (r.week_of_year, r.day_of_week) == (week, weekday)
        assert r.is_weekend == int(weekday >= 6)


def test_other_ranges(spark):
    got = dims.dim_date(spark, "2030-06-30", 2).collect()
    assert [r.date_key for r in got] == [date(2030, 6, 30), date(2030, 7, 1)]


def test_statuses(spark):
    rows = dims.dim_order_status(spark).orderBy("display_order").collect()
    assert [(r.status, r.is_terminal) for r in rows] == [
        ("PENDING", 0), ("PROCESSING", 0), ("REPROCESSING", 0), ("COMPLETED", 1), ("CANCELLED", 1)
    ]
    assert {r.status_group for r in rows if r.is_terminal} == {"terminal"}


def test_open_means_non_terminal_and_known(spark):
    df = spark.createDataFrame(
        [("PENDING",), ("CANCELLED",), ("COMPLETED",), ("LOST",), (None,)], "status string"
    )
    got = dims.open_orders(df, dims.dim_order_status(spark)).collect()
    assert [r.status for r in got] == ["PENDING"]


def test_calendar_join_keeps_days_outside_the_range(spark):
    df = spark.createDataFrame([(date(2024, 1, 6),), (date(2040, 1, 1),), (None,)], "d date")
    got = {r.d: r.is_weekend for r in dims.with_calendar(df, "d").collect()}
    assert got == {date(2024, 1, 6): 1, date(2040, 1, 1): None, None: None}
