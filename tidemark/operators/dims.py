"""The generated dimensions and the join to the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The calendar's default range.
CALENDAR_START = "2024-01-01"
CALENDAR_DAYS = 365 * 5

# Status, status_group, is_terminal, display_order.
ORDER_STATUSES = [
    ("PENDING", "open", 0, 1),
    ("PROCESSING", "open", 0, 2),
    ("REPROCESSING", "open", 0, 3),
    ("COMPLETED", "terminal", 1, 4),
    ("CANCELLED", "terminal", 1, 5),
]


def dim_date(
    spark: SparkSession, start: str = CALENDAR_START, days: int = CALENDAR_DAYS
) -> DataFrame:
    """One row per day. ``day_name`` is the day of the month as text; ``weekday_name`` is the weekday."""
    d = F.col("date_key")
    weekday = F.weekday(d) + 1
    return spark.range(days).select(
        F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date_key")
    ).select(
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofmonth(d).alias("day_of_month"),
        weekday.alias("day_of_week"),
        F.date_format(d, "d").alias("day_name"),
        F.date_format(d, "EEEE").alias("weekday_name"),
        F.when(weekday >= 6, 1).otherwise(0).alias("is_weekend"),
    )


def dim_order_status(spark: SparkSession) -> DataFrame:
    rows = ", ".join(str(row) for row in ORDER_STATUSES)
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS s(status, status_group, is_terminal, display_order)"
    )


def open_orders(orders: DataFrame, statuses: DataFrame) -> DataFrame:
    """Orders (or anything with a ``status``) whose status the dimension calls non-terminal.

    No broadcast hint: the dimension's size is known to Spark, which broadcasts it while it is small.
    """
    still_open = statuses.filter(F.col("is_terminal") == 0).select("status")
    return orders.join(still_open, "status", "left_semi")


def with_calendar(
    facts: DataFrame, day: str, start: str = CALENDAR_START, days: int = CALENDAR_DAYS
) -> DataFrame:
    """Left join on the calendar; days outside its range get null calendar columns.

    Spark knows the calendar's size from its number of days and broadcasts it while it is small.
    """
    calendar = dim_date(facts.sparkSession, start, days)
    return facts.join(calendar, F.col(day) == F.col("date_key"), "left")
