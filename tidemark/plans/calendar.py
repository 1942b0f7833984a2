"""Order counts rolled up along the date dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dims import with_calendar


def roll_up(orders: DataFrame, by: Sequence[str]) -> DataFrame:
    """Orders per calendar attribute of their delivery date.

    Days outside the calendar, and orders without a date, form a group of nulls.
    """
    per_day = orders.groupBy("delivery_date").agg(F.count(F.lit(1)).alias("_orders"))
    return (
        with_calendar(per_day, "delivery_date")
        .groupBy(*by)
        .agg(F.sum("_orders").alias("order_count"))
    )


def weekend_split(orders: DataFrame) -> DataFrame:
    return roll_up(orders, ["is_weekend"])


def monthly(orders: DataFrame) -> DataFrame:
    return roll_up(orders, ["year", "month"])


def quarterly(orders: DataFrame) -> DataFrame:
    return roll_up(orders, ["year", "quarter"])
