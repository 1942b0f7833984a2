"""Column expressions shared by the operators. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the end of an interval that is still open.
OPEN_END = "9999-12-31 23:59:59.999"


def open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp")


def day_from_epoch(days: Column) -> Column:
    """Days since 1970-01-01 as a date. Negative counts stand for "no date"."""
    return F.when(days >= 0, F.date_from_unix_date(days))


def user_number(text: Column) -> Column:
    """A user reference made of digits as a number; anything else, null included, is -1."""
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")), F.lit(-1).cast("bigint"))


def money(amount: Column, precision: int = 20) -> Column:
    """Two decimals, rounded half up. The precision leaves room for sums over very large groups."""
    return amount.cast(f"decimal({precision},2)")


def name_or(name: Column, fallback: str) -> Column:
    return F.coalesce(name, F.lit(fallback))
