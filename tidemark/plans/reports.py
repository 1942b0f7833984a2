"""Parameterised reports on the marts.

``status`` filters only at the documented value ("open" for orders, "pending" for items and customers);
any other value means no filter, with a warning where it is not a documented one. Ties in a ranking are
broken by key, so results are the same on every run.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dims import open_orders


def _known(status: str, known: tuple[str, ...]) -> None:
    if status not in known:
        warnings.warn(f"status {status!r} is none of {known}: no filter applied", stacklevel=3)


def checked_limit(limit: int) -> int:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return limit


def _pending_only(mart: DataFrame, status: str) -> DataFrame:
    _known(status, ("pending", "open"))
    return mart.filter(F.col("status") == "PENDING") if status == "pending" else mart


def orders_report(mart: DataFrame, statuses: DataFrame, status: str = "open") -> DataFrame:
    """Orders by delivery date and status: open ones, or all."""
    _known(status, ("open", "all"))
    chosen = open_orders(mart, statuses) if status == "open" else mart
    return (
        chosen.groupBy("delivery_date", "status")
        .agg(F.sum("order_count").alias("order_count"))
        .orderBy("delivery_date", "status")
    )


def top_delivery_dates_report(mart: DataFrame, limit: int = 3) -> DataFrame:
    """Delivery dates with the most open orders."""
    return (
        mart.select("delivery_date", "order_count", "unique_customers")
        .orderBy(F.desc("order_count"), "delivery_date")
        .limit(checked_limit(limit))
    )


def items_by_product_report(mart: DataFrame, status: str = "pending") -> DataFrame:
    """Quantity per product of pending or of all open orders."""
    return (
        _pending_only(mart, status)
        .groupBy("product_id", "product_name")
        .agg(F.sum("pending_quantity").alias("pending_quantity"))
        .orderBy(F.desc("pending_quantity"), "product_id")
    )


def top_customers_report(mart: DataFrame, status: str = "pending", limit: int = 3) -> DataFrame:
    """Customers with the most pending or open orders."""
    return (
        _pending_only(mart, status)
        .groupBy("customer_id", "customer_name")
        .agg(F.sum("order_count").alias("order_count"))
        .orderBy(F.desc("order_count"), "customer_id")
        .limit(checked_limit(limit))
    )
