"""Batch reports as CSV."""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import batch
from tidemark.session import together
from tidemark.sources.tables import drop_folder

# Report names, in export order.
REPORTS = (
    "open_orders_by_date_status",
    "top_delivery_dates",
    "pending_items_by_product",
    "top_customers_with_pending_orders",
)


def batch_reports(
    orders: DataFrame, items: DataFrame, selection: Iterable[str], limit: int = 3
) -> dict[str, DataFrame]:
    chosen = set(selection)
    if unknown := chosen - set(REPORTS):
        raise ValueError(f"unknown reports: {sorted(unknown)}")
    plans = {
        "open_orders_by_date_status": lambda: batch.open_orders_by_date_status(orders),
        "top_delivery_dates": lambda: batch.top_delivery_dates(orders, limit),
        "pending_items_by_product": lambda: batch.pending_items_by_product(items),
        "top_customers_with_pending_orders": lambda: batch.top_customers_with_pending_orders(
            orders, limit
        ),
    }
    return {name: plans[name]() for name in REPORTS if name in chosen}


def write_csv(report: DataFrame, path: str, single_file: bool = False) -> int:
    """Write a report with a header; returns its rows. An empty report leaves nothing at ``path``.

    Every task writes its own part, each with the header, and the names of the parts follow the order of the report. With
    ``single_file`` the report goes through one task; that is for small ones.
    """
    seen = Observation()
    out = report.observe(seen, F.count(F.lit(1)).alias("rows"))
    out = out.coalesce(1) if single_file else out
    out.write.mode("overwrite").option("header", True).csv(path)
    rows = seen.get["rows"]
    if not rows:
        drop_folder(report.sparkSession, path)
    return rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A written report, all columns as text; equal headers of its parts are read once each."""
    return spark.read.option("header", True).csv(path)


def export_reports(
    spark: SparkSession,
    orders: DataFrame,
    items: DataFrame,
    folder: str,
    selection: Iterable[str] = REPORTS,
    limit: int = 3,
    single_file: bool = False,
) -> DataFrame:
    """Write the chosen reports below ``folder``; the result lists each with its number of rows."""
    chosen = batch_reports(orders, items, selection, limit)
    rows = together(
        spark,
        *[partial(write_csv, df, f"{folder}/{name}.csv", single_file) for name, df in chosen.items()],
    )
    return spark.createDataFrame(list(zip(chosen, rows, strict=True)), "report string, row_count bigint")
