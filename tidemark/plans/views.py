"""The warehouse under its table names, for queries in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.entities import CUSTOMERS, ORDER_ITEMS, ORDERS, PRODUCTS
from tidemark.operators.dims import dim_date, dim_order_status
from tidemark.plans.marts import MARTS
from tidemark.streaming import ingest

# The stored name of each entity.
TABLE_NAMES = {
    CUSTOMERS: "dim_customers",
    PRODUCTS: "dim_products",
    ORDERS: "fact_orders",
    ORDER_ITEMS: "fact_order_items",
}


def register(spark: SparkSession, root: str) -> list[str]:
    """Declare temporary views over what a stream has written below ``root``; returns their names.

    Per entity ``<table>`` (last record per key, deleted ones flagged), ``<table>_hist`` (every
    record), ``v_<entity>_current`` (live rows) and ``v_<entity>_history`` (rows with validity), then
    the two dimensions and the four marts. A view sees the micro-batches that were complete when it
    was declared; declare again to see later ones.
    """
    views = {}
    for entity, table in TABLE_NAMES.items():
        kept = ingest.history(spark, root, entity)
        views[table] = ingest.last_records(spark, root, entity)
        views[f"{table}_hist"] = kept.select(*entity.columns, "_inserted_at")
        views[f"v_{entity.name}_current"] = ingest.current(spark, root, entity)
        views[f"v_{entity.name}_history"] = ingest.intervals(spark, root, entity)
    views["dim_date"] = dim_date(spark)
    views["dim_order_status"] = dim_order_status(spark)
    for name in MARTS:
        views[name] = ingest.mart(spark, root, name)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
