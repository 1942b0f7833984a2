"""The four marts, computed from live current state.

Facts are counted by id before names are joined on, so the joins with customers and products see one
row per id and status rather than every order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import name_or
from tidemark.operators.dims import open_orders

# Columns of current state the marts read. Pass them, or fewer where fewer are enough, to
# ``state.current``, which prunes by name.
ORDER_COLUMNS = ["order_id", "delivery_date", "customer_id", "status"]
ITEM_COLUMNS = ["order_id", "product_id", "quantity"]
PRODUCT_COLUMNS = ["product_id", "product_name"]
CUSTOMER_COLUMNS = ["customer_id", "customer_name"]

SKETCH_LG_K = 12  # a sketch has 2**12 places, some 4 KB once it is full
SKETCH_RSD = 1.04 / 2 ** (SKETCH_LG_K / 2)

# In refresh order.
MARTS = (
    "agg_orders_by_date_status",
    "agg_top_delivery_dates",
    "agg_pending_items_by_product",
    "agg_top_customers_open",
)


def orders_by_date_status(orders: DataFrame) -> DataFrame:
    """Orders per delivery date and status, all statuses."""
    return (
        orders.filter(F.col("delivery_date").isNotNull() & F.col("status").isNotNull())
        .groupBy("delivery_date", "status")
        .agg(F.count(F.lit(1)).alias("order_count"))
    )


def top_delivery_dates(
    orders: DataFrame, statuses: DataFrame, approximate: bool = False, rsd: float = 0.05
) -> DataFrame:
    """Open orders per delivery date. Orders without a customer count as orders, not as customers."""
    customers = (
        F.approx_count_distinct("customer_id", rsd)
        if approximate
        else F.count_distinct("customer_id")
    )
    return (
        open_orders(orders, statuses)
        .filter(F.col("delivery_date").isNotNull())
        .groupBy("delivery_date")
        .agg(F.count(F.lit(1)).alias("order_count"), customers.alias("unique_customers"))
    )


def customer_sketches(orders: DataFrame, statuses: DataFrame) -> DataFrame:
    """Open orders per delivery date with a sketch of their customers, which can be merged with others."""
    return (
        open_orders(orders, statuses)
        .filter(F.col("delivery_date").isNotNull())
        .groupBy("delivery_date")
        .agg(F.count(F.lit(1)).alias("order_count"), F.hll_sketch_agg("customer_id", SKETCH_LG_K).alias("customers"))
    )


def merged_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of several parts of the orders, per date, as one."""
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("delivery_date")
        .agg(F.sum("order_count").alias("order_count"), F.hll_union_agg("customers", F.lit(False)).alias("customers"))
    )


def counts_of(sketches: DataFrame) -> DataFrame:
    """The mart of the delivery dates as sketches tell it."""
    customers = F.hll_sketch_estimate("customers").alias("unique_customers")
    return sketches.select("delivery_date", "order_count", customers)


def pending_items_by_product(
    items: DataFrame, orders: DataFrame, products: DataFrame, statuses: DataFrame
) -> DataFrame:
    """Quantity of open items per product and order status ("pending" is applied by the reader)."""
    quantities = (
        items.filter(F.col("product_id").isNotNull())
        .select(*ITEM_COLUMNS)
        .join(open_orders(orders, statuses).select("order_id", "status"), "order_id")
        .groupBy("product_id", "status")
        .agg(F.sum("quantity").alias("pending_quantity"))
    )
    return quantities.join(products.select(*PRODUCT_COLUMNS), "product_id", "left").select(
        "product_id",
        name_or(F.col("product_name"), "").alias("product_name"),
        "status",
        "pending_quantity",
    )


def top_customers_open(
    orders: DataFrame, customers: DataFrame, statuses: DataFrame
) -> DataFrame:
    """Open orders per customer and status."""
    counts = (
        open_orders(orders, statuses)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "status")
        .agg(F.count(F.lit(1)).alias("order_count"))
    )
    return counts.join(customers.select(*CUSTOMER_COLUMNS), "customer_id", "left").select(
        "customer_id",
        name_or(F.col("customer_name"), "").alias("customer_name"),
        "status",
        "order_count",
    )
