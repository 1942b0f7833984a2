"""The batch path: changed orders with their relatives, analytic rows, upsert, reports.

"Open" means something else here than in the marts: everything but COMPLETED, so CANCELLED is open.
Deletes never travel this path, and a change to an item, customer or product is seen only when one of
its orders changes. Use the change stream where that matters.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import money, name_or, user_number
from tidemark.operators.state import upsert
from tidemark.plans.reports import checked_limit
from tidemark.session import together
from tidemark.sources.bases import aligned, folder_bytes, last_base, merge_base, read_base
from tidemark.sources.pruning import Range, id_ranges, within
from tidemark.sources.tables import (
    BATCH,
    batch_path,
    committed,
    drop_batches,
    read_batch,
    read_batches,
    schema_of,
    write_batch,
)

ORDERS_TABLE = "analytical_orders"
ITEMS_TABLE = "analytical_order_items"
LINES_TABLE = "extracted_lines"
ITEMS_READ = "extracted_items"
AT_WATERMARK = "orders_at_watermark"  # analytic orders with exactly the time of the last cycle's watermark

ORDERS_KEEP = ("created_at", "created_by")  # an update leaves these as first stored
ITEMS_KEEP = ("created_at",)

_AUDIT = [
    ("created_at", T.TimestampNTZType()),
    ("updated_at", T.TimestampNTZType()),
    ("created_by", T.StringType()),
    ("updated_by", T.StringType()),
]
ORDERS_SCHEMA = schema_of(
    ("order_id", T.LongType()),
    ("customer_id", T.LongType()),
    ("customer_name", T.StringType()),
    ("order_date", T.TimestampNTZType()),
    ("delivery_date", T.TimestampNTZType()),
    ("status", T.StringType()),
    ("total_items", T.LongType()),
    ("total_amount", T.DecimalType(20, 2)),
    *_AUDIT,
)
ITEMS_SCHEMA = schema_of(
    ("id", T.LongType()),
    ("order_id", T.LongType()),
    ("product_id", T.LongType()),
    ("product_name", T.StringType()),
    ("quantity", T.LongType()),
    ("price", T.DecimalType(20, 2)),
    ("order_status", T.StringType()),
    ("delivery_date", T.TimestampNTZType()),
    *_AUDIT,
)


@dataclass(frozen=True)
class Tables:
    """The four operational tables, whole or as extracted."""

    orders: DataFrame
    order_items: DataFrame
    customers: DataFrame
    products: DataFrame


# --- extract ---------------------------------------------------------------------------------------


def extract_orders(
    orders: DataFrame, since: datetime | None = None, inclusive: bool = True
) -> DataFrame:
    """Orders changed since the watermark. An order without ``updated_at`` is never seen as changed.

    ``inclusive`` also takes those with exactly that time: a transaction may commit late with an
    equal timestamp.
    """
    if since is None:
        return orders.filter(F.col("updated_at").isNotNull())
    changed = F.col("updated_at") >= F.lit(since) if inclusive else F.col("updated_at") > F.lit(since)
    return orders.filter(changed)


def next_watermark(orders: DataFrame) -> DataFrame:
    return orders.agg(F.max("updated_at").alias("watermark"))


def extract_items(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    return order_items.join(orders.select("order_id"), "order_id", "left_semi")


def _referenced(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    # Distinct ids first: a parent of very many children then costs one row per map task.
    return parents.join(children.select(key).distinct(), key, "left_semi")


def extract_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    return _referenced(customers, orders, "customer_id")


def extract_products(products: DataFrame, order_items: DataFrame) -> DataFrame:
    return _referenced(products, order_items, "product_id")


def changed_orders(
    source: Tables, since: datetime | None = None, inclusive: bool = True, known: DataFrame | None = None
) -> DataFrame:
    """Orders changed since the watermark, but for those that ``known`` analytic orders hold unchanged."""
    orders = extract_orders(source.orders, since, inclusive)
    return orders if known is None else orders.join(known, _same_order(orders, known), "left_anti")


def changed(
    source: Tables, since: datetime | None = None, inclusive: bool = True, known: DataFrame | None = None
) -> Tables:
    """What a cycle works on: changed orders, their items, and the customers and products as they are.

    The transform joins those by key, so reducing them to the referenced rows first would only scan
    and shuffle the items twice; :func:`extract` does it for those who want the rows themselves.
    """
    orders = changed_orders(source, since, inclusive, known)
    items = extract_items(source.order_items, orders)
    return Tables(orders, items, source.customers, source.products)


def pruned(source: Tables, orders: DataFrame, ranges: dict[str, list[Range]]) -> Tables:
    """Changed ``orders`` with their items and customers, read by the ranges of their ids."""
    items = extract_items(within(source.order_items, "order_id", ranges["order_id"]), orders)
    customers = within(source.customers, "customer_id", ranges["customer_id"])
    return Tables(orders, items, customers, source.products)


def _same_order(orders: DataFrame, known: DataFrame) -> Column:
    """The same order with the same contents: the columns that both tables hold as they were read."""
    same = orders["order_id"] == known["order_id"]
    for name in ("customer_id", "status", "updated_at"):
        same &= orders[name].eqNullSafe(known[name])
    for name in ("order_date", "delivery_date"):
        same &= orders[name].cast("timestamp_ntz").eqNullSafe(known[name])
    user = user_number(orders["updated_by"].cast("string")).cast("string")
    return same & user.eqNullSafe(known["updated_by"])


def extract(source: Tables, since: datetime | None = None, inclusive: bool = True) -> Tables:
    """Changed orders, their items, and only the customers and products these refer to."""
    found = changed(source, since, inclusive)
    return Tables(
        found.orders,
        found.order_items,
        extract_customers(source.customers, found.orders),
        extract_products(source.products, found.order_items),
    )


# --- transform -------------------------------------------------------------------------------------


def _user_text(user: Column) -> Column:
    return F.coalesce(user.cast("string"), F.lit("None"))


def item_lines(extracted: Tables) -> DataFrame:
    """Items with the name and exact price of their product; nulls where it is missing."""
    products = extracted.products.select("product_id", "product_name", "unity_price")
    return extracted.order_items.join(products, "product_id", "left")


def transform_orders(extracted: Tables, lines: DataFrame | None = None) -> DataFrame:
    """Analytic orders: customer name, number of items and amount. Orders without items have zeros.

    A missing product adds nothing to the amount; a missing customer is named Unknown. ``lines`` are
    :func:`item_lines`, where they have been stored.
    """
    lines = item_lines(extracted) if lines is None else lines
    totals = lines.groupBy("order_id").agg(
        F.sum("quantity").alias("_items"),
        F.sum(F.col("quantity") * F.col("unity_price")).alias("_amount"),
    )
    names = extracted.customers.select("customer_id", "customer_name")
    rows = extracted.orders.join(totals, "order_id", "left").join(names, "customer_id", "left")
    return rows.select(
        "order_id",
        "customer_id",
        name_or(F.col("customer_name"), "Unknown").alias("customer_name"),
        F.col("order_date").cast("timestamp_ntz").alias("order_date"),
        F.col("delivery_date").cast("timestamp_ntz").alias("delivery_date"),
        "status",
        F.coalesce("_items", F.lit(0)).cast("bigint").alias("total_items"),
        money(F.coalesce("_amount", F.lit(0))).alias("total_amount"),
        "created_at",
        "updated_at",
        user_number(F.col("created_by").cast("string")).cast("string").alias("created_by"),
        user_number(F.col("updated_by").cast("string")).cast("string").alias("updated_by"),
    )


def transform_items(extracted: Tables, lines: DataFrame | None = None) -> DataFrame:
    """Analytic items: product name and price, and the status and delivery date of their order."""
    lines = item_lines(extracted) if lines is None else lines
    parents = extracted.orders.select(
        "order_id",
        F.col("status").alias("order_status"),
        F.col("delivery_date").cast("timestamp_ntz").alias("delivery_date"),
    )
    return lines.join(parents, "order_id").select(
        F.col("order_item_id").alias("id"),
        "order_id",
        "product_id",
        name_or(F.col("product_name"), "Unknown").alias("product_name"),
        F.col("quantity").cast("bigint").alias("quantity"),
        money(F.coalesce("unity_price", F.lit(0))).alias("price"),
        "order_status",
        "delivery_date",
        "created_at",
        "updated_at",
        _user_text(F.col("created_by")).alias("created_by"),
        _user_text(F.col("updated_by")).alias("updated_by"),
    )


# --- load ------------------------------------------------------------------------------------------


def fold(batches: DataFrame, key: str, columns: list[str], keep: tuple[str, ...]) -> DataFrame:
    """The upserted table from its appended batches: last values per key, but the first ``keep`` ones.

    Appending and folding on read gives what an upsert in place gives, without rewriting the table
    for every batch.
    """
    moving = [c for c in columns if c != key and c not in keep]
    folded = batches.groupBy(key).agg(
        F.max(F.struct(BATCH, *moving)).alias("_last"), F.min(F.struct(BATCH, *keep)).alias("_first")
    )
    picked = {c: F.col(f"_last.{c}") for c in moving} | {c: F.col(f"_first.{c}") for c in keep}
    return folded.select(*[F.col(c) if c == key else picked[c].alias(c) for c in columns])


def last_cycle(spark: SparkSession, root: str) -> int | None:
    """The last cycle both of whose tables are complete."""
    orders, items = (set(committed(spark, root, t)) for t in (ORDERS_TABLE, ITEMS_TABLE))
    return max(orders & items, default=None)


def stored_watermark(spark: SparkSession, root: str) -> datetime | None:
    """Where the last complete cycle ended, read from its own rows: it cannot run ahead of them."""
    last = last_cycle(spark, root)
    if last is None:
        return None
    rows = read_batch(spark, root, ORDERS_TABLE, ORDERS_SCHEMA, last)
    return next_watermark(rows).first()["watermark"]


def run_cycle(source: Tables, root: str, inclusive: bool = True) -> int | None:
    """One extract, transform and load. Returns the cycle's id, or None when nothing has changed.

    Orders with exactly the watermark's time are read again and left out where they are stored
    unchanged, so one that committed late is not missed and an unchanged source adds no cycle. Ids of the changed orders and of their
    items go to the source as ranges, so that it reads only what may belong to them.
    A cycle that fails lacks a marker; the next one reads from the same watermark and replaces what
    it wrote.
    """
    spark = source.orders.sparkSession
    last = last_cycle(spark, root)
    since = stored_watermark(spark, root)
    known = _at_watermark(spark, root, last, since) if inclusive and since is not None else None
    orders = changed_orders(source, since, inclusive, known)
    ranges = id_ranges(orders, ["order_id", "customer_id"])
    if not ranges["order_id"]:
        return None
    cycle = 0 if last is None else last + 1
    extracted = pruned(source, orders, ranges)
    # Both results need the items with their products: join them once, into a table of their own.
    write_batch(extracted.order_items, root, ITEMS_READ, cycle)
    items = spark.read.parquet(batch_path(root, ITEMS_READ, cycle))
    products = within(source.products, "product_id", id_ranges(items, ["product_id"])["product_id"])
    extracted = Tables(orders, items, extracted.customers, products)
    write_batch(item_lines(extracted), root, LINES_TABLE, cycle)
    lines = spark.read.parquet(batch_path(root, LINES_TABLE, cycle))
    items, found = transform_items(extracted, lines), transform_orders(extracted, lines)
    together(
        spark,
        lambda: write_batch(items, root, ITEMS_TABLE, cycle, ["product_id"], ITEMS_SCHEMA),
        lambda: write_batch(found, root, ORDERS_TABLE, cycle, ["delivery_date"], ORDERS_SCHEMA),
    )
    _save_at_watermark(spark, root, cycle, since, known)
    for table in (LINES_TABLE, ITEMS_READ, AT_WATERMARK):
        drop_batches(spark, root, table, before=cycle)
    return cycle


def _at_watermark(spark: SparkSession, root: str, last: int, since: datetime) -> DataFrame:
    """Analytic orders stored with exactly the watermark's time, as last stored.

    The last cycle has put them aside; only if it broke off before that are the stored orders searched.
    """
    if last in committed(spark, root, AT_WATERMARK):
        return read_batch(spark, root, AT_WATERMARK, ORDERS_SCHEMA, last)
    only = F.col("updated_at") == F.lit(since)
    return _upserted(spark, root, ORDERS_TABLE, ORDERS_SCHEMA, "order_id", ORDERS_KEEP, only=only)


def _save_at_watermark(
    spark: SparkSession, root: str, cycle: int, since: datetime | None, known: DataFrame | None
) -> None:
    """Put the orders at the new watermark aside; while it stays the same, with those known before."""
    watermark = stored_watermark(spark, root)
    orders = read_batch(spark, root, ORDERS_TABLE, ORDERS_SCHEMA, cycle)
    rows = orders.filter(F.col("updated_at") == F.lit(watermark))
    if known is not None and watermark == since:
        rows = rows.unionByName(known.join(orders.select("order_id"), "order_id", "left_anti").select(*ORDERS_SCHEMA.names))
    write_batch(rows, root, AT_WATERMARK, cycle, schema=ORDERS_SCHEMA)


def _upserted(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType,
    key: str,
    keep: tuple[str, ...],
    only: Column | None = None,
) -> DataFrame:
    """All complete cycles, folded: those since the last base, upserted into it. ``only`` filters the scans."""
    only = F.lit(True) if only is None else only
    last = last_cycle(spark, root)
    upto = -1 if last is None else last
    base = last_base(spark, root, table)
    if base is None:
        rows = read_batches(spark, root, table, schema, upto=upto).filter(only)
        return fold(rows, key, schema.names, keep)
    rows = read_base(spark, root, table, schema, key, base).filter(only)
    later = aligned(read_batches(spark, root, table, schema, after=base.reached, upto=upto).filter(only), key, base)
    return upsert(rows, fold(later, key, schema.names, keep), key, keep)


def analytical_orders(spark: SparkSession, root: str) -> DataFrame:
    return _upserted(spark, root, ORDERS_TABLE, ORDERS_SCHEMA, "order_id", ORDERS_KEEP)


def analytical_items(spark: SparkSession, root: str) -> DataFrame:
    return _upserted(spark, root, ITEMS_TABLE, ITEMS_SCHEMA, "id", ITEMS_KEEP)


def compact(spark: SparkSession, root: str, buckets: int | None = None) -> int | None:
    """Fold the complete cycles of both tables into bases, so that readers fold only later ones."""
    last = last_cycle(spark, root)
    if last is None:
        return None
    for table, schema, key, keep in (
        (ORDERS_TABLE, ORDERS_SCHEMA, "order_id", ORDERS_KEEP),
        (ITEMS_TABLE, ITEMS_SCHEMA, "id", ITEMS_KEEP),
    ):

        def changes(reached: int | None, table=table, schema=schema, key=key, keep=keep):
            new = [b for b in committed(spark, root, table) if b <= last and (reached is None or b > reached)]
            if not new:
                return None
            rows = read_batches(spark, root, table, schema, after=reached, upto=last)
            size = folder_bytes(spark, [batch_path(root, table, b) for b in new])
            return last, fold(rows, key, schema.names, keep), size

        before = last_base(spark, root, table)
        merge_base(
            spark, root, table, schema, key, changes, lambda old, new, key=key, keep=keep: upsert(old, new, key, keep), buckets
        )
        if before is not None:  # the base just replaced stays, for readers that have begun
            drop_batches(spark, root, table, before=min(before.reached + 1, last))
    return last


# --- reports on the analytic tables ----------------------------------------------------------------


def _open_dated(orders: DataFrame) -> DataFrame:
    return orders.filter(
        (F.col("status") != "COMPLETED") & F.col("delivery_date").isNotNull()
    ).withColumn("delivery_date", F.to_date("delivery_date"))


def open_orders_by_date_status(orders: DataFrame) -> DataFrame:
    return (
        _open_dated(orders)
        .groupBy("delivery_date", "status")
        .agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy("delivery_date", "status")
    )


def top_delivery_dates(orders: DataFrame, limit: int = 3) -> DataFrame:
    checked_limit(limit)
    return (
        _open_dated(orders)
        .groupBy("delivery_date")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.count_distinct("customer_id").alias("unique_customers"),
        )
        .orderBy(F.desc("order_count"), "delivery_date")
        .limit(limit)
    )


def pending_items_by_product(items: DataFrame) -> DataFrame:
    return (
        items.filter(F.col("order_status") == "PENDING")
        .groupBy("product_id", "product_name")
        .agg(F.sum("quantity").alias("pending_items"))
        .orderBy(F.desc("pending_items"), "product_id")
    )


def top_customers_with_pending_orders(orders: DataFrame, limit: int = 3) -> DataFrame:
    checked_limit(limit)
    return (
        orders.filter(F.col("status") == "PENDING")
        .groupBy("customer_id", "customer_name")
        .agg(
            F.count(F.lit(1)).alias("pending_order_count"),
            F.sum("total_amount").alias("total_pending_amount"),
        )
        .orderBy(F.desc("pending_order_count"), "customer_id")
        .limit(limit)
    )
