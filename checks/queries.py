"""The registered queries: each operator over the whole derived logs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial, reduce
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import logs as L
from tidemark.entities import CUSTOMERS, ENTITIES, ORDER_ITEMS, ORDERS, PRODUCTS, SEQ
from tidemark.operators import cdc, dims, quality, state
from tidemark.operators import history as H
from tidemark.plans import batch, calendar, exports, marts, reports
from tidemark.session import scratch_folder, shuffles_dropped, together, use_utc
from tidemark.sources.bases import folder_bytes
from tidemark.sources.changes import file_messages, to_messages
from tidemark.sources.tables import drop_folder, read_batches, slices, slices_for, write_batch
from tidemark.streaming import ingest, keyed

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values the SQL checks use too.
AS_OF = L.T0 + 2 * L.DAY + 700
PERIOD = (L.T0, L.T0 + L.DAY)
FIRST_CYCLE_UNTIL = datetime(2000, 1, 1)
CHANGED_SINCE = datetime(1998, 1, 1)
SLICED_KEYS = 500
APPROXIMATE_RSD = 0.05

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _register(name: str, fn: Query) -> None:
    QUERIES[name] = fn


# --- decode ----------------------------------------------------------------------------------------


@query
def cdc_unwrap(spark, sf):
    messages = L.envelopes(L.spread(L.log(spark, sf, ORDER_ITEMS)), ORDER_ITEMS)
    return cdc.unwrap(messages, ORDER_ITEMS)


@query
def cdc_quarantine(spark, sf):
    return cdc.quarantine(L.flawed_order_messages(spark, sf), ORDERS)


@query
def cdc_snapshot_union(spark, sf):
    changes = L.log(spark, sf, PRODUCTS).filter(F.col("cdc_op") != "r")
    return cdc.snapshot_union(L.product_rows(spark, sf), changes, PRODUCTS, L.T0)


# --- staging, current state, history: the same operator for each entity ------------------------------

for _e in ENTITIES:
    _register(
        f"stage_{_e.name}", lambda spark, sf, e=_e: L.staged(spark, sf, e).select(*e.columns)
    )
    _register(f"current_{_e.name}", lambda spark, sf, e=_e: L.current(spark, sf, e))
    _register(
        f"scd2_{_e.name}", lambda spark, sf, e=_e: H.with_intervals(L.staged(spark, sf, e), e)
    )


@query
def scd2_order_items_sliced(spark, sf):
    """The plan for keys too large for one task, with the keys given."""
    log = L.staged(spark, sf, ORDER_ITEMS)
    return H.with_intervals(log, ORDER_ITEMS, hot=range(1, SLICED_KEYS + 1))


@query
def current_orders_rownum(spark, sf):
    return state.live(state.latest_by_rank(L.staged(spark, sf, ORDERS), ORDERS)).select(
        *ORDERS.columns
    )


@query
def current_reinsert(spark, sf):
    return state.reinserted(L.staged(spark, sf, CUSTOMERS), CUSTOMERS)


@query
def late_event_order(spark, sf):
    """Newer versions arrive in one batch, the versions they replaced in the next."""
    root = scratch_folder(use_utc(spark), "late")
    log = L.log(spark, sf, ORDERS)
    for batch_id, part in enumerate([log.filter(F.col(SEQ) > 0), log.filter(F.col(SEQ) == 0)]):
        ingest.land(spark, to_messages(L.spread(part), ORDERS), batch_id, root, [ORDERS])
    return ingest.current(spark, root, ORDERS)


@query
def history_append_count(spark, sf):
    """Snapshot reads in one batch, changes in another, the second one written twice."""
    root = scratch_folder(use_utc(spark), "history")

    def append(e):
        rows = L.staged(spark, sf, e).withColumn("_inserted_at", F.current_timestamp())
        is_read = F.col("cdc_op") == "r"
        for batch_id, part in [(0, is_read), (1, ~is_read), (1, ~is_read)]:
            write_batch(rows.filter(part), root, e.name, batch_id, [e.key], e.history_schema)

    together(spark, *[partial(append, e) for e in ENTITIES])
    tables = {e: read_batches(spark, root, e.name, e.history_schema) for e in ENTITIES}
    return quality.row_counts(tables, "history_rows")


@query
def history_dedup(spark, sf):
    rows = L.staged(spark, sf, ORDERS)
    again = rows.filter(F.col("order_id") % 13 == 0).withColumn(SEQ, F.col(SEQ) + 100)
    return H.drop_redelivered(rows.unionByName(again), ORDERS)


@query
def scd2_asof_customers(spark, sf):
    return H.as_of(L.staged(spark, sf, CUSTOMERS), CUSTOMERS, AS_OF)


@query
def scd2_asof_join_orders(spark, sf):
    facts = L.staged(spark, sf, ORDERS).select(
        "order_id", "status", "customer_id", F.col("cdc_source_ts_ms").alias("at_ms")
    )
    versions = L.staged(spark, sf, CUSTOMERS)
    columns = ["customer_name", "is_active", "cdc_deleted", "cdc_source_ts_ms"]
    return H.as_of_join(facts, versions, CUSTOMERS, "at_ms", columns)


@query
def scd2_active_in_period(spark, sf):
    log = L.staged(spark, sf, CUSTOMERS)
    return H.active_through(log, CUSTOMERS, *PERIOD, carry=["customer_name"])


@query
def audit_op_counts(spark, sf):
    first, *rest = [H.op_counts(L.staged(spark, sf, e), e) for e in ENTITIES]
    for part in rest:
        first = first.unionByName(part)
    return first


# --- dimensions and calendar -------------------------------------------------------------------------


def _dated(spark, sf):
    return L.current(spark, sf, ORDERS, ["delivery_date"])


@query
def dim_date(spark, sf):
    """Every day of the calendar with the number of orders due on it."""
    due = _dated(spark, sf).groupBy("delivery_date").agg(F.count(F.lit(1)).alias("_due"))
    return (
        dims.dim_date(spark)
        .join(due, F.col("date_key") == F.col("delivery_date"), "left")
        .withColumn("order_count", F.coalesce("_due", F.lit(0).cast("bigint")))
        .drop("delivery_date", "_due")
    )


@query
def dim_order_status(spark, sf):
    """Orders per status, with what the dimension says about it; unknown statuses get nulls."""
    counts = _orders(spark, sf, "status").groupBy("status").agg(F.count(F.lit(1)).alias("order_count"))
    return counts.join(dims.dim_order_status(spark), "status", "left")


_register("calendar_weekend_split", lambda spark, sf: calendar.weekend_split(_dated(spark, sf)))
_register("calendar_monthly", lambda spark, sf: calendar.monthly(_dated(spark, sf)))
_register("calendar_quarterly", lambda spark, sf: calendar.quarterly(_dated(spark, sf)))


# --- marts and reports -------------------------------------------------------------------------------


def _orders(spark, sf, *columns):
    return L.current(spark, sf, ORDERS, columns)


@query
def mart_orders_by_date_status(spark, sf):
    return marts.orders_by_date_status(_orders(spark, sf, "delivery_date", "status"))


@query
def mart_top_delivery_dates(spark, sf):
    return marts.top_delivery_dates(
        _orders(spark, sf, "delivery_date", "customer_id", "status"), dims.dim_order_status(spark)
    )


@query
def mart_top_delivery_dates_approx(spark, sf):
    """Exact counts per date, and whether the ones from merged sketches, and from one pass, are within six standard deviations."""
    orders, statuses = _orders(spark, sf, "order_id", "delivery_date", "customer_id", "status"), dims.dim_order_status(spark)
    parts = [orders.filter(F.pmod("order_id", F.lit(3)) == n) for n in range(3)]
    sketches = marts.merged_sketches(*[marts.customer_sketches(p, statuses) for p in parts])
    merged = marts.counts_of(sketches).withColumnRenamed("unique_customers", "_merged")
    near = marts.top_delivery_dates(orders, statuses, approximate=True, rsd=APPROXIMATE_RSD).withColumnRenamed("unique_customers", "_near")

    def close(c, rsd):
        return F.abs(F.col(c) - F.col("unique_customers")) <= 6 * rsd * F.col("unique_customers") + 2

    both = close("_near", APPROXIMATE_RSD) & close("_merged", marts.SKETCH_RSD)
    return (
        mart_top_delivery_dates(spark, sf)
        .join(near, ["delivery_date", "order_count"], "full_outer")
        .join(merged, ["delivery_date", "order_count"], "full_outer")
        .select("delivery_date", "order_count", "unique_customers", both.cast("int").alias("within_bound"))
    )


@query
def mart_pending_items_by_product(spark, sf):
    return marts.pending_items_by_product(
        L.current(spark, sf, ORDER_ITEMS, marts.ITEM_COLUMNS),
        _orders(spark, sf, "order_id", "status"),
        L.current(spark, sf, PRODUCTS, marts.PRODUCT_COLUMNS),
        dims.dim_order_status(spark),
    )


@query
def mart_top_customers_open(spark, sf):
    return marts.top_customers_open(
        _orders(spark, sf, "customer_id", "status"),
        L.current(spark, sf, CUSTOMERS, marts.CUSTOMER_COLUMNS),
        dims.dim_order_status(spark),
    )


@query
def distinct_mart_statuses(spark, sf):
    return mart_orders_by_date_status(spark, sf).select("status").distinct()


@query
def report_orders_open(spark, sf):
    return reports.orders_report(
        mart_orders_by_date_status(spark, sf), dims.dim_order_status(spark), "open"
    )


@query
def report_orders_all(spark, sf):
    return reports.orders_report(
        mart_orders_by_date_status(spark, sf), dims.dim_order_status(spark), "all"
    )


@query
def report_top_delivery_dates(spark, sf):
    return reports.top_delivery_dates_report(mart_top_delivery_dates(spark, sf))


@query
def report_items_by_product_pending(spark, sf):
    return reports.items_by_product_report(mart_pending_items_by_product(spark, sf), "pending")


@query
def report_items_by_product_open(spark, sf):
    return reports.items_by_product_report(mart_pending_items_by_product(spark, sf), "open")


@query
def report_top_customers_pending(spark, sf):
    return reports.top_customers_report(mart_top_customers_open(spark, sf), "pending")


@query
def report_top_customers_open(spark, sf):
    return reports.top_customers_report(mart_top_customers_open(spark, sf), "open")


# --- batch path --------------------------------------------------------------------------------------


def _changed(spark, sf) -> batch.Tables:
    return batch.changed(L.operational(spark, sf), CHANGED_SINCE, inclusive=False)


def _extracted(spark, sf) -> batch.Tables:
    return batch.extract(L.operational(spark, sf), CHANGED_SINCE, inclusive=False)


def _first_cycle(spark, sf) -> batch.Tables:
    source = L.operational(spark, sf, settled=False)
    early = source.orders.filter(F.col("updated_at") <= F.lit(FIRST_CYCLE_UNTIL))
    return batch.Tables(early, source.order_items, source.customers, source.products)


@query
def batch_extract_orders(spark, sf):
    return _extracted(spark, sf).orders


@query
def batch_extract_items(spark, sf):
    return _extracted(spark, sf).order_items


@query
def batch_extract_customers(spark, sf):
    return _extracted(spark, sf).customers


@query
def batch_extract_products(spark, sf):
    return _extracted(spark, sf).products


@query
def batch_next_watermark(spark, sf):
    return batch.next_watermark(_changed(spark, sf).orders)


@query
def batch_transform_orders(spark, sf):
    return batch.transform_orders(_changed(spark, sf))


@query
def batch_transform_items(spark, sf):
    return batch.transform_items(_changed(spark, sf))


@query
def batch_upsert_orders(spark, sf):
    return state.upsert(
        batch.transform_orders(batch.changed(_first_cycle(spark, sf))),
        batch.transform_orders(_changed(spark, sf)),
        "order_id",
        batch.ORDERS_KEEP,
    )


@query
def batch_upsert_items(spark, sf):
    return state.upsert(
        batch.transform_items(batch.changed(_first_cycle(spark, sf))),
        batch.transform_items(_changed(spark, sf)),
        "id",
        batch.ITEMS_KEEP,
    )


@query
def batch_run_orders(spark, sf):
    """Two cycles: the orders known by a date, then all of them with their final status."""
    root = scratch_folder(use_utc(spark), "batch")
    batch.run_cycle(_first_cycle(spark, sf), root)
    batch.run_cycle(L.operational(spark, sf), root)
    return batch.analytical_orders(spark, root)


def _analytic_orders(spark, sf):
    return batch.transform_orders(batch.changed(L.operational(spark, sf)))


def _analytic_items(spark, sf):
    return batch.transform_items(batch.changed(L.operational(spark, sf)))


@query
def batch_open_orders_by_date_status(spark, sf):
    return batch.open_orders_by_date_status(_analytic_orders(spark, sf))


@query
def batch_top_delivery_dates(spark, sf):
    return batch.top_delivery_dates(_analytic_orders(spark, sf))


@query
def batch_pending_items_by_product(spark, sf):
    return batch.pending_items_by_product(_analytic_items(spark, sf))


@query
def batch_top_customers_pending(spark, sf):
    return batch.top_customers_with_pending_orders(_analytic_orders(spark, sf))


@query
def export_reports(spark, sf):
    """The four reports as read back from their files: each line's values, joined by ``|``."""
    folder = scratch_folder(use_utc(spark), "reports")
    written = exports.export_reports(spark, _analytic_orders(spark, sf), _analytic_items(spark, sf), folder)
    lines = []
    for name in [r["report"] for r in written.filter("row_count > 0").collect()]:
        rows = exports.read_csv(spark, f"{folder}/{name}.csv")
        values = [F.coalesce(c, F.lit("")) for c in rows.columns]
        header = F.lit("|".join(rows.columns)).alias("header")
        lines.append(rows.select(F.lit(name).alias("report"), header, F.concat_ws("|", *values).alias("line")))
    return reduce(DataFrame.unionByName, lines)


# --- streaming ---------------------------------------------------------------------------------------


MICRO_BATCHES = 3


def _feed(spark, deals, root) -> DataFrame:
    """The messages, saved deal by deal, as a stream of about three micro-batches."""
    for messages in deals:
        L.save_messages(messages, f"{root}/topics")
    files = len(spark.read.text(f"{root}/topics").inputFiles())
    return file_messages(spark, f"{root}/topics", ceil(files / MICRO_BATCHES), delete_read=True)


def _ingest(spark, sf, root, refresh_every=None) -> DataFrame:
    """Run the change stream over all four topics."""
    messages = _feed(spark, L.dealt_messages(use_utc(spark), sf, MICRO_BATCHES), root)
    ingest.start(messages, root, every=None, refresh_every=refresh_every).awaitTermination()
    return messages


def _slice_by_slice(spark, root, compute) -> DataFrame:
    """The few rows that ``compute`` gives for an entity and a slice of its keys, of one slice after the other: on disk are only
    the shuffles of one."""
    rows, schema = [], None
    with shuffles_dropped(spark):
        for e in ENTITIES:
            number = slices_for(folder_bytes(spark, [f"{root}/history/{e.name}"]))
            for part in slices(e.key, number):
                found = compute(e, part)
                schema = found.schema
                rows += found.collect()
    return spark.createDataFrame(rows, schema)


def _ingested_counts(spark, root):
    drop_folder(spark, f"{root}/topics")
    kept = _slice_by_slice(
        spark, root, lambda e, part: quality.row_counts({e: ingest.history(spark, root, e).filter(part)}, "history_rows")
    )
    now = _slice_by_slice(
        spark, root, lambda e, part: quality.row_counts({e: ingest.current(spark, root, e, [e.key]).filter(part)}, "live_rows")
    )
    kept = kept.groupBy("entity").agg(F.sum("history_rows").alias("history_rows"))
    return kept.join(now.groupBy("entity").agg(F.sum("live_rows").alias("live_rows")), "entity")


@query
def stream_current_orders(spark, sf):
    root = scratch_folder(use_utc(spark), "keyed")
    messages = _feed(spark, [to_messages(L.spread(L.log(spark, sf, ORDERS)), ORDERS)], root)
    cores = spark.sparkContext.defaultParallelism
    keyed.start(messages, root, ORDERS, every=None, partitions=cores).awaitTermination()
    return keyed.current(spark, root, ORDERS)


@query
def stream_fanout_counts(spark, sf):
    root = scratch_folder(use_utc(spark), "fanout")
    _ingest(spark, sf, root)
    return _ingested_counts(spark, root)


@query
def stream_mart_orders_by_date_status(spark, sf):
    return _refreshed_mart(spark, sf, "agg_orders_by_date_status")


def _refreshed_mart(spark, sf, name):
    root = scratch_folder(use_utc(spark), "marts")
    _ingest(spark, sf, root, refresh_every=1)
    return ingest.mart(spark, root, name)


@query
def stream_marts(spark, sf):
    """All four marts after a refresh by difference per micro-batch, as ``mart, key, status, name, n, m``."""
    root = scratch_folder(use_utc(spark), "marts")
    _ingest(spark, sf, root, refresh_every=1)
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    columns = {
        "agg_orders_by_date_status": ("delivery_date", "status", none, "order_count", no_number),
        "agg_top_delivery_dates": ("delivery_date", none, none, "order_count", "unique_customers"),
        "agg_pending_items_by_product": ("product_id", "status", "product_name", "pending_quantity", no_number),
        "agg_top_customers_open": ("customer_id", "status", "customer_name", "order_count", no_number),
    }
    parts = []
    for name, (key, *rest) in columns.items():
        shown = [F.col(c) if isinstance(c, str) else c for c in rest]
        named = [c.alias(n) for c, n in zip(shown, ("status", "name", "n", "m"), strict=True)]
        mart = ingest.mart(spark, root, name)
        parts.append(mart.select(F.lit(name).alias("mart"), F.col(key).cast("string").alias("key"), *named))
    return reduce(DataFrame.unionByName, parts)


@query
def stored_orders_merged_twice(spark, sf):
    """Current orders from three micro-batches, stored state being merged into its base after the first and the second."""
    root = scratch_folder(use_utc(spark), "merged")
    messages = to_messages(L.spread(L.log(spark, sf, ORDERS)), ORDERS).withColumn("part", F.pmod(F.hash("value"), F.lit(3)))
    for n in range(3):
        ingest.land(spark, messages.filter(F.col("part") == n).drop("part"), n, root, [ORDERS])
        if n < 2:
            ingest.tidy(spark, root, ORDERS)
    return ingest.current(spark, root, ORDERS)


@query
def stream_replay_idempotent(spark, sf):
    """Restart from the checkpoint; then lose the last commit, so that its micro-batch runs again."""
    root = scratch_folder(use_utc(spark), "replay")
    messages = _ingest(spark, sf, root)
    ingest.start(messages, root, every=None, refresh_every=None).awaitTermination()
    L.forget_last_commit(spark, f"{root}/_checkpoints/ingest")
    ingest.start(messages, root, every=None, refresh_every=None).awaitTermination()
    return _ingested_counts(spark, root)


# --- quality -----------------------------------------------------------------------------------------


def _intervals(spark, sf):
    return {e: H.with_intervals(L.staged(spark, sf, e), e) for e in ENTITIES}


@query
def dq_live_counts(spark, sf):
    return quality.row_counts(
        {e: L.current(spark, sf, e, [e.key]) for e in ENTITIES}, "live_rows"
    )


@query
def dq_history_counts(spark, sf):
    return quality.row_counts({e: L.staged(spark, sf, e) for e in ENTITIES}, "history_rows")


@query
def dq_history_ge_current(spark, sf):
    """Stored history against stored state, both written from one feed."""
    root = scratch_folder(use_utc(spark), "covers")
    ingest.land(spark, L.all_messages(spark, sf), 0, root)

    def covers(e, part):
        kept, now = ingest.history(spark, root, e), ingest.last_records(spark, root, e)
        return quality.history_covers_state({e: kept.filter(part)}, {e: now.filter(part)})

    found = _slice_by_slice(spark, root, covers).groupBy("entity")
    sums = [F.sum(c).alias(c) for c in ("history_rows", "state_rows")]
    return found.agg(*sums, F.min("covered").alias("covered"))


@query
def dq_scd2_no_current(spark, sf):
    return quality.without_current(_intervals(spark, sf))


@query
def dq_scd2_bad_interval(spark, sf):
    return quality.bad_intervals(_intervals(spark, sf))


@query
def dq_unmatched_items(spark, sf):
    source = L.operational(spark, sf)
    return quality.unmatched(source.order_items, source.products, "product_id")
