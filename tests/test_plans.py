"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F
from records import log, record

import __spark_entry__ as contract
from bench import WRITING
from checks import logs as L
from tidemark.entities import CUSTOMERS, ORDERS
from tidemark.operators import cdc, dims, history
from tidemark.plans import batch, marts
from tidemark.sources.bases import last_base
from tidemark.sources import stored
from tidemark.sources.changes import to_messages
from tidemark.streaming import ingest


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    """Every operator with all its columns and pushed filters."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - WRITING))
def test_no_python_and_no_product_joins(spark, sf, name):
    text = plan(contract.queries()[name](spark, sf))
    for word in ("Python", "InPandas", "ArrowEval", "CartesianProduct", "NestedLoop"):
        assert word not in text


def test_current_state_is_combined_before_its_only_shuffle(spark, sf):
    text = plan(L.current(spark, sf, ORDERS, ["order_id", "status"]))
    assert text.count("Exchange") == 1
    before, after = text.split("Exchange")[1], text.split("Exchange")[0]
    assert "partial_max" in before and "partial_max" not in after


def test_intervals_need_one_shuffle(spark, sf):
    assert plan(history.with_intervals(L.staged(spark, sf, ORDERS), ORDERS)).count("Exchange") == 1


def test_scans_read_only_what_a_query_needs(spark, sf):
    text = formatted(contract.queries()["mart_top_customers_open"](spark, sf))
    read = sorted(re.findall(r"ReadSchema: struct<(.*?)>", text))
    assert len(read) == 2
    assert [f.split(":")[0] for f in read[0].split(",")] == ["c_custkey", "c_name"]
    wanted = {"o_orderkey", "o_custkey", "o_orderstatus"}
    assert {f.split(":")[0] for f in read[1].split(",")} == wanted


def test_status_dimension_is_broadcast_and_the_watermark_pushed_down(spark, sf):
    text = plan(contract.queries()["mart_top_delivery_dates"](spark, sf))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text
    extracted = formatted(contract.queries()["batch_extract_orders"](spark, sf))
    assert re.search(r"PushedFilters: .*GreaterThan\(o_orderdate,1998-01-01", extracted)


def test_calendar_is_broadcast_while_it_is_small(spark):
    days = spark.range(10).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    assert "BroadcastHashJoin" in plan(dims.with_calendar(days, "d"))
    forever = dims.with_calendar(days, "d", days=50_000_000)
    assert "BuildRight" not in plan(forever)


def test_top_reports_do_not_sort_everything(spark, sf):
    text = plan(contract.queries()["report_top_customers_open"](spark, sf))
    assert "TakeOrderedAndProject" in text


def test_as_of_filter_reaches_the_history_files(spark, tmp_path):
    rows = log(spark, ORDERS, [record(ORDERS, 1, 5, 0, "c")])
    ingest.land(spark, to_messages(rows, ORDERS), 0, str(tmp_path), [ORDERS])
    kept = ingest.history(spark, str(tmp_path), ORDERS)
    assert "LessThanOrEqual(cdc_source_ts_ms,3)" in formatted(history.as_of(kept, ORDERS, 3))


@pytest.mark.parametrize("width", [4, 64, 200])
def test_a_base_is_not_shuffled(spark, tmp_path, width):
    root, before = str(tmp_path), spark.conf.get("spark.sql.shuffle.partitions")
    for n in range(2):
        rows = [record(ORDERS, k, n, n, "u", status=f"{n}") for k in range(n * 50, 100)]
        ingest.land(spark, to_messages(log(spark, ORDERS, rows), ORDERS), n, root, [ORDERS])
        if n == 0:
            stored.compact(spark, root, "current/orders", ORDERS, buckets=8)
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        now = ingest.current(spark, root, ORDERS, ["order_id", "status"])
        counts = {r["status"]: r["count"] for r in now.groupBy("status").count().collect()}
        assert counts == {"0": 50, "1": 50}
        text = plan(now)
        stored.compact(spark, root, "current/orders", ORDERS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    base_side = text[text.index("SortMergeJoin") : text.index("Bucketed: true")]
    assert "Exchange" not in base_side
    assert len(last_base(spark, root, "current/orders").files) == 8  # one file per bucket


@pytest.fixture
def eager_skew(spark):
    """Treat small partitions as large ones, so that a test can show how skew is handled."""
    wanted = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_items_of_one_huge_order_are_split_in_the_mart(spark, eager_skew, tmp_path):
    n = 60_000
    items = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("order_id"),
        (F.col("id") % 500).alias("product_id"),
        F.lit(1).alias("quantity"),
    )
    orders = spark.range(n).select(F.col("id").alias("order_id"), F.lit("PENDING").alias("status"))
    products = spark.range(500).select(F.col("id").alias("product_id"), F.lit("p").alias("product_name"))
    mart = marts.pending_items_by_product(items, orders, products, dims.dim_order_status(spark))
    assert mart.agg(F.sum("pending_quantity")).first()[0] == n
    rows = mart.collect()
    assert len(rows) == 500 and "skew=true" in plan(mart)


def test_orders_of_one_huge_customer_are_split_in_the_batch_path(spark, eager_skew):
    n = 30_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id"))
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    orders = spark.range(0, n, 1, 8).select(
        F.col("id").alias("order_id"), hot.alias("customer_id"), F.lit("PENDING").alias("status"),
        at.cast("date").alias("order_date"), at.cast("date").alias("delivery_date"),
        at.alias("created_at"), at.alias("updated_at"),
        F.lit(1).alias("created_by"), F.lit(1).alias("updated_by"),
    )
    items = spark.range(0, n, 1, 8).select(
        F.col("id").alias("order_item_id"), F.col("id").alias("order_id"), hot.alias("product_id"),
        F.lit(2).alias("quantity"), at.alias("created_at"), at.alias("updated_at"),
        F.lit(1).alias("created_by"), F.lit(1).alias("updated_by"),
    )
    customers = spark.range(n).select(F.col("id").alias("customer_id"), F.lit("c").alias("customer_name"))
    products = spark.range(n).select(
        F.col("id").alias("product_id"), F.lit("p").alias("product_name"),
        F.lit("1.50").cast("decimal(10,2)").alias("unity_price"),
    )
    source = batch.Tables(orders, items, customers, products)
    out = batch.transform_orders(source)
    rows = out.collect()
    assert len(rows) == n and {r.customer_name for r in rows} == {"c"}
    assert sum(r.total_amount for r in rows) == 3 * n
    assert plan(out).count("skew=true") >= 2  # by product, and by customer
    lines = batch.transform_items(source)
    assert len(lines.collect()) == n and "skew=true" in plan(lines)


def test_facts_of_one_huge_customer_are_split_in_the_as_of_join(spark, monkeypatch):
    monkeypatch.setattr("tidemark.functions.skew.MIN_HOT_ROWS", 500)
    n = 6_000
    facts = spark.range(n).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") + 10).alias("customer_id"),
        F.col("id").alias("at"),
    )
    rows = [record(CUSTOMERS, 1, t, t, updated_by=t) for t in range(0, n, 10)]
    versions = cdc.stage(log(spark, CUSTOMERS, rows), CUSTOMERS)
    got = history.as_of_join(facts, versions, CUSTOMERS, "at", ["updated_by"])
    assert "_slice" in plan(got)
    found = {r.n: r.customers_updated_by for r in got.collect()}
    assert found == {i: (i // 10 * 10 if i % 3 == 0 else None) for i in range(n)}
