"""What a large run leaves on disk while it goes on."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from records import log, record

from checks import logs, queries
from tidemark.entities import ENTITIES, ORDER_ITEMS, ORDERS, SEQ
from tidemark.operators import dims, state
from tidemark.plans import marts
from tidemark.session import DROP_SHUFFLES, shuffles_dropped
from tidemark.sources import tables
from tidemark.sources.changes import saved_messages, to_messages
from tidemark.sources.tables import committed, exists
from tidemark.streaming import ingest


@pytest.fixture
def sliced(monkeypatch):
    """Tables of any size are shuffled in three slices."""
    monkeypatch.setattr("tidemark.sources.tables.SLICE_BYTES", 1)
    monkeypatch.setattr("tidemark.sources.tables.MOST_SLICES", 3)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in Path(d).rglob("shuffle_*.data")}


def order_messages(spark, n=200, seed=1):
    rng = random.Random(seed)
    rows = [
        record(ORDERS, rng.randrange(60), rng.randrange(50), i, rng.choice("ccud"), status=rng.choice(["PENDING", "COMPLETED", None]),
               delivery_date=rng.choice([None, 20_000, 20_001]), customer_id=rng.choice([None, 1, 2, 3]))
        for i in range(n)
    ]
    return to_messages(log(spark, ORDERS, rows), ORDERS)


def item_messages(spark, n=200, seed=2):
    rng = random.Random(seed)
    rows = [
        record(ORDER_ITEMS, rng.randrange(80), rng.randrange(50), i, rng.choice("ccud"), order_id=rng.choice([None, *range(65)]),
               product_id=rng.choice([None, 1, 2]), quantity=rng.choice([None, 0, 5, -5]))
        for i in range(n)
    ]
    return to_messages(log(spark, ORDER_ITEMS, rows), ORDER_ITEMS)


def test_landing_in_slices_leaves_no_shuffles(spark, tmp_path, sliced, monkeypatch):
    root, latest, there = str(tmp_path), state.latest, []
    messages = order_messages(spark)
    before = shuffle_files(spark)

    def seen(*args):
        there.append(exists(spark, f"{root}/messages/batch_id=0"))
        return latest(*args)

    monkeypatch.setattr(state, "latest", seen)
    for _ in range(2):  # landing again changes nothing
        ingest.land(spark, messages, 0, root, [ORDERS])
        assert shuffle_files(spark) <= before
    assert there == [False] * 6  # the messages are gone before state is made, slice by slice
    monkeypatch.undo()
    stored = spark.read.parquet(f"{root}/current/orders/batch_id=0")
    expected = latest(spark.read.parquet(f"{root}/history/orders/batch_id=0"), ORDERS)
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, expected.select(*stored.columns).collect()))
    assert committed(spark, root, "current/orders") == [0]


def test_settings_are_put_back(spark):
    assert spark.conf.get(DROP_SHUFFLES) == "false"
    with shuffles_dropped(spark):
        with shuffles_dropped(spark):
            pass
        assert spark.conf.get(DROP_SHUFFLES) == "true"
    assert spark.conf.get(DROP_SHUFFLES) == "false"


def test_a_batch_counts_with_its_last_part(spark, tmp_path):
    first, fails = spark.range(5), spark.range(5).select(F.raise_error("broken off").cast("long").alias("id"))
    with pytest.raises(Exception, match="broken off"):
        tables.write_parts([first, fails], str(tmp_path), "numbers", 0)
    assert (tmp_path / "numbers/batch_id=0").exists() and committed(spark, str(tmp_path), "numbers") == []
    tables.write_parts([first, spark.range(5, 9)], str(tmp_path), "numbers", 0)
    found = spark.read.parquet(f"{tmp_path}/numbers/batch_id=0")
    assert committed(spark, str(tmp_path), "numbers") == [0] and sorted(r.id for r in found.collect()) == list(range(9))


def test_the_feed_is_dealt_out_compressed_and_deleted_when_read(spark, sf, tmp_path):
    root = str(tmp_path)
    deals = logs.dealt_messages(spark, sf, 3)
    counts = [m.count() for m in deals]
    whole = logs.all_messages(spark, sf)
    assert sum(counts) == whole.count() and min(counts) > 0.9 * max(counts)
    before = shuffle_files(spark)
    feed = queries._feed(spark, deals, root)
    assert shuffle_files(spark) <= before
    saved = list(tmp_path.glob("topics/part-*"))
    assert all(f.suffix == ".gz" for f in saved)
    kept = saved_messages(spark, f"{root}/topics")
    assert kept.exceptAll(whole).isEmpty() and whole.exceptAll(kept).isEmpty()
    ingest.start(feed, root, every=None, refresh_every=None).awaitTermination()
    assert len(committed(spark, root, "history/orders")) == 3
    assert len(list(tmp_path.glob("topics/part-*"))) <= len(saved) // 3 + 3  # those of the last micro-batch, which may be replayed


def test_records_read_by_enough_tasks_are_not_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 100, 1, 2 * cores).write.parquet(f"{tmp_path}/many")
    spark.range(0, 100, 1, 1).write.parquet(f"{tmp_path}/one")

    def plan(folder):
        rows = logs._over_all_cores(spark.read.option("openCostInBytes", 1).parquet(folder))
        assert rows.count() == 100
        return rows._jdf.queryExecution().optimizedPlan().toString()

    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert "Repartition" not in plan(f"{tmp_path}/many") and "Repartition" in plan(f"{tmp_path}/one")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_counting_history_shuffles_keys_and_fingerprints(spark, tmp_path):
    root = str(tmp_path)
    rows = [
        record(ORDERS, 1, 1, 0, "u", updated_by=5), record(ORDERS, 1, 1, 1, "u", created_by=5), record(ORDERS, 1, 1, 2, "u", customer_id=5),
        record(ORDERS, 1, 1, 3, "u", updated_by=5), record(ORDERS, 2, 1, 4, "u", updated_by=5),
    ]
    ingest.land(spark, to_messages(log(spark, ORDERS, rows), ORDERS), 0, root, [ORDERS])
    found = ingest.history(spark, root, ORDERS)
    # A hash passes over nulls; rows that differ in which column is null are still told apart.
    assert sorted((r.order_id, r[SEQ]) for r in found.collect()) == [(1, 0), (1, 1), (1, 2), (2, 4)]
    counted = found.agg(F.count(F.lit(1)))
    assert counted.first()[0] == 4
    aggregates = [line for line in counted._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [order_id" in line]
    assert len(aggregates) == 1 and "_inserted_at" not in aggregates[0] and "min(" not in aggregates[0]


@pytest.mark.parametrize("name", ["stream_fanout_counts", "dq_history_ge_current"])
def test_counts_are_the_same_in_slices(spark, sf, monkeypatch, name):
    whole = queries.QUERIES[name](spark, sf).collect()
    monkeypatch.setattr("tidemark.sources.tables.SLICE_BYTES", 20_000)
    monkeypatch.setattr("tidemark.sources.tables.MOST_SLICES", 3)
    before = shuffle_files(spark)
    found = queries.QUERIES[name](spark, sf)
    assert shuffle_files(spark) <= before
    assert sorted(found.collect()) == sorted(whole) and len(whole) == len(ENTITIES)


def test_marts_by_difference_in_slices(spark, tmp_path, sliced, monkeypatch):
    root, parts = str(tmp_path), {}

    def counted(rows, root, table, *args):
        parts[table] = len(rows)
        tables.write_parts(rows, root, table, *args)

    for module in ("streaming.differences", "sources.sums"):
        monkeypatch.setattr(f"tidemark.{module}.write_parts", counted)
    for n in range(3):
        ingest.land(spark, order_messages(spark, seed=n).unionByName(item_messages(spark, seed=n + 9)), n, root)
        before = shuffle_files(spark)
        ingest.refresh_marts(spark, root, n)
        assert shuffle_files(spark) <= before
        customers, products, orders, items = (ingest.current(spark, root, e) for e in ENTITIES)
        statuses = dims.dim_order_status(spark)
        expected = (
            marts.orders_by_date_status(orders),
            marts.top_delivery_dates(orders, statuses),
            marts.pending_items_by_product(items, orders, products, statuses),
            marts.top_customers_open(orders, customers, statuses),
        )
        for name, mart in zip(marts.MARTS, expected, strict=True):
            assert sorted(map(repr, ingest.mart(spark, root, name).collect())) == sorted(map(repr, mart.collect())) and not mart.isEmpty()
    in_slices = ["changes/orders", "changes/order_items", "changes/date_customers", "sums/date_customers", "sums/order_products"]
    assert [parts[t] for t in [*in_slices, "sums/agg_pending_items_by_product"]] == [3] * 6
