import re
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.plans import batch, exports
from tidemark.sources import pruning
from tidemark.sources.tables import committed

T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)

ORDERS = (
    "order_id bigint, customer_id bigint, order_date date, delivery_date date, status string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, created_by bigint, updated_by bigint"
)
ITEMS = (
    "order_item_id bigint, order_id bigint, product_id bigint, quantity int, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, created_by bigint, updated_by bigint"
)


def order(key, customer=1, status="PENDING", at=T1, by=7, due=date(2024, 2, 1)):
    return (key, customer, date(2024, 1, 1), due, status, at, at, by, None)


def tables(spark, orders, items=()):
    return batch.Tables(
        spark.createDataFrame(orders, ORDERS),
        spark.createDataFrame(
            [(i, o, p, q, T1, T1, None, 4) for i, o, p, q in items], ITEMS
        ),
        spark.createDataFrame([(1, "Ann"), (2, "Bo")], "customer_id bigint, customer_name string"),
        spark.createDataFrame(
            [(100, "bolt", Decimal("1.255")), (101, "nut", Decimal("2.00"))],
            "product_id bigint, product_name string, unity_price decimal(20,3)",
        ),
    )


def test_extract_follows_the_changed_orders(spark):
    source = tables(
        spark,
        [order(1, at=T1), order(2, 2, at=T2), order(3, 2, at=T3)],
        [(1, 1, 100, 1), (2, 2, 101, 1), (3, 3, 999, 1)],
    )
    got = batch.extract(source, T1, inclusive=False)
    assert sorted(r.order_id for r in got.orders.collect()) == [2, 3]
    assert sorted(r.order_item_id for r in got.order_items.collect()) == [2, 3]
    assert [r.customer_id for r in got.customers.collect()] == [2]
    assert [r.product_id for r in got.products.collect()] == [101]
    assert batch.next_watermark(got.orders).first().watermark == T3
    whole = batch.changed(source, T1, inclusive=False)
    assert sorted(r.order_item_id for r in whole.order_items.collect()) == [2, 3]
    for transform in (batch.transform_orders, batch.transform_items):
        assert sorted(transform(whole).collect()) == sorted(transform(got).collect())
    again = batch.extract_orders(source.orders, T3)
    assert [r.order_id for r in again.collect()] == [3]
    assert batch.extract_orders(source.orders, T3, inclusive=False).isEmpty()


def test_orders_get_names_totals_and_users(spark):
    source = tables(
        spark,
        [order(1), order(2, customer=5, by=None), order(3, by=-4)],
        [(1, 1, 100, 3), (2, 1, 101, 2), (3, 2, 999, 4)],
    )
    got = {r.order_id: r for r in batch.transform_orders(source).collect()}
    assert (got[1].customer_name, got[1].total_items) == ("Ann", 5)
    assert got[1].total_amount == Decimal("7.77")  # 3.765 + 4.00, rounded half up at the end
    assert (got[2].customer_name, got[2].total_items) == ("Unknown", 4)
    assert got[2].total_amount == Decimal("0.00")  # the product is unknown
    assert (got[3].total_items, got[3].total_amount) == (0, Decimal("0.00"))  # no items
    assert [got[k].created_by for k in (1, 2, 3)] == ["7", "-1", "-1"]
    assert got[1].updated_by == "-1"
    assert got[1].order_date == datetime(2024, 1, 1)


def test_items_get_names_prices_and_their_order(spark):
    source = tables(spark, [order(1, status="COMPLETED")], [(1, 1, 100, 3), (2, 1, 999, 1), (3, 8, 100, 1)])
    got = {r.id: r for r in batch.transform_items(source).collect()}
    assert set(got) == {1, 2}
    assert (got[1].product_name, got[1].price, got[1].order_status) == ("bolt", Decimal("1.26"), "COMPLETED")
    assert (got[2].product_name, got[2].price) == ("Unknown", Decimal("0.00"))
    assert (got[1].created_by, got[1].updated_by) == ("None", "4")


def test_an_order_that_commits_late_is_not_missed(spark, tmp_path):
    root = str(tmp_path)
    first = [order(1, at=T1), order(2, at=T2), order(5, at=None)]
    assert batch.run_cycle(tables(spark, first), root) == 0
    assert batch.run_cycle(tables(spark, first), root) is None
    late = [*first, order(3, at=T2)]
    assert batch.run_cycle(tables(spark, late), root) == 1
    assert batch.run_cycle(tables(spark, late), root) is None  # what either cycle stored at that time
    again = [order(1, at=T1), order(2, at=T2, status="COMPLETED"), order(3, at=T2)]
    assert batch.run_cycle(tables(spark, again), root) == 2
    assert batch.run_cycle(tables(spark, again), root) is None
    batch.compact(spark, root)
    assert batch.run_cycle(tables(spark, again), root) is None
    got = {r.order_id: r.status for r in batch.analytical_orders(spark, root).collect()}
    assert got == {1: "PENDING", 2: "COMPLETED", 3: "PENDING"}


def test_orders_at_the_watermark_are_found_without_reading_the_stored_ones(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    first = [order(1, at=T1), order(2, at=T2)]
    batch.run_cycle(tables(spark, first), root)
    batch.compact(spark, root)
    late = [*first, order(3, at=T2)]
    assert batch.run_cycle(tables(spark, late), root) == 1
    kept = {r.order_id for r in batch._at_watermark(spark, root, 1, T2).collect()}
    assert kept == {2, 3}  # those of both cycles, as the watermark stayed

    def refused(*args, **kwargs):
        raise AssertionError("the stored orders were read")

    monkeypatch.setattr(batch, "_upserted", refused)
    assert batch.run_cycle(tables(spark, late), root) is None
    files = batch._at_watermark(spark, root, 1, T2).inputFiles()
    assert files and all("/orders_at_watermark/" in f for f in files)
    monkeypatch.undo()
    for marker in (tmp_path / "orders_at_watermark").glob("*/_SUCCESS"):
        marker.unlink()  # the cycle broke off before it put them aside
    assert batch.run_cycle(tables(spark, late), root) is None


def test_ids_of_changed_orders_reach_the_source_as_ranges(spark, tmp_path):
    orders = [order(k, customer=k % 7, at=T1 if k < 500 else T2) for k in range(1000)]
    whole = tables(spark, orders, [(k, k, 100, 1) for k in range(1000)])
    for name in ("orders", "order_items", "customers", "products"):
        getattr(whole, name).write.parquet(str(tmp_path / name))
    source = batch.Tables(*[spark.read.parquet(str(tmp_path / n)) for n in ("orders", "order_items", "customers", "products")])
    changed = batch.changed_orders(source, T2).filter("order_id < 520 OR order_id > 990")
    ranges = pruning.id_ranges(changed, ["order_id", "customer_id"], most=8)
    assert ranges["order_id"][0][0] == 500 and ranges["order_id"][-1] == (991, 999) and len(ranges["order_id"]) <= 8
    found = batch.pruned(source, changed, ranges)
    shown = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = found.order_items._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", shown)
    assert "GreaterThanOrEqual(order_id,500)" in plan and "LessThanOrEqual(order_id,999)" in plan
    assert {r.order_id for r in found.order_items.collect()} == {*range(500, 520), *range(991, 1000)}
    assert pruning.predicates("order_id", [(1, 5), (9, 9)]) == ["order_id >= 1 AND order_id <= 5", "order_id >= 9 AND order_id <= 9"]
    assert pruning.id_ranges(changed.limit(0), ["order_id"]) == {"order_id": []}
    assert pruning.within(source.orders, "order_id", []).count() == 0
    nulls = spark.createDataFrame([(None, 5), (7, None), (-3, None)], "a bigint, b bigint")
    assert pruning.id_ranges(nulls, ["a", "b"], most=1) == {"a": [(-3, 7)], "b": [(5, 5)]}


def test_the_filter_by_ranges_is_small_enough_to_be_compiled(spark, capsys):
    ids = spark.range(0, 200_000_000, 1_000_000).select((F.col("id") + F.col("id") / 1_000_000 % 7).cast("bigint").alias("id"))
    ranges = pruning.id_ranges(ids, ["id"])["id"]
    assert 1 < len(ranges) <= pruning.RANGES
    kept = pruning.within(ids, "id", ranges)
    assert kept.count() == 200  # no id is lost
    rows = spark.range(100).select(F.when(F.col("id") > 3, F.col("id")).alias("k"))
    widest = [(i * 10, i * 10 + 5) for i in range(pruning.RANGES)]
    for filtered in (kept, pruning.within(rows.select(F.struct("k").alias("s")).select("s.k"), "k", widest)):
        filtered.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8_000  # the JVM interprets larger methods


def test_ranges_are_apart_by_the_widest_gaps(spark):
    rows = spark.range(0, 100_000, 7).unionByName(spark.range(400_000, 500_000, 3)).unionByName(spark.range(900_000, 900_005))
    assert pruning.id_ranges(rows, ["id"]) == {"id": [(0, 99_995), (400_000, 499_999), (900_000, 900_004)]}
    assert pruning.id_ranges(rows, ["id"], most=2) == {"id": [(0, 499_999), (900_000, 900_004)]}
    assert pruning.joined([(1, 2), (3, 5), (7, 7), (20, 30), (26, 31)], 9) == [(1, 5), (7, 7), (20, 31)]
    assert pruning.joined([(1, 2), (7, 7), (20, 30)], 1) == [(1, 30)]
    assert pruning.joined([], 3) == []


@pytest.mark.parametrize("report", [batch.top_delivery_dates, batch.top_customers_with_pending_orders])
def test_a_limit_below_one_is_refused(spark, report):
    with pytest.raises(ValueError, match="limit"):
        report(analytic(spark)[0], 0)


def test_cycles_upsert_and_keep_first_creation(spark, tmp_path):
    root = str(tmp_path)
    assert batch.run_cycle(tables(spark, [order(1, at=T1), order(2, at=T1)], [(1, 1, 100, 1)]), root) == 0
    later = tables(
        spark,
        [order(1, at=T1), order(2, status="COMPLETED", at=T2, by=9), order(3, at=T3)],
        [(1, 1, 100, 1), (2, 2, 101, 6)],
    )
    assert batch.run_cycle(later, root) == 1
    assert batch.run_cycle(later, root) is None  # nothing changed since
    got = {r.order_id: r for r in batch.analytical_orders(spark, root).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[2].status, got[2].total_items) == ("COMPLETED", 6)
    assert (got[2].created_at, got[2].created_by, got[2].updated_at) == (T1, "7", T2)
    assert {r.id for r in batch.analytical_items(spark, root).collect()} == {1, 2}


def test_compaction_changes_nothing_for_readers(spark, tmp_path):
    root = str(tmp_path)
    assert batch.compact(spark, root) is None
    batch.run_cycle(tables(spark, [order(1, at=T1), order(2, at=T1)], [(1, 1, 100, 1)]), root)
    assert batch.compact(spark, root, buckets=4) == 0
    later = tables(
        spark, [order(2, status="COMPLETED", at=T2, by=9), order(3, at=T2)], [(1, 2, 101, 6)]
    )
    batch.run_cycle(later, root)
    for _ in range(2):
        got = {r.order_id: r for r in batch.analytical_orders(spark, root).collect()}
        assert {k: r.status for k, r in got.items()} == {1: "PENDING", 2: "COMPLETED", 3: "PENDING"}
        assert (got[2].created_at, got[2].created_by) == (T1, "7")
        assert [(r.id, r.order_id, r.quantity) for r in batch.analytical_items(spark, root).collect()] == [
            (1, 2, 6)
        ]
        assert batch.compact(spark, root, buckets=4) == 1


def test_a_failed_cycle_is_repeated_from_the_same_watermark(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    batch.run_cycle(tables(spark, [order(1, at=T1)], [(1, 1, 100, 1)]), root)
    later = tables(spark, [order(1, at=T2, status="COMPLETED")], [(1, 1, 100, 5)])
    write = batch.write_batch

    def fail_on_orders(df, r, table, *rest):
        if table == batch.ORDERS_TABLE:
            raise OSError("lost")
        write(df, r, table, *rest)

    monkeypatch.setattr(batch, "write_batch", fail_on_orders)
    with pytest.raises(OSError, match="lost"):
        batch.run_cycle(later, root)
    monkeypatch.setattr(batch, "write_batch", write)
    assert batch.stored_watermark(spark, root) == T1
    assert batch.analytical_items(spark, root).first().quantity == 1  # half a cycle is not visible
    assert batch.run_cycle(later, root) == 1
    assert batch.analytical_items(spark, root).first().quantity == 5
    assert batch.analytical_orders(spark, root).first().status == "COMPLETED"


def test_empty_source_writes_nothing(spark, tmp_path):
    assert batch.run_cycle(tables(spark, []), str(tmp_path)) is None
    assert committed(spark, str(tmp_path), batch.ORDERS_TABLE) == []
    assert batch.analytical_orders(spark, str(tmp_path)).count() == 0


def analytic(spark):
    source = tables(
        spark,
        [
            order(1, 1), order(2, 1, "CANCELLED"), order(3, 2, "COMPLETED"), order(4, 2, due=None),
            order(5, 2, due=date(2024, 3, 1)), order(6, 1, None),
        ],
        [(1, 1, 100, 4), (2, 4, 100, 1), (3, 5, 101, 7), (4, 3, 101, 9)],
    )
    return batch.transform_orders(source), batch.transform_items(source)


def test_batch_reports(spark):
    orders, items = analytic(spark)
    feb, mar = date(2024, 2, 1), date(2024, 3, 1)
    by_date = [tuple(r) for r in batch.open_orders_by_date_status(orders).collect()]
    assert by_date == [(feb, "CANCELLED", 1), (feb, "PENDING", 1), (mar, "PENDING", 1)]
    assert [tuple(r) for r in batch.top_delivery_dates(orders, 1).collect()] == [(feb, 2, 1)]
    assert [tuple(r) for r in batch.pending_items_by_product(items).collect()] == [
        (101, "nut", 7),
        (100, "bolt", 5),
    ]
    top = [tuple(r) for r in batch.top_customers_with_pending_orders(orders).collect()]
    assert top == [(2, "Bo", 2, Decimal("15.26")), (1, "Ann", 1, Decimal("5.02"))]


def test_export_writes_one_file_with_header_and_skips_empty_reports(spark, tmp_path):
    orders, items = analytic(spark)
    chosen = ["top_delivery_dates", "pending_items_by_product"]
    got = exports.export_reports(spark, orders, items.limit(0), str(tmp_path), chosen)
    assert {tuple(r) for r in got.collect()} == {("top_delivery_dates", 2), ("pending_items_by_product", 0)}
    assert [p.name for p in tmp_path.iterdir()] == ["top_delivery_dates.csv"]
    (part,) = Path(tmp_path, "top_delivery_dates.csv").glob("part-*.csv")
    assert part.read_text().splitlines() == [
        "delivery_date,order_count,unique_customers", "2024-02-01,2,1", "2024-03-01,1,1"
    ]


def test_reports_keep_their_order_over_several_files(spark, tmp_path):
    report = spark.range(1_000).repartition(4).orderBy("id")
    assert exports.write_csv(report, str(tmp_path / "one.csv"), single_file=True) == 1_000
    assert len(list((tmp_path / "one.csv").glob("part-*.csv"))) == 1
    assert exports.write_csv(report, str(tmp_path / "r.csv")) == 1_000
    parts = sorted((tmp_path / "r.csv").glob("part-*.csv"))
    assert {p.read_text().splitlines()[0] for p in parts} == {"id"}
    assert exports.read_csv(spark, str(tmp_path / "r.csv")).count() == 1_000
    ids = [int(x) for p in parts for x in p.read_text().splitlines() if x != "id"]
    assert ids == list(range(1_000))


def test_no_selection_writes_nothing(spark, tmp_path):
    orders, items = analytic(spark)
    assert exports.export_reports(spark, orders, items, str(tmp_path), []).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        exports.batch_reports(orders, items, ["all"])
