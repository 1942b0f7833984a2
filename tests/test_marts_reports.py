from datetime import date

import pytest

from tidemark.operators.dims import dim_order_status
from tidemark.plans import calendar, marts, reports

D1, D2 = date(2024, 5, 1), date(2024, 5, 4)


@pytest.fixture(scope="module")
def state(spark):
    orders = spark.createDataFrame(
        [
            (1, D1, 10, "PENDING"),
            (2, D1, 10, "PROCESSING"),
            (3, D1, None, "PENDING"),
            (4, D2, 11, "CANCELLED"),
            (5, None, 11, "PENDING"),
            (6, D2, 12, "REPROCESSING"),
            (7, D2, 99, "PENDING"),
            (8, D2, 12, None),
            (9, D2, 12, "LOST"),
        ],
        "order_id bigint, delivery_date date, customer_id bigint, status string",
    )
    items = spark.createDataFrame(
        [(1, 100, 5), (1, 101, 1), (2, 100, 2), (4, 100, 50), (6, 102, 3), (7, None, 9), (77, 100, 9)],
        "order_id bigint, product_id bigint, quantity int",
    )
    products = spark.createDataFrame(
        [(100, "bolt"), (101, "nut")], "product_id bigint, product_name string"
    )
    customers = spark.createDataFrame(
        [(10, "Ann"), (11, "Bo"), (12, "Cy")], "customer_id bigint, customer_name string"
    )
    return orders, items, products, customers, dim_order_status(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_orders_by_date_status(state):
    df = marts.orders_by_date_status(state[0])
    assert set(df.columns) == {"delivery_date", "status", "order_count"}
    assert (D1, "PENDING", 2) in rows(df) and (D2, "LOST", 1) in rows(df)
    assert len(rows(df)) == 6  # neither a null date nor a null status


@pytest.mark.parametrize("approximate", [False, True])
def test_top_delivery_dates_counts_orders_without_customer_but_not_as_customers(state, approximate):
    df = marts.top_delivery_dates(state[0], state[4], approximate)
    assert set(df.columns) == {"delivery_date", "order_count", "unique_customers"}
    assert rows(df) == [(D1, 3, 1), (D2, 2, 2)]


def test_pending_items_by_product(state):
    orders, items, products, _, statuses = state
    df = marts.pending_items_by_product(items, orders, products, statuses)
    assert set(df.columns) == {"product_id", "product_name", "status", "pending_quantity"}
    assert rows(df) == [
        (100, "bolt", "PENDING", 5),
        (100, "bolt", "PROCESSING", 2),
        (101, "nut", "PENDING", 1),
        (102, "", "REPROCESSING", 3),
    ]


def test_top_customers_open(state):
    orders, _, _, customers, statuses = state
    df = marts.top_customers_open(orders, customers, statuses)
    assert set(df.columns) == {"customer_id", "customer_name", "status", "order_count"}
    assert rows(df) == [
        (10, "Ann", "PENDING", 1),
        (10, "Ann", "PROCESSING", 1),
        (11, "Bo", "PENDING", 1),
        (12, "Cy", "REPROCESSING", 1),
        (99, "", "PENDING", 1),
    ]


def test_orders_report_filters_only_when_open(state):
    mart = marts.orders_by_date_status(state[0])
    opened = reports.orders_report(mart, state[4])
    assert {r.status for r in opened.collect()} == {"PENDING", "PROCESSING", "REPROCESSING"}
    assert rows(reports.orders_report(mart, state[4], "all")) == rows(mart)
    with pytest.warns(UserWarning, match="no filter"):
        assert rows(reports.orders_report(mart, state[4], "closed")) == rows(mart)


def test_items_report(state):
    orders, items, products, _, statuses = state
    mart = marts.pending_items_by_product(items, orders, products, statuses)
    pending = reports.items_by_product_report(mart)
    assert [tuple(r) for r in pending.collect()] == [(100, "bolt", 5), (101, "nut", 1)]
    opened = reports.items_by_product_report(mart, "open")
    assert [tuple(r) for r in opened.collect()] == [(100, "bolt", 7), (102, "", 3), (101, "nut", 1)]


def test_customers_report_ranks_with_ties_by_key(state):
    orders, _, _, customers, statuses = state
    mart = marts.top_customers_open(orders, customers, statuses)
    assert [r.customer_id for r in reports.top_customers_report(mart).collect()] == [10, 11, 99]
    two = reports.top_customers_report(mart, "open", 2).collect()
    assert [(r.customer_id, r.order_count) for r in two] == [(10, 2), (11, 1)]


def test_dates_report_and_limits(state):
    mart = marts.top_delivery_dates(state[0], state[4])
    assert [r.delivery_date for r in reports.top_delivery_dates_report(mart, 1).collect()] == [D1]
    for bad in (0, -1):
        with pytest.raises(ValueError, match="limit"):
            reports.top_delivery_dates_report(mart, bad)


def test_calendar_roll_ups(state):
    assert rows(calendar.weekend_split(state[0])) == [(0, 3), (1, 5), (None, 1)]
    assert rows(calendar.monthly(state[0])) == [(2024, 5, 8), (None, None, 1)]
    assert rows(calendar.quarterly(state[0])) == [(2024, 2, 8), (None, None, 1)]
