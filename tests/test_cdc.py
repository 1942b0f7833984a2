import json
from datetime import date, datetime

import pytest
from records import log, record

from checks.logs import envelopes
from tidemark.entities import CUSTOMERS, ENTITIES, ORDER_ITEMS, ORDERS, PRODUCTS, SEQ
from tidemark.operators import cdc
from tidemark.sources.changes import MESSAGE_SCHEMA, only_topics, to_messages


def messages(spark, *rows):
    return spark.createDataFrame(list(rows), MESSAGE_SCHEMA)


def envelope(op, before=None, after=None, ts=5):
    return json.dumps({"before": before, "after": after, "op": op, "source": {"ts_ms": ts}, "ts_ms": 9})


def test_unwrap_takes_the_new_row_and_the_old_one_of_a_delete(spark):
    row = {"order_item_id": 1, "order_id": 2, "product_id": 3, "quanity": 4}
    t = ORDER_ITEMS.topic()
    df = messages(
        spark,
        (t, 0, envelope("c", after=row)),
        (t, 1, envelope("u", before=row, after={**row, "quanity": 9})),
        (t, 2, envelope("d", before={**row, "quanity": 9})),
        (t, 3, None),
        (ORDERS.topic(), 4, envelope("c", after={"order_id": 1})),
    )
    got = cdc.unwrap(df, ORDER_ITEMS).orderBy(SEQ).collect()
    assert [(r.quantity, r.cdc_op, r.cdc_deleted, r.cdc_source_ts_ms) for r in got] == [
        (4, "c", False, 5),
        (9, "u", False, 5),
        (9, "d", True, 5),
    ]
    assert "quanity" not in got[0].asDict()  # renamed on the way


@pytest.mark.parametrize("entity", ENTITIES, ids=lambda e: e.name)
def test_envelopes_unwrap_to_the_records_they_came_from(spark, sf, entity):
    from checks.logs import log as derived

    records = derived(spark, sf, entity).select(*entity.columns, SEQ)
    got = cdc.unwrap(envelopes(records, entity), entity)
    assert records.exceptAll(got).count() == 0 and got.exceptAll(records).count() == 0


@pytest.mark.parametrize("entity", ENTITIES, ids=lambda e: e.name)
def test_flat_messages_decode_to_the_records_they_came_from(spark, sf, entity):
    from checks.logs import log as derived

    records = derived(spark, sf, entity).select(*entity.columns, SEQ)
    got = cdc.decode(to_messages(records, entity), entity)
    assert records.exceptAll(got).count() == 0 and got.exceptAll(records).count() == 0


def test_delete_flag_may_be_boolean_or_text(spark):
    t = CUSTOMERS.topic()
    df = messages(
        spark,
        (t, 0, '{"customer_id": 1, "cdc_deleted": true}'),
        (t, 1, '{"customer_id": 2, "cdc_deleted": "true"}'),
        (t, 2, '{"customer_id": 3, "cdc_deleted": "false"}'),
        (t, 3, '{"customer_id": 4}'),
    )
    got = cdc.decode(df, CUSTOMERS).orderBy("customer_id").collect()
    assert [r.cdc_deleted for r in got] == [True, True, False, None]


def test_bad_messages_are_set_aside_and_good_ones_kept(spark):
    t = ORDERS.topic()
    rows = [
        (t, 0, '{"order_id": 1, "status": "PENDING"}'),
        (t, 1, '{"order_id": 1, "sta'),
        (t, 2, '{"status": "PENDING"}'),
        (t, 3, '{"order_id": "many"}'),
        (t, 4, "not json"),
        (t, 5, None),
    ]
    df = messages(spark, *rows)
    assert [r.seq for r in cdc.decode(df, ORDERS).collect()] == [0]
    assert sorted(r.offset for r in cdc.quarantine(df, ORDERS).collect()) == [1, 2, 3, 4]


def test_bad_envelopes_are_set_aside(spark):
    t = CUSTOMERS.topic()
    rows = [
        (t, 0, envelope("u", after={"customer_id": 1, "is_active": "false"})),
        (t, 1, envelope("u", after={"customer_id": 1})[:-3]),
        (t, 2, envelope("d", before=None)),
        (t, 3, envelope("c", after={"customer_id": "x"})),
        (t, 4, None),
    ]
    df = messages(spark, *rows)
    got = cdc.unwrap(df, CUSTOMERS).collect()
    assert [(r.seq, r.is_active) for r in got] == [(0, False)]
    bad = cdc.quarantine(df, CUSTOMERS, envelope=True).collect()
    assert sorted(r.offset for r in bad) == [1, 2, 3]


def test_only_listed_topics_pass(spark):
    df = messages(spark, (ORDERS.topic(), 0, "{}"), ("operations.secrets", 1, "{}"))
    assert [r.topic for r in only_topics(df, ENTITIES).collect()] == [ORDERS.topic()]


def test_staging_fills_defaults_and_decodes_days_and_instants(spark):
    rows = [
        record(ORDERS, 1, 1_000, 0, order_date=0, delivery_date=-1, updated_at=1_500, created_at=None),
        {**record(ORDERS, 2, None, 1), "cdc_op": None, "cdc_deleted": None},
    ]
    first, second = cdc.stage(log(spark, ORDERS, rows), ORDERS).orderBy("order_id").collect()
    assert first.order_date == date(1970, 1, 1) and first.delivery_date is None
    assert first.updated_at == datetime(1970, 1, 1, 0, 0, 1, 500_000) and first.created_at is None
    assert (second.cdc_op, second.cdc_deleted, second.cdc_source_ts_ms) == ("", 0, 0)


def test_staging_flags_default_to_active(spark):
    rows = [record(CUSTOMERS, k, 1, k, is_active=v) for k, v in enumerate([None, True, False])]
    got = cdc.stage(log(spark, CUSTOMERS, rows), CUSTOMERS).orderBy("customer_id").collect()
    assert [r.is_active for r in got] == [1, 1, 0]
    assert [r.customer_name for r in got] == ["", "", ""]


def test_staged_schema_is_the_declared_one(spark):
    for e in ENTITIES:
        staged = cdc.stage(log(spark, e, [record(e, 1, 1, 0)]), e)
        assert [(f.name, f.dataType) for f in staged.schema] == [
            (f.name, f.dataType) for f in e.staged_schema
        ]


def test_snapshot_reads_come_before_every_change(spark):
    rows = spark.createDataFrame(
        [(1, "bolt", "b", 2.0, True, None, None, None, None)], PRODUCTS.row_image
    )
    changes = log(spark, PRODUCTS, [record(PRODUCTS, 1, 50, 0, product_name="nut")])
    got = cdc.snapshot_union(rows, changes, PRODUCTS, 50).orderBy(SEQ).collect()
    assert [(r.cdc_op, r.cdc_deleted, r.product_name) for r in got] == [
        ("r", False, "bolt"),
        ("u", False, "nut"),
    ]


def test_snapshot_renames_source_columns(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4, None, None, None, None)], ORDER_ITEMS.row_image)
    changes = log(spark, ORDER_ITEMS, [])
    (got,) = cdc.snapshot_union(rows, changes, ORDER_ITEMS, 0).collect()
    assert got.quantity == 4
