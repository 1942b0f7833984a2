import random

from records import last_versions, log, record

from tidemark.entities import CUSTOMERS, ORDERS
from tidemark.operators import cdc, quality, state


def staged(spark, entity, rows):
    return cdc.stage(log(spark, entity, rows), entity)


def statuses(df):
    return {r.order_id: r.status for r in df.collect()}


def test_greatest_version_wins_whatever_the_arrival_order(spark):
    rows = [record(ORDERS, 1, ts, 10 - ts, status=str(ts)) for ts in (3, 1, 2)]
    assert statuses(state.current(staged(spark, ORDERS, rows), ORDERS)) == {1: "3"}


def test_equal_versions_are_decided_by_position(spark):
    rows = [record(ORDERS, 1, 5, seq, status=str(seq)) for seq in (2, 9, 4)]
    assert statuses(state.current(staged(spark, ORDERS, rows), ORDERS)) == {1: "9"}


def test_deleted_keys_vanish_and_old_rows_do_not_resurface(spark):
    rows = [
        record(ORDERS, 1, 1, 0, "c", status="old"),
        record(ORDERS, 1, 2, 1, "d", status="old"),
        record(ORDERS, 2, 1, 0, "c", status="kept"),
    ]
    assert statuses(state.current(staged(spark, ORDERS, rows), ORDERS)) == {2: "kept"}


def test_reinsert_makes_a_key_live_again(spark):
    rows = [
        record(CUSTOMERS, 1, 1, 0, "c"),
        record(CUSTOMERS, 1, 2, 1, "d"),
        record(CUSTOMERS, 1, 3, 2, "c", customer_name="back"),
        record(CUSTOMERS, 2, 1, 0, "c", customer_name="never gone"),
        record(CUSTOMERS, 3, 1, 0, "d"),
    ]
    df = staged(spark, CUSTOMERS, rows)
    assert {r.customer_id for r in state.current(df, CUSTOMERS).collect()} == {1, 2}
    assert [r.customer_name for r in state.reinserted(df, CUSTOMERS).collect()] == ["back"]


def test_duplicates_change_nothing(spark):
    rows = [record(ORDERS, k, ts, ts, status=f"{k}-{ts}") for k in range(5) for ts in range(3)]
    df = staged(spark, ORDERS, rows)
    once, twice = state.current(df, ORDERS), state.current(df.unionByName(df), ORDERS)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_matches_brute_force_and_both_methods_agree(spark):
    rng = random.Random(7)
    rows = [
        record(ORDERS, rng.randrange(60), rng.randrange(12), n, rng.choice("cud"), status=str(n))
        for n in range(800)
    ]
    expected = {
        k: r["status"] for k, r in last_versions(ORDERS, rows).items() if not r["cdc_deleted"]
    }
    df = staged(spark, ORDERS, rows)
    assert statuses(state.current(df, ORDERS)) == expected
    assert statuses(state.current(df, ORDERS, ["order_id", "status"])) == expected
    assert statuses(state.live(state.latest_by_rank(df, ORDERS))) == expected


def test_one_key_with_a_third_of_all_rows(spark):
    hot = [record(ORDERS, 1, ts, ts, status=str(ts)) for ts in range(3_000)]
    rest = [record(ORDERS, k, 1, 0, status="x") for k in range(2, 6_000)]
    got = statuses(state.current(staged(spark, ORDERS, hot + rest), ORDERS))
    assert got[1] == "2999" and len(got) == 5_999


def test_upsert_inserts_updates_and_keeps(spark):
    schema = "id int, a string, made string"
    target = spark.createDataFrame([(1, "one", "t"), (2, None, None)], schema)
    batch = spark.createDataFrame([(2, "two", "b"), (3, "three", "b")], schema)
    got = {r.id: (r.a, r.made) for r in state.upsert(target, batch, "id", ["made"]).collect()}
    assert got == {1: ("one", "t"), 2: ("two", None), 3: ("three", "b")}


def test_upsert_may_set_a_column_to_null(spark):
    target = spark.createDataFrame([(1, "one")], "id int, a string")
    batch = spark.createDataFrame([(1, None)], "id int, a string")
    assert state.upsert(target, batch, "id").collect()[0].a is None


def test_history_that_lost_a_key_or_state_that_made_one_up_is_reported(spark):
    whole = spark.createDataFrame([(1,), (1,), (2,)], f"{ORDERS.key} bigint")
    keys = whole.distinct()
    cases = [(whole, keys, (3, 2, 1)), (whole.filter(f"{ORDERS.key} = 1"), keys, (2, 2, 0))]
    cases += [(whole, keys.unionByName(keys), (3, 4, 0)), (whole.limit(0), keys, (0, 2, 0))]
    for history, state_rows, expected in cases:
        got = quality.history_covers_state({ORDERS: history}, {ORDERS: state_rows}).first()
        assert tuple(got) == ("orders", *expected)
