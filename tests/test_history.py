import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from records import intervals, log, record

from tidemark.entities import CUSTOMERS, ORDERS
from tidemark.functions.skew import hot_keys, time_cuts, with_time_slices
from tidemark.operators import cdc, history


def staged(spark, entity, rows):
    return cdc.stage(log(spark, entity, rows), entity)


def some_rows(seed, keys=8, rows=600, times=90):
    rng = random.Random(seed)
    return [
        record(
            CUSTOMERS, rng.randrange(keys), rng.randrange(times), n, rng.choice("cud"), updated_by=n
        )
        for n in range(rows)
    ]


def found(df):
    ms = df.select(
        "customer_id", "cdc_source_ts_ms", "updated_by", F.unix_millis("valid_to").alias("end")
    )
    return sorted(tuple(r) for r in ms.collect())


@pytest.mark.parametrize("hot", [[], [0], [0, 3, 5], list(range(8))], ids=lambda h: f"{len(h)} hot")
def test_intervals_match_brute_force(spark, hot):
    rows = some_rows(1)
    got = history.with_intervals(staged(spark, CUSTOMERS, rows), CUSTOMERS, hot=hot)
    assert found(got) == intervals(CUSTOMERS, rows)


@pytest.mark.parametrize("times", [1, 3, 100_000])
def test_a_hot_key_whose_records_share_one_instant_or_none(spark, times):
    rows = some_rows(2, keys=1, rows=900, times=times)
    got = history.with_intervals(staged(spark, CUSTOMERS, rows), CUSTOMERS, hot=[0])
    assert found(got) == intervals(CUSTOMERS, rows)


def awkward(spark):
    """Records with null keys and times, exact copies, and copies that differ in one column."""
    rng = random.Random(9)
    rows = [
        record(CUSTOMERS, rng.randrange(4), rng.randrange(6), rng.randrange(3), "u", updated_by=rng.randrange(2))
        for _ in range(300)
    ]
    df = staged(spark, CUSTOMERS, rows)
    chance = F.xxhash64(F.monotonically_increasing_id()) % 100
    return df.withColumn("customer_id", F.when(chance < 90, F.col("customer_id"))).withColumn(
        "cdc_source_ts_ms", F.when(chance > -90, F.col("cdc_source_ts_ms"))
    )


def whole_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("hot", [[0], [1, 3], [0, 1, 2, 3, 99]], ids=str)
def test_sliced_and_plain_intervals_agree_on_nulls_copies_and_ties(spark, hot):
    df = awkward(spark)
    plain = history.with_intervals(df, CUSTOMERS, hot=[])
    assert whole_rows(history.with_intervals(df, CUSTOMERS, hot=hot)) == whole_rows(plain)
    dated = df.filter("customer_id IS NOT NULL AND cdc_source_ts_ms IS NOT NULL")
    open_rows = history.with_intervals(dated, CUSTOMERS, hot=hot).groupBy("customer_id").agg(F.sum("is_current"))
    assert {tuple(r) for r in open_rows.collect()} == {(k, 1) for k in range(4)}


@pytest.mark.parametrize("hot", [[0], [0, 1, 2, 3]], ids=str)
def test_sliced_and_plain_as_of_joins_agree_on_nulls_copies_and_ties(spark, hot):
    versions = awkward(spark)
    facts = versions.select("customer_id", (F.col("cdc_source_ts_ms") + 1).alias("at"))
    args = (facts, versions, CUSTOMERS, "at", ["updated_by", "cdc_op", "cdc_source_ts_ms"])
    plain = history.as_of_join(*args, hot=[])
    assert whole_rows(history.as_of_join(*args, hot=hot)) == whole_rows(plain)


def test_an_empty_table_has_no_hot_keys(spark):
    assert hot_keys(spark.range(0), "id") == []


def test_too_many_keys_to_cut_are_refused(spark):
    points = spark.range(4).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    with pytest.raises(ValueError):
        time_cuts(points, "k", "t", 60_000)


def test_open_end_and_ties(spark):
    rows = [record(CUSTOMERS, 1, ts, n, updated_by=n) for n, ts in enumerate([5, 5, 9])]
    got = history.with_intervals(staged(spark, CUSTOMERS, rows), CUSTOMERS, hot=[]).collect()
    by_seq = {r.updated_by: r for r in got}
    assert by_seq[0].valid_from == by_seq[0].valid_to  # superseded in the same millisecond
    assert by_seq[2].valid_to == datetime(9999, 12, 31, 23, 59, 59, 999_000)
    assert [by_seq[n].is_current for n in range(3)] == [0, 0, 1]


def test_deleted_versions_stay_unless_left_out(spark):
    rows = [record(CUSTOMERS, 1, 1, 0, "c"), record(CUSTOMERS, 1, 2, 1, "d")]
    df = staged(spark, CUSTOMERS, rows)
    both = history.with_intervals(df, CUSTOMERS, hot=[]).collect()
    assert [(r.cdc_op, r.is_current) for r in sorted(both, key=lambda r: r.valid_from)] == [
        ("c", 0),
        ("d", 1),
    ]
    kept = history.with_intervals(df, CUSTOMERS, include_deleted=False, hot=[]).collect()
    assert [(r.cdc_op, r.is_current) for r in kept] == [("c", 0)]


def test_hot_keys_finds_only_the_large_ones(spark):
    df = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-7)).otherwise(F.col("id")).alias("k")
    )
    assert hot_keys(df, "k", min_rows=1_000) == [-7]
    assert hot_keys(df, "k") == []  # small enough for one task
    nulls = df.withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    assert hot_keys(nulls, "k", min_rows=1_000) == []


def test_slices_are_even(spark):
    points = spark.range(4_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    cuts = time_cuts(points, "k", "t", 1)
    sliced = with_time_slices(points, "k", "t", cuts)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1_100


def test_detected_hot_key_takes_the_sliced_path(spark, monkeypatch):
    monkeypatch.setattr("tidemark.functions.skew.MIN_HOT_ROWS", 100)
    rows = some_rows(3, keys=1, rows=700) + [
        record(CUSTOMERS, k, 1, 0, updated_by=0) for k in range(100, 800)
    ]
    got = history.with_intervals(staged(spark, CUSTOMERS, rows), CUSTOMERS)
    assert "_slice" in got._jdf.queryExecution().optimizedPlan().toString()
    assert found(got) == intervals(CUSTOMERS, rows)


def test_as_of_is_the_version_in_force(spark):
    rows = some_rows(4)
    df = staged(spark, CUSTOMERS, rows)
    for at in (0, 17, 89, 500):
        expected = sorted(
            (k, start, n) for k, start, n, end in intervals(CUSTOMERS, rows) if start <= at < end
        )
        got = history.as_of(df, CUSTOMERS, at).select("customer_id", "cdc_source_ts_ms", "updated_by")
        assert sorted(tuple(r) for r in got.collect()) == expected
    live = history.as_of(df, CUSTOMERS, 89, include_deleted=False)
    assert live.filter("cdc_deleted = 1").count() == 0


@pytest.mark.parametrize("hot", [[], [2], list(range(10))], ids=lambda h: f"{len(h)} hot")
def test_as_of_join_matches_brute_force(spark, hot):
    rows = [r for r in some_rows(5) if r["cdc_source_ts_ms"] >= 10]
    rng = random.Random(6)
    facts = [
        (n, rng.choice([None, *range(10)]), rng.choice([None, *range(110)])) for n in range(500)
    ]
    spans = intervals(CUSTOMERS, rows)

    def match(key, at):
        if key is None or at is None:
            return None
        return next((n for k, start, n, end in spans if k == key and start <= at < end), None)

    df = spark.createDataFrame(facts, "n int, customer_id bigint, at bigint")
    got = history.as_of_join(
        df, staged(spark, CUSTOMERS, rows), CUSTOMERS, "at", ["updated_by", "cdc_op"], hot=hot
    )
    assert got.columns == ["n", "customer_id", "at", "customers_updated_by", "customers_cdc_op"]
    pairs = [(r.n, r.customers_updated_by) for r in got.collect()]
    assert len(pairs) == len(facts)
    assert set(pairs) == {(n, match(key, at)) for n, key, at in facts}


def test_redelivered_records_are_dropped_but_real_repeats_stay(spark):
    a = record(ORDERS, 1, 5, 0, status="A")
    again = {**a, "seq": 7}
    same_time = {**a, "seq": 8, "status": "B"}
    df = staged(spark, ORDERS, [a, again, same_time])
    got = history.drop_redelivered(df, ORDERS).orderBy("seq").collect()
    assert [(r.status, r.seq) for r in got] == [("A", 0), ("B", 8)]


def test_active_through_a_period(spark):
    def c(key, ts, seq, active, op="u"):
        return record(CUSTOMERS, key, ts, seq, op, is_active=active, customer_name=f"n{key}")

    rows = [
        c(1, 0, 0, True),  # active all along
        c(2, 0, 0, True), c(2, 50, 1, False),  # not any more
        c(3, 0, 0, False), c(3, 150, 1, True),  # only afterwards
        c(4, 0, 0, True), c(4, 50, 1, False), c(4, 150, 2, True),  # then and now
        c(5, 0, 0, True), c(5, 150, 1, True, "d"),  # deleted
        c(6, 100, 0, True),  # starts as the period ends
        c(7, 0, 0, True), c(7, 10, 1, False), c(7, 120, 2, True),  # ended as the period starts
    ]
    got = history.active_through(staged(spark, CUSTOMERS, rows), CUSTOMERS, 10, 100, ["customer_name"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "n1"), (4, "n4")]


def test_op_counts(spark):
    rows = [record(ORDERS, 1, n, n, op) for n, op in enumerate("ruuud")] + [record(ORDERS, 2, 0, 0, "c")]
    got = history.op_counts(staged(spark, ORDERS, rows), ORDERS).orderBy("key").collect()
    assert [tuple(r) for r in got] == [("orders", 1, 1, 0, 3, 1), ("orders", 2, 0, 1, 0, 0)]
