"""Change logs and operational tables derived from the test tables (FIXTURES.md, section 6).

Each log is one projection of one scan: a row becomes an array of its versions, which is exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.entities import CUSTOMERS, ENTITIES, ORDER_ITEMS, ORDERS, PRODUCTS, SEQ, VERSION, Entity
from tidemark.operators import cdc, state
from tidemark.plans.batch import Tables
from tidemark.session import shuffles_dropped, use_utc
from tidemark.sources.changes import to_messages

# Fixed values of the derivation.
T0 = 1_704_067_200_000  # 2024-01-01 00:00:00 UTC
DAY = 86_400_000
SHIFT_DAYS = 10_592  # order dates move by 29 years, to 2024-01-01 and after
LEAD_DAYS = 10  # from order to delivery

ITEM_FIELDS = [
    "order_id", "product_id", "quantity", "created_at", "updated_at", "created_by", "updated_by"
]


# The columns the derivation reads. Declared, so that no job has to look them up.
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _version(when: Column | None, seq: int, op: str, key: Column, **changes: Column) -> Column:
    built = F.struct(
        F.lit(seq).cast("bigint").alias(SEQ),
        F.lit(op).alias("cdc_op"),
        (F.lit(T0 + seq * DAY).cast("bigint") + key).alias(VERSION),
        *[value.alias(name) for name, value in changes.items()],
    )
    return built if when is None else F.when(when, built)


def _explode(df: DataFrame, versions: list[Column]) -> DataFrame:
    return df.withColumn("v", F.explode(F.array(*versions))).filter(F.col("v").isNotNull())


def _audit(key: Column) -> list[Column]:
    seq, version = F.col(f"v.{SEQ}"), F.col(f"v.{VERSION}")
    return [
        F.when((seq > 0) | (key % 13 != 0), version).alias("updated_at"),
        F.when(seq > 0, seq).alias("updated_by"),
        (F.lit(T0).cast("bigint") + key).alias("created_at"),
        (key % 10).alias("created_by"),
        (F.col("v.cdc_op") == "d").alias("cdc_deleted"),
        F.col("v.cdc_op").alias("cdc_op"),
        version.alias(VERSION),
        seq.alias(SEQ),
    ]


def customers_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    stays = F.when(k % 11 != 0, F.lit(True))
    flipped = F.lit(False)
    last = F.when(k % 3 == 0, flipped).otherwise(stays)
    rows = _explode(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"),
        [
            _version(None, 0, "r", k, is_active=stays),
            _version(k % 3 == 0, 1, "u", k, is_active=flipped),
            _version(k % 50 == 0, 2, "d", k, is_active=last),
            _version(k % 100 == 0, 3, "c", k, is_active=F.lit(True)),
        ],
    )
    return rows.select(
        k.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("v.is_active").alias("is_active"),
        F.when(k % 7 != 0, F.col("c_mktsegment")).alias("customer_address"),
        *_audit(k),
    )


def products_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(10,2)")
    raised = (price * F.lit("1.1").cast("decimal(2,1)")).cast("decimal(10,2)").cast("double")
    price = price.cast("double")
    last = F.when(k % 4 == 0, raised).otherwise(price)
    rows = _explode(
        table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice"),
        [
            _version(None, 0, "r", k, unity_price=price),
            _version(k % 4 == 0, 1, "u", k, unity_price=raised),
            _version(k % 97 == 0, 2, "d", k, unity_price=last),
        ],
    )
    return rows.select(
        k.alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("barcode"),
        F.col("v.unity_price").alias("unity_price"),
        F.when(k % 17 != 0, k % 5 != 0).alias("is_active"),
        *_audit(k),
    )


def _final_status(k: Column) -> Column:
    source = F.col("o_orderstatus")
    done = F.when(k % 5 == 0, "CANCELLED").otherwise("COMPLETED")
    going = F.when(k % 5 < 2, "REPROCESSING").otherwise("PROCESSING")
    return F.when(source == "F", done).when(source == "P", going).otherwise("PENDING")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    known = k % 211 != 0
    first, last = F.when(known, F.lit("PENDING")), F.when(known, _final_status(k))
    day = F.unix_date(F.col("o_orderdate").cast("date")) + SHIFT_DAYS
    rows = _explode(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"),
        [
            _version(None, 0, "c", k, status=first),
            _version(F.col("o_orderstatus").isin("F", "P"), 1, "u", k, status=last),
            _version(k % 101 == 0, 2, "d", k, status=last),
        ],
    )
    return rows.select(
        k.alias("order_id"),
        F.when(k % 401 == 0, F.lit(-1)).otherwise(day).alias("order_date"),
        F.when(k % 23 != 0, day + LEAD_DAYS).alias("delivery_date"),
        F.when(k % 307 != 0, F.col("o_custkey")).alias("customer_id"),
        F.col("v.status").alias("status"),
        *_audit(k),
    )


def order_items_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated line items are versions of each other; the part key breaks ties between them."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    version = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    flag = F.col("l_returnflag")
    op = F.when(flag == "N", "c").when(flag == "A", "u").otherwise("d")
    return table(spark, sf_dir, "lineitem").select(
        key.alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        version.alias("updated_at"),
        F.col("l_suppkey").alias("updated_by"),
        version.alias("created_at"),
        F.when(key % 13 != 0, key % 10).alias("created_by"),
        (op == "d").alias("cdc_deleted"),
        op.alias("cdc_op"),
        version.alias(VERSION),
        F.col("l_partkey").alias(SEQ),
    )


LOGS = {
    CUSTOMERS: customers_log,
    PRODUCTS: products_log,
    ORDERS: orders_log,
    ORDER_ITEMS: order_items_log,
}


def log(spark: SparkSession, sf_dir: str, entity: Entity) -> DataFrame:
    return LOGS[entity](spark, sf_dir)


def staged(spark: SparkSession, sf_dir: str, entity: Entity) -> DataFrame:
    return cdc.stage(log(spark, sf_dir, entity), entity)


def current(spark: SparkSession, sf_dir: str, entity: Entity, columns=None) -> DataFrame:
    return state.current(staged(spark, sf_dir, entity), entity, columns)


def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products table as a snapshot would read it."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("bigint")
    return table(spark, sf_dir, "part").select(
        k.alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("barcode"),
        F.col("p_retailprice").cast("decimal(10,2)").cast("double").alias("unity_price"),
        F.when(k % 17 != 0, k % 5 != 0).alias("is_active"),
        none.alias("updated_at"),
        none.alias("updated_by"),
        (F.lit(T0).cast("bigint") + k).alias("created_at"),
        (k % 10).alias("created_by"),
    )


def operational(spark: SparkSession, sf_dir: str, settled: bool = True) -> Tables:
    """The four operational tables of the batch path.

    With ``settled`` orders have their final status and carry another creator, so that a second
    cycle changes what the first one stored. Tables are whole; some orders point at customers, and some
    items at products, that do not exist (negative ids).
    """
    k = F.col("o_orderkey")
    day = F.date_add(F.col("o_orderdate").cast("date"), SHIFT_DAYS)
    status = _final_status(k) if settled else F.lit("PENDING")
    creator = F.lit(99).cast("bigint") if settled else F.when(k % 13 != 0, k % 10)
    orders = table(spark, sf_dir, "orders").select(
        k.alias("order_id"),
        _astray(F.col("o_custkey"), 50).alias("customer_id"),
        day.alias("order_date"),
        F.when(k % 23 != 0, F.date_add(day, LEAD_DAYS)).alias("delivery_date"),
        status.alias("status"),
        (F.col("o_orderdate") + _later(settled)).alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        creator.alias("created_by"),
        F.when(k % 17 != 0, k % 10).alias("updated_by"),
    )
    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(
        c.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        (c % 3 != 0).alias("is_active"),
        F.col("c_mktsegment").alias("customer_address"),
    )
    p = F.col("p_partkey")
    products = table(spark, sf_dir, "part").select(
        p.alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("barcode"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unity_price"),
    )
    items = current(spark, sf_dir, ORDER_ITEMS, ["order_item_id", *ITEM_FIELDS]).withColumns(
        {
            "created_at": F.col("created_at").cast("timestamp_ntz") + _later(settled),
            "updated_at": F.col("updated_at").cast("timestamp_ntz"),
            "product_id": _astray(F.col("product_id"), 97),
        }
    )
    if settled:
        items = items.withColumn("created_by", F.lit(99).cast("bigint"))
    return Tables(orders, items, customers, products)


def _astray(key: Column, every: int) -> Column:
    """The key, or for each ``every``-th one an id that no parent has."""
    return F.when(key % every == 0, -key).otherwise(key)


def _later(settled: bool) -> Column:
    """A settled row claims another creation time, which an upsert must not store."""
    return F.expr("INTERVAL 1 DAY" if settled else "INTERVAL 0 DAY")


def envelopes(records: DataFrame, entity: Entity) -> DataFrame:
    """Flat records as the before/after envelopes a connector would unwrap them from."""
    stored_name = {new: old for old, new in entity.renames.items()}
    fields = [c for c in entity.columns if not c.startswith("cdc_")]
    image = F.struct(*[F.col(c).alias(stored_name.get(c, c)) for c in fields])
    op = F.col("cdc_op")
    envelope = F.struct(
        F.when(op.isin("u", "d"), image).alias("before"),
        F.when(op != "d", image).alias("after"),
        op.alias("op"),
        F.struct(F.col(VERSION).alias("ts_ms")).alias("source"),
        F.col(VERSION).alias("ts_ms"),
    )
    return records.select(
        F.lit(entity.topic()).alias("topic"),
        F.col(SEQ).alias("offset"),
        F.to_json(envelope).alias("value"),
    )


def flawed_order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders topic with cut-off messages (every 997th key) and a tombstone after each delete.

    Offsets are not unique across keys, as in all logs here: they order the versions of one key.
    """
    key = F.col("order_id")
    cut = F.when(key % 997 == 0, F.concat(F.lit('{"order_id": '), key.cast("string")))
    tombstone = F.struct(F.lit(None).cast("string").alias("value"), (F.col(SEQ) + 1).alias("offset"))
    message = F.struct(
        F.coalesce(cut, F.to_json(F.struct(*ORDERS.columns))).alias("value"),
        F.col(SEQ).alias("offset"),
    )
    sent = F.array(message, F.when(F.col("cdc_op") == "d", tombstone))
    return (
        orders_log(spark, sf_dir)
        .select(F.explode(sent).alias("m"))
        .filter(F.col("m").isNotNull())
        .select(F.lit(ORDERS.topic()).alias("topic"), "m.offset", "m.value")
    )


def spread(records: DataFrame) -> DataFrame:
    """Deal records out over all cores, in no particular order, before they grow into JSON."""
    return records.repartition(records.sparkSession.sparkContext.defaultParallelism)


def _over_all_cores(records: DataFrame) -> DataFrame:
    """Records on all cores: as they are read if as many tasks find some, else dealt out."""
    cores = records.sparkSession.sparkContext.defaultParallelism
    if records.rdd.getNumPartitions() < cores:
        return spread(records)
    # A file may be cut where it has no rows.
    return records if records.select(F.spark_partition_id()).distinct().count() >= cores else spread(records)


def all_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    (messages,) = dealt_messages(spark, sf_dir, 1)
    return messages


def dealt_messages(spark: SparkSession, sf_dir: str, deals: int) -> list[DataFrame]:
    """All messages in as many deals, which the records of a key fall into in no particular order."""
    logs = {e: _over_all_cores(log(spark, sf_dir, e)) for e in ENTITIES}

    def deal(n: int) -> DataFrame:
        def some(e: Entity) -> Column:
            return F.lit(True) if deals == 1 else F.pmod(F.xxhash64(e.key, SEQ), F.lit(deals)) == n

        parts = [to_messages(records.filter(some(e)), e) for e, records in logs.items()]
        return reduce(DataFrame.unionByName, parts)

    return [deal(n) for n in range(deals)]


def save_messages(messages: DataFrame, folder: str) -> None:
    with shuffles_dropped(messages.sparkSession):
        messages.write.mode("append").option("compression", "gzip").json(folder)


def forget_last_commit(spark: SparkSession, checkpoint: str) -> int:
    """Put a checkpoint into the state a crash leaves: the last micro-batch written, not committed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{checkpoint}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(int(f.getPath().getName()) for f in files.globStatus(hadoop.Path(folder, "[0-9]*")))
    files.delete(hadoop.Path(folder, str(last)), False)
    return last
