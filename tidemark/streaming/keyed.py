"""Current state kept by the streaming engine itself: the latest record per key as streaming state.

State grows with keys, not with records, and is never dropped: a record may arrive at any time and
must still be compared with the version it would replace. Only keys that changed leave a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.entities import SEQ, VERSION, Entity
from tidemark.operators import cdc
from tidemark.sources import stored
from tidemark.sources.tables import write_batch

_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB instead of executor memory.

    ``partitions`` of the state are fixed at the first start of a query, for its whole life.
    """
    wanted = dict(_ON_DISK)
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def start(
    messages: DataFrame,
    root: str,
    entity: Entity,
    prefix: str = "operations",
    envelope: bool = False,
    every: str | None = "5 seconds",
    partitions: int | None = None,
) -> StreamingQuery:
    """Write the changed keys of every micro-batch; :func:`current` reads them."""
    spark = messages.sparkSession
    staged = cdc.stage(cdc.decode(messages, entity, prefix, envelope), entity)
    rest = [c for c in entity.columns if c not in (entity.key, VERSION)]
    kept = staged.groupBy(entity.key).agg(F.max(F.struct(VERSION, SEQ, *rest)).alias("_last"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(entity.key, "_last.*").select(*entity.columns, SEQ)
        write_batch(rows, root, f"keyed/{entity.name}", batch_id, [entity.key])

    trigger = {"processingTime": every} if every else {"availableNow": True}
    with state_settings(spark, partitions):
        return (
            kept.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", f"{root}/_checkpoints/keyed-{entity.name}")
            .trigger(**trigger)
            .start()
        )


def current(spark: SparkSession, root: str, entity: Entity) -> DataFrame:
    return stored.live_rows(spark, root, f"keyed/{entity.name}", entity)


def compact(spark: SparkSession, root: str, entity: Entity, buckets: int | None = None) -> int | None:
    """Merge what the stream has written so far; run it from time to time."""
    return stored.compact(spark, root, f"keyed/{entity.name}", entity, buckets)
