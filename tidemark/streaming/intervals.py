"""Validity kept up to date: a stored table of versions with their intervals.

Upkeep takes in the batches since the last time. A key that has new records, late ones included, has its intervals worked out
anew from its stored versions and the new ones; the others keep theirs, and buckets without such a key keep their files.
Readers do the same for the batches that upkeep has not seen yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.entities import SEQ, Entity
from tidemark.operators.history import drop_redelivered, with_intervals
from tidemark.sources.bases import Base, aligned, buckets_of, folder_bytes, last_base, merge_base, read_base
from tidemark.sources.tables import batch_path, committed, read_batches
from tidemark.streaming import statistics

VALIDITY = ("valid_from", "valid_to", "is_current")


def _table(entity: Entity) -> str:
    return f"intervals/{entity.name}"


def schema(entity: Entity) -> T.StructType:
    """The stored columns: a version with its place in the feed and its validity."""
    kinds = zip(VALIDITY, (T.TimestampType(), T.TimestampType(), T.IntegerType()), strict=True)
    return T.StructType([*entity.staged_schema, *[T.StructField(name, kind) for name, kind in kinds]])


def _with_intervals(spark: SparkSession, root: str, entity: Entity, records: DataFrame) -> DataFrame:
    hot, cuts = statistics.hot_keys(spark, root, entity)
    once = drop_redelivered(records.select(*entity.columns, SEQ), entity)
    return with_intervals(once, entity, hot=hot, cuts=cuts, with_seq=True).select(*schema(entity).names)


def _taken_in(spark: SparkSession, root: str, entity: Entity, old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows with new records taken in. Records without a key are one group, worked out anew."""
    key = entity.key
    keys = new.select(key).distinct()
    staying = old.filter(F.col(key).isNotNull()).join(keys, key, "left_anti")
    touched = old.join(keys, key, "left_semi").unionByName(old.filter(F.col(key).isNull()))
    records = touched.select(*entity.columns, SEQ).unionByName(new)
    return staying.select(*schema(entity).names).unionByName(_with_intervals(spark, root, entity, records))


def _records(spark: SparkSession, root: str, entity: Entity, after: int | None, upto: int | None = None) -> DataFrame:
    rows = read_batches(spark, root, f"history/{entity.name}", entity.history_schema, after=after, upto=upto)
    return rows.select(*entity.columns, SEQ)


def update(spark: SparkSession, root: str, entity: Entity, buckets: int | None = None) -> Base | None:
    """Take in the history batches since the last time. Run it before they are rolled up."""

    def changes(reached: int | None):
        new = [b for b in committed(spark, root, f"history/{entity.name}") if reached is None or b > reached]
        if not new:
            return None
        size = folder_bytes(spark, [batch_path(root, f"history/{entity.name}", b) for b in new])
        return new[-1], _records(spark, root, entity, reached, new[-1]), size

    return merge_base(
        spark,
        root,
        _table(entity),
        schema(entity),
        entity.key,
        changes,
        lambda old, new: _taken_in(spark, root, entity, old, new),
        buckets,
        deal=True,
        initial=lambda rows: _with_intervals(spark, root, entity, rows),
    )


def read(spark: SparkSession, root: str, entity: Entity) -> DataFrame | None:
    """Every version with its validity as of the last complete batch; None before the first upkeep."""
    table, kind = _table(entity), schema(entity)
    base = last_base(spark, root, table)
    if base is None:
        return None
    shown = [*entity.columns, *VALIDITY]
    if not any(b > base.reached for b in committed(spark, root, f"history/{entity.name}")):
        return read_base(spark, root, table, kind, entity.key, base).select(*shown)
    new = aligned(_records(spark, root, entity, base.reached), entity.key, base)
    old = read_base(spark, root, table, kind, entity.key, base)
    return _taken_in(spark, root, entity, old, new).select(*shown)


def of_keys(spark: SparkSession, root: str, entity: Entity, keys: DataFrame) -> DataFrame | None:
    """Versions with validity of some keys (a column named as the entity's key), from the buckets that hold them."""
    base = last_base(spark, root, _table(entity))
    if base is None:
        return None
    only = buckets_of(keys, entity.key, base)
    old = read_base(spark, root, _table(entity), schema(entity), entity.key, base, only)
    old = old.join(keys, entity.key, "left_semi")
    new = _records(spark, root, entity, base.reached).join(keys, entity.key, "left_semi")
    return _taken_in(spark, root, entity, old, new).select(*entity.columns, *VALIDITY)
