"""Current state of an entity from its change records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.entities import SEQ, VERSION, Entity


def latest(records: DataFrame, entity: Entity, columns: Sequence[str] | None = None) -> DataFrame:
    """Per key the record with the greatest version; ``seq`` decides between equal versions.

    A max over a struct is combined before the shuffle, so a key with very many records sends one row
    per map task. Name the ``columns`` you need: Catalyst does not prune inside the struct.
    """
    wanted = list(columns) if columns else [*entity.columns, SEQ]
    rest = [c for c in wanted if c not in (entity.key, VERSION, SEQ)]
    return (
        records.groupBy(entity.key)
        .agg(F.max(F.struct(VERSION, SEQ, *rest)).alias("_last"))
        .select(*[F.col(c) if c == entity.key else F.col(f"_last.{c}").alias(c) for c in wanted])
    )


def latest_by_rank(records: DataFrame, entity: Entity) -> DataFrame:
    """The same rows as :func:`latest` by ranking; unused columns are pruned by Catalyst."""
    newest_first = Window.partitionBy(entity.key).orderBy(F.desc(VERSION), F.desc(SEQ))
    return (
        records.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def live(latest_records: DataFrame) -> DataFrame:
    """Drop keys whose last record is a delete. Only right after the versions were collapsed."""
    return latest_records.filter(F.col("cdc_deleted") == 0)


def current(records: DataFrame, entity: Entity, columns: Sequence[str] | None = None) -> DataFrame:
    """Live rows of an entity, one per key, from its staged records."""
    if not columns:
        return live(latest(records, entity)).select(*entity.columns)
    wanted = list(columns)
    needed = wanted if "cdc_deleted" in wanted else [*wanted, "cdc_deleted"]
    return live(latest(records, entity, needed)).select(*wanted)


def merge_latest(base: DataFrame, changes: DataFrame, entity: Entity) -> DataFrame:
    """The newer row per key of two relations with one row per key each.

    A ``base`` in buckets is read as it lies if ``changes`` are dealt out alike (``sources.bases.aligned``).
    """
    rest = [c for c in changes.columns if c not in (entity.key, VERSION, SEQ)]
    row = F.struct(VERSION, SEQ, *rest)
    return (
        base.select(entity.key, row.alias("_base"))
        .join(changes.select(entity.key, row.alias("_change")), entity.key, "full_outer")
        .select(entity.key, F.greatest("_base", "_change").alias("_last"))  # greatest skips nulls
        .select(
            *[F.col(c) if c == entity.key else F.col(f"_last.{c}").alias(c) for c in changes.columns]
        )
    )


def reinserted(records: DataFrame, entity: Entity) -> DataFrame:
    """Live rows of keys that were deleted at some time and came back."""
    rest = [c for c in entity.columns if c not in (entity.key, VERSION)]
    return (
        records.groupBy(entity.key)
        .agg(
            F.max(F.struct(VERSION, SEQ, *rest)).alias("_last"),
            F.max("cdc_deleted").alias("_was_deleted"),
        )
        .filter((F.col("_was_deleted") == 1) & (F.col("_last.cdc_deleted") == 0))
        .select(entity.key, "_last.*")
        .select(*entity.columns)
    )


def upsert(
    target: DataFrame, batch: DataFrame, key: str, keep: Sequence[str] = ()
) -> DataFrame:
    """``target`` with ``batch`` merged in by ``key``; rows that exist keep their ``keep`` columns.

    Keys are unique on both sides, so no key can be hot.
    """
    old, new = target.alias("old"), batch.alias("new")
    in_old, in_new = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")

    def merged(c: str):
        if c in keep:
            return F.when(in_old, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c)
        return F.when(in_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    return joined.select(*[merged(c) for c in target.columns])
