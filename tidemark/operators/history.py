"""The full history of an entity: intervals of validity, as-of reads and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.entities import SEQ, VERSION, Entity
from tidemark.functions.columns import open_end
from tidemark.functions.skew import hot_keys, time_cuts, with_time_slices
from tidemark.operators.state import latest


def drop_redelivered(records: DataFrame, entity: Entity) -> DataFrame:
    """One row per distinct record; of repeated deliveries the first position stays.

    Grouping by the record's own columns keeps this a hash aggregate with a fixed-width buffer.
    """
    return records.groupBy(*entity.columns).agg(F.min(SEQ).alias(SEQ))


def with_intervals(
    history: DataFrame,
    entity: Entity,
    include_deleted: bool = True,
    hot: Sequence | None = None,
    cuts: DataFrame | None = None,
    with_seq: bool = False,
) -> DataFrame:
    """Each version with ``valid_from``, ``valid_to`` and ``is_current``.

    A version ends when the next one of its key starts, in event time, whatever order they arrived in.
    Versions that record a delete are kept unless ``include_deleted`` is false. Records of one (key,
    version, seq) are ordered by their other columns, and of equal copies one is the last. Records without
    a key are one group, which is never cut. ``hot`` overrides the detection of keys too large for one task, and ``cuts`` where
    they are cut; that changes how rows are spread, not the result.
    """
    records = history.select(*entity.columns, SEQ)
    hot = hot_keys(records, entity.key) if hot is None else list(hot)
    if hot:
        is_hot = F.coalesce(F.col(entity.key).isin(hot), F.lit(False))
        ends = _next_start(records.filter(~is_hot), entity).unionByName(
            _next_start_sliced(records.filter(is_hot), entity, len(hot), cuts)
        )
    else:
        ends = _next_start(records, entity)
    end = F.coalesce(F.timestamp_millis("_next"), open_end())
    out = ends.select(
        *entity.columns,
        *([SEQ] if with_seq else []),
        F.timestamp_millis(VERSION).alias("valid_from"),
        end.alias("valid_to"),
        (end == open_end()).cast("int").alias("is_current"),
    )
    return out if include_deleted else out.filter(F.col("cdc_deleted") == 0)


def _position(entity: Entity) -> list[str]:
    """Columns that order the records of one key and version."""
    return [SEQ, *[c for c in entity.columns if c not in (entity.key, VERSION)]]


def _next_start(records: DataFrame, entity: Entity) -> DataFrame:
    in_order = Window.partitionBy(entity.key).orderBy(VERSION, *_position(entity))
    return records.withColumn("_next", F.lead(VERSION).over(in_order))


def _next_start_sliced(records: DataFrame, entity: Entity, keys: int, cuts: DataFrame | None = None) -> DataFrame:
    """:func:`_next_start` for keys whose records do not fit one task.

    Only distinct (key, version) points are ordered, in slices of time. The last point of a slice
    takes the first one of the next slice. Records then look their point up; those tied on a point
    end where they start, except the last of them. Equal copies are counted into one row before that.
    """
    key = entity.key
    position = F.struct(*_position(entity))
    distinct = records.groupBy(*records.columns).agg(F.count(F.lit(1)).alias("_copies"))
    points = records.groupBy(key, VERSION).agg(F.max(position).alias("_last"))
    cuts = time_cuts(records, key, VERSION, keys) if cuts is None else cuts
    sliced = with_time_slices(points, key, VERSION, cuts)
    following = (
        sliced.groupBy(key, "_slice")
        .agg(F.min(VERSION).alias("_first"))
        .withColumn("_after", F.lead("_first").over(Window.partitionBy(key).orderBy("_slice")))
        .select(key, "_slice", "_after")
    )
    in_slice = Window.partitionBy(key, "_slice").orderBy(VERSION)
    resolved = (
        sliced.withColumn("_within", F.lead(VERSION).over(in_slice))
        .join(following, [key, "_slice"])
        .select(
            F.col(key).alias("_key"),
            F.col(VERSION).alias("_version"),
            "_last",
            F.coalesce("_within", "_after").alias("_point_next"),
        )
    )
    at_point = (F.col(key) == F.col("_key")) & F.col(VERSION).eqNullSafe(F.col("_version"))
    copies = distinct.join(resolved, at_point).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    )
    is_last = position.eqNullSafe(F.col("_last")) & (F.col("_copy") == F.col("_copies"))
    return copies.select(
        *entity.columns, SEQ, F.when(is_last, F.col("_point_next")).otherwise(F.col(VERSION)).alias("_next")
    )


def as_of(history: DataFrame, entity: Entity, at_ms: int, include_deleted: bool = True) -> DataFrame:
    """The version of each key in force at an instant.

    That is the latest one started by then: a filter that reaches the scan and one aggregate, without
    deriving the intervals of all versions.
    """
    started = history.filter(F.col(VERSION) <= F.lit(at_ms))
    found = latest(started, entity, entity.columns).withColumn(
        "valid_from", F.timestamp_millis(VERSION)
    )
    return found if include_deleted else found.filter(F.col("cdc_deleted") == 0)


def active_through(
    history: DataFrame, entity: Entity, start_ms: int, end_ms: int, carry: Sequence[str]
) -> DataFrame:
    """Keys that were active at some time in [start, end) and are active now.

    ``carry`` columns come from the current version.
    """
    start, end = F.timestamp_millis(F.lit(start_ms)), F.timestamp_millis(F.lit(end_ms))
    active = (F.col("is_active") == 1) & (F.col("cdc_deleted") == 0)
    overlaps = (F.col("valid_from") < end) & (F.col("valid_to") > start)
    nonempty = F.col("valid_from") < F.col("valid_to")
    now = F.col("is_current") == 1
    per_key = with_intervals(history, entity).groupBy(entity.key).agg(
        F.max((active & overlaps & nonempty).cast("int")).alias("_then"),
        F.max((active & now).cast("int")).alias("_now"),
        *[F.max(F.when(now, F.col(c))).alias(c) for c in carry],
    )
    return per_key.filter((F.col("_then") == 1) & (F.col("_now") == 1)).select(entity.key, *carry)


def op_counts(history: DataFrame, entity: Entity) -> DataFrame:
    """How often each key was read by a snapshot, created, updated and deleted."""
    return history.groupBy(F.col(entity.key).alias("key")).agg(
        *[F.count_if(F.col("cdc_op") == op).alias(f"n_{op}") for op in ("r", "c", "u", "d")]
    ).select(F.lit(entity.name).alias("entity"), "key", "n_r", "n_c", "n_u", "n_d")


def as_of_join(
    facts: DataFrame,
    versions: DataFrame,
    entity: Entity,
    at: str,
    columns: Sequence[str],
    hot: Sequence | None = None,
) -> DataFrame:
    """Each fact with the version of its ``entity.key`` in force at epoch-ms column ``at``.

    Left join: facts without a version (no key, unknown key, too early) get nulls. Facts and versions
    are merged into one time order per key and each fact takes the last version before it. Work grows
    with facts plus versions, never with their product. Versions without a time are never in force; of
    several with one time the last by ``seq``, then by ``columns``, is.
    """
    key = entity.key
    dim = F.struct(*columns)
    keyed = facts.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    versions = versions.filter(F.col(VERSION).isNotNull() & F.col(key).isNotNull())
    versions = versions.select(*dict.fromkeys([key, VERSION, SEQ, *columns]))
    no_dim = F.lit(None).cast(versions.select(dim.alias("d")).schema["d"].dataType)
    if hot is None:
        hot = hot_keys(keyed.select(key).unionByName(versions.select(key)), key)
    if hot:
        is_hot = F.col(key).isin(list(hot))
        matched = _last_before(
            keyed.filter(~is_hot), versions.filter(~is_hot), key, at, dim
        ).unionByName(
            _last_before_sliced(
                keyed.filter(is_hot), versions.filter(is_hot), key, at, dim, len(hot)
            )
        )
    else:
        matched = _last_before(keyed, versions, key, at, dim)
    unkeyed = facts.filter(F.col(key).isNull() | F.col(at).isNull()).withColumn("_dim", no_dim)
    return matched.unionByName(unkeyed).select(
        *facts.columns, *[F.col(f"_dim.{c}").alias(f"{entity.name}_{c}") for c in columns]
    )


def _last_before(facts: DataFrame, versions: DataFrame, key: str, at: str, dim) -> DataFrame:
    merged = versions.select(
        F.col(key).alias("_key"),
        F.col(VERSION).alias("_at"),
        F.lit(0).alias("_kind"),
        F.col(SEQ).alias("_seq"),
        dim.alias("_dim"),
    ).unionByName(
        facts.select(
            F.col(key).alias("_key"),
            F.col(at).alias("_at"),
            F.lit(1).alias("_kind"),
            F.struct(*facts.columns).alias("_fact"),
        ),
        allowMissingColumns=True,
    )
    so_far = (
        Window.partitionBy("_key")
        .orderBy("_at", "_kind", "_seq", "_dim")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        merged.withColumn("_found", F.last("_dim", ignorenulls=True).over(so_far))
        .filter(F.col("_kind") == 1)
        .select("_fact.*", F.col("_found").alias("_dim"))
    )


def _last_before_sliced(
    facts: DataFrame, versions: DataFrame, key: str, at: str, dim, keys: int
) -> DataFrame:
    """:func:`_last_before` for keys whose rows do not fit one task.

    Distinct instants of facts and versions are ordered in slices of time; a slice starts from the time of
    the last version before it. Facts look up the time of the version in force at their instant,
    and then that version.
    """
    last_at_instant = versions.groupBy(F.col(key).alias("_key"), F.col(VERSION).alias("_from")).agg(
        F.max(F.struct(F.col(SEQ), dim.alias("_dim"))).alias("_v")
    )
    last_at_instant = last_at_instant.select("_key", "_from", F.col("_v._dim").alias("_dim"))
    moments = facts.select(key, F.col(at).alias("_at"), F.lit(None).cast("bigint").alias("_from")).unionByName(
        versions.select(key, F.col(VERSION).alias("_at"), F.col(VERSION).alias("_from"))
    )
    points = moments.groupBy(key, "_at").agg(
        F.max("_from").alias("_from"), F.max(F.col("_from").isNull()).alias("_asked")
    )
    cuts = time_cuts(moments, key, "_at", keys)
    sliced = with_time_slices(points, key, "_at", cuts)
    up_to_here = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(key, "_slice")
        .agg(F.max("_from").alias("_latest"))
        .withColumn("_carry", F.max("_latest").over(up_to_here))
        .select(key, "_slice", "_carry")
    )
    so_far = (
        Window.partitionBy(key, "_slice")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answers = (
        sliced.withColumn("_within", F.max("_from").over(so_far))
        .filter("_asked")
        .join(carried, [key, "_slice"])
        .select(F.col(key).alias("_key"), "_at", F.coalesce("_within", "_carry").alias("_from"))
        .join(last_at_instant, ["_key", "_from"], "left")
    )
    found = (F.col(key) == F.col("_key")) & (F.col(at) == F.col("_at"))
    return facts.join(answers, found).select(*facts.columns, "_dim")
