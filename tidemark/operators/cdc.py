"""From change messages to typed change records.

Messages are rows (topic, offset, value): ``value`` is one JSON object, ``offset`` orders the messages
of a key. Both the Kafka and the file source produce them (``tidemark.sources.changes``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.entities import SEQ, VERSION, Entity

_MALFORMED = "_malformed"


def _of_topic(messages: DataFrame, entity: Entity, prefix: str) -> DataFrame:
    # A message without a value is a tombstone and says nothing the delete before it did not say.
    return messages.filter((F.col("topic") == entity.topic(prefix)) & F.col("value").isNotNull())


def _tolerant(schema: T.StructType) -> list[T.StructField]:
    # A flag may arrive as a JSON boolean or as the text "true"; text covers both.
    text = T.StringType()
    return [T.StructField(f.name, text) if f.dataType == T.BooleanType() else f for f in schema]


def envelope_schema(entity: Entity) -> T.StructType:
    """A message before unwrapping: the row before and after the change, and where it came from."""
    image = T.StructType(_tolerant(entity.row_image))
    return T.StructType(
        [
            T.StructField("before", image),
            T.StructField("after", image),
            T.StructField("op", T.StringType()),
            T.StructField("source", T.StructType([T.StructField("ts_ms", T.LongType())])),
            T.StructField("ts_ms", T.LongType()),
        ]
    )


def parse(
    messages: DataFrame, entity: Entity, prefix: str = "operations", envelope: bool = False
) -> DataFrame:
    """Each message of an entity with its fields and ``bad``: not JSON, wrong types, or no key.

    Messages are flat records, or with ``envelope`` still carry the rows before and after the change.
    The parsed value goes through ``inline`` because a filter is not pushed below a generator: pushed
    further down it would parse every message again.
    """
    fields = list(envelope_schema(entity)) if envelope else _tolerant(entity.wire_schema)
    with_bad = T.StructType([*fields, T.StructField(_MALFORMED, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED}
    parsed = _of_topic(messages, entity, prefix).select(
        "topic", "offset", "value", F.inline(F.array(F.from_json("value", with_bad, options)))
    )
    flat = _unwrapped(parsed, entity) if envelope else parsed
    return flat.withColumn("bad", F.col(_MALFORMED).isNotNull() | F.col(entity.key).isNull())


def _unwrapped(parsed: DataFrame, entity: Entity) -> DataFrame:
    """The new row of each change; a delete becomes a flagged record with the last known row."""
    is_delete = F.col("op") == "d"
    flat = parsed.select(
        "topic",
        "offset",
        "value",
        F.when(is_delete, F.col("before")).otherwise(F.col("after")).alias("row"),
        F.when(is_delete, "true").otherwise("false").alias("__deleted"),
        F.col("op").alias("cdc_op"),
        F.col("source.ts_ms").alias(VERSION),
        _MALFORMED,
    ).select("*", "row.*")
    return flat.drop("row").withColumnsRenamed({"__deleted": "cdc_deleted", **entity.renames})


def good_records(parsed: DataFrame, entity: Entity) -> DataFrame:
    """Flat change records in wire types, with the offset as ``seq``."""
    return parsed.filter(~F.col("bad")).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in entity.wire_schema],
        F.col("offset").cast("bigint").alias(SEQ),
    )


def decode(
    messages: DataFrame, entity: Entity, prefix: str = "operations", envelope: bool = False
) -> DataFrame:
    """The change records of one entity; :func:`quarantine` has what is left out."""
    return good_records(parse(messages, entity, prefix, envelope), entity)


def unwrap(messages: DataFrame, entity: Entity, prefix: str = "operations") -> DataFrame:
    """The change records of one entity from messages in envelopes."""
    return decode(messages, entity, prefix, envelope=True)


def quarantine(
    messages: DataFrame, entity: Entity, prefix: str = "operations", envelope: bool = False
) -> DataFrame:
    """The messages :func:`decode` leaves out."""
    parsed = parse(messages, entity, prefix, envelope)
    return parsed.filter("bad").select("topic", "offset", "value")


def stage(records: DataFrame, entity: Entity) -> DataFrame:
    """Stored types and defaults. The only place where a record is transformed."""
    return records.select(*[a.staged() for a in entity.attributes], SEQ)


def snapshot_union(rows: DataFrame, changes: DataFrame, entity: Entity, taken_at_ms: int) -> DataFrame:
    """The initial snapshot of a table, read as ``r`` records, followed by its change records.

    A snapshot read precedes every logged change, so its position is below all offsets.
    """
    reads = rows.select(
        *[f.name for f in entity.row_image if f.name not in entity.renames],
        *[F.col(old).alias(new) for old, new in entity.renames.items()],
        F.lit(False).alias("cdc_deleted"),
        F.lit("r").alias("cdc_op"),
        F.lit(taken_at_ms).cast("bigint").alias(VERSION),
        F.lit(-1).cast("bigint").alias(SEQ),
    )
    return reads.select(*entity.columns, SEQ).unionByName(changes.select(*entity.columns, SEQ))
