"""Stored statistics of keys, so that a plan can be made without a look at the data.

Upkeep adds a sketch of the batches since the last time; sketches merge. From all of them follow the most frequent keys and, for those that
could be too large for a task, the times at which to cut their records. That is a small file which the planner reads
by itself. It only steers how rows are spread over tasks, so it may lag behind what was written since.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.entities import SEQ, VERSION, Entity
from tidemark.functions.skew import MAX_CUTS, MIN_HOT_ROWS, key_sketches, time_cuts, too_large, top_keys
from tidemark.sources.tables import committed, drop_batches, read_all, read_batches, read_text, write_batch, write_text

TRACKED = 16_384
MOST = 1_000  # keys that are remembered; a key beyond them holds less than a thousandth of all rows
GROUPS = 16


def _table(entity: Entity) -> str:
    return f"statistics/{entity.name}"


def update(spark: SparkSession, root: str, entity: Entity, min_rows: int | None = None) -> None:
    """Take in the history batches since the last time. Keys of ``min_rows`` (a million) or more get cuts."""
    history, table = f"history/{entity.name}", _table(entity)
    seen = committed(spark, root, table)
    reached = seen[-1] if seen else None
    done = committed(spark, root, history)
    if not done or (reached is not None and done[-1] <= reached):
        return
    rows = read_batches(spark, root, history, entity.history_schema, after=reached)
    sketches = key_sketches(rows, entity.key, TRACKED, GROUPS)
    if reached is not None:
        # Merged into one row, so that the stored sketches stay as few as one upkeep makes.
        stored = spark.read.parquet(f"{root}/{table}/batch_id={reached}")
        merged = f"approx_top_k_combine(sketch, {TRACKED})"
        stored = stored.groupBy((F.col("rows") * 0).alias("_all")).agg(F.expr(merged).alias("sketch"), F.sum("rows").alias("rows"))
        sketches = sketches.unionByName(stored.select("sketch", "rows"))
    write_batch(sketches, root, table, done[-1])
    top, total = top_keys(spark.read.parquet(f"{root}/{table}/batch_id={done[-1]}"), TRACKED, MOST)
    floor = MIN_HOT_ROWS if min_rows is None else min_rows
    large = [k for k, n in top if n > floor]
    cuts = {}
    if large:
        all_rows = _records(spark, root, entity).filter(F.col(entity.key).isin(large))
        parts = time_cuts(all_rows, entity.key, VERSION, len(large)).collect()  # at most MAX_CUTS numbers
        cuts = {r[entity.key]: r["_cuts"] for r in parts}
    found = {"total": total, "top": [[k, n, cuts.get(k)] for k, n in top]}
    write_text(spark, f"{root}/{table}/top.json", json.dumps(found))
    drop_batches(spark, root, table, before=done[-1])


def _records(spark: SparkSession, root: str, entity: Entity) -> DataFrame:
    return read_all(spark, root, f"history/{entity.name}", entity.history_schema, entity.columns, SEQ, entity.key)


def hot_keys(
    spark: SparkSession, root: str, entity: Entity, min_rows: int | None = None
) -> tuple[list, DataFrame | None]:
    """Keys too large for one task, as far as upkeep has seen, and where to cut them. Starts no job."""
    text = read_text(spark, f"{root}/{_table(entity)}/top.json")
    if text is None:
        return [], None
    found = json.loads(text)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = {k: c for k, _, c in found["top"] if c}
    hot = [k for k in too_large([(k, n) for k, n, _ in found["top"]], found["total"], tasks, min_rows) if k in cuts]
    if not hot:
        return [], None
    kind = T.StructType([T.StructField(entity.key, T.LongType()), T.StructField("_cuts", T.ArrayType(T.LongType()))])
    per_key = max(1, MAX_CUTS // len(hot))
    return hot, spark.createDataFrame([(k, cuts[k][:: -(-len(cuts[k]) // per_key)]) for k in hot], kind)
