"""Keys that hold too many rows for one task, and a way to cut their rows into time slices.

Aggregates need none of this: Spark combines rows before the shuffle. Joins are split at run time by
adaptive execution. What is left is the ordered window, which puts all rows of a key into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED_KEYS = 16_384  # least size of the sketch, which has 16 places per shuffle partition
MOST_TRACKED = 1_000_000  # what Spark allows
MERGE_GROUPS = 1_000  # sketches are merged in this many groups first
MIN_HOT_ROWS = 1_000_000  # a task sorts this many rows with ease
MAX_CUTS = 100_000  # over all hot keys; bounds what is broadcast about their slices


def key_sketches(df: DataFrame, key: str, tracked: int, groups: int) -> DataFrame:
    """``sketch, rows``: mergeable sketches of how often keys occur, some per ``groups`` sets of map tasks."""
    part = F.pmod(F.spark_partition_id(), F.lit(groups)).alias("_part")
    sketches = df.groupBy(part).agg(
        F.expr(f"approx_top_k_accumulate(`{key}`, {tracked})").alias("sketch"),
        F.count(F.lit(1)).alias("rows"),
    )
    return sketches.select("sketch", "rows")


def top_keys(sketches: DataFrame, tracked: int, most: int) -> tuple[list[tuple], int]:
    """The most frequent keys with their counts, at most ``most``, and the number of all rows."""
    merged = f"approx_top_k_combine(sketch, {tracked})"
    # One group rather than none: combining fails on a task without sketches, which a grouped aggregate never makes.
    found = (
        sketches.groupBy((F.col("rows") * 0).alias("_all"))
        .agg(F.expr(f"approx_top_k_estimate({merged}, {most})").alias("top"), F.sum("rows").alias("total"))
        .first()
    )
    if found is None:
        return [], 0
    return [(t["item"], t["count"]) for t in found["top"] or [] if t["item"] is not None], found["total"]


def too_large(top: list[tuple], total: int, tasks: int, min_rows: int | None = None) -> list:
    """Those of the most frequent keys that hold more rows than an average shuffle partition."""
    limit = max(MIN_HOT_ROWS if min_rows is None else min_rows, total / tasks)
    return [key for key, count in top if count > limit]


def hot_keys(df: DataFrame, key: str, min_rows: int | None = None) -> list:
    """Keys holding more rows than an average shuffle partition, largest first.

    No more keys than there are partitions can do so, and that many are asked for. Mergeable sketches find
    them in one scan of the key column: one per map task, merged in groups and then all together. The answer only
    steers how rows are spread over tasks; results are the same whatever it says.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(MOST_TRACKED, max(TRACKED_KEYS, 16 * tasks))
    sketches = key_sketches(df, key, tracked, max(1, min(MERGE_GROUPS, tasks // 4)))
    top, total = top_keys(sketches, tracked, min(tasks, tracked))
    return too_large(top, total, tasks, min_rows)


def time_cuts(rows: DataFrame, key: str, order: str, keys: int) -> DataFrame:
    """Per key the values of ``order`` that part its rows into slices of about equal size.

    ``rows`` holds only the rows of ``keys`` hot keys. At most ``MAX_CUTS`` numbers come to the driver.
    They are fixed there because a quantile sketch may answer differently each time it is evaluated,
    and every part of a plan has to cut at the same places.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if 2 * keys > MAX_CUTS:
        raise ValueError(f"{keys} keys are too many to cut; at most {MAX_CUTS // 2}")
    parts = max(2, min(tasks, MAX_CUTS // max(1, keys)))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = rows.groupBy(key).agg(F.percentile_approx(order, shares).alias("_cuts"))
    return spark.createDataFrame(found.collect(), found.schema)


def with_time_slices(points: DataFrame, key: str, order: str, cuts: DataFrame) -> DataFrame:
    """Add ``_slice``, the number of the key's ``cuts`` below ``order``. Equal values stay together."""
    below = F.size(F.filter("_cuts", lambda cut: cut < F.col(order)))
    return points.join(F.broadcast(cuts), key).withColumn("_slice", below).drop("_cuts")
