"""Exact duplicates with the frequent digests split off.

Texts are equal when identical after each run of ASCII white space becomes one space; equality is decided by
SHA-256 of the normalised text. A Misra-Gries style sketch of the digests (merged in two levels, so
no task merges all of it) proposes the frequent ones; their exact counts and winners are then taken from all rows, and
only proven frequent digests are broadcast, at most ``TRACKED`` of them. Their rows are decided where they lie. The
remaining digests have few rows each and are shuffled as usual.

Null text counts as empty, so nulls and empty texts are one group. A null id sorts first. Of rows that repeat one id and
text exactly one is kept. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import landed, tasks, text_or_empty, unused

TRACKED = 4096  # digests the sketch follows; any with more than about 1/1000 of the rows is among them
TOP = 1000  # digests taken from the sketch; bounds what is broadcast
MERGE_GROUPS = 64


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space. A single space is left alone, which spares most of the work."""
    return F.regexp_replace(text, r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def digest_of(text_col: str) -> Column:
    return F.sha2(normalised(text_or_empty(text_col)), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id``, ``id`` and ``digest`` of every row."""
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("id"),
        digest_of(text_col).alias("digest"),
    )


def frequent(rows: DataFrame, column: str = "digest") -> DataFrame:
    """Values that may hold a large share of the rows, at most ``TOP``, from one scan."""
    groups = min(MERGE_GROUPS, max(1, tasks(rows.sparkSession) // 4))
    part = F.pmod(F.spark_partition_id(), F.lit(groups)).alias("_part")
    sketches = rows.groupBy(part).agg(F.expr(f"approx_top_k_accumulate({column}, {TRACKED})").alias("sketch"))
    # One group rather than none: combining fails on a task without sketches, which a grouped aggregate never makes.
    merged = sketches.groupBy((F.col("_part") * 0).alias("all"))
    merged = merged.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {TOP})").alias("top"))
    return merged.select(F.explode("top.item").alias(column))


def winners(rows: DataFrame, key: str = "digest") -> DataFrame:
    """Per value of ``key``: the row that stays and the number of rows. Rows are combined before the shuffle."""
    first = F.min(F.struct("id", "row_id"))
    return rows.groupBy(key).agg(first.alias("keep"), F.count(F.lit(1)).alias("group_size"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tasks_for_hot: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    rows = landed(digests(docs, id_col, text_col), "digests")
    total = rows.count()
    limit = max(2, total // (tasks_for_hot or TOP))
    proposed = frequent(rows)
    # Proven: counted over all rows, and above the limit, so there are at most ``total / limit``.
    hot = landed(winners(rows.join(F.broadcast(proposed), "digest", "left_semi")).filter(F.col("group_size") >= limit), "hot")
    in_place = rows.join(F.broadcast(hot), "digest").select(
        "id",
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    others = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    # Counted by a combined aggregate and joined from a written table, so that adaptive execution can split what is still large.
    several = landed(winners(others).filter("group_size > 1"), "several")
    shuffled = others.join(several, "digest", "left").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("keep.row_id"), F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return in_place.unionByName(shuffled)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts that of the smallest id."""
    row, kept_row = unused(docs, "_row", "_kept_row")
    numbered = landed(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(row).alias("row_id"), F.col(id_col).alias("id"), digest_of(text_col).alias("digest"))
    rows = landed(rows, "digests")
    limit = max(2, rows.count() // TOP)
    hot = winners(rows.join(F.broadcast(frequent(rows)), "digest", "left_semi")).filter(F.col("group_size") >= limit)
    hot = landed(hot.select("digest", F.col("keep.row_id").alias(kept_row)), "hot")
    others = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    several = landed(winners(others).filter("group_size > 1").select("digest", F.col("keep.row_id").alias(kept_row)), "several")
    found = rows.join(F.broadcast(hot), "digest").unionByName(others.join(several, "digest"))
    gone = landed(found.filter(F.col("row_id") != F.col(kept_row)).select(F.col("row_id").alias(row)), "gone")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
