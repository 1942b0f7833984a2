"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of about equal bytes. Weights are whole shares; with ``Q`` shares in all, block ``j``
of a source with ``e`` shares may not run before slot ``floor(j * Q / e)`` and must run before ``ceil((j + 1) * Q / e)``.
Earliest deadline first meets every such window, so at any slot each source is less than one block from its target.
The schedule repeats after ``Q`` slots, so only one period is worked out; every block's slot follows from it by
arithmetic. When a source has no blocks left a new phase begins, in which the others share its part by their own shares.

Sources given shares and those with a fair part of all bytes (with ``MAX_SOURCES`` 1,000 and no shares, one in 500) are scheduled
as they are; the others are put into as many classes by hash, each of which is scheduled like a source and holds its sources in
proportion to their sizes. The rule is the same for every input: what counts is a source's part of the bytes, not how many there are.

Every document is kept exactly once. A null source is a source of its own; a source without a share gets one share. Documents
of a source are ordered by a hash of id and text, ties by their place in the input. No documents: no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import landed, text_or_empty, unused

BLOCK_BYTES = 64 << 10
BLOCK_OVERHEAD = 1  # bytes each document counts beside its text, so that empty ones fill blocks too
BUCKET_ROWS = 4_000  # rows of a source numbered by one task
MAX_SOURCES = 1_000  # sources and classes of sources; rows brought to the driver
MAX_SCHEDULE = 1_000_000  # slots of all phases, which are broadcast


def pfair_period(shares: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of ``sum(shares)`` slots, earliest deadline first."""
    total = sum(shares.values())
    slots: dict[str, list[int]] = {s: [] for s in shares}
    waiting = [(0, s) for s in sorted(shares)]  # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str]] = []  # by deadline, then larger shares first
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // shares[s]), -shares[s], s))
        deadline, _, s = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        slots[s].append(slot)
        if len(slots[s]) < shares[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // shares[s], s))
    return slots


@dataclass(frozen=True)
class Phase:
    first_slot: int
    first_block: dict[str, int]  # of each source still running
    period: int
    slots: dict[str, list[int]]


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[Phase]:
    """The phases of a mixture in which source ``s`` has ``blocks[s]`` blocks."""
    done, left, slot, out = dict.fromkeys(blocks, 0), {s: n for s, n in blocks.items() if n}, 0, []
    while left:
        own = {s: shares[s] for s in left}
        period, slots = sum(own.values()), pfair_period(own)
        out.append(Phase(slot, {s: done[s] for s in left}, period, slots))
        last = {s: (n - 1) // own[s] * period + slots[s][(n - 1) % own[s]] for s, n in left.items()}
        length = min(last.values()) + 1
        for s in list(left):
            full, rest = divmod(length, period)
            ran = full * own[s] + sum(1 for x in slots[s] if x < rest)
            done[s] += ran
            left[s] -= ran
            if not left[s]:
                del left[s]
        slot += length
    return out


def root_shares(blocks: dict[str, int], total: int = 1_000) -> dict[str, int]:
    """Shares in proportion to the square root of a source's size, one at least: small sources weigh more than their size."""
    roots = {s: n**0.5 for s, n in blocks.items()}
    whole = sum(roots.values()) or 1
    return {s: max(1, round(total * r / whole)) for s, r in roots.items()}


def mix(
    docs: DataFrame,
    shares: dict[str, int] | None = None,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``mix_block`` (number in its source), ``mix_slot`` and ``mix_byte`` (place in its source).

    Ordered by ``mix_slot, mix_byte`` the documents are mixed to weight. Without ``shares`` those of ``root_shares`` hold.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    docs = docs.drop("mix_block", "mix_slot", "mix_byte")
    names = unused(docs, "_source", "_bytes", "_order", "_buckets", "_bucket", "_start", "_own")
    source, size, order, buckets, bucket, start, own = names
    rows = docs.select(
        "*",
        F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias(source),
        (F.octet_length(text) + BLOCK_OVERHEAD).cast("long").alias(size),
        F.xxhash64(id_col, text).alias(order),
    )
    narrow = landed(rows.select(source, size, order), "mix")
    sizes = narrow.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    sizes = landed(sizes, "sources")
    label = _classed(sizes, source, shares)
    rows, narrow = rows.withColumn(source, label), narrow.withColumn(source, label)
    sizes = sizes.withColumn(source, label).groupBy(source).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    found = sizes.collect()  # at most ``MAX_SOURCES``
    if not found:
        return docs.withColumns({c: F.lit(0).cast("long") for c in ("mix_block", "mix_slot", "mix_byte")})
    counts = [(r[source], -(-r["n"] // BUCKET_ROWS)) for r in found]
    per_source = F.broadcast(spark.createDataFrame(counts, f"{source} string, {buckets} long"))  # a row per source
    in_bucket = F.expr(f"(shiftrightunsigned({order}, 33) * {buckets}) div 2147483648").alias(bucket)

    # Bytes of a source before each bucket, then before each document of the bucket.
    sums = narrow.join(per_source, source).groupBy(source, in_bucket).agg(F.sum(size).alias("sum"))
    before = Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(source, bucket, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(source, bucket).orderBy(order, F.col(id_col).asc_nulls_first())
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.join(per_source, source)
        .select("*", in_bucket)
        .withColumn(own, F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(landed(starts, "mix"), [source, bucket])
        .withColumn("mix_byte", F.col(start) + F.col(own))
        .withColumn("mix_block", F.expr(f"mix_byte div {block_bytes}"))
    )
    blocks = {r[source]: (r["bytes"] - 1) // block_bytes + 1 for r in found}
    plan = schedule_table(spark, blocks, shares or root_shares(blocks))
    first = F.col("plan.first_block")
    at = F.col("mix_block") - first
    period = F.floor(at / F.size("plan.slots"))
    place = F.element_at("plan.slots", (at % F.size("plan.slots") + 1).cast("int"))
    slot = F.col("plan.first_slot") + period * F.col("plan.period") + place
    here = (F.col("plan.for_source") == F.col(source)) & (at >= 0) & (F.col("mix_block") < F.col("plan.end_block"))
    return (
        placed.join(F.broadcast(plan).alias("plan"), here, "left")
        .withColumn("mix_slot", slot)
        .select(*docs.columns, "mix_block", "mix_slot", "mix_byte")
    )


def _classed(sizes: DataFrame, source: str, shares: dict[str, int] | None) -> Column:
    """The source itself where it has a share or a fair part of all bytes, for the others the name of a class."""
    half = MAX_SOURCES // 2
    if shares and len(shares) > half:
        raise ValueError(f"{half} sources at most can have shares of their own")
    own = list(shares or {})
    if places := half - len(own):  # as many sources at most can have this part
        total = sizes.agg(F.sum("bytes")).first()[0] or 0
        large = sizes.filter(F.col("bytes") * places >= F.lit(total).cast("long"))
        own += [r[source] for r in large.select(source).collect() if r[source] not in (shares or {})]
    part = F.pmod(F.xxhash64(source), F.lit(half)).cast("string")
    return F.when(F.col(source).isin(own), F.col(source)).otherwise(F.concat(F.lit("\0class "), part))


def schedule_table(spark, blocks: dict[str, int], shares: dict[str, int]) -> DataFrame:
    """A row per source and phase: which blocks run in it, and their slots in one period."""
    shares = {s: int(shares.get(s, 1)) for s in blocks}
    if min(shares.values()) < 1 or len(blocks) * sum(shares.values()) > MAX_SCHEDULE:
        raise ValueError(f"shares must be 1 or more, and sources times all shares {MAX_SCHEDULE} at most")
    plan = phases(blocks, shares)
    rows = []
    for phase, after in zip(plan, [*plan[1:], None], strict=True):
        for s, first in phase.first_block.items():
            end = after.first_block.get(s, blocks[s]) if after else blocks[s]
            rows.append((s, first, end, phase.first_slot, phase.period, phase.slots[s]))
    kind = "for_source string, first_block long, end_block long, first_slot long, period long, slots array<int>"
    return spark.createDataFrame(rows, kind)


def in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of ``mix`` in their order, over all partitions."""
    dealt = mixed.repartitionByRange("mix_slot", "mix_byte").sortWithinPartitions("mix_slot", "mix_byte")
    return dealt.select(*columns)
