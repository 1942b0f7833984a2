"""Batch cycles on a timer, for sources without a change stream."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.batch import Tables, compact, run_cycle

log = logging.getLogger(__name__)


def start(
    spark: SparkSession,
    source: Callable[[], Tables],
    root: str,
    every: str = "60 seconds",
    inclusive: bool = True,
    compact_every: int = 60,
) -> StreamingQuery:
    """Run :func:`run_cycle` on a trigger. A cycle that fails is logged and tried again next time,
    from the same watermark. After every ``compact_every``-th cycle the stored ones are folded into a
    base, so that folders and reads stay bounded."""

    def tick(_: DataFrame, __: int) -> None:
        try:
            cycle = run_cycle(source(), root, inclusive)
            if cycle is not None and (cycle + 1) % compact_every == 0:
                compact(spark, root)
        except Exception:
            log.exception("batch cycle failed; the next trigger repeats it")

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        clock.writeStream.foreachBatch(tick)
        .option("checkpointLocation", f"{root}/_checkpoints/polling")
        .trigger(processingTime=every)
        .start()
    )
