"""Ids as ranges a source can prune by: a semi join on ids sends none of them to the files or the database it reads from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Of one key. A filter with as many alternatives is still pushed to files and databases, and the method Spark generates for it
# stays below the 8,000 bytes above which the JVM leaves a method interpreted (150 to 220 bytes a range; 64 ran to 10,100 to 14,800).
RANGES = 16
STRETCHES = 1_024  # of one key's ids, among which the gaps are looked for

Range = tuple[int, int]


def id_ranges(rows: DataFrame, keys: list[str], most: int = RANGES) -> dict[str, list[Range]]:
    """Per key up to ``most`` ranges that hold all its values, apart by the widest gaps between these; none for no values.

    A gap that is narrower than a stretch, a thousandth of the ids, would save no reading: dense ids are one range.
    Two jobs, whose results are a row and at most ``STRETCHES`` rows per key.
    """
    ends = [f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]
    found = rows.agg(*ends).first()
    low = {k: found[f"min_{k}"] for k in keys}
    wide = {k: (found[f"max_{k}"] - low[k]) // STRETCHES + 1 for k in keys if low[k] is not None}
    if not wide:
        return {k: [] for k in keys}
    parts = [
        F.struct(F.lit(k).alias("key"), F.col(k).cast("bigint").alias("id"), ((F.col(k) - low[k]) / wide[k]).cast("bigint").alias("part"))
        for k in wide
    ]
    ids = rows.select(F.explode(F.array(*parts)).alias("x")).select("x.*").filter("id IS NOT NULL")
    spans = ids.groupBy("key", "part").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    return {k: joined(sorted((r["lo"], r["hi"]) for r in spans if r["key"] == k), most, wide.get(k, 1)) for k in keys}


def joined(ranges: list[Range], most: int, narrow: int = 1) -> list[Range]:
    """Ascending ``ranges`` in at most ``most``, apart by the widest gaps, of those that step over more than ``narrow``."""
    steps = [(after[0] - before[1], i) for i, (before, after) in enumerate(zip(ranges, ranges[1:]), 1)]
    widest = sorted((s for s in steps if s[0] > narrow), reverse=True)[: most - 1]
    cuts = [0, *sorted(i for _, i in widest), len(ranges)]
    return [(ranges[a][0], ranges[b - 1][1]) for a, b in zip(cuts, cuts[1:]) if a < b]


def within(rows: DataFrame, key: str, ranges: list[Range]) -> DataFrame:
    """Rows whose ``key`` lies in one of the ranges, as a filter that reaches the source."""
    inside = [(F.col(key) >= lo) & (F.col(key) <= hi) for lo, hi in ranges]
    return rows.filter(reduce(lambda a, b: a | b, inside) if inside else F.lit(False))


def predicates(key: str, ranges: list[Range]) -> list[str]:
    """The ranges as conditions in SQL, for a JDBC read with a partition for each."""
    return [f"{key} >= {lo} AND {key} <= {hi}" for lo, hi in ranges]
