"""Connected components of a graph held as rows, without bringing nodes or edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import landed


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (``a`` > ``b``)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    rest = large.join(least, "a").filter(F.col("b") != F.col("m"))
    small = rest.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _fingerprint(edges: DataFrame):
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    return edges.agg(F.count(F.lit(1)), F.sum(mark)).first()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that ``links`` (``a``, ``b``) touch, in any direction.

    Alternating large and small stars; each step combines rows before it shuffles and is written to
    shared storage. Nodes that are their component's smallest are included. Null ends and loops are left out.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = landed(edges, "edges"), None
    while (now := _fingerprint(edges)) != before:
        before = now
        if not now[0]:
            break
        edges = landed(_stars(edges), "edges")
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
