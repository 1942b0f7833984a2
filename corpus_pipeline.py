"""From raw documents to packed training sequences, in five stages.

Toxic documents go, of exact copies one stays, of each group of near copies one stays, the rest is put in an order that
mixes the sources to weight, and is packed into sequences of at most 2048 tokens. Each stage's result is written as
Parquet on shared storage and read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tidemark.llm.common import as_stored, ship_code, table, unused
from tidemark.session import scratch_folder

TOXIC_FROM = 0.5
STRETCH = 1_000  # documents, in mixed order, that are packed together


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below ``TOXIC_FROM``; learnt from the labelled ones among them."""
    ship_code(spark)
    (score,) = unused(docs, "toxicity")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, score_col=score)
    return scored.filter(F.col(score) < TOXIC_FROM).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word 5-grams, Jaccard of 0.8 or more."""
    ship_code(spark)
    return ngram_join.drop_similar(docs, ngram_join.Similarity(n=5, percent=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which sources come by the square root of their size."""
    return mixing.in_order(mixing.mix(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences that follow the order the documents were stored in: ascending ``sequence_id`` keeps the mixture."""
    ship_code(spark)
    (place,) = unused(docs, "place")
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.token_pieces(as_stored(docs, place), path, end_id=0, capacity=2048, place_col=place)
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    in_order = packing.pack(pieces, 2048, per_partition=STRETCH, in_order=True)
    return in_order.select(F.col("id").alias("doc_id"), *columns)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

# A fitted model and a packing heuristic have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
