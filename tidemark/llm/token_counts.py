"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches inside a task are balanced by bytes, and a batch's distinct chunks of text are encoded once. A
text longer than ``long_bytes`` is cut at safe boundaries (a space after another character, where no token can cross)
into pieces that are dealt out over all tasks, so one giant text does not hold up one task.

Null and empty texts have no tokens. Rows are told apart by their place in the input, so repeated ids stay separate rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, record_batch, schema, text_or_empty
from tidemark.llm.tokens import piece_counter

LONG_BYTES = 4 << 20
COUNTED = schema("row_id long, id long, n_bytes long, n_tokens long")
PIECES = schema("row_id long, id long, n_bytes long, piece string, begins boolean")


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in byte_batches(batches, "text"):
            n = counter.count_column(batch.column("text"))
            yield record_batch(COUNTED, [batch.column("row_id"), batch.column("id"), batch.column("n_bytes"), n])

    return run


def cut_at_spaces(text: str, size: int) -> list[str]:
    """Pieces of at least ``size`` characters; each next one begins at a space after another character."""
    pieces, begin = [], 0
    border = re.compile("(?<=[^ ]) (?= *[^ ])")
    while found := border.search(text, begin + size):
        pieces.append(text[begin : found.start()])
        begin = found.start()
    return [*pieces, text[begin:]]


def _cut(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        safe = piece_counter(path).safe
        for batch in byte_batches(batches, "text"):
            for row in batch.to_pylist():
                pieces = cut_at_spaces(row["text"], size) if safe else [row["text"]]
                for i, piece in enumerate(pieces):
                    # The model puts a space before every piece, so a later piece goes without its own.
                    text = piece[1:] if i else piece
                    yield record_batch(PIECES, [[row["row_id"]], [row["id"]], [row["n_bytes"]], [text], [i == 0]])

    return run


def _count_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in byte_batches(batches, "piece"):
            n = counter.count_column(batch.column("piece"))
            yield record_batch(COUNTED, [batch.column("row_id"), batch.column("id"), batch.column("n_bytes"), n])

    return run


def count_tokens(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES
) -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).cast("long").alias("id"),
        text_or_empty(text_col).alias("text"),
    ).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = rows.filter(F.col("n_bytes") <= long_bytes).mapInArrow(_count(model_path), COUNTED)
    pieces = rows.filter(F.col("n_bytes") > long_bytes).mapInArrow(_cut(model_path, long_bytes // 4), PIECES)
    dealt = pieces.repartition(F.xxhash64("row_id", "piece"))
    long = (
        dealt.mapInArrow(_count_pieces(model_path), COUNTED)
        .groupBy("row_id")
        .agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    )
    return short.unionByName(long).select("id", "n_bytes", "n_tokens")


def total_tokens(counts: DataFrame) -> int:
    return int(np.int64(counts.agg(F.sum("n_tokens")).first()[0] or 0))
