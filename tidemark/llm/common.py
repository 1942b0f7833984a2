"""What several operators share: tables, landed results, byte-bounded batches, dense numbering."""

from __future__ import annotations

import itertools
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import scratch_folder
from tidemark.sources.tables import drop_folder

BATCH_BYTES = 2 << 20  # text handled at once inside a task; some operators need fifty times as much memory


@lru_cache(maxsize=1)
def _package_archive() -> str:
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "tidemark").rglob("*.py")):
            out.write(file, str(file.relative_to(root)))
    return str(archive)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers run parts of it, unless it was sent before."""
    context = spark.sparkContext
    if not any(f.endswith("tidemark_code.zip") for f in context.listFiles):
        context.addPyFile(_package_archive())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: later steps survive lost executors."""
    folder = scratch_folder(df.sparkSession, purpose)
    out = df.write.option("compression", "zstd")
    out.partitionBy(*partition_by).parquet(folder) if partition_by else out.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.landed_in = folder
    return out


def discard(df: DataFrame) -> None:
    """Delete a ``landed`` table once nothing that is still to run reads it."""
    drop_folder(df.sparkSession, df.landed_in)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def byte_batches(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        texts = batch.column(column)
        if batch.num_rows == 0:
            continue
        width = np.diff(np.frombuffer(texts.buffers()[1], dtype=_offset_type(texts))[texts.offset :][: len(texts) + 1])
        part = np.cumsum(width.astype(np.int64)) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        starts = [0, *edges.tolist()]
        for start, end in zip(starts, [*edges.tolist(), batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def key_runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The groups of rows with equal ``keys`` (whole numbers), which must arrive one group after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edge = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            edge |= c[1:] != c[:-1]
        borders = [0, *(np.flatnonzero(edge) + 1).tolist(), batch.num_rows]
        for start, end in itertools.pairwise(borders):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _offset_type(texts: pa.Array):
    return np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32


def strings(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def record_batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """An Arrow batch with the types of ``schema`` from numpy arrays, lists or Arrow arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    arrays = [
        c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type)
        for c, f in zip(columns, target, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=target)


KINDS = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "array<int>": T.ArrayType(T.IntegerType()),
    "array<long>": T.ArrayType(T.LongType()),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def schema(text: str) -> T.StructType:
    """A schema from ``name kind, ...``; unlike Spark's parser it needs no session."""
    return T.StructType([T.StructField(*f.split()[:1], KINDS[f.split()[1]]) for f in text.split(",")])


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def as_stored(docs: DataFrame, place: str) -> DataFrame:
    """``docs``, read from Parquet files, with the rows' places in the order they were written in, from 0 without gaps.

    Spark numbers part files by partition, so what was sorted over all partitions keeps its order.
    """
    path, row, number, before = unused(docs, "_path", "_row", "_number", "_before")
    rows = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    files = rows.groupBy(path).agg(F.count(F.lit(1)).alias(number))
    part = F.regexp_extract(F.element_at(F.split(F.col(path), "/"), -1), r"part-(\d+)", 1).cast("long")
    earlier = Window.orderBy(part, path).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(path, F.coalesce(F.sum(number).over(earlier), F.lit(0)).alias(before))
    # A row per file, and files are listed on the driver anyway.
    return rows.join(F.broadcast(starts), path).withColumn(place, F.col(before) + F.col(row)).drop(path, row, before)
