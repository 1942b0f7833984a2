"""Tables on shared storage: one folder per batch, rolled up or compacted now and then.

A batch that is written again replaces its own folder, so a replayed batch adds nothing. A folder
counts once its ``_SUCCESS`` marker is there; readers ask for committed batches only.

Rolling up turns the small files of many batches into few large ones and keeps every row once.

A large batch is computed in slices of its key, one after the other, so that what they shuffle is not on disk at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shuffles_dropped

BATCH = "batch_id"
ROLLED = "from_batch"  # the batch id of a row that was rolled up
MARK = "_mark"  # a fingerprint of what makes a rolled-up row the same as another
SLICE_BYTES = 32 << 20  # of files that are shuffled at once; shuffled they take three to four times as much
MOST_SLICES = 8  # each slice reads the files again
MARKER = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def schema_of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# --- batches ---------------------------------------------------------------------------------------


def batch_path(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/{BATCH}={batch_id}"


def write_batch(
    df: DataFrame,
    root: str,
    table: str,
    batch_id: int,
    sort: Sequence[str] = (),
    schema: T.StructType | None = None,
) -> None:
    """Write one batch, in ``schema`` where one is declared: other columns or types are an error.

    Sorting inside each file narrows its row-group statistics, without a shuffle.
    """
    write_parts([df], root, table, batch_id, sort, schema)


def write_parts(
    parts: Sequence[DataFrame],
    root: str,
    table: str,
    batch_id: int,
    sort: Sequence[str] = (),
    schema: T.StructType | None = None,
) -> None:
    """Write one batch as :func:`write_batch` does, part by part; the marker comes with the last one."""
    with shuffles_dropped(parts[0].sparkSession):
        for n, df in enumerate(parts):
            out = df if schema is None else df.to(schema)
            out = out.sortWithinPartitions(*sort) if sort else out
            out = out.write.mode("append" if n else "overwrite").option("compression", "zstd")
            out.option(MARKER, str(n == len(parts) - 1).lower()).parquet(batch_path(root, table, batch_id))


def slices_for(size: int) -> int:
    """In how many slices to shuffle what takes ``size`` bytes in files."""
    return min(MOST_SLICES, max(1, -(-size // SLICE_BYTES)))


def slices(key: str, number: int) -> list[Column]:
    """Conditions that each take a slice of the keys; together they take every row, those without a key too."""
    if number == 1:
        return [F.lit(True)]
    return [F.pmod(F.xxhash64(key), F.lit(number)) == n for n in range(number)]


def _markers(spark: SparkSession, pattern: str) -> list[dict[str, int]]:
    """The ``name=number`` folders above each ``_SUCCESS`` marker that matches."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = []
    for status in glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []:
        parts = [p.split("=") for p in status.getPath().toString().split("/") if "=" in p]
        found.append({name: int(value) for name, value in parts if value.isdigit()})
    return found


def committed(spark: SparkSession, root: str, table: str) -> list[int]:
    """Ids of the completely written batches, ascending."""
    return sorted(m[BATCH] for m in _markers(spark, f"{root}/{table}/{BATCH}=*"))


def read_batches(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType,
    after: int | None = None,
    upto: int | None = None,
) -> DataFrame:
    """Committed batches with ``after < batch_id <= upto``; only their folders are listed."""
    done = [
        b
        for b in committed(spark, root, table)
        if (after is None or b > after) and (upto is None or b <= upto)
    ]
    full = T.StructType([*schema, T.StructField(BATCH, T.LongType())])
    if not done:
        return spark.createDataFrame([], full)
    paths = [batch_path(root, table, b) for b in done]
    return spark.read.schema(full).option("basePath", f"{root}/{table}").parquet(*paths)


def drop_batches(spark: SparkSession, root: str, table: str, before: int) -> None:
    """Delete the folders of batches below ``before``, which nothing reads any more."""
    for batch_id in committed(spark, root, table):
        if batch_id < before:
            drop_folder(spark, batch_path(root, table, batch_id))


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """Write a small file from the driver; False if it is there already and must not be replaced."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    try:
        stream = fs.create(target, overwrite)
    except Py4JJavaError as error:
        if not overwrite and ("AlreadyExists" in str(error.java_exception) or fs.exists(target)):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, read on the driver; None where there is none."""
    source = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(source):
        return None
    stream = fs.open(source)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_batch(
    spark: SparkSession, root: str, table: str, schema: T.StructType, batch_id: int
) -> DataFrame:
    """One batch, known to be committed."""
    return spark.read.schema(schema).parquet(batch_path(root, table, batch_id))


# --- segments --------------------------------------------------------------------------------------


def _fingerprint(identity: Sequence[str]) -> Column:
    """64 bits of the columns; a hash passes over nulls, so which ones are null goes into it as well."""
    nulls = [F.when(F.isnull(c), F.lit(1 << n).cast("long")).otherwise(0) for n, c in enumerate(identity)]
    return F.xxhash64(*identity, reduce(Column.bitwiseOR, nulls))


def first_copies(rows: DataFrame, identity: Sequence[str], position: str, key: str) -> DataFrame:
    """Of rows that agree in ``key`` and the fingerprint of ``identity`` the one of the earliest batch, by ``position`` in it.

    A reader that needs no other columns shuffles the key and the fingerprint only.
    """
    rest = [c for c in rows.columns if c not in (key, BATCH, position)]
    same = rows.groupBy(key, _fingerprint(identity).alias("_same"))
    found = same.agg(F.min(F.struct(BATCH, position, *rest)).alias("_first"))
    return found.select(*[c if c == key else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def _not_rolled(rows: DataFrame, rolled: DataFrame, identity: Sequence[str], key: str) -> DataFrame:
    """``rows`` without those that a rolled-up row repeats; two are the same if key and 64-bit fingerprint agree."""
    marked = rows.withColumn(MARK, F.xxhash64(*identity))
    same = marked[key].eqNullSafe(rolled[key]) & (marked[MARK] == rolled[MARK])
    return marked.join(rolled, same, "left_anti")


def roll_up(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType,
    sort: Sequence[str],
    identity: Sequence[str],
    position: str,
) -> int | None:
    """Rewrite the batches since the last roll-up into one folder of few, large files, without repeated rows.

    Each row is rewritten once. Its batch id becomes a column. Earlier folders are asked whether they hold a row
    already; the range of the new rows' keys (the first of ``sort``) says which parts of them are read. Batches that an
    earlier roll-up covered are dropped; those of this one stay until the next, for readers that have begun.
    """
    rolled = committed(spark, root, f"rolled/{table}")
    reached = rolled[-1] if rolled else None
    done = committed(spark, root, table)
    if not done or (reached is not None and done[-1] <= reached):
        return reached
    key = sort[0]
    rows = first_copies(read_batches(spark, root, table, schema, after=reached), identity, position, key)
    if rolled:
        ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        before = _rolled(spark, root, table, schema).select(key, MARK)
        if ends["lo"] is not None:
            before = before.filter(F.col(key).isNull() | F.col(key).between(ends["lo"], ends["hi"]))
        rows = _not_rolled(rows, before, identity, key)
    else:
        rows = rows.withColumn(MARK, F.xxhash64(*identity))
    by_key = rows.withColumnRenamed(BATCH, ROLLED).repartitionByRange(*sort).sortWithinPartitions(*sort)
    by_key.write.mode("overwrite").parquet(batch_path(root, f"rolled/{table}", done[-1]))
    if reached is not None:
        drop_batches(spark, root, table, reached + 1)
    return done[-1]


def _rolled(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    stored = T.StructType([*schema, T.StructField(ROLLED, T.LongType()), T.StructField(MARK, T.LongType())])
    return read_batches(spark, root, f"rolled/{table}", stored).drop(BATCH)


def read_all(
    spark: SparkSession, root: str, table: str, schema: T.StructType, identity: Sequence[str], position: str, key: str
) -> DataFrame:
    """Every committed row of a table once: what was rolled up, and what the batches after it add.

    Only the rows of those batches are compared, with each other and with the rolled-up ones.
    """
    rolled = committed(spark, root, f"rolled/{table}")
    rest = read_batches(spark, root, table, schema, after=rolled[-1] if rolled else None)
    rest = first_copies(rest, identity, position, key)
    if not rolled:
        return rest
    large = _rolled(spark, root, table, schema)
    if committed(spark, root, table)[-1] <= rolled[-1]:
        return large.drop(MARK).withColumnRenamed(ROLLED, BATCH)
    rest = _not_rolled(rest, large.select(key, MARK), identity, key).drop(MARK)
    return large.drop(MARK).withColumnRenamed(ROLLED, BATCH).unionByName(rest)
