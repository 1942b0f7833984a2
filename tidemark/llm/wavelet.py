"""Token files: one wavelet matrix per shard, which answers access, counting and occurrence lookup.

A shard holds the ids of consecutive documents as bit planes, highest bit first; each plane keeps the order that
sorting by the higher bits gives. A directory of set bits per block, stored beside each plane, makes rank a table look-up and a
population count, so that opening a shard reads no plane. There are as many planes as the largest id of the vocabulary needs. Shards are rows of a Parquet folder (Spark's writer, so any store works); the bytes of one shard are self-contained.

Documents are in ascending order of id (nulls first, ties by text). Null and empty texts hold the end id only. A
document never spans shards, so a shard is as large as its target or its largest document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, record_batch, schema, tasks
from tidemark.llm.tokens import chunk_encoder

MAGIC = b"WMX2"
BLOCK = 512  # bits per entry of the directory
SHARD_TOKENS = 1 << 20
CACHED_CHUNKS = 1_000_000  # a worker that writes holds little else
SHARDS = schema("part long, shard long, first_id long, n_docs long, n_tokens long, payload binary")
DOCUMENTS = schema("part long, shard long, id long, start_in_shard long, n_tokens long, ids_crc32 long")
FOUND = schema("part long, shard long, id long, position long")


def _narrow(levels: int) -> type:
    return np.uint16 if levels <= 16 else np.uint32


class WaveletMatrix:
    """``n`` numbers below ``2 ** levels`` as bit planes with rank support."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        bits = np.bitwise_count(plane.view("<u8")).astype(np.int64)
        per_block = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK // 64)) if len(bits) else bits
        return np.concatenate([[0], np.cumsum(per_block)]).astype("<i8")

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, zeros = [], []
        if len(ids) and int(ids.max()) >> levels:
            raise ValueError(f"id {int(ids.max())} needs more than {levels} planes")
        order = ids.astype(_narrow(levels))
        for level in range(levels - 1, -1, -1):
            bits = (order >> level & 1).astype(np.uint8)
            packed = np.packbits(bits, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, dtype=np.uint8)]))
            zeros.append(len(bits) - int(np.count_nonzero(bits)))
            order = order[np.argsort(bits, kind="stable")]  # bytes are sorted by counting
        return cls(len(ids), planes, zeros, [cls._directory(p) for p in planes])

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QI", self.n, len(self.planes)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        return head + b"".join(r.tobytes() + p.tobytes() for r, p in zip(self.ranks, self.planes, strict=True))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, levels = struct.unpack_from("<QI", data, 4)
        zeros = list(struct.unpack_from(f"<{levels}Q", data, 16))
        size, blocks, at = -(-n // 64) * 8, -(-n // BLOCK) + 1, 16 + 8 * levels
        step = 8 * blocks + size
        ranks = [np.frombuffer(data, dtype="<i8", count=blocks, offset=at + i * step) for i in range(levels)]
        planes = [np.frombuffer(data, dtype=np.uint8, count=size, offset=at + i * step + 8 * blocks) for i in range(levels)]
        return cls(n, planes, zeros, ranks)

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a plane before place ``i``."""
        block = i // BLOCK
        rest = np.unpackbits(self.planes[level][block * BLOCK // 8 : (i + 7) // 8], bitorder="little")
        return int(self.ranks[level][block]) + int(rest[: i - block * BLOCK].sum())

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` among places ``begin`` to ``end`` lie below the last plane."""
        if value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, begin), self._ones(level, end)
            if value >> (len(self.planes) - 1 - level) & 1:
                begin, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before place ``i``."""
        begin, end = self._range(value, 0, i)
        return end - begin

    def select(self, value: int, k: int) -> int:
        """Place of occurrence number ``k`` (from 0) of ``value``."""
        begin, end = self._range(value, 0, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        place = begin + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - level) & 1
            place = self._nth(level, place - self.zeros[level] if one else place, one)
        return place

    def _nth(self, level: int, k: int, bit: int) -> int:
        """Place of set (or clear) bit number ``k`` of a plane."""
        ranks = self.ranks[level]
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All numbers, undoing the sort of one plane at a time."""
        kind = _narrow(len(self.planes))
        values = np.zeros(self.n, dtype=kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little")
            order = np.empty(self.n, dtype=kind)
            order[np.flatnonzero(bits == 0)] = values[: self.zeros[level]]
            order[np.flatnonzero(bits)] = values[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            values = order
        return values.astype(np.uint32)


def shard_bytes(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    """Documents' ids (with a mark for nulls) and lengths, compressed, before the matrix."""
    table = doc_ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + lengths.astype("<i8").tobytes()
    packed = zlib.compress(table)
    return struct.pack("<QQ", len(doc_ids), len(packed)) + packed + matrix.to_bytes()


def open_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    count, size = struct.unpack_from("<QQ", data)
    table = zlib.decompress(data[16 : 16 + size])
    doc_ids = np.frombuffer(table, dtype="<i8", count=count)
    known = np.frombuffer(table, dtype=np.uint8, count=count, offset=8 * count).astype(bool)
    lengths = np.frombuffer(table, dtype="<i8", count=count, offset=9 * count)
    return doc_ids, known, lengths, WaveletMatrix.from_bytes(data[16 + size :])


def _write(path: str, end_id: int, levels: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = chunk_encoder(path, CACHED_CHUNKS), TaskContext.get().partitionId()
        shard, held = 0, 0
        ids: list[np.ndarray] = []
        keys: list = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            known = np.array([k is not None for k in keys], dtype=bool)
            doc_ids = np.array([0 if k is None else k for k in keys], dtype=np.int64)
            matrix = WaveletMatrix.build(np.concatenate(ids), levels)
            data = shard_bytes(doc_ids, known, np.concatenate(lengths), matrix)
            return record_batch(SHARDS, [[part], [shard], [keys[0]], [len(keys)], [matrix.n], [data]])

        for batch in byte_batches(batches, "text", 2 << 20):
            flat, sizes = encoder.encode_column(batch.column("text"))
            ends = np.cumsum(sizes)
            ids.append(np.insert(flat, ends, np.uint32(end_id)))
            keys += batch.column("id").to_pylist()
            lengths.append(sizes + 1)
            held += len(ids[-1])
            if held >= shard_tokens:
                yield close()
                shard, held, ids, keys, lengths = shard + 1, 0, [], [], []
        if keys:
            yield close()

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    levels: int | None = None,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all documents, in ascending order of document id, as shards below ``folder``.

    ``levels``, the number of bit planes, follows from the vocabulary and ``end_id``; a given number that is too small is an error.
    """
    needed = max(end_id, chunk_encoder(tokenizer_path).largest_id()).bit_length()
    if levels is not None and levels < needed:
        raise ValueError(f"the vocabulary needs {needed} planes")
    levels = levels or needed
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(4 * tasks(docs.sparkSession), "id").sortWithinPartitions("id", "text")
    shards = dealt.mapInArrow(_write(tokenizer_path, end_id, levels, shard_tokens), SHARDS)
    shards.write.parquet(folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(folder)


def shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard: sums per part, then within a part, so that no task sees all shards."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    own = shards.select("part", "shard", F.coalesce(inside, F.lit(0)).alias("inside"))
    return own.join(parts, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("shard_start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            doc_ids, known, lengths, matrix = open_shard(row["payload"])
            ids = matrix.decode().astype("<u4")
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            n = len(doc_ids)
            keys = pa.array(doc_ids, mask=~known)
            yield record_batch(DOCUMENTS, [[row["part"]] * n, [row["shard"]] * n, keys, ends - lengths, lengths, crc])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, decoded from the files: ``id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    stored = shards(spark, folder)
    documents = stored.select("payload", "part", "shard").mapInArrow(_read, DOCUMENTS)
    starts = shard_starts(stored.select("part", "shard", "n_tokens"))
    start = F.col("shard_start") + F.col("start_in_shard")
    return documents.join(starts, ["part", "shard"]).select("id", start.alias("start"), "n_tokens", "ids_crc32")


def _find(token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, known, lengths, matrix = open_shard(row["payload"])
                places = np.array([matrix.select(token, k) for k in range(matrix.rank(token, matrix.n))], dtype=np.int64)
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, places, side="right")
                position = places - (ends - lengths)[doc]
                keys = pa.array(doc_ids[doc], mask=~known[doc])
                yield record_batch(FOUND, [[row["part"]] * len(doc), [row["shard"]] * len(doc), keys, position])

    return run


def find_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """Every occurrence of ``token``: document and position in it. Only planes are touched, nothing is decoded."""
    return shards(spark, folder).select("payload", "part", "shard").mapInArrow(_find(token), FOUND)


def count_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """Occurrences of ``token`` per shard, from rank alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = open_shard(row["payload"])[3]
                yield record_batch(kind, [[row["part"]], [row["shard"]], [matrix.rank(token, matrix.n)]])

    kind = schema("part long, shard long, n long")
    return shards(spark, folder).select("payload", "part", "shard").mapInArrow(run, kind)
