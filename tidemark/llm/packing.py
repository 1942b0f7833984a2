"""Best-fit packing with certified bin counts.

Documents become runs of token ids; one longer than a sequence is cut into full sequences, its first piece
taking the remainder. Only remainders need packing. They are dealt by hash, or in stretches of a given order, into partitions of
bounded size; each is packed best-fit decreasing and compared with a lower bound from dual feasible functions. A partition
that meets its bound is done but for its emptiest sequence. The others hand the documents of their unfilled sequences to a common pool, which is
dealt anew into fewer, larger partitions and packed again; a round that saves no sequence is not taken.

In order, sequences are numbered by their first document, so that a schedule of sources holds from stretch to stretch of the
sequences as well; the pool is dealt in order too.

Null and empty texts are a single end token. Rows are told apart by their place in the input, so repeated ids are
packed as separate documents. No documents: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, landed, record_batch, schema
from tidemark.llm.tokens import chunk_encoder

CAPACITY = 2048
ITEMS_PER_PARTITION = 20_000
ROUNDS = 4
BINS = 1 << 18  # more than a partition can open; hashing deals out at most a few times ITEMS_PER_PARTITION
PIECES = schema("row_id long, id long, piece int, start long, length long, ids_crc32 long")
PIECES_WITH_IDS = schema("row_id long, id long, piece int, start long, length long, ids_crc32 long, ids array<int>")
PLACED = schema("row_id long, length long, part long, bin long, offset long, closed boolean, saved long, first_row long")
PIECE_SPAN = 1 << 24  # pieces of a document, in the numbers of sequences in order


def cut_points(total: int, capacity: int) -> np.ndarray:
    """Starts of the pieces of ``total`` ids; the first piece takes what does not fill a sequence."""
    first = total % capacity if total > capacity else total
    return np.concatenate([[0], np.arange(first or capacity, total, capacity)]).astype(np.int64)


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        for batch in byte_batches(batches, "text", 4 << 20):
            ids, sizes = encoder.encode_column(batch.column("text"))
            ends = np.cumsum(sizes)
            out: list[list] = [[] for _ in (PIECES_WITH_IDS if with_ids else PIECES)]
            keys = zip(batch.column("row_id").to_pylist(), batch.column("id").to_pylist(), strict=True)
            for (row, key), size, end in zip(keys, sizes.tolist(), ends.tolist(), strict=True):
                own = np.append(ids[end - size : end], np.uint32(end_id)).astype("<u4")
                starts = cut_points(len(own), capacity).tolist()
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True)):
                    values = [row, key, i, a, b - a, zlib.crc32(own[a:b])]
                    for column, value in zip(out, values + [own[a:b].astype(np.int32)] * with_ids, strict=True):
                        column.append(value)
            yield record_batch(PIECES_WITH_IDS if with_ids else PIECES, out)

    return run


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    place_col: str | None = None,
) -> DataFrame:
    """The pieces of every document, with their ids if asked for.

    ``place_col`` holds the documents' places in an order that :func:`pack` is to keep, from 0 without gaps.
    """
    rows = docs.select(
        (F.col(place_col) if place_col else F.monotonically_increasing_id()).alias("row_id"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )
    kind = PIECES_WITH_IDS if with_ids else PIECES
    return rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity, with_ids), kind)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best of two families of dual feasible functions.

    One family rounds items above ``capacity - t`` up to a whole sequence and drops those below ``t``; the
    other rounds multiples of ``1 / (k + 1)`` down.
    """
    if len(lengths) == 0:
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    above = np.cumsum(count[::-1])[::-1]  # items of this length or more
    weight = np.cumsum((count * size)[::-1])[::-1]
    for t in range(capacity // 2 + 1):
        whole = above[capacity - t + 1] if t else 0
        middle = weight[t] - (weight[capacity - t + 1] if t else 0)
        best = max(best, int(whole + -(-middle // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        rounded = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)
        best = max(best, int(-(-int((rounded * count).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the room left in each bin."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some bin has room r
    room_of: list[int] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(room_of)
            room_of.append(capacity)
        bins[item], offsets[item] = at, capacity - room
        room_of[at] = left = room - need
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets, np.asarray(room_of, dtype=np.int64)


def _pack(capacity: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "row_id"], ascending=[False, True], kind="stable")
        lengths = items["length"].to_numpy(np.int64)
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        closed = (room == 0) | (gap == 0)  # certified, or nothing to gain from this sequence
        closed[np.argmax(room)] = room.max() == 0  # a bound per partition rounds up, so its emptiest may still be saved
        first = items["row_id"].groupby(bins).transform("min")
        return items.assign(bin=bins, offset=offsets, closed=closed[bins], saved=gap, first_row=first)[PLACED.fieldNames()]

    return run


def _dealt(items: DataFrame, parts: int, round_no: int) -> DataFrame:
    part = F.pmod(F.xxhash64("row_id", F.lit(round_no)), F.lit(parts)) + round_no * (1 << 40)
    return items.select("row_id", "length", part.alias("part"))


def _dealt_in_order(open_items: DataFrame, larger: int, round_no: int) -> DataFrame:
    """Neighbouring partitions together, until they hold ``larger`` items."""
    counts = open_items.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / larger) + round_no * (1 << 40)
    joined = open_items.select("row_id", "length", "part").join(counts.select("part", part.alias("_to")), "part")
    return joined.select("row_id", "length", F.col("_to").alias("part"))


def pack_items(items: DataFrame, capacity: int, per_partition: int, rounds: int, in_order: bool = False) -> DataFrame:
    """Place items (``row_id``, ``length`` up to ``capacity``): ``part`` and ``bin`` name the sequence, and ``offset``.

    ``first_row`` is the smallest ``row_id`` in the sequence.
    """
    if per_partition > BINS // 8:
        raise ValueError(f"per_partition can be {BINS // 8} at most")
    done: list[DataFrame] = []
    if in_order:
        dealt = items.select("row_id", "length", F.expr(f"row_id div {per_partition}").alias("part"))
    else:
        dealt = _dealt(items, -(-items.count() // per_partition) or 1, 0)
    placed = landed(dealt.groupBy("part").applyInPandas(_pack(capacity), PLACED), "packed")
    for round_no in range(1, rounds + 1):
        open_items = placed.filter(~F.col("closed"))
        old = open_items.agg(F.count_distinct("part", "bin"), F.count("*"), F.sum("length")).first()
        if not old[0] or old[0] <= -(-old[2] // capacity):
            break  # certified: no packing of the pool needs fewer
        larger = min(per_partition << round_no, BINS // 8)  # a wider choice of partners, still bounded
        if in_order:
            dealt = _dealt_in_order(open_items, larger, round_no)
        else:
            dealt = _dealt(open_items, -(-old[1] // larger) or 1, round_no)
        again = landed(dealt.groupBy("part").applyInPandas(_pack(capacity), PLACED), "packed")
        if again.agg(F.count_distinct("part", "bin")).first()[0] >= old[0]:
            continue
        done.append(placed.filter("closed"))
        placed = again
    for more in done:
        placed = placed.unionByName(more)
    return placed.select("row_id", "part", "bin", "offset", "first_row")


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    per_partition: int = ITEMS_PER_PARTITION,
    rounds: int = ROUNDS,
    in_order: bool = False,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``. A piece that fills a sequence has it to itself.

    With ``in_order`` the pieces' ``row_id`` is a place in an order: stretches of ``per_partition`` documents are packed
    together, and ascending ``sequence_id`` follows the order.
    """
    pieces = landed(pieces, "pieces")
    items = pieces.filter(F.col("length") < capacity).select("row_id", "length")  # one per document at most
    placed = pack_items(items, capacity, per_partition, rounds, in_order)
    name = F.col("first_row") * PIECE_SPAN if in_order else F.col("part") * BINS + F.col("bin")
    placed = placed.select("row_id", name.alias("sequence_id"), "offset")
    fitted = pieces.filter(F.col("length") < capacity).join(placed, "row_id")
    alone = F.col("row_id") * PIECE_SPAN + F.col("piece") if in_order else -1 - F.monotonically_increasing_id()
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": alone, "offset": F.lit(0).cast("long")})
    return fitted.unionByName(full)


def global_bound(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """Lower bound over all pieces, from the counts per length (at most ``capacity`` rows)."""
    counts = pieces.groupBy("length").count().collect()
    lengths = np.repeat([r["length"] for r in counts], [r["count"] for r in counts]).astype(np.int64)
    return lower_bound(lengths, capacity)
