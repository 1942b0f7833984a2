"""Repeated passages: every word covered by a long word window that occurs earlier is removed.

Anchors, short windows hashed only at positions of a difference cover modulo ``PERIOD``, are the index. For any two positions
there is a step below the period that leads from both to cover positions, so two equal long windows share an anchor at the same
place. Anchors that occur twice are extended: the long windows around them are hashed, and a window goes unless it is the
first with its words. Every task first settles what it sees itself: of anchors or windows with equal words one row per batch is
left, and of those a task remembers what comes again (``Memory``), so a passage that a third of all documents share meets in
about one row per task. What a task forgets is shuffled as any other row: the memory changes what moves, not the result.

Words are runs of non-white-space bytes, unchanged. Null and empty texts have none. A null id comes first. Ids should be
unique: rows that repeat an id count as one document, so their windows are not removed for each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, landed, record_batch, schema, text_or_empty
from tidemark.llm.words import (
    U64,
    WORDS_2,
    byte_values,
    mixed,
    span_hashes,
    text_buffer,
    window_hashes,
    word_spans,
)

WINDOW = 20
# A perfect difference set; every step from 1 to 12 is a difference of two of them modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
WORK_BYTES = 2 << 20  # text hashed at once; the arrays take some 50 times as much
REMEMBERED = 1 << 19  # places in a task's memory, some 30 bytes each
SLOTS = 1 << 20  # bounds what is broadcast to spare documents without repeats a shuffle
NULL_ID = -(1 << 63)
ANCHORS = schema("deal long, id long, position int, settled boolean")
WINDOWS = schema("deal long, check long, id long, start int, settled boolean")
RESULT = schema("id long, n_words long, n_removed long, kept string, kept_sha256 string")
VALUES, VALUES_2 = byte_values(31), byte_values(32)
IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _layout(borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its text, its place in the text and the text's number of words."""
    size = np.diff(borders)
    text = np.repeat(np.arange(len(size)), size)
    return text, np.arange(borders[-1]) - borders[text], size[text]


class Memory:
    """Rows a task has shuffled lately, by key, in bounded room: a key keeps its place while it returns more often than others come by."""

    def __init__(self, places: int = REMEMBERED) -> None:
        self.key = np.zeros(places, dtype=U64)
        self.check = np.zeros(places, dtype=U64)
        self.id, self.start = np.zeros(places, dtype=np.int64), np.zeros(places, dtype=np.int32)
        self.worth = np.zeros(places, dtype=np.int8)  # 0: free
        self.again = np.zeros(places, dtype=bool)  # the key came again

    def recall(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether the key holds it; no key may be given twice."""
        place = (keys % U64(len(self.key))).astype(np.int64)
        known = (self.worth[place] > 0) & (self.key[place] == keys) & (self.check[place] == checks)
        self.worth[place[known]] = np.minimum(self.worth[place[known]] + 2, 100)
        self.worth[place[~known]] = np.maximum(self.worth[place[~known]] - 1, 0)
        return place, known

    def keep(self, place: np.ndarray, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        """Remember rows whose places are free; of several for one place, one."""
        free = np.flatnonzero(self.worth[place] == 0)
        place, first = np.unique(place[free], return_index=True)
        rows = free[first]
        self.key[place], self.check[place], self.id[place], self.start[place] = keys[rows], checks[rows], ids[rows], starts[rows]
        self.worth[place], self.again[place] = 1, False


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(window: int):
    anchor = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in byte_batches(batches, "text", WORK_BYTES):
            data, borders = text_buffer(batch.column("text"))
            if not len(data):
                continue
            starts, ends, before = word_spans(data, borders)
            hashes = window_hashes(span_hashes(data, starts, ends, VALUES), anchor)
            text, place, size = _layout(before)
            usable = (size >= window) & (place <= size - anchor) & IN_COVER[place % PERIOD]
            at = np.flatnonzero(usable)
            keys = hashes[at]
            _, first, group, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            settled = times[group] > 1
            other = np.ones(len(at), dtype=bool)
            other[first] = False  # seen to be repeated here, and represented by the first of its kind
            ids, position = _ids(batch)[text[at]], place[at]
            slot, known = memory.recall(keys[first], keys[first])
            new, old = first[~known], slot[known]
            other[first[known]] = settled[first[known]] = True  # represented by a row of an earlier batch,
            told = old[~memory.again[old]]  # which is now seen to be repeated
            memory.again[old] = True
            told_ids, told_positions = memory.id[told], memory.start[told]
            memory.keep(slot[~known], keys[new], keys[new], ids[new], position[new])
            keys[other] = mixed(ids[other].astype(U64))  # dealt out by document
            keys = np.concatenate([keys, mixed(told_ids.astype(U64))])
            settled = np.concatenate([settled, np.ones(len(told), dtype=bool)])
            ids, position = np.concatenate([ids, told_ids]), np.concatenate([position, told_positions])
            yield record_batch(ANCHORS, [(keys >> U64(16)).view(np.int64), ids, position, settled])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in byte_batches(batches, "text", WORK_BYTES):
            data, borders = text_buffer(batch.column("text"))
            if not len(data):
                continue
            starts, ends, before = word_spans(data, borders)
            text, place, size = _layout(before)
            marked = np.zeros(len(place) + 1, dtype=np.int64)
            lists = batch.column("positions")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = before[owner] + lists.flatten().to_numpy()
            at = at[at < before[owner + 1]]
            # A window is of interest if an anchor begins at one of its first PERIOD words.
            np.add.at(marked, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(marked, at + 1, -1)
            chosen = np.flatnonzero((np.cumsum(marked[:-1]) > 0) & (place <= size - window))
            if not len(chosen):
                continue
            keys = window_hashes(span_hashes(data, starts, ends, VALUES), window)[chosen]
            checks = window_hashes(span_hashes(data, starts, ends, VALUES_2), window, WORDS_2)[chosen]
            ids, start = _ids(batch)[text[chosen]], place[chosen]
            order = np.lexsort((start, ids, checks, keys))
            keys, checks, ids, start = keys[order], checks[order], ids[order], start[order]
            same = (keys[1:] == keys[:-1]) & (checks[1:] == checks[:-1])
            leads = np.concatenate([[True], ~same])
            of = np.maximum.accumulate(np.where(leads, np.arange(len(keys)), 0))
            settled = (ids > ids[of]) | (start > start[of])
            again = ~leads & ~settled  # the same place of a repeated id
            lead = np.flatnonzero(leads)
            slot, known = memory.recall(keys[lead], checks[lead])
            at_id, at_start = memory.id[slot], memory.start[slot]
            later = known & ((ids[lead] > at_id) | ((ids[lead] == at_id) & (start[lead] > at_start)))
            earlier = known & ((ids[lead] < at_id) | ((ids[lead] == at_id) & (start[lead] < at_start)))
            memory.id[slot[earlier]], memory.start[slot[earlier]] = ids[lead[earlier]], start[lead[earlier]]
            new = lead[~known]
            memory.keep(slot[~known], keys[new], checks[new], ids[new], start[new])
            settled[lead[later]] = True  # a row of an earlier batch comes before it
            keys[settled], checks[settled] = mixed(ids[settled].astype(U64)), U64(0)  # dealt out by document
            keep = ~again
            yield record_batch(
                WINDOWS, [keys.view(np.int64)[keep], checks.view(np.int64)[keep], ids[keep], start[keep], settled[keep]]
            )

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            out: list[list] = [[], [], [], []]
            repeats = batch.column("starts").to_pylist() if "starts" in batch.schema.names else [None] * batch.num_rows
            for text, starts in zip(batch.column("text").to_pylist(), repeats, strict=True):
                words = text.encode().split()
                n = len(words)
                if starts:
                    begin = np.asarray(starts)
                    begin = begin[begin <= n - window]
                    cover = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + window, -1)
                    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()
                    words = [words[i] for i in kept]
                whole = b" ".join(words)
                values = [n, n - len(words), whole.decode(), hashlib.sha256(whole).hexdigest()]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield record_batch(RESULT, [batch.column("id"), *out])

    return run


def _slot() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("slot")


def _in_slots(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows that may (``left_semi``) or can not (``left_anti``) have one of ``ids``; at most ``SLOTS`` numbers are broadcast."""
    slots = ids.select(_slot()).distinct()
    return rows.join(F.broadcast(slots), _slot_of(rows) == slots["slot"], how)


def _slot_of(rows: DataFrame) -> Column:
    return F.pmod(F.xxhash64(rows["id"]), F.lit(SLOTS))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by a space), its digest."""
    if window < PERIOD:
        raise ValueError(f"a window must have {PERIOD} words at least")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), text_or_empty(text_col).alias("text")
    )
    anchors = rows.mapInArrow(_anchors(window), ANCHORS)
    times = F.count(F.lit(1)).over(Window.partitionBy("deal"))
    shared = anchors.withColumn("times", times).filter("settled OR times > 1").groupBy("id")
    shared = landed(shared.agg(F.collect_list("position").alias("positions")), "anchors")

    near = _in_slots(rows, shared, "left_semi").join(shared, "id")
    windows = near.mapInArrow(_windows(window), WINDOWS)
    first = F.min(F.struct("id", "start")).over(Window.partitionBy("deal", "check"))
    repeated = windows.withColumn("first", first)
    later = F.col("settled") | (F.col("first.id") < F.col("id")) | (F.col("first.start") < F.col("start"))
    repeated = landed(repeated.filter(later).groupBy("id").agg(F.collect_list("start").alias("starts")), "windows")

    untouched = _in_slots(rows, repeated, "left_anti").mapInArrow(_remove(window), RESULT)
    touched = _in_slots(rows, repeated, "left_semi").join(repeated, "id", "left").mapInArrow(_remove(window), RESULT)
    found = untouched.unionByName(touched)
    return found.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))
